"""Snapshots over time: adding, replacing and deleting documents, second passes, grafts, jobs (CMP-5..7, GRF-11, GRF-12, GRF-14, GRF-15, REL-3, REL-15, STR-2, STR-4, STR-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import strip
from ..sources.files import write_snapshot
from . import graph as G
from .filters import references
from .relations import candidates_in_passage

PASSAGE_CHARS = 200


def add_document(existing: DataFrame, new: DataFrame) -> DataFrame:
    """CMP-5 and STR-6: the records after a run over some documents: their earlier records are replaced, all others stay as they are.

    Documents of the run without any new record keep what they have: a run that gave nothing never deletes.
    """
    docs = new.where("doc_id is not null").select("doc_id").distinct()
    return existing.join(docs, "doc_id", "left_anti").unionByName(new.select(*existing.columns))


def belongs(doc: Column, wanted: Column) -> Column:
    """GRF-11: a record is a document's by path or by file name, however its slashes are written."""
    d, w = F.replace(doc, F.lit("\\"), F.lit("/")), F.replace(wanted, F.lit("\\"), F.lit("/"))
    return (d == w) | (F.substring_index(d, "/", -1) == F.substring_index(w, "/", -1))


def source_keys(source: Column) -> Column:
    """JON-15: what a provenance may be looked up by: itself and every beginning of it before a `:` or `/`."""
    s = F.replace(source, F.lit("\\"), F.lit("/"))
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.substr(s, i, F.lit(1)).isin(":", "/"))
    return F.array_distinct(F.concat(F.array(s), F.transform(ends, lambda i: F.substr(s, F.lit(1), i - 1))))


def document_edges(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """JON-15: (src, dst, edge_type, doc_id): the documents that an edge's provenance points at: the document's path or file name, alone or before `:` or `/`."""
    keys = edges.where("source is not null").select("src", "dst", "edge_type", F.explode(source_keys(F.col("source"))).alias("k")).where("k <> ''")
    d = docs.where("doc_id is not null").select("doc_id").distinct().withColumn("p", F.replace("doc_id", F.lit("\\"), F.lit("/")))
    d = d.select("doc_id", F.explode(F.array_distinct(F.array("p", F.substring_index("p", "/", -1)))).alias("k"))
    return keys.join(d, "k").select("src", "dst", "edge_type", "doc_id").distinct()


def delete_end_to_end(records: DataFrame, doc: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """GRF-11: (records, concepts, edges) of the next snapshot without a document: its records go, and what only they said."""
    kept = records.where(F.col("doc_id").isNull() | ~belongs(F.col("doc_id"), F.lit(doc)))
    n, e = G.nodes(records), G.edges(records)
    said = kept.where("trim(coalesce(concept_name, '')) <> ''").select(G.concept_id(F.col("concept_name")).alias("id"), "doc_id")
    n2, e2 = G.delete_document(n, e, said, doc)
    # an edge whose end is gone goes too
    ids = n2.select("id")
    e2 = e2.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return kept, n2, e2.select("src", "dst", "edge_type", "relation", "source")


def records_from_graph(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """CMP-7: one record per concept and source (id, doc_id, chunk_id, page_number, section_title) rebuilt from a graph; blanks take their defaults."""
    d = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return nodes.join(sources.distinct(), "id").select(
        F.coalesce("name", "id").alias("concept_name"), d("concept_type", "definition"), d("difficulty", "intermediate"), d("summary", ""), d("doc_id", ""), d("chunk_id", ""), d("page_number", 0), d("section_title", ""),
    )


def second_pass(records: DataFrame, proposer=None, cap: int = 8) -> DataFrame:
    """REL-3: (rec_id, kind, target, relation): relations that a second look at the passages adds, beyond those that a record has.

    Passages of over PASSAGE_CHARS characters with candidates (names of other records in them, the longest first, at most `cap`) are given to
    `proposer(records, candidates)`, the seam for a model; what it names must be a candidate. The default takes what the passage says with words
    of requiring or unlocking right before a candidate.
    """
    long_ = records.where(F.length(F.coalesce("source_passage", F.lit(""))) > PASSAGE_CHARS)
    names = records.where("trim(coalesce(concept_name, '')) <> ''").select(strip(F.col("concept_name")).alias("name")).distinct()
    c = candidates_in_passage(long_, names, cap)
    found = (proposer or stated_relations)(long_, c).join(c.select("rec_id", F.col("name").alias("target")), ["rec_id", "target"], "left_semi")
    have = references(records).where("target is not null").select("rec_id", "kind", F.lower("target").alias("t")).distinct()
    return found.withColumn("t", F.lower("target")).join(have, ["rec_id", "kind", "t"], "left_anti").select("rec_id", "kind", "target", "relation").distinct()


def stated_relations(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """(rec_id, kind, target, relation): candidates that follow words of requiring or unlocking in the passage."""
    j = records.select("rec_id", F.lower("source_passage").alias("p")).join(candidates, "rec_id")
    at = F.call_function("instr", F.col("p"), F.lower("name"))
    before = F.when(at > 1, F.substr(F.col("p"), F.greatest(at - 40, F.lit(1)), F.least(at - 1, F.lit(40)))).otherwise("")
    j = j.withColumn("b", before)
    kind = F.when(F.col("b").rlike(r"\b(?:requires?|needs?|builds on|depends on|based on)\b[^.!?]*$"), "prereq").when(F.col("b").rlike(r"\b(?:enables?|unlocks?|leads to|allows?)\b[^.!?]*$"), "unlock")
    j = j.withColumn("kind", kind).where("kind is not null")
    return j.select("rec_id", "kind", F.col("name").alias("target"), F.when(F.col("kind") == "prereq", "requires").otherwise("enables").alias("relation"))


def graft(records: DataFrame, donor: DataFrame) -> DataFrame:
    """REL-15: (name, kind, target, relation): relations of another extraction between concepts that both are in this one's inventory, and that it lacks.

    Names are compared in lower case and without blanks at the ends; a relation counts once.
    """
    key = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    mine = records.select(key(F.col("concept_name")).alias("k")).where("k <> ''").distinct()
    have = references(records).select(key(F.col("concept_name")).alias("name"), "kind", key(F.col("target")).alias("target")).distinct()
    d = references(donor).select(key(F.col("concept_name")).alias("name"), "kind", key(F.col("target")).alias("target"), "relation").where("name <> '' and target <> '' and name <> target")
    d = d.join(mine.toDF("name"), "name", "left_semi").join(mine.toDF("target"), "target", "left_semi").join(have, ["name", "kind", "target"], "left_anti")
    return d.groupBy("name", "kind", "target").agg(F.min("relation").alias("relation"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """GRF-12: a table after rows have been written over it by key: of several for a key the last by `order` holds, fields that it leaves null keep their old value."""
    rest = [c for c in table.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rest]), order).alias("__n"))
    old = table.select(*keys, F.struct(*rest).alias("__o"))
    return old.join(last, keys, "full").select(*keys, *[F.coalesce(F.col("__n")[c], F.col("__o")[c]).alias(c) for c in rest])


def migrate(table: DataFrame, schema: StructType) -> DataFrame:
    """GRF-14: a table in a wider schema: columns that it lacks are added as nulls, those that it has are cast, none is lost."""
    have = set(table.columns)
    wanted = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return table.select(*wanted, *[c for c in table.columns if c not in {f.name for f in schema.fields}])


def loose_match(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """GRF-15: (target, id): the concept that a freely written target means: the same name, else the first (by name) that holds it or is held by it, else the
    first with the same first word. Names meet over their words, so a target shares a whole word with what it is matched to.
    """
    t = refs.select(F.lower(strip(F.col("target"))).alias("target")).where("target <> ''").distinct()
    n = nodes.select("id", F.lower(strip(F.col("name"))).alias("name")).where("name <> ''")
    ws = lambda df, c: df.withColumn("w", F.explode(F.array_distinct(F.split(c, r"\s+"))))
    j = ws(t, "target").join(ws(n, "name"), "w").select("target", "id", "name").distinct()
    padded = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"\s+", " "), F.lit(" "))
    rank = F.when(F.col("target") == F.col("name"), 1).when(F.contains(padded("name"), padded("target")) | F.contains(padded("target"), padded("name")), 2).when(F.element_at(F.split("target", r"\s+"), 1) == F.element_at(F.split("name", r"\s+"), 1), 3)
    j = j.withColumn("rank", rank).where("rank is not null")
    return j.groupBy("target").agg(F.min(F.struct("rank", "name", "id")).alias("b")).select("target", F.col("b.id").alias("id"), F.col("b.rank").alias("rank"))


def publish(spark: SparkSession, root: str, version: int, records: DataFrame, jobs: DataFrame) -> DataFrame:
    """STR-4: stages the snapshot of `records` beside the current one, checks it, and only then turns the pointer: (version, concepts, edges, self_edges, accepted).

    A snapshot without concepts or with self edges is refused and the pointer stays, so readers keep the last good version. `jobs` are kept with the version.
    """
    n, e = G.nodes(records), G.edges(records)
    stage = f"{root}/stage-{version}"
    for name, df in (("concepts", n), ("edges", e), ("jobs", jobs)):
        df.write.mode("overwrite").parquet(f"{stage}/{name}")
    n, e, j = (spark.read.parquet(f"{stage}/{x}") for x in ("concepts", "edges", "jobs"))
    counts = n.agg(F.count(F.lit(1)).alias("concepts")).crossJoin(e.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("self_edges")))  # one row each
    row = counts.first()
    accepted = row.concepts > 0 and row.self_edges == 0
    if accepted:
        write_snapshot({"concepts": n, "edges": e, "jobs": j}, root, version)
    return spark.createDataFrame([(version, row.concepts, row.edges, row.self_edges, accepted)], "version int, concepts bigint, edges bigint, self_edges bigint, accepted boolean")


def merged_jobs(jobs: DataFrame) -> DataFrame:
    """STR-2: (job_id, status, cancelled, stages): the last status of a job, whether any record asked to cancel it, and its progress merged by stage (the later record wins)."""
    at = F.coalesce("updated_at", "created_at")
    p = jobs.select("job_id", at.alias("at"), F.explode("progress").alias("stage", "p")).groupBy("job_id", "stage").agg(F.max(F.struct("at", "p.pct", "p.detail")).alias("r"))
    p = p.groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "stage", F.col("r.pct").cast("string")))), ",").alias("stages"))  # a job has few stages
    last = jobs.groupBy("job_id").agg(F.max(F.struct(at.alias("at"), F.lower(F.trim("status")).alias("status"))).alias("r"), F.bool_or(F.coalesce("cancelled", F.lit(False))).alias("cancelled"))
    return last.join(p, "job_id", "left").select("job_id", "r.status", "cancelled", F.coalesce("stages", F.lit("")).alias("stages"))

