"""Remaining projections, exports, routes, payloads and training rows (PRJ-4, PRJ-5, CAN-13, CAN-14, EVL-7, GRF-6, RTE-6, CIT-14, CIT-15, LIB-3, TRN-9, TRN-18, TRN-30, EXT-4, EXT-5, EXT-7)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.fuzzy import token_set_ratio
from ..functions.names import acronym, aliases, canonical_name
from ..functions.text import strip
from .chunking import chunk_kind
from .dataset import DIFFICULTIES, TYPES
from .filters import RELATIONS, is_bibliography
from .graph import orphans
from .relations import mentions

# Aliases too general to name a concept, and acronyms that are words.
GENERIC_ALIASES = (
    "of", "for", "and", "or", "the", "a", "an", "in", "on", "at", "to", "from", "by", "with", "is", "it", "that", "this", "are", "was", "be", "model", "models", "network", "networks", "data", "system", "systems", "learning", "training", "method",
    "methods", "analysis", "function", "functions", "value", "values",
)
WORD_ACRONYMS = ("IS", "IT", "OF", "FOR", "AND", "OR", "THE", "AN", "IN", "ON", "AT", "TO", "BY")


def normal_related(records: DataFrame) -> DataFrame:
    """PRJ-4: (rec_id, relation, pos, concept): unknown relations become `uses`; each concept and relation once, the first place wins."""
    x = records.select("rec_id", F.posexplode("related_to").alias("pos", "r")).where(strip(F.coalesce("r.concept", F.lit(""))) != "")
    rel = F.lower(F.trim("r.relation"))
    y = x.select("rec_id", "pos", strip(F.col("r.concept")).alias("concept"), F.when(rel.isin(*RELATIONS), rel).otherwise("uses").alias("relation"))
    return y.groupBy("rec_id", "relation", F.lower("concept").alias("__k")).agg(F.min("pos").alias("pos"), F.min_by("concept", "pos").alias("concept")).drop("__k")


def normal_records(records: DataFrame) -> DataFrame:
    """PRJ-5: types and levels outside the vocabulary get the default; tags as slugs."""
    t, d = F.lower(F.trim("concept_type")), F.lower(F.trim("difficulty"))
    tags = F.transform(F.filter("tags", lambda x: x.isNotNull()), lambda x: F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"))
    return records.select("rec_id", F.when(t.isin(*TYPES), t).otherwise("definition").alias("concept_type"), F.when(d.isin(*DIFFICULTIES), d).otherwise("intermediate").alias("difficulty"), F.coalesce(F.array_join(tags, " "), F.lit("")).alias("tags"))


def query_acronym(c: Column) -> Column:
    """CAN-13: as the index's acronym, but none that is a common word."""
    a = acronym(c)
    return F.when(a.isin(*WORD_ACRONYMS), "").otherwise(a)


def query_aliases(c: Column) -> Column:
    """CAN-14: aliases without general words, unless they are the name itself."""
    own = F.lower(F.trim(c))
    return F.filter(aliases(c), lambda a: (a == own) | ~a.isin(*GENERIC_ALIASES))


def gates(n: DataFrame, e: DataFrame) -> DataFrame:
    """EVL-7: (gate, value, passed) of the size, orphan and self-edge thresholds."""
    total = n.agg(F.count(F.lit(1)).cast("double").alias("n"))
    lost = orphans(n, e).agg(F.count(F.lit(1)).cast("double").alias("o"))
    links = e.agg(F.count(F.lit(1)).cast("double").alias("e"), F.count_if(F.col("src") == F.col("dst")).cast("double").alias("s"))
    j = total.crossJoin(lost).crossJoin(links)  # one row each
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), v.alias("value"), F.lit(a).alias("least"), F.lit(b).alias("most")) for g, v, a, b in (
        ("concepts", F.col("n"), 80.0, 1e12), ("edges", F.col("e"), 80.0, 1e12), ("orphan_share", F.col("o") / F.col("n"), 0.0, 0.6), ("self_edges", F.col("s"), 0.0, 0.0))])
    return j.select(F.explode(rows).alias("r")).select("r.gate", F.round("r.value", 6).alias("value"), F.col("r.value").between(F.col("r.least"), F.col("r.most")).alias("passed"))


def edge_provenance(e: DataFrame) -> DataFrame:
    """GRF-6: the provenance of a pair from its strongest edge: REQUIRES, UNLOCKS, RELATED."""
    rank = F.when(F.col("edge_type") == "REQUIRES", 1).when(F.col("edge_type") == "UNLOCKS", 2).otherwise(3)
    return e.groupBy("src", "dst").agg(F.min_by("source", rank).alias("source"))


def active_concept(m: DataFrame, conversation: str, turn: str) -> DataFrame:
    """RTE-6 and WIN-12: the longest concept of the newest turn of a conversation that names one."""
    return m.groupBy(conversation).agg(F.max_by("id", F.struct(F.col(turn), F.length("id"), F.col("id"))).alias("concept"))


def learning_paths(n: DataFrame, e: DataFrame) -> DataFrame:
    """CIT-14 and CIT-15: `prerequisites -> concept -> unlocks` of each concept, at most three names on a side, in order of the alphabet."""
    def side(kind: str, out: str) -> DataFrame:
        w = Window.partitionBy("src").orderBy("name")
        x = e.where(F.col("edge_type") == kind).join(n.select(F.col("id").alias("dst"), "name"), "dst").withColumn("r", F.row_number().over(w)).where("r <= 3")
        return x.groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias(out))  # three at most

    none = F.lit("None extracted")
    j = n.join(side("REQUIRES", "p"), "id", "left").join(side("UNLOCKS", "u"), "id", "left")
    return j.select("id", F.concat(F.coalesce("p", none), F.lit(" -> "), "name", F.lit(" -> "), F.coalesce("u", none)).alias("path"))


@F.pandas_udf(DoubleType())
def _token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b)])


def resolve_documents(q: DataFrame, docs: DataFrame, least: float = 45.0) -> DataFrame:
    """LIB-3: (query, doc_id, score): the document whose file name or title is nearest to each question, from `least` of 100."""
    j = q.toDF("query", "q").crossJoin(docs)  # a stated set of questions against all documents
    words = F.lower(F.regexp_replace("doc_id", r"[/_.\-]+", " "))
    s = F.greatest(_token_set(F.lower("q"), words), F.coalesce(_token_set(F.lower("q"), F.lower(F.coalesce("title", F.lit("")))), F.lit(0.0)))
    best = j.withColumn("score", F.round(s, 4)).groupBy("query").agg(F.max_by(F.struct("doc_id", "score"), F.struct("score", "doc_id")).alias("b"))
    return best.select("query", "b.doc_id", "b.score").where(F.col("score") >= least)


def acceptance(pairs: DataFrame) -> DataFrame:
    """TRN-9 and SET-5: chunks in both train and test, share of empty answers, rows per side."""
    e = F.col("output").rlike(r"^\s*\[\s*\]\s*$")
    side = lambda s: pairs.where(F.col("split_name") == s).select("doc_id", "chunk_id")
    leaks = side("train").intersect(side("test")).agg(F.count(F.lit(1)).alias("leaked_chunks"))
    rest = pairs.agg(F.round(F.avg(F.when(e, 1.0).otherwise(0.0)), 6).alias("empty_share"), F.count_if(F.col("split_name") == "train").alias("n_train"), F.count_if(F.col("split_name") == "test").alias("n_test"))
    return leaks.crossJoin(rest)  # one row each


def chunk_back_edges(records: DataFrame) -> DataFrame:
    """TRN-18: (doc_id, chunk_id, concept, prerequisite) of the prerequisites between a chunk's own concepts that close a cycle when taken in order.

    A chunk has few concepts, so the fold over one chunk is small whatever the table's size.
    """
    r = records.where("doc_id is not null and chunk_id is not null and concept_name is not null")
    own = r.select("doc_id", "chunk_id", F.lower(F.trim("concept_name")).alias("prerequisite")).distinct()
    p = r.select("rec_id", "doc_id", "chunk_id", F.lower(F.trim("concept_name")).alias("concept"), F.posexplode("prerequisites").alias("pos", "x")).withColumn("prerequisite", F.lower(F.trim("x"))).where("prerequisite <> concept")
    p = p.join(own, ["doc_id", "chunk_id", "prerequisite"], "left_semi").select("doc_id", "chunk_id", "rec_id", "pos", "concept", "prerequisite")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        needs: dict[str, set] = {}
        out = []
        for x in pdf.sort_values(["rec_id", "pos", "prerequisite"]).itertuples():
            seen, todo = {x.prerequisite}, [x.prerequisite]
            while todo:
                for y in needs.get(todo.pop(), ()):
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            if x.concept in seen:
                out.append((x.doc_id, x.chunk_id, x.concept, x.prerequisite))
            else:
                needs.setdefault(x.concept, set()).add(x.prerequisite)
        return pd.DataFrame(sorted(set(out)), columns=["doc_id", "chunk_id", "concept", "prerequisite"])

    return p.groupBy("doc_id", "chunk_id").applyInPandas(fold, "doc_id string, chunk_id string, concept string, prerequisite string")


def scrubbed(records: DataFrame) -> DataFrame:
    """TRN-30: (rec_id, pos, target): prerequisites canonical, without blanks and the record itself, each once."""
    r = records.select("rec_id", "concept_name", F.posexplode("prerequisites").alias("pos", "t")).where(strip(F.coalesce("t", F.lit(""))) != "").withColumn("t", canonical_name(F.col("t")))
    r = r.where(F.lower("t") != F.lower(strip(F.coalesce("concept_name", F.lit("")))))
    return r.groupBy("rec_id", F.lower("t").alias("__k")).agg(F.min("pos").alias("pos"), F.min_by("t", "pos").alias("target")).drop("__k")


def extract(chunks: DataFrame, concepts: DataFrame, tagger=None) -> DataFrame:
    """EXT-1, EXT-4 and EXT-5: records (doc_id, chunk_id, concept_name, concept_type, difficulty) of the prose chunks outside bibliographies.

    `tagger(chunks, concepts)` is the seam for a model; the default names the listed concepts that a chunk holds as whole words.
    """
    prose = chunks.where((chunk_kind(F.col("text"), F.col("section_title")) == "prose") & ~is_bibliography(F.col("section_title")))
    found = (tagger or (lambda c, k: mentions(c, k.select("id", "name"), ["doc_id", "chunk_id"])))(prose, concepts)
    return found.join(concepts.select("id", F.col("name").alias("concept_name"), "concept_type", "difficulty"), "id").select("doc_id", "chunk_id", "concept_name", "concept_type", "difficulty")


def schema_ok(pairs: DataFrame) -> DataFrame:
    """EXT-7: whether an answer is a JSON array whose elements all have the four required keys."""
    v = F.try_parse_json("output")
    cs = F.try_variant_get("v", "$", "array<struct<concept_name:string,concept_type:string,difficulty:string,summary:string>>")
    ok = F.forall("cs", lambda c: c["concept_name"].isNotNull() & c["concept_type"].isNotNull() & c["difficulty"].isNotNull() & c["summary"].isNotNull())
    return pairs.withColumn("v", v).withColumn("cs", cs).select("pair_id", F.coalesce(ok, F.lit(False)).alias("ok"))
