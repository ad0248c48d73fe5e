"""Queries of manual edges, gold matches, anchors, intents, training records and whole builds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import queries as U
from ..functions import text as T
from ..operators import extra as X
from ..operators import filters as L
from ..operators import graph as G

from ..operators.chunking import CITATION, EMAIL
from ..tables import read
from . import duck as D
from .q_graph import GRAPH, _e, _n

from .q_retrieval import _QS, _TEXT, _questions
from .q_text import _REFS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _train(x: str) -> str:
    x = D.strip(f"coalesce({x}, '')")
    for p, r in X.TRAINING_SPELLINGS:
        x = f"regexp_replace({x}, {D.q(p)}, {D.q(r)}, 'g')"
    return x


@query("can15_training_names", f"SELECT DISTINCT concept_name AS n, {_train('concept_name')} AS name FROM okf_results WHERE concept_name IS NOT NULL")
def can15(spark, sf):
    n = read(spark, sf, "okf_results", F.col("concept_name").alias("n")).where("n is not null").distinct()
    return n.select("n", X.training_name(F.col("n")).alias("name"))


@query("flt14_plausible_neighbours", f"WITH {GRAPH} SELECT src, dst FROM edges JOIN nodes s ON src = s.id JOIN nodes d ON dst = d.id WHERE edge_type = 'REQUIRES' AND NOT coalesce({D.rank('d.difficulty')} - {D.rank('s.difficulty')} >= 2, false) AND NOT list_contains({D.items([f'{a}>{b}' for a, b in L.BLOCKED_AT_READ])}, src || '>' || dst)")
def flt14(spark, sf):
    d = _n(spark, sf).select("id", "name", "difficulty")
    e = _e(spark, sf).where("edge_type = 'REQUIRES'").join(d.select(F.col("id").alias("src"), F.col("name").alias("sn"), F.col("difficulty").alias("sd")), "src").join(d.select(F.col("id").alias("dst"), F.col("name").alias("dn"), F.col("difficulty").alias("dd")), "dst")
    return e.where(~L.inverted_prerequisite(F.col("sn"), F.col("dn"), F.col("sd"), F.col("dd"), L.BLOCKED_AT_READ)).select("src", "dst")


_TYPES = "CASE relation " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.EDGE_TYPES.items()) + " END"


@query("grf3_manual_edges", f"WITH {GRAPH}, m AS (SELECT DISTINCT {D.slug('concept_name')} AS src, {D.slug('target')} AS dst, relation FROM refs WHERE concept_name IS NOT NULL AND target IS NOT NULL) SELECT src, dst, relation, CASE WHEN {_TYPES} IS NULL THEN 'unknown_relation' WHEN src = dst THEN 'self' WHEN EXISTS (SELECT 1 FROM edges e WHERE e.src = m.src AND e.dst = m.dst AND e.edge_type = {_TYPES.replace('CASE relation', 'CASE m.relation')}) THEN 'exists' ELSE 'created' END AS verdict FROM m")
def grf3(spark, sf):
    r = L.references(read(spark, sf, "okf_results", "rec_id", "concept_name", "prerequisites", "unlocks", "related_to")).where("concept_name is not null and target is not null")
    m = r.select(T.slug(F.col("concept_name")).alias("src"), T.slug(F.col("target")).alias("dst"), "relation").distinct()
    types = F.create_map(*[F.lit(x) for kv in G.EDGE_TYPES.items() for x in kv])
    m = m.withColumn("edge_type", F.try_element_at(types, F.col("relation"))).join(_e(spark, sf).select("src", "dst", "edge_type", F.lit(True).alias("known")), ["src", "dst", "edge_type"], "left")
    return m.select("src", "dst", "relation", X.edge_verdict(F.col("src"), F.col("dst"), F.col("relation"), F.col("known")).alias("verdict"))


@query("grf10_document_records", "SELECT o.rec_id FROM okf_results o JOIN (SELECT source_filename AS f FROM ingestion_jobs ORDER BY job_id, source_filename LIMIT 1) j ON o.doc_id = j.f OR ends_with(o.doc_id, j.f) OR regexp_extract(o.doc_id, '[^/]*$') = regexp_extract(j.f, '[^/]*$')")
def grf10(spark, sf):
    j = read(spark, sf, "ingestion_jobs", "job_id", "source_filename").orderBy("job_id", "source_filename").limit(1).select(F.col("source_filename").alias("f"))  # the one document asked for
    return read(spark, sf, "okf_results", "rec_id", "doc_id").join(F.broadcast(j), X.of_document(F.col("doc_id"), F.col("f"))).select("rec_id")


@query("grf18_mention_links", f"WITH {GRAPH} SELECT DISTINCT o.doc_id, o.chunk_id, id FROM ids JOIN okf_results o USING (rec_id) JOIN (SELECT DISTINCT doc_id, chunk_id FROM chunks) c ON o.doc_id = c.doc_id AND o.chunk_id = c.chunk_id")
def grf18(spark, sf):
    o = read(spark, sf, "okf_results", "concept_name", "doc_id", "chunk_id").where("trim(coalesce(concept_name, '')) <> ''")
    return o.join(read(spark, sf, "chunks", "doc_id", "chunk_id").distinct(), ["doc_id", "chunk_id"], "left_semi").select("doc_id", "chunk_id", G.concept_id(F.col("concept_name")).alias("id")).distinct()


@query("jon18_gold_matches")
def jon18(spark, sf):
    return X.gold_matches(read(spark, sf, "okf_results", "concept_name"), read(spark, sf, "concept_reference", "canonical_name"))


@query("evl3_gold_names", f"SELECT DISTINCT {D.concept_key('n')} AS key FROM (SELECT unnest(gold_names) AS n FROM lib_qwen_ingestion_eval UNION ALL SELECT unnest(pred_names) FROM lib_qwen_ingestion_eval) WHERE n IS NOT NULL")
def evl3(spark, sf):
    e = read(spark, sf, "lib_qwen_ingestion_eval", "gold_names", "pred_names")
    n = e.select(F.explode("gold_names").alias("n")).unionByName(e.select(F.explode("pred_names").alias("n"))).where("n is not null")
    return n.select(N.concept_key(F.col("n")).alias("key")).distinct()


@query("evl4_edge_names", f"WITH {_REFS} SELECT DISTINCT {D.concept_key('concept_name')} AS a, {D.concept_key('target')} AS b FROM refs WHERE kind = 'prereq' AND target IS NOT NULL AND concept_name IS NOT NULL")
def evl4(spark, sf):
    r = L.references(read(spark, sf, "okf_results", "rec_id", "concept_name", "prerequisites", "unlocks", "related_to")).where("kind = 'prereq' and target is not null and concept_name is not null")
    return r.select(N.concept_key(F.col("concept_name")).alias("a"), N.concept_key(F.col("target")).alias("b")).distinct()


@query("lib11_book_titles", rf"""SELECT pair_id, regexp_replace(regexp_replace(q, {D.q(U.BOOK_FILLER)}, '', 'g'), '^[ :"''?.]+|[ :"''?.]+$', '', 'g') AS title FROM {_QS}""")
def lib11(spark, sf):
    return _questions(spark, sf).select("pair_id", U.clean_book(F.col("q")).alias("title"))


def _few(c: str, n: int) -> str:
    xs = f"list_filter(list_transform(list_filter({c}, lambda x: {D.strip('''coalesce(x, '')''')} <> ''), lambda x: {_train('x')}), lambda x: lower(x) <> lower({_train('concept_name')}))"
    return f"coalesce(array_to_string(list_filter({xs}, lambda x, i: list_position({xs}, x) = i)[1:{n}], '|'), '')"


@query("trn4_clean_records", f"SELECT rec_id, {_train('concept_name')} AS name, {_few('prerequisites', 4)} AS prerequisites, {_few('unlocks', 6)} AS unlocks, {_few('tags', 5)} AS tags FROM okf_results")
def trn4(spark, sf):
    return X.clean_training_records(read(spark, sf, "okf_results", "rec_id", "concept_name", "prerequisites", "unlocks", "tags"))


_NM, _SM = D.strip("coalesce(concept_name, '')"), D.strip("coalesce(summary, '')")


@query("trn24_first_failures", f"SELECT rec_id, CASE WHEN {_NM} = '' THEN 'missing_name' WHEN length({_NM}) > 60 THEN 'long_name' WHEN NOT {D.valid('concept_name')} THEN 'invalid_name' WHEN concept_type IS NULL THEN 'missing_type' WHEN difficulty IS NULL THEN 'missing_difficulty' WHEN length({_SM}) < 15 THEN 'short_summary' END AS reason FROM okf_results")
def trn24(spark, sf):
    return X.first_failure(read(spark, sf, "okf_results", "rec_id", "concept_name", "concept_type", "difficulty", "summary"))


@query("trn16_near_words", """WITH a AS (SELECT rec_id, lower(source_passage) AS t, lower(trim(concept_name)) AS n, list_filter(string_split_regex(lower(trim(concept_name)), '[^a-z0-9]+'), lambda w: length(w) > 2) AS ws FROM okf_results WHERE source_passage IS NOT NULL AND concept_name IS NOT NULL)
 SELECT rec_id, contains(t, n) OR coalesce(instr(t, ws[1]) > 0 AND instr(t, ws[-1]) > 0 AND abs(instr(t, ws[1]) - instr(t, ws[-1])) <= 100, false) AS grounded FROM a""")
def trn16(spark, sf):
    o = read(spark, sf, "okf_results", "rec_id", "concept_name", "source_passage").where("source_passage is not null and concept_name is not null")
    return o.select("rec_id", X.near_words(F.col("source_passage"), F.col("concept_name")).alias("grounded"))


@query("trn28_rebuilt_rows", f"SELECT pair_id, text, len(regexp_extract_all(text, {D.q(EMAIL)})) >= 2 OR len(regexp_extract_all(text, {D.q(CITATION)})) >= 12 AS empty FROM (SELECT pair_id, ({_TEXT})[1:1800] AS text FROM sft_pairs) WHERE length(text) >= 40")
def trn28(spark, sf):
    return X.rebuilt_rows(read(spark, sf, "sft_pairs", "pair_id", "instruction"))


@query("ext8_normal_eval_names", r"SELECT eval_id, trim(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g')) AS key, count(*) AS n FROM (SELECT eval_id, unnest(pred_names) AS n FROM lib_qwen_ingestion_eval) WHERE n IS NOT NULL GROUP BY 1, 2")
def ext8(spark, sf):
    e = read(spark, sf, "lib_qwen_ingestion_eval", "eval_id", F.explode("pred_names").alias("x")).where("x is not null")
    return e.groupBy("eval_id", F.trim(F.regexp_replace(F.lower("x"), "[^a-z0-9]+", " ")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("src16_graph_links", f"WITH {GRAPH} SELECT src AS source, dst AS target, lower(edge_type) AS type FROM edges")
def src16(spark, sf):
    return _e(spark, sf).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lower("edge_type").alias("type"))


@query("snk2_edge_json", f"WITH {GRAPH} SELECT to_json({{'from_id': src, 'to_id': dst, 'type': edge_type}})::varchar AS line FROM edges")
def snk2(spark, sf):
    return _e(spark, sf).select(F.to_json(F.struct(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), F.col("edge_type").alias("type"))).alias("line"))


@query("win8_ordered_pages", "SELECT doc_id, chunk_id, rank FROM (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, chunk_id) AS rank FROM (SELECT DISTINCT doc_id, chunk_id, page_number FROM chunks))")
def win8(spark, sf):
    from pyspark.sql import Window

    c = read(spark, sf, "chunks", "doc_id", "chunk_id", "page_number").distinct()
    return c.select("doc_id", "chunk_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "chunk_id")).alias("rank"))


@query("cmp3_built_graph")
def cmp3(spark, sf):
    o = read(spark, sf, "okf_results", "rec_id", "concept_name", "concept_type", "difficulty", "summary", "prerequisites", "unlocks", "related_to", "relation_provenance", "doc_id", "chunk_id", "section_title", "page_number", "source_passage")
    return X.build(o)[1]


@query("rte3_graph_coverage", f"WITH v AS (SELECT DISTINCT unnest(string_split_regex(lower(canonical_name), '[^a-z0-9]+')) AS w FROM concept_reference), t AS (SELECT DISTINCT pair_id, unnest(string_split_regex(lower(q), '[^a-z0-9]+')) AS w FROM {_QS}) SELECT pair_id, count(*) FILTER (w IN (SELECT w FROM v)) * 2 >= count(*) AS covered FROM t WHERE length(w) > 3 GROUP BY 1")
def rte3(spark, sf):
    v = read(spark, sf, "concept_reference", F.explode(F.split(F.lower("canonical_name"), "[^a-z0-9]+")).alias("w")).distinct().withColumn("k", F.lit(1))
    t = _questions(spark, sf).select("pair_id", F.explode(F.split(F.lower("q"), "[^a-z0-9]+")).alias("w")).where("length(w) > 3").distinct()
    return t.join(v, "w", "left").groupBy("pair_id").agg((F.count("k") * 2 >= F.count(F.lit(1))).alias("covered"))
