"""Queries of the remaining projections, exports, routes, payloads and training rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as N

from ..functions import text as T
from ..operators import dataset as S
from ..operators import evidence as V
from ..operators import filters as L

from ..operators import more as M
from ..operators import relations as B
from ..tables import read
from . import duck as D
from .q_graph import GRAPH, _e, _n
from .q_relations import _EV, _K, _Q, _concepts, _evidence, _wf
from .q_text import _ANNOTATED, _BIB, _KIND

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_REL = D.items(L.RELATIONS)


@query("prj4_related", f"""WITH x AS (SELECT rec_id, generate_subscripts(related_to, 1) - 1 AS pos, unnest(related_to) AS r FROM okf_results), y AS (SELECT rec_id, pos, {D.strip('r.concept')} AS concept, CASE WHEN list_contains({_REL}, lower(trim(r.relation))) THEN lower(trim(r.relation)) ELSE 'uses' END AS relation FROM x WHERE {D.strip("coalesce(r.concept, '')")} <> '')
 SELECT rec_id, relation, min(pos) AS pos, arg_min(concept, pos) AS concept FROM y GROUP BY rec_id, relation, lower(concept)""")
def prj4(spark, sf):
    return M.normal_related(read(spark, sf, "okf_results", "rec_id", "related_to"))


@query("prj5_normal_records", f"""SELECT rec_id, CASE WHEN list_contains({D.items(S.TYPES)}, lower(trim(concept_type))) THEN lower(trim(concept_type)) ELSE 'definition' END AS concept_type, CASE WHEN list_contains({D.items(S.DIFFICULTIES)}, lower(trim(difficulty))) THEN lower(trim(difficulty)) ELSE 'intermediate' END AS difficulty,
 coalesce(array_to_string(list_transform(list_filter(tags, lambda t: t IS NOT NULL), lambda t: regexp_replace(lower(trim(t)), '[^a-z0-9]+', '_', 'g')), ' '), '') AS tags FROM okf_results""")
def prj5(spark, sf):
    return M.normal_records(read(spark, sf, "okf_results", "rec_id", "concept_type", "difficulty", "tags"))


@query("prj5_records_per_chunk", "SELECT rec_id FROM (SELECT rec_id, row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY rec_id) AS r FROM okf_results WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL) WHERE r <= 5")
def prj5b(spark, sf):
    w = Window.partitionBy("doc_id", "chunk_id").orderBy("rec_id")  # a chunk gives five records at most: the rule of the extraction
    return read(spark, sf, "okf_results", "rec_id", "doc_id", "chunk_id").where("doc_id is not null and chunk_id is not null").withColumn("r", F.row_number().over(w)).where("r <= 5").select("rec_id")


@query("prj7_record_sources", "SELECT rec_id, coalesce(doc_id, '') || ':' || coalesce(chunk_id, '') || '@' || coalesce(page_number, 0)::bigint AS source FROM okf_results")
def prj7(spark, sf):
    o = read(spark, sf, "okf_results", "rec_id", "doc_id", "chunk_id", "page_number")
    return o.select("rec_id", F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), F.coalesce("chunk_id", F.lit("")), F.lit("@"), F.coalesce(F.col("page_number").cast("bigint"), F.lit(0)).cast("string")).alias("source"))


_NAMES = "(SELECT DISTINCT concept_name AS n FROM okf_results WHERE concept_name IS NOT NULL)"


@query("can13_query_acronyms", f"SELECT n, CASE WHEN {D.acronym('n')} IN ('IS', 'IT', 'OF', 'FOR', 'AND', 'OR', 'THE', 'AN', 'IN', 'ON', 'AT', 'TO', 'BY') THEN '' ELSE {D.acronym('n')} END AS acronym FROM {_NAMES}")
def can13(spark, sf):
    n = read(spark, sf, "okf_results", F.col("concept_name").alias("n")).where("n is not null").distinct()
    return n.select("n", M.query_acronym(F.col("n")).alias("acronym"))


@query("can14_query_aliases", f"SELECT canonical_name AS n, alias FROM (SELECT canonical_name, unnest({D.aliases('canonical_name')}) AS alias FROM concept_reference) WHERE alias = lower(trim(canonical_name)) OR NOT list_contains({D.items(M.GENERIC_ALIASES)}, alias)")
def can14(spark, sf):
    r = read(spark, sf, "concept_reference", F.col("canonical_name").alias("n"))
    return r.select("n", F.explode(M.query_aliases(F.col("n"))).alias("alias"))


@query("evl8_comparison_keys", f"SELECT n, {D.concept_key(D.canonical('n'))} AS key FROM {_NAMES}")
def evl8(spark, sf):
    n = read(spark, sf, "okf_results", F.col("concept_name").alias("n")).where("n is not null").distinct()
    return n.select("n", N.concept_key(N.canonical_name(F.col("n"))).alias("key"))


@query("evl7_gates", f"""WITH {GRAPH}, v AS (SELECT 'concepts' AS gate, count(*)::double AS value, 80.0 AS least, 1e12 AS most FROM nodes UNION ALL SELECT 'edges', count(*)::double, 80.0, 1e12 FROM edges UNION ALL SELECT 'orphan_share', (count(*) FILTER (id NOT IN (SELECT id FROM ends)))::double / count(*), 0.0, 0.6 FROM nodes
 UNION ALL SELECT 'self_edges', count(*)::double, 0.0, 0.0 FROM edges WHERE src = dst) SELECT gate, round(value, 6) AS value, value BETWEEN least AND most AS passed FROM v""")
def evl7(spark, sf):
    return M.gates(_n(spark, sf), _e(spark, sf))


@query("trv5_hop_pages", f"{_EV} SELECT id, doc_id, chunk_id, CASE WHEN page_number > 0 THEN page_number END AS page FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY quality DESC, doc_id, page_number, chunk_id) AS rank FROM (SELECT *, {_Q} AS quality FROM ev)) WHERE rank = 1")
def trv5(spark, sf):
    return V.best_citations(_evidence(spark, sf), 1).select("id", "doc_id", "chunk_id", F.when(F.col("page_number") > 0, F.col("page_number")).alias("page"))


_PRI = "CASE edge_type WHEN 'REQUIRES' THEN 1 WHEN 'UNLOCKS' THEN 2 ELSE 3 END"


@query("grf6_edge_provenance", f"WITH {GRAPH} SELECT src, dst, arg_min(source, {_PRI}) AS source FROM edges GROUP BY 1, 2")
def grf6(spark, sf):
    return M.edge_provenance(_e(spark, sf))


@query("grf2_upserted_concepts", f"WITH ids AS (SELECT rec_id, {D.slug('concept_name')} AS id, concept_type, difficulty FROM okf_results WHERE concept_name IS NOT NULL) SELECT id, x.t AS concept_type, x.d AS difficulty FROM (SELECT id, arg_max({{'t': concept_type, 'd': difficulty}}, rec_id) AS x FROM ids GROUP BY 1)")
def grf2(spark, sf):
    from ..operators.records import first_rows

    o = read(spark, sf, "okf_results", "rec_id", "concept_name", "concept_type", "difficulty").where("concept_name is not null")
    return first_rows(o.select(T.slug(F.col("concept_name")).alias("id"), "rec_id", "concept_type", "difficulty"), ["id"], "rec_id", desc=True).select("id", "concept_type", "difficulty")


@query("grf17_upserted_chunks", "SELECT doc_id, chunk_id, max(page_number) AS page_number, count(*) AS n_versions FROM (SELECT DISTINCT doc_id, chunk_id, page_number, text FROM chunks) GROUP BY 1, 2")
def grf17(spark, sf):
    return read(spark, sf, "chunks", "doc_id", "chunk_id", "page_number", "text").distinct().groupBy(*_K).agg(F.max("page_number").alias("page_number"), F.count(F.lit(1)).alias("n_versions"))


@query("rte6_active_concepts", f"""WITH al AS (SELECT DISTINCT id, {_wf('a')} AS alias FROM (SELECT canonical_name AS id, unnest({D.aliases('canonical_name')}) AS a FROM concept_reference)), w AS (SELECT doc_id, pair_id, ' ' || {_wf('output')} || ' ' AS w FROM sft_pairs WHERE doc_id IS NOT NULL), m AS (SELECT DISTINCT doc_id, pair_id, id FROM w JOIN al ON contains(w, ' ' || alias || ' ') WHERE length(alias) >= 2)
 SELECT doc_id, arg_max(id, {{'p': pair_id, 'l': length(id), 'i': id}}) AS concept FROM m GROUP BY 1""")
def rte6(spark, sf):
    p = read(spark, sf, "sft_pairs", "doc_id", "pair_id", "output").where("doc_id is not null")
    m = B.mentions(p, _concepts(spark, sf), ["doc_id", "pair_id"], "output")
    return M.active_concept(m, "doc_id", "pair_id")


@query("cit20_citation_labels", f"{_EV} SELECT id, ' [S1: ' || id || ' | ' || doc_id || CASE WHEN page_number > 0 THEN ', PDF page ' || page_number ELSE '' END || ']' AS label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY quality DESC, doc_id, page_number, chunk_id) AS rank FROM (SELECT *, {_Q} AS quality FROM ev)) WHERE rank = 1")
def cit20(spark, sf):
    b = V.best_citations(_evidence(spark, sf), 1)
    return b.select("id", F.concat(F.lit(" [S1: "), "id", F.lit(" | "), "doc_id", F.when(F.col("page_number") > 0, F.concat(F.lit(", PDF page "), F.col("page_number").cast("string"))).otherwise(""), F.lit("]")).alias("label"))


@query("cit15_learning_paths", f"""WITH {GRAPH}, p AS (SELECT src AS id, name, row_number() OVER (PARTITION BY src ORDER BY name) AS r FROM edges JOIN nodes ON dst = nodes.id WHERE edge_type = 'REQUIRES'), u AS (SELECT src AS id, name, row_number() OVER (PARTITION BY src ORDER BY name) AS r FROM edges JOIN nodes ON dst = nodes.id WHERE edge_type = 'UNLOCKS'),
 pp AS (SELECT id, string_agg(name, ', ' ORDER BY name) AS x FROM p WHERE r <= 3 GROUP BY 1), uu AS (SELECT id, string_agg(name, ', ' ORDER BY name) AS x FROM u WHERE r <= 3 GROUP BY 1) SELECT n.id, coalesce(pp.x, 'None extracted') || ' -> ' || n.name || ' -> ' || coalesce(uu.x, 'None extracted') AS path FROM nodes n LEFT JOIN pp ON pp.id = n.id LEFT JOIN uu ON uu.id = n.id""")
def cit15(spark, sf):
    return M.learning_paths(_n(spark, sf), _e(spark, sf))


@query("lib3_resolved_documents")
def lib3(spark, sf):
    q = read(spark, sf, "concept_reference", "ref_id", "canonical_name").where("ref_id % 100 = 0")  # the stated query set of a search
    d = read(spark, sf, "chunks", "doc_id", "doc_title").groupBy("doc_id").agg(F.min("doc_title").alias("title"))
    return M.resolve_documents(q, d)


@query("trn5_grounded_names", """WITH a AS (SELECT rec_id, lower(source_passage) AS low, concept_name AS n, list_filter(string_split_regex(lower(concept_name), '[^a-z0-9]+'), lambda w: length(w) > 2) AS ws FROM okf_results WHERE source_passage IS NOT NULL AND concept_name IS NOT NULL)
 SELECT rec_id, CASE WHEN len(ws) = 0 THEN contains(low, lower(n)) ELSE len(list_filter(ws, lambda w: contains(low, w))) >= greatest(1, (len(ws) + 1) // 2) END AS grounded FROM a""")
def trn5(spark, sf):
    o = read(spark, sf, "okf_results", "rec_id", "concept_name", "source_passage").where("source_passage is not null and concept_name is not null")
    return o.select("rec_id", S.grounded(F.col("concept_name"), F.col("source_passage")).alias("grounded"))


@query("trn9_acceptance_gate", r"""WITH p AS (SELECT *, regexp_matches(output, '^\s*\[\s*\]\s*$') AS e FROM sft_pairs), l AS (SELECT DISTINCT doc_id, chunk_id FROM p WHERE split_name = 'train' INTERSECT SELECT doc_id, chunk_id FROM p WHERE split_name = 'test')
 SELECT (SELECT count(*) FROM l) AS leaked_chunks, round(avg(CASE WHEN e THEN 1.0 ELSE 0.0 END), 6) AS empty_share, count(*) FILTER (split_name = 'train') AS n_train, count(*) FILTER (split_name = 'test') AS n_test FROM p""")
def trn9(spark, sf):
    return M.acceptance(read(spark, sf, "sft_pairs", "split_name", "doc_id", "chunk_id", "output"))


@query("trn18_chunk_cycles")
def trn18(spark, sf):
    return M.chunk_back_edges(read(spark, sf, "okf_results", "rec_id", "doc_id", "chunk_id", "concept_name", "prerequisites"))


@query("trn30_scrubbed_references", f"""WITH r AS (SELECT rec_id, concept_name, generate_subscripts(prerequisites, 1) - 1 AS pos, unnest(prerequisites) AS t FROM okf_results), c AS (SELECT rec_id, pos, {D.canonical('t')} AS t, concept_name FROM r WHERE {D.strip("coalesce(t, '')")} <> '')
 SELECT rec_id, min(pos) AS pos, arg_min(t, pos) AS target FROM c WHERE lower(t) <> lower({D.strip("coalesce(concept_name, '')")}) GROUP BY rec_id, lower(t)""")
def trn30(spark, sf):
    return M.scrubbed(read(spark, sf, "okf_results", "rec_id", "concept_name", "prerequisites"))


@query("trn34_junk_names", f"SELECT n, {D.strip('n')} = '' OR length({D.strip('n')}) < 3 OR regexp_matches({D.strip('n')}, {D.q(N.NUMERIC_NAME)}) OR regexp_matches({D.strip('n')}, {D.q(N.JUNK_NAME)}) OR regexp_matches({D.strip('n')}, {D.q(N.FORMULA_NAME)}) AS junk FROM {_NAMES}")
def trn34(spark, sf):
    n = read(spark, sf, "okf_results", F.col("concept_name").alias("n")).where("n is not null").distinct()
    s = T.strip(F.col("n"))
    return n.select("n", ((F.length(s) < 3) | s.rlike(N.NUMERIC_NAME) | s.rlike(N.JUNK_NAME) | s.rlike(N.FORMULA_NAME)).alias("junk"))


_PROSE = _ANNOTATED.replace("FROM chunks)", "FROM (SELECT DISTINCT doc_id, chunk_id, text, section_title FROM chunks))")


@query("ext4_extracted_records", f"""{_PROSE}, p AS (SELECT DISTINCT doc_id, chunk_id, text FROM d WHERE {_KIND.replace('coalesce(t,', 'coalesce(section_title,')} = 'prose' AND NOT {_BIB}), al AS (SELECT DISTINCT id, {_wf('a')} AS alias FROM (SELECT canonical_name AS id, unnest({D.aliases('canonical_name')}) AS a FROM concept_reference)),
 m AS (SELECT DISTINCT doc_id, chunk_id, id FROM (SELECT doc_id, chunk_id, ' ' || {_wf('text')} || ' ' AS w FROM p) JOIN al ON contains(w, ' ' || alias || ' ') WHERE length(alias) >= 2) SELECT m.doc_id, m.chunk_id, r.canonical_name AS concept_name, r.concept_type, r.difficulty FROM m JOIN concept_reference r ON m.id = r.canonical_name""")
def ext4(spark, sf):
    c = read(spark, sf, "chunks", *_K, "text", "section_title").distinct()
    return M.extract(c, _concepts(spark, sf, "concept_type", "difficulty"))


@query("ext7_schema_ok", f"""SELECT pair_id, coalesce(CASE WHEN json_valid(output) AND json_type(output) = 'ARRAY' THEN len(list_filter(from_json(output, '["JSON"]'), lambda c: c->>'concept_name' IS NULL OR c->>'summary' IS NULL OR c->>'concept_type' IS NULL OR c->>'difficulty' IS NULL)) = 0 END, false) AS ok FROM sft_pairs""")
def ext7(spark, sf):
    return M.schema_ok(read(spark, sf, "sft_pairs", "pair_id", "output"))
