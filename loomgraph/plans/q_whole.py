"""Queries of evidence, payloads, texts made of them, exports, and snapshots over time."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import names as N
from ..functions.names import aliases
from ..operators import answers as A
from ..operators import evidence as V
from ..operators import filters as L
from ..operators import graph as G
from ..operators import lifecycle as C
from ..operators import relations as B
from ..session import checkpoint_root
from ..tables import read
from . import duck as D
from .q_graph import GRAPH, _e, _n, _r
from .q_relations import _EV, _K, _PAGE, _Q, _REFEDGES, MENTIONS, _chunks, _concepts, _evidence, _mentions, _refedges
from .q_retrieval import _QS, _questions
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


# --- evidence and payloads ---

_SPAN = "CASE WHEN text_offset_start >= 0 AND text_offset_start < text_offset_end AND text_offset_end <= length(coalesce(text, '')) THEN text[text_offset_start + 1 : text_offset_end] ELSE coalesce(text, '') END"


@query("cit7_payloads", f"""SELECT DISTINCT doc_id, chunk_id, page_number, coalesce('p. ' || {_PAGE}, CASE WHEN page_number > 0 THEN 'PDF page ' || page_number END, '') AS page, '/pdfs/' || replace(doc_id, ' ', '%20') || CASE WHEN page_number > 0 THEN '#page=' || page_number ELSE '' END AS url, md5({_SPAN}) AS span FROM chunks""")
def cit7(spark, sf):
    c = read(spark, sf, "chunks", *_K, "page_number", "page_label_map", "text", "text_offset_start", "text_offset_end")
    return c.select(*_K, "page_number", V.page_display(F.col("page_label_map"), F.col("page_number")).alias("page"), V.page_url(F.col("doc_id"), F.col("page_number")).alias("url"), F.md5(A.span(F.col("text"), F.col("text_offset_start"), F.col("text_offset_end"))).alias("span")).distinct()


@query("jon9_evidence_chain", f"WITH {MENTIONS}, t AS (SELECT doc_id, min(doc_title) AS title FROM chunks GROUP BY 1) SELECT m.id, m.doc_id, m.chunk_id, t.title FROM mentions m JOIN t USING (doc_id)")
def jon9(spark, sf):
    t = read(spark, sf, "chunks", "doc_id", "doc_title").groupBy("doc_id").agg(F.min("doc_title").alias("title"))
    return _mentions(spark, sf).join(t, "doc_id").select("id", "doc_id", "chunk_id", "title")


_LEG = f"lg AS (SELECT n.id, o.doc_id, o.chunk_id, o.page_number, o.section_title, o.source_passage AS text FROM ids n JOIN okf_results o USING (rec_id) WHERE o.doc_id IS NOT NULL AND o.chunk_id IS NOT NULL), cn AS (SELECT DISTINCT id FROM ids), ix AS (SELECT DISTINCT cid AS id, doc_id, chunk_id FROM mentions JOIN (SELECT canonical_name AS id, {{cid}} AS cid FROM concept_reference) r USING (id))"


def _legacy(spark, sf):
    o = read(spark, sf, "okf_results", "concept_name", *_K, "page_number", "section_title", F.col("source_passage").alias("text")).where("trim(coalesce(concept_name, '')) <> '' and doc_id is not null and chunk_id is not null")
    return o.select(G.concept_id(F.col("concept_name")).alias("id"), *_K, "page_number", "section_title", "text")


def _indexed(spark, sf):
    c = _concepts(spark, sf).select("id", G.concept_id(F.col("name")).alias("cid"))
    return _mentions(spark, sf).join(c, "id").select(F.col("cid").alias("id"), *_K).distinct()


def _cit17_sql() -> str:
    from .q_graph import _cid

    return f"""WITH {GRAPH}, {MENTIONS}, {_LEG.replace('{cid}', _cid('canonical_name'))}, lr AS (SELECT id, doc_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY quality DESC, doc_id, page_number NULLS FIRST, chunk_id) AS rank FROM (SELECT *, {_Q} AS quality FROM lg WHERE id NOT IN (SELECT id FROM ix))) WHERE rank = 1)
 SELECT ix.id, ix.doc_id, ix.chunk_id, 'index' AS origin FROM ix JOIN cn USING (id) UNION ALL SELECT id, doc_id, chunk_id, 'legacy' FROM lr"""


@query("cit17_concept_evidence", _cit17_sql())
def cit17(spark, sf):
    n = read(spark, sf, "okf_results", "concept_name").where("trim(coalesce(concept_name, '')) <> ''").select(G.concept_id(F.col("concept_name")).alias("id")).distinct()
    return A.concept_evidence(n, _indexed(spark, sf), _legacy(spark, sf))


@query("cit18_prerequisite_evidence", f"""WITH {_REFEDGES}, p AS (SELECT DISTINCT src AS target, dst AS prereq FROM re WHERE edge_type = 'REQUIRES' UNION SELECT DISTINCT dst, src FROM re WHERE edge_type = 'UNLOCKS'), o AS (SELECT src, dst, arg_min(source, {{'k': CASE edge_type WHEN 'REQUIRES' THEN 1 WHEN 'UNLOCKS' THEN 2 ELSE 3 END, 's': source}}) AS source FROM re WHERE source IS NOT NULL GROUP BY 1, 2)
 SELECT target, prereq, CASE WHEN f.source IS NOT NULL THEN 'forward' ELSE 'turned' END AS orientation, coalesce(f.source, t.source) AS source FROM p LEFT JOIN o f ON f.src = target AND f.dst = prereq LEFT JOIN o t ON t.src = prereq AND t.dst = target WHERE f.source IS NOT NULL OR t.source IS NOT NULL""")
def cit18(spark, sf):
    e = _refedges(spark, sf)
    p = e.where("edge_type = 'REQUIRES'").select(F.col("src").alias("target"), F.col("dst").alias("prereq")).unionByName(e.where("edge_type = 'UNLOCKS'").select(F.col("dst").alias("target"), F.col("src").alias("prereq")))
    return A.prerequisite_evidence(p, e)


def _refgraph(spark, sf):
    return _concepts(spark, sf, F.lit("").alias("summary")), _refedges(spark, sf)


_BEST = f"bt AS (SELECT id, doc_id, chunk_id, page_number, section_title, text, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY quality DESC, doc_id, page_number NULLS FIRST, chunk_id) AS rank FROM (SELECT *, {_Q} AS quality FROM ev)) WHERE rank <= 3)"
_BOTH = f"{_EV}, {_REFEDGES}".replace("WITH WITH", "WITH")
_OFFS = "tx AS (SELECT doc_id, chunk_id, min(text) AS text, min(text_offset_start) AS text_offset_start, min(text_offset_end) AS text_offset_end FROM chunks GROUP BY 1, 2)"


@query("cit19_ordered_payloads", f"""{_BOTH}, {_BEST}, {_OFFS}, nr AS (SELECT src, dst, edge_type, row_number() OVER (PARTITION BY src, edge_type ORDER BY dst) AS r FROM (SELECT DISTINCT src, dst, edge_type FROM re WHERE edge_type IN ('REQUIRES', 'UNLOCKS'))),
 it AS (SELECT canonical_name AS target, canonical_name AS id, 0 AS role, 0 AS r FROM concept_reference UNION ALL SELECT src, dst, CASE edge_type WHEN 'REQUIRES' THEN 1 ELSE 2 END, r FROM nr WHERE r <= 4), i1 AS (SELECT target, id, min({{'role': role, 'r': r}}) AS x FROM it GROUP BY 1, 2)
 SELECT target, row_number() OVER (PARTITION BY target ORDER BY x.role, x.r, i1.id, rank, bt.doc_id, bt.chunk_id) AS evidence_no, i1.id, i1.id AS topic, bt.doc_id, bt.chunk_id, md5({_SPAN.replace('text', 'tx.text').replace('tx.text_offset', 'tx.text_offset')}) AS text_span FROM i1 JOIN bt ON bt.id = i1.id JOIN tx ON tx.doc_id = bt.doc_id AND tx.chunk_id = bt.chunk_id WHERE rank <= 2""")
def cit19(spark, sf):
    n, e = _refgraph(spark, sf)
    t = _chunks(spark, sf, "text_offset_start", "text_offset_end").select(*_K, "text", F.col("text_offset_start").alias("start"), F.col("text_offset_end").alias("end"))
    p = A.payloads(n, e.select("src", "dst", "edge_type").distinct(), V.best_citations(_evidence(spark, sf), 2), t)
    return p.withColumn("text_span", F.md5("text_span"))


@query("cit21_narratives", rf"""{_BOTH}, {_BEST}, nr AS (SELECT src, dst, edge_type, row_number() OVER (PARTITION BY src, edge_type ORDER BY dst) AS r FROM (SELECT DISTINCT src, dst, edge_type FROM re WHERE edge_type IN ('REQUIRES', 'UNLOCKS'))),
 pr AS (SELECT src AS id, string_agg('   - ' || dst || ': ', chr(10) ORDER BY r) AS x FROM nr WHERE edge_type = 'REQUIRES' AND r <= 4 GROUP BY 1), un AS (SELECT src AS id, string_agg(dst, ', ' ORDER BY r) AS x FROM nr WHERE edge_type = 'UNLOCKS' AND r <= 4 GROUP BY 1),
 ct AS (SELECT id, string_agg('Citation ' || rank || ':' || chr(10) || '- Document: ' || doc_id || ' (Page: ' || coalesce(page_number::varchar, '') || ', Section: ' || coalesce(section_title, '') || ')' || chr(10) || '- Text Passage: "' || {D.strip("coalesce(text, '')")} || '"' || chr(10), chr(10) ORDER BY rank) AS x FROM bt GROUP BY 1)
 SELECT c.canonical_name AS id, md5('1. Upstream Prerequisites:' || chr(10) || coalesce(pr.x, '   - None extracted') || chr(10) || '2. Target Concept:' || chr(10) || '   - ' || c.canonical_name || ': ' || chr(10) || '3. Downstream Applications (Unlocks):' || chr(10) || '   - ' || coalesce(un.x, 'None extracted') || chr(10) || 'TEXTUAL CITATIONS:' || chr(10) || coalesce(ct.x, 'No specific source citations found in the database.' || chr(10))) AS recipe
 FROM concept_reference c LEFT JOIN pr ON pr.id = c.canonical_name LEFT JOIN un ON un.id = c.canonical_name LEFT JOIN ct ON ct.id = c.canonical_name""")
def cit21(spark, sf):
    n, e = _refgraph(spark, sf)
    r = A.narrative(n, e.select("src", "dst", "edge_type").distinct(), V.best_citations(_evidence(spark, sf), 3))
    return r.withColumn("recipe", F.md5("recipe"))


@query("trv3_path_sections")
def trv3(spark, sf):
    return A.path_section(G.first_chains(G.learn_arcs(_refedges(spark, sf))))


_NM = "SELECT c.canonical_name AS id, c.canonical_name AS label, c.aliases FROM concept_reference c"
_HAY = "hs AS (SELECT id, unnest(list_distinct(list_transform(list_concat([id, label], coalesce(list_filter(aliases, lambda x: x IS NOT NULL), [])), lambda x: lower(x)))) AS n FROM ({0}))".replace("{0}", _NM)
_TW = f"tw AS (SELECT q, unnest(list_filter(list_distinct(list_concat(w3, list_transform(list_filter(w3, lambda w: w LIKE '%s' AND length(w) >= 4), lambda w: w[:-2]))), lambda w: NOT list_contains({D.items(A.TOPIC_STOP)}, w))) AS w FROM (SELECT q, list_filter(regexp_extract_all(lower(q), '([\\p{{L}}\\p{{N}}_]+)', 1), lambda w: length(w) >= 3) AS w3 FROM (SELECT DISTINCT q FROM {_QS} WHERE q IS NOT NULL)))"


def _names(spark, sf):
    return read(spark, sf, "concept_reference", F.col("canonical_name").alias("id"), F.col("canonical_name").alias("label"), "aliases")


def _each_question(spark, sf):
    return _questions(spark, sf).select("q").where("q is not null").distinct()


@query("lib10_related_by_token", f"WITH {_HAY}, {_TW} SELECT DISTINCT q, id FROM tw JOIN hs ON contains(n, w)")
def lib10(spark, sf):
    return A.related_concepts(_each_question(spark, sf), _names(spark, sf))


@query("txt2_not_indexed_replies", f"""WITH {_HAY}, {_TW}, rl AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY id) AS r FROM (SELECT DISTINCT q, id FROM tw JOIN hs ON contains(n, w))), nm AS (SELECT q, string_agg(id, ', ' ORDER BY r) AS x FROM rl WHERE r <= 3 GROUP BY 1)
 SELECT e.q, 'This topic isn''t covered by the indexed library.' || CASE WHEN x IS NOT NULL THEN ' Related topics that are covered: ' || x || '.' ELSE ' The closest topics are: ' || (SELECT string_agg(canonical_name, ', ' ORDER BY ref_id) FROM (SELECT ref_id, canonical_name FROM concept_reference ORDER BY ref_id LIMIT 3)) || '.' END AS reply FROM (SELECT DISTINCT q FROM {_QS} WHERE q IS NOT NULL) e LEFT JOIN nm ON e.q = nm.q""")
def txt2(spark, sf):
    q = _each_question(spark, sf)
    near = read(spark, sf, "concept_reference", "ref_id", F.col("canonical_name").alias("id")).orderBy("ref_id").limit(3)  # the reply names three
    from pyspark.sql import Window

    near = near.select("id", F.row_number().over(Window.orderBy("ref_id")).alias("rank"))
    return A.not_indexed(q, A.related_concepts(q, _names(spark, sf)), q.crossJoin(F.broadcast(near)))  # three rows on the right


@query("lib13_rendered_books", f"""WITH {MENTIONS}, b AS (SELECT id, doc_id, count(*) AS n FROM mentions GROUP BY 1, 2), t AS (SELECT doc_id, min(nullif(trim(doc_title), '')) AS title FROM chunks GROUP BY 1), r AS (SELECT b.id, b.doc_id, n, title, {D.category('b.doc_id')} AS kind, row_number() OVER (PARTITION BY b.id ORDER BY n DESC, b.doc_id) AS r FROM b JOIN t USING (doc_id))
 SELECT id, 'Recommended reading for: **' || id || '**' || chr(10) || string_agg(r || '. **' || coalesce(title, doc_id) || '** _' || CASE kind WHEN 'web_syllabus' THEN 'syllabus' WHEN 'markdown' THEN 'notes' ELSE kind END || '_ (`' || doc_id || '`)' || chr(10) || '   - Mentions: ' || n, chr(10) ORDER BY r) AS listing FROM r WHERE r <= 10 GROUP BY 1""")
def lib13(spark, sf):
    from ..functions.text import source_category

    t = read(spark, sf, "chunks", "doc_id", "doc_title").groupBy("doc_id").agg(F.min(F.nullif(F.trim("doc_title"), F.lit(""))).alias("title"))
    b = _mentions(spark, sf).groupBy("id", "doc_id").agg(F.count(F.lit(1)).alias("n")).join(t, "doc_id").withColumn("kind", source_category(F.col("doc_id")))
    return A.rendered_books(b, "id", "title", "kind", "doc_id", "n")


@query("lib6_chapters", "SELECT doc_id, section_title, min(page_number) AS page FROM chunks WHERE trim(coalesce(section_title, '')) <> '' GROUP BY 1, 2")
def lib6(spark, sf):
    return read(spark, sf, "chunks", "doc_id", "section_title", "page_number").where("trim(coalesce(section_title, '')) <> ''").groupBy("doc_id", "section_title").agg(F.min("page_number").alias("page"))


@query("evl5_name_documents", f"SELECT DISTINCT {D.concept_key('concept_name')} AS key, doc_id FROM okf_results WHERE concept_name IS NOT NULL AND doc_id IS NOT NULL")
def evl5(spark, sf):
    return read(spark, sf, "okf_results", "concept_name", "doc_id").where("concept_name is not null and doc_id is not null").select(N.concept_key(F.col("concept_name")).alias("key"), "doc_id").distinct()


_P2, _R2 = "coalesce(tp::double / nullif(tp + fp, 0), 0.0)", "coalesce(tp::double / nullif(tp + fn, 0), 0.0)"
_CMP = "SELECT '{n}' AS part, count(*) FILTER (m AND g) AS tp, count(*) FILTER (m AND NOT g) AS fp, count(*) FILTER (g AND NOT m) AS fn FROM (SELECT k, bool_or(s = 1) AS m, bool_or(s = 2) AS g FROM ({u}) GROUP BY k)"


def _evl6_sql() -> str:
    names = _CMP.format(n="concepts", u=f"SELECT 1 AS s, {D.concept_key('name')} AS k FROM nodes UNION ALL SELECT 2, {D.concept_key('canonical_name')} FROM concept_reference")
    mine, gold = "SELECT src, dst FROM edges WHERE edge_type = 'REQUIRES'", "SELECT dst AS src, src AS dst FROM edges WHERE edge_type = 'UNLOCKS'"
    e = _CMP.format(n="edges", u=f"SELECT 1 AS s, src || '>' || dst AS k FROM ({mine}) UNION ALL SELECT 2, src || '>' || dst FROM ({gold})")
    u = _CMP.format(n="links", u=f"SELECT 1 AS s, least(src, dst) || '>' || greatest(src, dst) AS k FROM ({mine}) UNION ALL SELECT 2, least(src, dst) || '>' || greatest(src, dst) FROM ({gold})")
    f1 = "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0)"
    rows = " UNION ALL ".join(f"SELECT part || '_{m}' AS measure, round({v}, 6)::double AS value FROM c" for m, v in (("tp", "tp"), ("fp", "fp"), ("fn", "fn"), ("precision", _P2), ("recall", _R2), ("f1", f1)))
    return f"""WITH {GRAPH}, c AS ({names} UNION ALL {e} UNION ALL {u}), gd AS (SELECT DISTINCT src, dst FROM ({gold})), md AS (SELECT DISTINCT src, dst FROM ({mine})), a AS (SELECT count(*) FILTER ((src, dst) IN (SELECT (src, dst) FROM md)) AS r, count(*) FILTER ((dst, src) IN (SELECT (src, dst) FROM md) AND (src, dst) NOT IN (SELECT (src, dst) FROM md)) AS t FROM gd)
 {rows} UNION ALL SELECT 'direction_accuracy', round(coalesce(r::double / nullif(r + t, 0), 0.0), 6) FROM a"""


@query("evl6_gold_report", _evl6_sql())
def evl6(spark, sf):
    """The names of the graph against the reference list, and its REQUIRES edges against the UNLOCKS edges turned round, which say the same."""
    e = _e(spark, sf)
    mine, gold = e.where("edge_type = 'REQUIRES'").select("src", "dst"), e.where("edge_type = 'UNLOCKS'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return A.gold_report(_n(spark, sf).select(N.concept_key(F.col("name"))), read(spark, sf, "concept_reference", "canonical_name").select(N.concept_key(F.col("canonical_name"))), mine, gold)


@query("snk3_full_export", f"""WITH {GRAPH}, s AS (SELECT DISTINCT id, o.doc_id, o.chunk_id FROM ids JOIN okf_results o USING (rec_id) WHERE o.doc_id IS NOT NULL AND o.chunk_id IS NOT NULL) SELECT n.id, (SELECT count(*) FROM s WHERE s.id = n.id) AS n_sources, (SELECT count(*) FROM edges e WHERE e.src = n.id) AS n_edges, length(summary) AS n_summary FROM nodes n""")
def snk3(spark, sf):
    """The export read back: what each line holds."""
    o = read(spark, sf, "okf_results", "concept_name", *_K).where("trim(coalesce(concept_name, '')) <> '' and doc_id is not null and chunk_id is not null").select(G.concept_id(F.col("concept_name")).alias("id"), *_K)
    lines = A.full_export(_n(spark, sf), _e(spark, sf), o)
    back = F.from_json("line", "id string, summary string, sources array<struct<doc_id:string,chunk_id:string>>, edges array<struct<dst:string,edge_type:string>>")
    return lines.select(back.alias("x")).select("x.id", F.size("x.sources").cast("bigint").alias("n_sources"), F.size("x.edges").cast("bigint").alias("n_edges"), F.length("x.summary").cast("bigint").alias("n_summary"))


# --- graph lookups as rows ---


@query("grf5_export_sources", f"WITH {GRAPH} SELECT DISTINCT id, o.doc_id, o.chunk_id FROM ids JOIN okf_results o USING (rec_id) WHERE o.doc_id IS NOT NULL AND o.chunk_id IS NOT NULL")
def grf5(spark, sf):
    return read(spark, sf, "okf_results", "concept_name", *_K).where("trim(coalesce(concept_name, '')) <> '' and doc_id is not null and chunk_id is not null").select(G.concept_id(F.col("concept_name")).alias("id"), *_K).distinct()


@query("grf16_one_hop", f"WITH {GRAPH} SELECT e.src AS id, e.edge_type, e.dst AS neighbour, n.name FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.edge_type IN ('REQUIRES', 'UNLOCKS')")
def grf16(spark, sf):
    return _e(spark, sf).where("edge_type in ('REQUIRES', 'UNLOCKS')").join(_n(spark, sf).select(F.col("id").alias("dst"), "name"), "dst").select(F.col("src").alias("id"), "edge_type", F.col("dst").alias("neighbour"), "name")


@query("grf19_node_details", f"WITH {GRAPH} SELECT n.id, n.name, e.direction, e.edge_type, e.other FROM nodes n LEFT JOIN (SELECT src AS id, 'out' AS direction, edge_type, dst AS other FROM edges UNION ALL SELECT dst, 'in', edge_type, src FROM edges) e ON e.id = n.id")
def grf19(spark, sf):
    e = _e(spark, sf)
    both = e.select(F.col("src").alias("id"), F.lit("out").alias("direction"), "edge_type", F.col("dst").alias("other")).unionByName(e.select(F.col("dst").alias("id"), F.lit("in").alias("direction"), "edge_type", F.col("src").alias("other")))
    return _n(spark, sf).select("id", "name").join(both, "id", "left").select("id", "name", "direction", "edge_type", "other")


@query("rel6_grounded_references", f"WITH {_REFS}, {MENTIONS}, t AS (SELECT DISTINCT x.id AS a, y.id AS b FROM mentions x JOIN mentions y USING (doc_id, chunk_id)) SELECT rec_id, kind, pos FROM refs JOIN t ON refs.concept_name = t.a AND refs.target = t.b WHERE concept_name <> target")
def rel6(spark, sf):
    names = _concepts(spark, sf).select("id")
    r = L.references(read(spark, sf, "okf_results", "rec_id", "concept_name", "prerequisites", "unlocks", "related_to")).where("concept_name <> target").select("rec_id", "kind", "pos", "concept_name", "target")
    r = r.join(names.toDF("concept_name"), "concept_name", "left_semi").join(names.toDF("target"), "target", "left_semi")
    ok = B.validated(r.select(F.col("concept_name").alias("a"), F.col("target").alias("b")), _mentions(spark, sf), _K)
    return r.join(ok.toDF("concept_name", "target"), ["concept_name", "target"], "left_semi").select("rec_id", "kind", "pos")


_BELONGS = "(s = d OR starts_with(s, d || ':') OR starts_with(s, d || '/') OR s = b OR starts_with(s, b || ':') OR starts_with(s, b || '/'))"


@query("jon15_document_edges", rf"WITH {GRAPH}, dd AS (SELECT DISTINCT doc_id, replace(doc_id, '\', '/') AS d, regexp_extract(replace(doc_id, '\', '/'), '[^/]*$') AS b FROM chunks WHERE doc_id IS NOT NULL) SELECT DISTINCT src, dst, edge_type, doc_id FROM (SELECT *, replace(source, '\', '/') AS s FROM edges WHERE source IS NOT NULL) e JOIN dd ON {_BELONGS}")
def jon15(spark, sf):
    return C.document_edges(_e(spark, sf), read(spark, sf, "chunks", "doc_id"))


# --- snapshots over time ---

_DOC = "(SELECT min(doc_id) AS d FROM okf_results WHERE doc_id IS NOT NULL)"


def _one(spark, sf) -> str:
    return read(spark, sf, "okf_results", "doc_id").agg(F.min("doc_id")).first()[0] or ""


@query("cmp5_replaced_document", f"SELECT rec_id, doc_id, concept_name FROM okf_results WHERE doc_id IS NULL OR doc_id <> (SELECT d FROM {_DOC}) UNION ALL SELECT rec_id + 1000000000, doc_id, upper(concept_name) FROM okf_results WHERE doc_id = (SELECT d FROM {_DOC}) AND concept_name IS NOT NULL")
def cmp5(spark, sf):
    """A new run over the first document: its records come anew (other ids, names in capitals), those of all other documents stay."""
    o, d = read(spark, sf, "okf_results", "rec_id", "doc_id", "concept_name"), _one(spark, sf)
    new = o.where((F.col("doc_id") == d) & F.col("concept_name").isNotNull()).select((F.col("rec_id") + 1_000_000_000).alias("rec_id"), "doc_id", F.upper("concept_name").alias("concept_name"))
    return C.add_document(o, new)


@query("str6_replaced_by_jobs", "WITH n AS (SELECT DISTINCT source_filename AS d FROM ingestion_jobs WHERE source_filename IS NOT NULL) SELECT rec_id, doc_id FROM okf_results WHERE doc_id IS NULL OR doc_id NOT IN (SELECT d FROM n) UNION ALL SELECT -rec_id, doc_id FROM okf_results WHERE doc_id IN (SELECT d FROM n)")
def str6(spark, sf):
    """The documents of all jobs come anew under negative ids; a job that is run twice changes nothing."""
    o = read(spark, sf, "okf_results", "rec_id", "doc_id")
    new = o.join(read(spark, sf, "ingestion_jobs", F.col("source_filename").alias("doc_id")).distinct(), "doc_id", "left_semi").select((-F.col("rec_id")).alias("rec_id"), "doc_id")
    return C.add_document(C.add_document(o, new), new)


@query("cmp6_relations_only")
def cmp6(spark, sf):
    """The second pass over the cleaned records."""
    o = read(spark, sf, "okf_results", "rec_id", "concept_name", "prerequisites", "unlocks", "related_to", "source_passage").where(N.valid_name(F.col("concept_name")))
    return C.second_pass(o)


@query("cmp7_rebuilt_records", f"""WITH {GRAPH}, s AS (SELECT DISTINCT id, doc_id, chunk_id, page_number, section_title FROM ids JOIN okf_results o USING (rec_id)) SELECT coalesce(n.name, n.id) AS concept_name, coalesce(n.concept_type, 'definition') AS concept_type, coalesce(n.difficulty, 'intermediate') AS difficulty, coalesce(n.summary, '') AS summary, coalesce(s.doc_id, '') AS doc_id, coalesce(s.chunk_id, '') AS chunk_id, coalesce(s.page_number, 0) AS page_number, coalesce(s.section_title, '') AS section_title FROM nodes n JOIN s USING (id)""")
def cmp7(spark, sf):
    o = read(spark, sf, "okf_results", "concept_name", *_K, "page_number", "section_title").where("trim(coalesce(concept_name, '')) <> ''")
    return C.records_from_graph(_n(spark, sf), o.select(G.concept_id(F.col("concept_name")).alias("id"), *_K, "page_number", "section_title"))


def _belongs_sql(x: str) -> str:
    return rf"(replace({x}, '\', '/') = (SELECT replace(d, '\', '/') FROM {_DOC}) OR regexp_extract(replace({x}, '\', '/'), '[^/]*$') = (SELECT regexp_extract(replace(d, '\', '/'), '[^/]*$') FROM {_DOC}))"


@query("grf11_deleted_document", f"SELECT rec_id FROM okf_results WHERE doc_id IS NULL OR NOT {_belongs_sql('doc_id')}")
def grf11(spark, sf):
    return C.delete_end_to_end(_r(spark, sf), _one(spark, sf))[0].select("rec_id")


@query("grf11_remaining_graph")
def grf11b(spark, sf):
    _, n, e = C.delete_end_to_end(_r(spark, sf), _one(spark, sf))
    return n.select(F.lit("concept").alias("part"), F.col("id").alias("key")).unionByName(e.select(F.lit("edge").alias("part"), F.concat_ws(">", "src", "edge_type", "dst").alias("key")))


@query("grf12_upserted_chunks", """SELECT doc_id, chunk_id, coalesce(x.p, page_number) AS page_number, coalesce(x.s, section_title) AS section_title FROM (SELECT doc_id, chunk_id, min(page_number) AS page_number, min(section_title) AS section_title FROM chunks GROUP BY 1, 2) o
 FULL JOIN (SELECT doc_id, chunk_id, arg_max({'p': page_number, 's': section_title}, rec_id) AS x FROM okf_results WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2) n USING (doc_id, chunk_id)""")
def grf12(spark, sf):
    c = read(spark, sf, "chunks", *_K, "page_number", "section_title").groupBy(*_K).agg(F.min("page_number").alias("page_number"), F.min("section_title").alias("section_title"))
    o = read(spark, sf, "okf_results", "rec_id", *_K, "page_number", "section_title").where("doc_id is not null and chunk_id is not null")
    return C.upsert(c, o, _K, "rec_id")


@query("grf14_migrated_jobs", "SELECT job_id, status, CAST(NULL AS VARCHAR) AS owner, CAST(graph_version AS VARCHAR) AS graph_version, CAST(NULL AS DOUBLE) AS cost, cancelled FROM ingestion_jobs")
def grf14(spark, sf):
    schema = Y.StructType([Y.StructField("job_id", Y.StringType()), Y.StructField("status", Y.StringType()), Y.StructField("owner", Y.StringType()), Y.StructField("graph_version", Y.StringType()), Y.StructField("cost", Y.DoubleType())])
    return C.migrate(read(spark, sf, "ingestion_jobs", "job_id", "status", "graph_version", "cancelled"), schema)


@query("grf15_loose_matches")
def grf15(spark, sf):
    r = L.references(read(spark, sf, "okf_results", "rec_id", "concept_name", "prerequisites", "unlocks", "related_to"))
    return C.loose_match(r, read(spark, sf, "concept_reference", F.col("ref_id").cast("string").alias("id"), F.col("canonical_name").alias("name")))


@query("rel3_second_pass")
def rel3(spark, sf):
    return C.second_pass(read(spark, sf, "okf_results", "rec_id", "concept_name", "prerequisites", "unlocks", "related_to", "source_passage"))


def _low(x: str) -> str:
    return "lower(" + D.strip(f"coalesce({x}, '')") + ")"


@query("rel15_grafted_relations", f"""WITH {_REFS}, r AS (SELECT {_low('concept_name')} AS name, kind, {_low('target')} AS target, relation FROM refs), k AS (SELECT DISTINCT {_low('concept_name')} AS k FROM okf_results WHERE {_low('concept_name')} <> '')
 SELECT name, kind, target, min(relation) AS relation FROM r WHERE kind = 'unlock' AND name <> '' AND target <> '' AND name <> target AND name IN (SELECT k FROM k) AND target IN (SELECT k FROM k) GROUP BY 1, 2, 3""")
def rel15(spark, sf):
    """The whole extraction grafted onto the same records as an extraction without unlocks would have them."""
    o = read(spark, sf, "okf_results", "rec_id", "concept_name", "prerequisites", "unlocks", "related_to")
    return C.graft(o.withColumn("unlocks", F.lit(None).cast("array<string>")), o)


@query("str4_published_snapshot", f"WITH {GRAPH} SELECT 1 AS version, (SELECT count(*) FROM nodes) AS concepts, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE src = dst) AS self_edges, (SELECT count(*) FROM nodes) > 0 AND (SELECT count(*) FROM edges WHERE src = dst) = 0 AS accepted")
def str4(spark, sf):
    import uuid

    return C.publish(spark, f"{checkpoint_root(spark)}/published-{uuid.uuid4().hex}", 1, _r(spark, sf), read(spark, sf, "ingestion_jobs", "job_id", "status"))


@query("str2_merged_jobs", """WITH a AS (SELECT *, coalesce(updated_at, created_at) AS ts FROM ingestion_jobs), p AS (SELECT job_id, e.key AS stage, max({'t': ts, 'p': e.value.pct, 'd': e.value.detail}) AS r FROM (SELECT job_id, ts, unnest(map_entries(progress)) AS e FROM a) GROUP BY 1, 2), s AS (SELECT job_id, string_agg(stage || coalesce('=' || r.p, ''), ',' ORDER BY stage || coalesce('=' || r.p, '')) AS x FROM p GROUP BY 1),
 l AS (SELECT job_id, max({'t': ts, 's': lower(trim(status))}) AS r, bool_or(coalesce(cancelled, false)) AS cancelled FROM a GROUP BY 1) SELECT l.job_id, r.s AS status, cancelled, coalesce(x, '') AS stages FROM l LEFT JOIN s USING (job_id)""")
def str2(spark, sf):
    return C.merged_jobs(read(spark, sf, "ingestion_jobs", "job_id", "status", "created_at", "updated_at", "progress", "cancelled"))


@query("prj6_source_records", "SELECT rec_id, coalesce(doc_id, '') AS doc_id, coalesce(chunk_id, '') AS chunk_id, coalesce(page_number, 0) AS page_number, coalesce(section_title, '') AS section_title, coalesce(source_category, 'unknown') AS source_category, md5(coalesce(source_passage, '')) AS passage FROM okf_results")
def prj6(spark, sf):
    o = read(spark, sf, "okf_results", "rec_id", *_K, "page_number", "section_title", "source_category", "source_passage")
    return o.select("rec_id", *[F.coalesce(c, F.lit("")).alias(c) for c in _K], F.coalesce("page_number", F.lit(0)).alias("page_number"), F.coalesce("section_title", F.lit("")).alias("section_title"), F.coalesce("source_category", F.lit("unknown")).alias("source_category"), F.md5(F.coalesce("source_passage", F.lit(""))).alias("passage"))


@query("src15_concept_cache", f"WITH {GRAPH} SELECT id, name, alias FROM (SELECT id, name, unnest({D.aliases('name')}) AS alias FROM nodes)")
def src15(spark, sf):
    """The graph written as JSON and read back, with the aliases that lookups need."""
    import uuid

    path = f"{checkpoint_root(spark)}/graph-{uuid.uuid4().hex}"
    _n(spark, sf).write.json(path)
    n = spark.read.schema("id string, name string, concept_type string, difficulty string, summary string").json(path)
    return n.select("id", "name", F.explode(aliases(F.col("name"))).alias("alias"))
