"""Queries of mentions, relations, evidence and the library."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import source_category
from ..operators import evidence as V
from ..operators import graph as G
from ..operators import relations as R
from ..operators.records import alias_index
from ..tables import read
from . import duck as D
from .q_graph import GRAPH, _cid, _e
from .q_text import _REFS

QUERIES: dict = {}
SQL: dict[str, str] = {}
_K = ["doc_id", "chunk_id"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_W = r"trim(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _wf(x: str) -> str:
    return _W.format(x=x)


MENTIONS = f"""ch AS (SELECT doc_id, chunk_id, min(text) AS text FROM chunks GROUP BY 1, 2), al AS (SELECT DISTINCT id, {_wf('a')} AS alias FROM (SELECT canonical_name AS id, unnest({D.aliases('canonical_name')}) AS a FROM concept_reference)),
 cw AS (SELECT doc_id, chunk_id, ' ' || {_wf('text')} || ' ' AS w FROM ch), mentions AS (SELECT DISTINCT doc_id, chunk_id, id FROM cw JOIN al ON contains(w, ' ' || alias || ' ') WHERE length(alias) >= 2)"""


def _chunks(spark, sf, *more):
    return read(spark, sf, "chunks", *_K, "text", *more).groupBy(*_K).agg(F.min("text").alias("text"), *[F.min(c).alias(c) for c in more])


def _concepts(spark, sf, *more):
    return read(spark, sf, "concept_reference", F.col("canonical_name").alias("id"), F.col("canonical_name").alias("name"), *more)


def _mentions(spark, sf):
    return R.mentions(_chunks(spark, sf), _concepts(spark, sf), _K)


@query("jon5_mentions", f"WITH {MENTIONS} SELECT * FROM mentions")
def jon5(spark, sf):
    return _mentions(spark, sf)


@query("jon6_co_mentions", f"WITH {MENTIONS} SELECT x.id AS a, y.id AS b, count(*) AS n_chunks FROM mentions x JOIN mentions y USING (doc_id, chunk_id) WHERE x.id < y.id GROUP BY 1, 2")
def jon6(spark, sf):
    return R.co_mentions(_mentions(spark, sf), _K).select("a", "b", "n_chunks")


# edges of the record graph whose ends are in the reference list, by name
_REFEDGES = f"{GRAPH}, cr AS (SELECT canonical_name AS name, {_cid('canonical_name')} AS id FROM concept_reference), re AS (SELECT s.name AS src, d.name AS dst, edge_type, source FROM edges JOIN cr s ON edges.src = s.id JOIN cr d ON edges.dst = d.id)"


def _refedges(spark, sf):
    c = _concepts(spark, sf).select("name", G.concept_id(F.col("name")).alias("cid"))
    e = _e(spark, sf)
    return e.join(c.select(F.col("cid").alias("src"), F.col("name").alias("s")), "src").join(c.select(F.col("cid").alias("dst"), F.col("name").alias("d")), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "edge_type", "source")


_HOME = f"home AS (SELECT DISTINCT cr.name AS id, o.doc_id AS doc FROM ids JOIN cr ON ids.id = cr.id JOIN okf_results o USING (rec_id) WHERE o.doc_id IS NOT NULL)"
_CAND = f"""{_REFEDGES}, {MENTIONS}, {_HOME}, pr AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM mentions x JOIN mentions y USING (doc_id, chunk_id) WHERE x.id < y.id GROUP BY 1, 2),
 ex AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM re), sh AS (SELECT DISTINCT x.id AS a, y.id AS b FROM home x JOIN home y ON x.doc = y.doc WHERE x.id < y.id),
 cand AS (SELECT pr.a, pr.b, n + CASE WHEN sh.a IS NULL AND pr.a IN (SELECT id FROM home) AND pr.b IN (SELECT id FROM home) THEN 100 ELSE 0 END AS score FROM pr LEFT JOIN sh ON pr.a = sh.a AND pr.b = sh.b WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.a = pr.a AND ex.b = pr.b))"""


def _candidates(spark, sf):
    c = _concepts(spark, sf).select("name", G.concept_id(F.col("name")).alias("cid"))
    home = read(spark, sf, "okf_results", "concept_name", "doc_id").where("trim(coalesce(concept_name, '')) <> ''").select(G.concept_id(F.col("concept_name")).alias("cid"), "doc_id").join(c, "cid").select("name", "doc_id")
    return R.co_mention_candidates(R.co_mentions(_mentions(spark, sf), _K), _refedges(spark, sf), home)


@query("rel9_comention_candidates", f"WITH {_CAND} SELECT a, b, score FROM cand")
def rel9(spark, sf):
    return _candidates(spark, sf).select("a", "b", "score")


@query("rel9_comention_edges")
def rel9b(spark, sf):
    return R.capped_edges(_candidates(spark, sf))


@query("jon7_new_pairs", f"WITH {_CAND} SELECT score >= 100 AS cross_document, count(*) AS n FROM cand GROUP BY 1")
def jon7(spark, sf):
    return _candidates(spark, sf).groupBy((F.col("score") >= 100).alias("cross_document")).agg(F.count(F.lit(1)).alias("n"))


@query("rel5_validated_relations", f"WITH {_REFEDGES}, {MENTIONS} SELECT DISTINCT src AS a, dst AS b FROM re WHERE EXISTS (SELECT 1 FROM mentions x JOIN mentions y USING (doc_id, chunk_id) WHERE x.id = re.src AND y.id = re.dst)")
def rel5(spark, sf):
    return R.validated(_refedges(spark, sf).select(F.col("src").alias("a"), F.col("dst").alias("b")), _mentions(spark, sf), _K)


@query("rel7_directions", f"""WITH {_REFEDGES}, {MENTIONS}, c AS (SELECT canonical_name AS id, lower(trim(canonical_name)) AS n, coalesce({D.rank('difficulty')}, 2) AS r FROM concept_reference), t AS (SELECT doc_id, chunk_id, doc_id || ':' || chunk_id AS ord, lower(text) AS t FROM ch),
 near AS (SELECT doc_id, chunk_id, ord, c.id, instr(t, n) AS p FROM mentions JOIN c USING (id) JOIN t USING (doc_id, chunk_id) WHERE instr(t, n) > 0), fs AS (SELECT id, min(ord) AS o FROM near GROUP BY 1), p AS (SELECT DISTINCT src AS a, dst AS b FROM re WHERE edge_type = 'REQUIRES'),
 v AS (SELECT a, b, sum(sign(y.p - x.p)) AS score FROM p JOIN near x ON x.id = a JOIN near y ON y.id = b AND x.doc_id = y.doc_id AND x.chunk_id = y.chunk_id GROUP BY 1, 2),
 j AS (SELECT p.a, p.b, CASE WHEN coalesce(score, 0) <> 0 THEN score > 0 WHEN fa.o IS NOT NULL AND fb.o IS NOT NULL AND fa.o <> fb.o THEN fa.o < fb.o WHEN ca.r <> cb.r THEN ca.r < cb.r ELSE ca.n < cb.n END AS f
  FROM p LEFT JOIN v ON p.a = v.a AND p.b = v.b LEFT JOIN fs fa ON fa.id = p.a LEFT JOIN fs fb ON fb.id = p.b JOIN c ca ON ca.id = p.a JOIN c cb ON cb.id = p.b) SELECT a, b, CASE WHEN f THEN a ELSE b END AS first, CASE WHEN f THEN b ELSE a END AS second FROM j""")
def rel7(spark, sf):
    p = _refedges(spark, sf).where("edge_type = 'REQUIRES'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    t = _chunks(spark, sf).withColumn("ord", F.concat("doc_id", F.lit(":"), "chunk_id"))
    return R.directions(p, t, _mentions(spark, sf), _concepts(spark, sf, "difficulty"), _K)


@query("rel8_oriented_edges", f"WITH {_REFEDGES}, {MENTIONS}, v AS (SELECT DISTINCT src, dst, edge_type FROM re WHERE EXISTS (SELECT 1 FROM mentions x JOIN mentions y USING (doc_id, chunk_id) WHERE x.id = re.src AND y.id = re.dst)) SELECT edge_type, count(*) AS n FROM v GROUP BY 1")
def rel8(spark, sf):
    e, m = _refedges(spark, sf), _mentions(spark, sf)
    ok = R.validated(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), m, _K)
    return e.select("src", "dst", "edge_type").distinct().join(ok.select(F.col("a").alias("src"), F.col("b").alias("dst")), ["src", "dst"], "left_semi").groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query("rel8_edges")
def rel8b(spark, sf):
    o = read(spark, sf, "okf_results", "rec_id", "concept_name", "prerequisites", "unlocks", "related_to", "relation_provenance", *_K)
    t = _chunks(spark, sf).withColumn("ord", F.concat("doc_id", F.lit(":"), "chunk_id"))
    return R.oriented_edges(o, t, _mentions(spark, sf), _concepts(spark, sf, "difficulty"), alias_index(read(spark, sf, "concept_reference", "ref_id", "canonical_name")), _K)


@query("rel10_promoted_unlocks", f"SELECT rec_id, x.concept AS target, list_contains({D.items(R.UNLOCK_LABELS)}, lower(trim(x.relation))) AS promoted FROM (SELECT rec_id, unnest(related_to) AS x FROM okf_results) WHERE x.concept IS NOT NULL")
def rel10(spark, sf):
    o = read(spark, sf, "okf_results", "rec_id", F.explode("related_to").alias("x")).where("x.concept is not null")
    return o.select("rec_id", F.col("x.concept").alias("target"), F.lower(F.trim("x.relation")).isin(*R.UNLOCK_LABELS).alias("promoted"))


@query("rel11_trigger_unlocks")
def rel11(spark, sf):
    return R.trigger_unlocks(_chunks(spark, sf), _concepts(spark, sf), _K)


@query("rel1_passage_candidates", f"""WITH al AS (SELECT DISTINCT id, {_wf('a')} AS alias FROM (SELECT canonical_name AS id, unnest({D.aliases('canonical_name')}) AS a FROM concept_reference)), w AS (SELECT rec_id, lower(trim(concept_name)) AS o, ' ' || {_wf('source_passage')} || ' ' AS w FROM okf_results WHERE source_passage IS NOT NULL),
 m AS (SELECT DISTINCT rec_id, id, o FROM w JOIN al ON contains(w, ' ' || alias || ' ') WHERE length(alias) >= 2 AND lower(id) <> coalesce(o, '')) SELECT rec_id, id AS name FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY length(id) DESC, id) AS r FROM m) WHERE r <= 8""")
def rel1(spark, sf):
    return R.candidates_in_passage(read(spark, sf, "okf_results", "rec_id", "concept_name", "source_passage"), _concepts(spark, sf))


_CLUSTERS = {"retrieval": ["retrieval", "query", "index", "search"], "calibration": ["calibration", "estimation", "weights"], "graphs": ["graph", "node", "path", "traversal"]}


@query("ext3_keyword_chunks", f"""WITH t AS (SELECT doc_id, lower(text) AS t, len({D.toks('text')}) AS n FROM documents), s AS ({" UNION ALL ".join(f"SELECT '{c}' AS cluster, doc_id, " + " + ".join(f"contains(t, '{k}')::int" for k in ks) + " AS score FROM t WHERE n BETWEEN 40 AND 350" for c, ks in _CLUSTERS.items())})
 SELECT cluster, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, doc_id) AS r FROM s WHERE score >= 2) WHERE r <= 8""")
def ext3(spark, sf):
    return R.keyword_scores(read(spark, sf, "documents", "doc_id", "text"), "doc_id", "text", _CLUSTERS)


@query("ext2_chunk_closure", f"""WITH {_REFS}, f AS (SELECT rec_id, doc_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY rec_id) AS r FROM okf_results WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL) WHERE r <= {R.CHUNK_CONCEPTS})
 SELECT rec_id, kind, pos, target FROM refs JOIN f USING (rec_id) JOIN (SELECT DISTINCT doc_id, chunk_id, concept_name FROM okf_results) c ON f.doc_id = c.doc_id AND f.chunk_id = c.chunk_id AND refs.target = c.concept_name""")
def ext2b(spark, sf):
    return R.closed_references(read(spark, sf, "okf_results", "rec_id", *_K, "concept_name", "prerequisites", "unlocks", "related_to"))


# --- evidence and citations ---

_EV = f"WITH {MENTIONS}, ev AS (SELECT m.id, c.doc_id, c.chunk_id, min(page_number) AS page_number, min(section_title) AS section_title, min(text) AS text FROM mentions m JOIN chunks c USING (doc_id, chunk_id) GROUP BY 1, 2, 3)"


def _evidence(spark, sf):
    return V.evidence_rows(_mentions(spark, sf), _chunks(spark, sf, "page_number", "section_title"))


@query("cit1_concept_evidence", f"{_EV} SELECT id, doc_id, chunk_id, page_number FROM ev")
def cit1(spark, sf):
    return _evidence(spark, sf).select("id", "doc_id", "chunk_id", "page_number")


_Q = """round(1.0 - CASE WHEN regexp_matches(lower(coalesce(section_title, '')), 'reference|bibliograph|works cited|acknowledg') THEN 2.5 ELSE 0 END - CASE WHEN len(regexp_extract_all(lower(coalesce(text, '')), 'et al')) >= 3 OR len(regexp_extract_all(lower(coalesce(text, '')), 'arxiv')) >= 2 THEN 1.5 ELSE 0 END
 + CASE WHEN page_number > 0 AND page_number <= 5 THEN 0.4 WHEN page_number >= 200 THEN -0.2 ELSE 0 END + CASE WHEN regexp_matches(lower(coalesce(section_title, '')), 'intro|background|method|preliminar|definition') THEN 0.5 ELSE 0 END, 2)::double"""


@query("cit4_citation_quality", f"SELECT doc_id, chunk_id, {_Q} AS quality FROM chunks")
def cit4(spark, sf):
    c = read(spark, sf, "chunks", *_K, "section_title", "text", "page_number")
    return c.select(*_K, F.round(V.citation_quality(F.col("section_title"), F.col("text"), F.col("page_number")), 2).alias("quality"))


@query("cit5_best_citations", f"{_EV} SELECT id, doc_id, chunk_id, quality, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY quality DESC, doc_id, page_number, chunk_id) AS rank FROM (SELECT *, {_Q} AS quality FROM ev)) WHERE rank <= 2")
def cit5(spark, sf):
    return V.best_citations(_evidence(spark, sf)).select("id", "doc_id", "chunk_id", "quality", "rank")


@query("cit2_edge_evidence", f"""WITH {_REFEDGES}, {MENTIONS}, m AS (SELECT DISTINCT id, doc_id || ':' || chunk_id AS k FROM mentions), o AS (SELECT id, min(k) AS o FROM m GROUP BY 1), b AS (SELECT re.src, re.dst, min(x.k) AS b FROM (SELECT DISTINCT src, dst FROM re) re JOIN m x ON x.id = src JOIN m y ON y.id = dst AND x.k = y.k GROUP BY 1, 2)
 SELECT re.src, re.dst, edge_type, CASE WHEN source IN (SELECT k FROM m) THEN 'provenance' WHEN b IS NOT NULL THEN 'both' WHEN o IS NOT NULL THEN 'source' ELSE 'none' END AS level, CASE WHEN source IN (SELECT k FROM m) THEN source ELSE coalesce(b, o) END AS chunk FROM re LEFT JOIN b ON re.src = b.src AND re.dst = b.dst LEFT JOIN o ON o.id = re.src""")
def cit2(spark, sf):
    return V.edge_evidence(_refedges(spark, sf), _mentions(spark, sf))


@query("jon11_both_mentioned", f"WITH {_REFEDGES}, {MENTIONS} SELECT re.src, re.dst, count(DISTINCT x.doc_id || ':' || x.chunk_id) AS n_chunks FROM (SELECT DISTINCT src, dst FROM re) re JOIN mentions x ON x.id = src JOIN mentions y ON y.id = dst AND x.doc_id = y.doc_id AND x.chunk_id = y.chunk_id GROUP BY 1, 2")
def jon11(spark, sf):
    m = _mentions(spark, sf)
    p = _refedges(spark, sf).select("src", "dst").distinct()
    j = p.join(m.select(F.col("id").alias("src"), *_K), "src").join(m.select(F.col("id").alias("dst"), *_K), ["dst", *_K])
    return j.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_chunks"))


@query("jon10_optional_chain", f"WITH {MENTIONS} SELECT canonical_name AS name, count(doc_id) AS n_chunks, count(DISTINCT doc_id) AS n_documents FROM concept_reference LEFT JOIN mentions ON canonical_name = id GROUP BY 1")
def jon10(spark, sf):
    j = _concepts(spark, sf).select("name").join(_mentions(spark, sf).withColumnRenamed("id", "name"), "name", "left")
    return j.groupBy("name").agg(F.count("doc_id").alias("n_chunks"), F.count_distinct("doc_id").alias("n_documents"))


@query("jon13_chunks_without_document", "SELECT DISTINCT c.doc_id, c.chunk_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM okf_results o WHERE o.doc_id = c.doc_id AND o.chunk_id = c.chunk_id)")
def jon13(spark, sf):
    return read(spark, sf, "chunks", *_K).distinct().join(read(spark, sf, "okf_results", *_K).distinct(), _K, "left_anti")


_PAGE = "CASE WHEN page_label_map IS NOT NULL THEN list_sort(list_transform(list_filter(map_entries(page_label_map), lambda e: e.value = page_number), lambda e: e.key))[1] END"


@query("cit8_printed_page", f"SELECT doc_id, chunk_id, {_PAGE} AS printed, coalesce('p. ' || {_PAGE}, CASE WHEN page_number > 0 THEN 'PDF page ' || page_number END, '') AS display FROM chunks")
def cit8(spark, sf):
    c = read(spark, sf, "chunks", *_K, "page_label_map", "page_number")
    return c.select(*_K, V.printed_page(F.col("page_label_map"), F.col("page_number")).alias("printed"), V.page_display(F.col("page_label_map"), F.col("page_number")).alias("display"))


@query("cit12_page_links", "SELECT DISTINCT doc_id, page_number, '[' || replace(coalesce(doc_title, doc_id, 'source'), ']', '\\]') || '](/pdfs/' || replace(doc_id, ' ', '%20') || CASE WHEN page_number > 0 THEN '#page=' || page_number ELSE '' END || ')' AS link FROM chunks")
def cit12(spark, sf):
    c = read(spark, sf, "chunks", "doc_id", "page_number", "doc_title")
    return c.select("doc_id", "page_number", V.markdown_link(F.col("doc_title"), F.col("doc_id"), F.col("page_number")).alias("link")).distinct()


@query("cit3_evidence_contract", "SELECT doc_id, chunk_id, block_x IS NOT NULL AND block_y IS NOT NULL AND block_w IS NOT NULL AND block_h IS NOT NULL AS has_box, text_offset_end - text_offset_start AS span FROM chunks")
def cit3(spark, sf):
    c = read(spark, sf, "chunks", *_K, "block_x", "block_y", "block_w", "block_h", "text_offset_start", "text_offset_end")
    return c.select(*_K, V.bounding_box(*[F.col(x) for x in ("block_x", "block_y", "block_w", "block_h")]).isNotNull().alias("has_box"), (F.col("text_offset_end") - F.col("text_offset_start")).alias("span"))


@query("cit6_evidence_ids", f"{_EV} SELECT doc_id, id, 'S' || row_number() OVER (PARTITION BY doc_id ORDER BY page_number, chunk_id, id) AS evidence_id FROM ev")
def cit6(spark, sf):
    w = Window.partitionBy("doc_id").orderBy("page_number", "chunk_id", "id")
    return _evidence(spark, sf).select("doc_id", "id", F.concat(F.lit("S"), F.row_number().over(w).cast("string")).alias("evidence_id"))


@query("cit9_cited_ids", r"SELECT doc_id, chunk_id, coalesce(array_to_string(list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(section_title || ' S2 S10 S2 S' || page_number, '\bS(\d+)\b', 1)), lambda x: x::int)), lambda x: 'S' || x), ' '), '') AS cited FROM chunks WHERE section_title IS NOT NULL")
def cit9(spark, sf):
    c = read(spark, sf, "chunks", *_K, "section_title", "page_number").where("section_title is not null")
    return c.select(*_K, F.array_join(V.cited_ids(F.concat("section_title", F.lit(" S2 S10 S2 S"), F.col("page_number").cast("string"))), " ").alias("cited"))


@query("cit13_snippets", r"WITH a AS (SELECT doc_id, chunk_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM chunks) SELECT doc_id, chunk_id, (CASE WHEN regexp_extract(t, '^(.+?[.!?])(\s|$)', 1) = '' THEN t ELSE regexp_extract(t, '^(.+?[.!?])(\s|$)', 1) END)[1:140] AS snippet FROM a")
def cit13(spark, sf):
    return read(spark, sf, "chunks", *_K, "text").select(*_K, V.first_sentence(F.col("text")).alias("snippet"))


@query("cit16_sterile_text", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\$\$[^$]*\$\$|\$[^$\n]*\$', ' ', 'g'), '\\[a-zA-Z]+\*?', ' ', 'g'), '[{}\\]', '', 'g'), '[ \t]+', ' ', 'g'))) AS digest FROM documents")
def cit16(spark, sf):
    return read(spark, sf, "documents", "doc_id", "text").select("doc_id", F.md5(V.strip_latex(F.col("text"))).alias("digest"))


# --- library ---


def _lib(w: dict, books: bool) -> str:
    case = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in w.items()) + " ELSE 1.0 END"
    boost = " * CASE WHEN contains(lower(doc_id), 'textbooks/') THEN 1.35 ELSE 1.0 END * CASE WHEN regexp_matches(lower(doc_id), 'syllab|seed') THEN 1.15 ELSE 1.0 END * CASE WHEN starts_with(lower(doc_id), 'papers/') OR category = 'paper' THEN 0.85 ELSE 1.0 END" if books else ""
    return f"WITH {MENTIONS}, n AS (SELECT id, doc_id, count(*) AS mentions, {D.category('doc_id')} AS category FROM mentions GROUP BY 1, 2) SELECT id, doc_id, mentions, round((1.0 + mentions)::double * {case}{boost}, 6) AS score FROM n"


def _category(spark, sf):
    return read(spark, sf, "chunks", "doc_id").distinct().withColumn("category", source_category(F.col("doc_id")))


@query("lib4_books_for_topic", _lib(V.BOOK_WEIGHTS, True))
def lib4(spark, sf):
    return V.document_scores(_mentions(spark, sf), _category(spark, sf))


@query("lib5_papers_for_topic", _lib(V.PAPER_WEIGHTS, False))
def lib5(spark, sf):
    return V.document_scores(_mentions(spark, sf), _category(spark, sf), prefer_papers=True)


@query("win7_top_books", f"SELECT id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, mentions DESC, doc_id) AS r FROM ({_lib(V.BOOK_WEIGHTS, True)})) WHERE r <= 5")
def win7(spark, sf):
    w = Window.partitionBy("id").orderBy(F.desc("score"), F.desc("mentions"), "doc_id")
    return V.document_scores(_mentions(spark, sf), _category(spark, sf)).withColumn("r", F.row_number().over(w)).where("r <= 5").select("id", "doc_id", "score")


@query("lib7_chapters_with_concept", f"WITH {MENTIONS} SELECT m.id, c.doc_id, c.section_title, min(c.page_number) AS page FROM mentions m JOIN chunks c USING (doc_id, chunk_id) WHERE trim(coalesce(c.section_title, '')) <> '' GROUP BY 1, 2, 3")
def lib7(spark, sf):
    c = read(spark, sf, "chunks", *_K, "section_title", "page_number").where("trim(coalesce(section_title, '')) <> ''")
    return _mentions(spark, sf).join(c, _K).groupBy("id", "doc_id", "section_title").agg(F.min("page_number").alias("page"))


@query("lib9_chapter_listing", r"""WITH a AS (SELECT doc_id, section_title, min(page_number) AS page FROM chunks WHERE trim(coalesce(section_title, '')) <> '' GROUP BY 1, 2), b AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page, section_title) AS r FROM a)
 SELECT doc_id, section_title, page FROM b WHERE CASE WHEN n > 40 THEN NOT regexp_matches(section_title, '^\d+\.\d') ELSE r <= 40 END""")
def lib9(spark, sf):
    c = read(spark, sf, "chunks", "doc_id", "section_title", "page_number").where("trim(coalesce(section_title, '')) <> ''").groupBy("doc_id", "section_title").agg(F.min("page_number").alias("page"))
    n = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("doc_id").orderBy("page", "section_title")
    c = c.join(n, "doc_id").withColumn("r", F.row_number().over(w))
    return c.where(F.when(F.col("n") > 40, ~F.col("section_title").rlike(r"^\d+\.\d")).otherwise(F.col("r") <= 40)).select("doc_id", "section_title", "page")


@query("lib8_document_titles", r"""SELECT DISTINCT doc_id, trim(regexp_replace(replace(replace(regexp_replace(regexp_extract(doc_id, '[^/]*$'), '\.\w+$', ''), '_', ' '), '-', ' '), '\s+', ' ', 'g')) AS title FROM chunks""")
def lib8(spark, sf):
    t = F.regexp_replace(F.substring_index("doc_id", "/", -1), r"\.\w+$", "")
    t = F.trim(F.regexp_replace(F.replace(F.replace(t, F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" ")), r"\s+", " "))
    return read(spark, sf, "chunks", "doc_id").distinct().select("doc_id", t.alias("title"))
