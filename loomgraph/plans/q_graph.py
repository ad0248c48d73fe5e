"""Queries of graph building, audit, traversal, versions and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..tables import read
from . import duck as D
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


def _cid(x: str) -> str:
    return f"(SELECT {D.slug('cc')} FROM (SELECT {D.canonical(x)} AS cc))"


_COLS = ("rec_id", "concept_name", "concept_type", "difficulty", "summary", "prerequisites", "unlocks", "related_to", "relation_provenance", "doc_id", "chunk_id")
GRAPH = f"""{_REFS},
 ids AS (SELECT rec_id, {_cid('concept_name')} AS id, {D.canonical('concept_name')} AS name, concept_type, difficulty, coalesce(summary, '')[1:500] AS summary FROM okf_results WHERE trim(coalesce(concept_name, '')) <> ''),
 nodes AS (SELECT id, x.name AS name, x.concept_type AS concept_type, x.difficulty AS difficulty, x.summary AS summary FROM (SELECT id, arg_min({{'name': name, 'concept_type': concept_type, 'difficulty': difficulty, 'summary': summary}}, rec_id) AS x FROM ids GROUP BY 1)),
 tids AS (SELECT target, {_cid('target')} AS b FROM (SELECT DISTINCT target FROM refs WHERE trim(coalesce(target, '')) <> '')),
 e0 AS (SELECT refs.rec_id, kind, pos, relation, ids.id AS a, tids.b, coalesce(map_extract(o.relation_provenance, kind || ':' || lower(refs.target))[1], coalesce(o.doc_id, '') || ':' || coalesce(o.chunk_id, '')) AS source
  FROM refs JOIN ids USING (rec_id) JOIN tids ON refs.target = tids.target JOIN okf_results o ON o.rec_id = refs.rec_id),
 e1 AS (SELECT CASE WHEN kind = 'related' THEN least(a, b) ELSE a END AS src, CASE WHEN kind = 'related' THEN greatest(a, b) ELSE b END AS dst, CASE kind WHEN 'prereq' THEN 'REQUIRES' WHEN 'unlock' THEN 'UNLOCKS' ELSE 'RELATED' END AS edge_type,
  relation, source, rec_id, pos FROM e0 WHERE a <> b AND b IN (SELECT id FROM nodes)),
 edges AS (SELECT src, dst, edge_type, x.relation AS relation, x.source AS source FROM (SELECT src, dst, edge_type, min({{'rec_id': rec_id, 'pos': pos, 'relation': relation, 'source': source}}) AS x FROM e1 GROUP BY 1, 2, 3)),
 arcs AS (SELECT dst AS a, src AS b FROM edges WHERE edge_type = 'REQUIRES' UNION SELECT src, dst FROM edges WHERE edge_type = 'UNLOCKS'),
 ends AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges)"""


def _r(spark, sf):
    return read(spark, sf, "okf_results", *_COLS)


def _n(spark, sf):
    return G.nodes(_r(spark, sf))


def _e(spark, sf):
    return G.edges(_r(spark, sf))


@query("grf1_nodes", f"WITH {GRAPH} SELECT * FROM nodes")
def grf1a(spark, sf):
    return _n(spark, sf)


@query("grf1_edges", f"WITH {GRAPH} SELECT * FROM edges")
def grf1b(spark, sf):
    return _e(spark, sf)


@query("jon2_known_targets", f"WITH {GRAPH} SELECT edge_type, relation, count(*) AS n FROM edges GROUP BY 1, 2")
def jon2(spark, sf):
    return _e(spark, sf).groupBy("edge_type", "relation").agg(F.count(F.lit(1)).alias("n"))


@query("jon3_unknown_targets", f"WITH {GRAPH} SELECT b AS target, count(*) AS n FROM refs JOIN tids ON refs.target = tids.target WHERE b NOT IN (SELECT id FROM nodes) GROUP BY 1")
def jon3(spark, sf):
    return G.unknown_targets(_r(spark, sf))


@query("jon12_orphans", f"WITH {GRAPH} SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM ends)")
def jon12(spark, sf):
    return G.orphans(_n(spark, sf), _e(spark, sf))


@query("agg11_orphan_ratio", f"WITH {GRAPH} SELECT count(*) AS concepts, count(*) FILTER (id NOT IN (SELECT id FROM ends)) AS orphans FROM nodes")
def agg11(spark, sf):
    n = _n(spark, sf)
    o = G.orphans(n, _e(spark, sf)).withColumn("o", F.lit(1))
    return n.join(o, "id", "left").agg(F.count(F.lit(1)).alias("concepts"), F.count("o").alias("orphans"))


@query("agg5_degrees", f"WITH {GRAPH} SELECT id, count(*) AS degree FROM ends GROUP BY 1")
def agg5(spark, sf):
    return G.degrees(_e(spark, sf))


@query("agg5_clusters", f"WITH {GRAPH} SELECT concept_type, difficulty, count(*) AS n, count(*) FILTER (id IN (SELECT id FROM ends)) AS connected FROM nodes GROUP BY 1, 2")
def agg5b(spark, sf):
    d = G.degrees(_e(spark, sf))
    return _n(spark, sf).join(d, "id", "left").groupBy("concept_type", "difficulty").agg(F.count(F.lit(1)).alias("n"), F.count("degree").alias("connected"))


@query("agg6_retrieval_terms", f"""WITH {GRAPH}, t AS (SELECT id, lower(name) AS term FROM nodes UNION SELECT id, lower(concept_type) FROM nodes UNION SELECT src, lower(name) FROM edges JOIN nodes ON dst = id UNION SELECT id, lower(tag) FROM (SELECT i.id, unnest(o.tags) AS tag FROM ids i JOIN okf_results o USING (rec_id)))
 SELECT id, string_agg(term, ' | ' ORDER BY term) AS terms FROM t WHERE term IS NOT NULL GROUP BY 1""")
def agg6(spark, sf):
    n, e = _n(spark, sf), _e(spark, sf)
    tags = read(spark, sf, "okf_results", "concept_name", "tags").where("trim(coalesce(concept_name, '')) <> ''").select(G.concept_id(F.col("concept_name")).alias("id"), F.explode("tags").alias("t"))
    near = e.join(n.select(F.col("id").alias("dst"), F.col("name").alias("t")), "dst").select(F.col("src").alias("id"), "t")
    t = n.select("id", F.col("name").alias("t")).unionByName(n.select("id", F.col("concept_type").alias("t"))).unionByName(near).unionByName(tags)
    t = t.select("id", F.lower("t").alias("t")).where("t is not null").distinct()
    # the index holds a concept's terms in one cell; they are distinct before they are gathered
    return t.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("t")), " | ").alias("terms"))


@query("agg7_audit", f"""WITH {GRAPH}, k AS (SELECT id, {D.concept_key('name')} AS k FROM nodes), j AS (SELECT edges.*, s.k AS ks, d.k AS kd FROM edges LEFT JOIN k s ON src = s.id LEFT JOIN k d ON dst = d.id),
 a AS (SELECT count(*) AS concepts, count(*) FILTER (trim(summary) = '') AS empty_summaries, count(*) FILTER (id = 'concept') AS placeholders FROM nodes),
 b AS (SELECT count(*) AS edges, count(*) FILTER (src = dst OR ks = kd) AS self_edges, count(*) FILTER (NOT coalesce(regexp_matches(source, '^[^:]+:[^:]+$'), false)) AS no_provenance FROM j),
 c AS (SELECT count(*) AS mutual_requires FROM edges x JOIN edges y ON x.src = y.dst AND x.dst = y.src WHERE x.edge_type = 'REQUIRES' AND y.edge_type = 'REQUIRES' AND x.src < x.dst) SELECT * FROM a, b, c""")
def agg7(spark, sf):
    return G.audit(_n(spark, sf), _e(spark, sf))


@query("agg8_export_stats", f"WITH {GRAPH} SELECT (SELECT count(*) FROM nodes) AS concepts, count(*) AS edges, count(*) FILTER (edge_type = 'REQUIRES') AS requires, count(*) FILTER (edge_type = 'UNLOCKS') AS unlocks, count(*) FILTER (edge_type = 'RELATED') AS related FROM edges")
def agg8(spark, sf):
    c = lambda t: F.count_if(F.col("edge_type") == t)
    e = _e(spark, sf).agg(F.count(F.lit(1)).alias("edges"), c("REQUIRES").alias("requires"), c("UNLOCKS").alias("unlocks"), c("RELATED").alias("related"))
    return _n(spark, sf).agg(F.count(F.lit(1)).alias("concepts")).crossJoin(e)  # one row each


@query("agg9_proxy_accuracy", f"""WITH {GRAPH}, nm AS (SELECT DISTINCT lower(concept_name) AS n FROM okf_results), r AS (SELECT count(*) AS total, count(*) FILTER (lower(target) IN (SELECT n FROM nm)) AS known FROM refs WHERE kind <> 'related' AND target IS NOT NULL AND target <> ''),
 q AS (SELECT count(*) AS records, count(*) FILTER (concept_name <> '' AND coalesce(summary, '') <> '' AND len(prerequisites) > 0 AND len(unlocks) > 0) AS core, count(*) FILTER (concept_name <> '' AND length(concept_name) < 60 AND len({D.toks('concept_name')}) <= 8 AND NOT concept_name LIKE '%.') AS good FROM okf_results),
 c AS (SELECT count(*) AS chunks FROM chunks), o AS (SELECT count(*) AS concepts, count(*) FILTER (id IN (SELECT id FROM ends)) AS connected FROM nodes)
 SELECT round(100.0 * records / chunks, 1) AS extraction_rate, round(100.0 * core / records, 1) AS completeness_core, round(100.0 * good / records, 1) AS name_quality, round(100.0 * known / total, 1) AS relation_consistency, round(100.0 * connected / concepts, 1) AS connectivity, round((SELECT count(*) FROM edges)::double / concepts, 2) AS edge_density FROM q, r, c, o""")
def agg9(spark, sf):
    from ..functions.text import word_count
    from ..operators.filters import references

    rec = _r(spark, sf)
    refs = references(rec).where("kind <> 'related' and target is not null and target <> ''").withColumn("n", F.lower("target"))
    names = rec.select(F.lower("concept_name").alias("n")).distinct().withColumn("k", F.lit(1))
    r = refs.join(names, "n", "left").agg(F.count(F.lit(1)).alias("total"), F.count("k").alias("known"))
    nm = F.col("concept_name")
    q = rec.agg(
        F.count(F.lit(1)).alias("records"), F.count_if((nm != "") & (F.coalesce("summary", F.lit("")) != "") & (F.size("prerequisites") > 0) & (F.size("unlocks") > 0)).alias("core"),
        F.count_if((nm != "") & (F.length(nm) < 60) & (word_count(nm) <= 8) & ~nm.endswith(".")).alias("good"),
    )
    e = _e(spark, sf)
    o = _n(spark, sf).join(G.degrees(e), "id", "left").agg(F.count(F.lit(1)).alias("concepts"), F.count("degree").alias("connected"))
    j = q.crossJoin(r).crossJoin(read(spark, sf, "chunks", "doc_id").agg(F.count(F.lit(1)).alias("chunks"))).crossJoin(o).crossJoin(e.agg(F.count(F.lit(1)).alias("edges")))  # one row each
    pct = lambda a, b: F.round(F.lit(100.0) * F.col(a) / F.col(b), 1)
    return j.select(
        pct("records", "chunks").alias("extraction_rate"), pct("core", "records").alias("completeness_core"), pct("good", "records").alias("name_quality"), pct("known", "total").alias("relation_consistency"),
        pct("connected", "concepts").alias("connectivity"), F.round(F.col("edges") / F.col("concepts"), 2).alias("edge_density"),
    )


@query("set2_edge_union", f"WITH {GRAPH} SELECT src, dst, edge_type FROM edges")
def set2(spark, sf):
    e = _e(spark, sf)
    part = lambda t: e.where(F.col("edge_type") == t).select("src", "dst", "edge_type")
    return part("REQUIRES").unionByName(part("UNLOCKS")).unionByName(part("RELATED"))


@query("trv1_neighbourhood", f"""WITH RECURSIVE {GRAPH}, q AS (SELECT DISTINCT src AS a, dst AS b FROM edges WHERE edge_type = 'REQUIRES' AND src <> dst), w(a, b, depth) AS (SELECT a, b, 1 FROM q UNION ALL SELECT w.a, q.b, depth + 1 FROM w JOIN q ON w.b = q.a WHERE depth < 2)
 SELECT a, b, min(depth) AS depth FROM w WHERE a <> b GROUP BY 1, 2""")
def trv1(spark, sf):
    return G.k_hops(_e(spark, sf).where("edge_type = 'REQUIRES'").select("src", "dst"), 2)


@query("jon14_three_hops", f"""WITH RECURSIVE {GRAPH}, q AS (SELECT DISTINCT a, b FROM arcs WHERE a <> b), w(a, b, depth) AS (SELECT a, b, 1 FROM q UNION SELECT w.a, q.b, depth + 1 FROM w JOIN q ON w.b = q.a WHERE depth < 3)
 SELECT depth, count(*) AS n FROM (SELECT a, b, min(depth) AS depth FROM w WHERE a <> b GROUP BY 1, 2) GROUP BY 1""")
def jon14(spark, sf):
    return G.k_hops(G.learn_arcs(_e(spark, sf)), 3).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query("trv2_chains", f"""WITH RECURSIVE {GRAPH}, q AS (SELECT DISTINCT src AS a, dst AS b FROM edges WHERE edge_type = 'REQUIRES' AND src <> dst), w(a, p, l, hops) AS (SELECT a, [a, b], b, 1 FROM q UNION ALL SELECT w.a, list_append(p, q.b), q.b, hops + 1 FROM w JOIN q ON w.l = q.a WHERE hops < 2 AND NOT list_contains(p, q.b)),
 x AS (SELECT * FROM w WHERE hops = 2 OR NOT EXISTS (SELECT 1 FROM q WHERE q.a = w.l AND NOT list_contains(w.p, q.b))) SELECT a AS start, array_to_string(p, '>') AS path, hops FROM x""")
def trv2(spark, sf):
    return G.chains(_e(spark, sf).where("edge_type = 'REQUIRES'").select("src", "dst"), 2)


@query("trv2_chains_three_hops", SQL["trv2_chains"].replace("hops < 2", "hops < 3").replace("hops = 2", "hops = 3"))
def trv2b(spark, sf):
    return G.chains(_e(spark, sf).where("edge_type = 'REQUIRES'").select("src", "dst"))


@query("trv4_components")
def trv4a(spark, sf):
    return G.connected_components(_e(spark, sf))


@query("trv4_cyclic_core")
def trv4b(spark, sf):
    return G.cyclic_core(G.learn_arcs(_e(spark, sf)).select("before", "after"))


@query("rel12_broken_cycles")
def rel12(spark, sf):
    return G.break_cycles(G.learn_arcs(_e(spark, sf)).select("before", "after"), _n(spark, sf))


@query("rel13_math_direction", f"""WITH {GRAPH}, j AS (SELECT src, dst, edge_type, edge_type = 'UNLOCKS' AND s.difficulty IN ('advanced', 'expert') AND regexp_matches(d.name, {D.q(G.MATH_NAME)}) AND NOT regexp_matches(s.name, {D.q(G.MATH_NAME)}) AS turned FROM edges JOIN nodes s ON src = s.id JOIN nodes d ON dst = d.id)
 SELECT CASE WHEN turned THEN dst ELSE src END AS src, CASE WHEN turned THEN src ELSE dst END AS dst, edge_type, turned FROM j""")
def rel13(spark, sf):
    return G.math_direction(_e(spark, sf), _n(spark, sf))


@query("rel14_math_concepts", f"WITH {GRAPH} SELECT id, regexp_matches(name, {D.q(G.MATH_NAME)}) AS math FROM nodes")
def rel14(spark, sf):
    return _n(spark, sf).select("id", F.col("name").rlike(G.MATH_NAME).alias("math"))


_HOT = "textbooks/Maravolt2018_Foundations_Of_Machine_Reasoning_00hot.pdf"
_OWN = f"coalesce(split_part(source, ':', 1) = '{_HOT}' OR regexp_extract(split_part(source, ':', 1), '[^/]*$') = regexp_extract('{_HOT}', '[^/]*$'), false)"


@query("grf8_delete_document", f"WITH {GRAPH}, l AS (SELECT * FROM edges WHERE NOT {_OWN}), m AS (SELECT DISTINCT id FROM ids JOIN okf_results o USING (rec_id) WHERE o.doc_id IS NULL OR o.doc_id <> '{_HOT}') SELECT id FROM nodes WHERE id IN (SELECT id FROM m) OR id IN (SELECT src FROM l) OR id IN (SELECT dst FROM l)")
def grf8(spark, sf):
    m = _r(spark, sf).where("trim(coalesce(concept_name, '')) <> ''").select(G.concept_id(F.col("concept_name")).alias("id"), "doc_id")
    return G.delete_document(_n(spark, sf), _e(spark, sf), m, _HOT)[0].select("id")


@query("grf9_document_edges", f"WITH {GRAPH} SELECT src, dst, edge_type, {_OWN} AS own FROM edges")
def grf9(spark, sf):
    return _e(spark, sf).select("src", "dst", "edge_type", F.coalesce(G.belongs_to(F.col("source"), F.lit(_HOT)), F.lit(False)).alias("own"))


@query("grf7_prune_orphans", f"WITH {GRAPH}, s AS (SELECT count(*) FILTER (id NOT IN (SELECT id FROM ends))::double / count(*) AS x FROM nodes) SELECT id FROM nodes, s WHERE id IN (SELECT id FROM ends) OR x < 0.05")
def grf7(spark, sf):
    return G.prune_orphans(_n(spark, sf), _e(spark, sf), 0.05).select("id")


def _two(w: str) -> str:
    return f"SELECT {_cid('concept_name')} AS id, arg_min({{'t': concept_type, 'd': difficulty}}, rec_id) AS x FROM okf_results WHERE trim(coalesce(concept_name, '')) <> '' AND {w} GROUP BY 1"


@query("grf13_graph_diff", f"WITH o AS ({_two('''source_category = 'textbooks' ''')}), w AS ({_two('''source_category = 'papers' ''')}) SELECT coalesce(o.id, w.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN w.id IS NULL THEN 'deleted' WHEN o.x.t IS DISTINCT FROM w.x.t OR o.x.d IS DISTINCT FROM w.x.d THEN 'modified' ELSE 'same' END AS status FROM o FULL JOIN w ON o.id = w.id")
def grf13(spark, sf):
    r = read(spark, sf, "okf_results", "rec_id", "concept_name", "concept_type", "difficulty", "summary", "source_category")
    return G.diff(G.nodes(r.where("source_category = 'textbooks'")), G.nodes(r.where("source_category = 'papers'")), "id", ["concept_type", "difficulty"])


_GOLD = f"g AS (SELECT DISTINCT {D.concept_key('canonical_name')} AS k FROM concept_reference), m AS (SELECT DISTINCT {D.concept_key('concept_name')} AS k FROM okf_results WHERE concept_name IS NOT NULL)"


@query("evl1_concepts_vs_gold", f"WITH {_GOLD}, c AS (SELECT count(*) FILTER (m.k IS NOT NULL AND g.k IS NOT NULL) AS tp, count(*) FILTER (g.k IS NULL) AS fp, count(*) FILTER (m.k IS NULL) AS fn FROM m FULL JOIN g ON m.k = g.k) SELECT tp, fp, fn, round(tp::double / (tp + fp), 6) AS precision, round(tp::double / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def evl1(spark, sf):
    from ..functions.names import concept_key

    mine = read(spark, sf, "okf_results", "concept_name").where("concept_name is not null").select(concept_key(F.col("concept_name")).alias("k"))
    return G.compare_sets(mine, read(spark, sf, "concept_reference", "canonical_name").select(concept_key(F.col("canonical_name")).alias("k")), ["k"])


@query("evl2_edges_vs_gold", f"""WITH {GRAPH}, m AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'REQUIRES'), g AS (SELECT DISTINCT dst AS src, src AS dst FROM edges WHERE edge_type = 'UNLOCKS'),
 c AS (SELECT count(*) FILTER (m.src IS NOT NULL AND g.src IS NOT NULL) AS tp, count(*) FILTER (g.src IS NULL) AS fp, count(*) FILTER (m.src IS NULL) AS fn FROM m FULL JOIN g ON m.src = g.src AND m.dst = g.dst) SELECT tp, fp, fn, round(tp::double / (tp + fp), 6) AS precision, round(tp::double / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def evl2(spark, sf):
    # what one kind of edge states against what the other states the other way round
    e = _e(spark, sf)
    return G.compare_sets(e.where("edge_type = 'REQUIRES'"), e.where("edge_type = 'UNLOCKS'").select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])


@query("evl2_direction_accuracy", f"""WITH {GRAPH}, m AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'REQUIRES'), g AS (SELECT DISTINCT dst AS src, src AS dst FROM edges WHERE edge_type = 'UNLOCKS'), r AS (SELECT count(*) AS x FROM g JOIN m USING (src, dst)), t AS (SELECT count(*) AS y FROM g JOIN m ON g.src = m.dst AND g.dst = m.src WHERE NOT EXISTS (SELECT 1 FROM m z WHERE z.src = g.src AND z.dst = g.dst))
 SELECT x AS "right", y AS turned, round(coalesce(x::double / nullif(x + y, 0), 0.0), 6) AS accuracy FROM r, t""")
def evl2b(spark, sf):
    e = _e(spark, sf)
    return G.direction_accuracy(e.where("edge_type = 'REQUIRES'"), e.where("edge_type = 'UNLOCKS'").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
