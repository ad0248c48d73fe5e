"""Queries of deduplication, merging, aliases, joins, sets and windows over records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..operators import filters as L
from ..operators import records as R
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


def _o(spark, sf, *cols):
    return read(spark, sf, "okf_results", *cols)


_ORIGIN = "{'d': coalesce(doc_id, ''), 'c': coalesce(chunk_id, ''), 's': coalesce(section_title, ''), 'p': coalesce(page_number, 0)}"
_MKEY = D.strip("replace(replace(lower(coalesce(concept_name, '')), '-', ' '), '_', ' ')")


@query("agg1_identical_records", f"SELECT min(rec_id) AS rec_id, count(*) AS copies, count(DISTINCT {_ORIGIN}) AS n_sources FROM okf_results GROUP BY coalesce(doc_id, ''), lower({D.strip('''coalesce(concept_name, '')''')}), {D.strip('''coalesce(summary, '')''')}")
def agg1(spark, sf):
    return R.identical_survivors(_o(spark, sf, "rec_id", "doc_id", "concept_name", "summary", "chunk_id", "section_title", "page_number"))


@query("agg2_merged_concepts", f"SELECT {_MKEY} AS name_key, min(rec_id) AS rec_id, count(*) AS n_records, arg_max(coalesce(summary, ''), {{'l': length(coalesce(summary, '')), 'r': -rec_id}}) AS summary, count(DISTINCT {_ORIGIN}) AS source_count FROM okf_results GROUP BY 1")
def agg2(spark, sf):
    return R.merged_concepts(_o(spark, sf, "rec_id", "doc_id", "concept_name", "summary", "chunk_id", "section_title", "page_number"))


def _facts(pick: str) -> str:
    return f"""WITH {_REFS}, p AS (SELECT rec_id, {_MKEY} AS name_key, relation_provenance AS m, coalesce(doc_id, '') || ':' || coalesce(chunk_id, '') AS own FROM okf_results),
 r AS (SELECT name_key, kind, lower(target) AS target, rec_id, pos, coalesce(map_extract(m, kind || ':' || lower(target))[1], nullif(own, ':')) AS source FROM refs JOIN p USING (rec_id) WHERE target IS NOT NULL)
 SELECT name_key, kind, target, min(rec_id) AS rec_id, {pick}(source, {{'r': rec_id, 'p': pos}}) AS source FROM r GROUP BY 1, 2, 3"""


_FACT_COLS = ("rec_id", "concept_name", "prerequisites", "unlocks", "related_to", "relation_provenance", "doc_id", "chunk_id")


@query("agg2_merged_facts", _facts("arg_min"))
def agg2b(spark, sf):
    return R.merged_facts(_o(spark, sf, *_FACT_COLS))


@query("agg3_facts_last_wins", _facts("arg_max"))
def agg3(spark, sf):
    return R.merged_facts(_o(spark, sf, *_FACT_COLS), last_wins=True)


@query("agg3_fuzzy_names")
def agg3b(spark, sf):
    return R.fuzzy_merges(_o(spark, sf, "concept_name").select(N.canonical_name(F.col("concept_name"))), 85.0)


@query("agg3_clustered_names")
def agg3c(spark, sf):
    return R.first_seen_map(_o(spark, sf, "rec_id", "concept_name"))


@query("agg3_clustered_facts")
def agg3d(spark, sf):
    o = _o(spark, sf, *_FACT_COLS)
    return R.merged_facts(o, last_wins=True, mapping=R.first_seen_map(o))


@query("agg4_distinct_sources", f"SELECT DISTINCT coalesce(doc_id, '') AS doc_id, {D.category('doc_id')} AS category, coalesce(chunk_id, '') AS chunk_id, coalesce(page_number, 0) AS page_number, coalesce(section_title, '') AS section_title FROM okf_results")
def agg4(spark, sf):
    o = _o(spark, sf, "doc_id", "chunk_id", "page_number", "section_title")
    return o.select(F.coalesce("doc_id", F.lit("")).alias("doc_id"), T.source_category(F.col("doc_id")).alias("category"), F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), F.coalesce("page_number", F.lit(0)).alias("page_number"), F.coalesce("section_title", F.lit("")).alias("section_title")).distinct()


@query("agg10_breakdowns", """SELECT 'type' AS dimension, concept_type AS value, count(*) AS n FROM okf_results GROUP BY 2 UNION ALL SELECT 'difficulty', difficulty, count(*) FROM okf_results GROUP BY 2
 UNION ALL SELECT 'relation', x.relation, count(*) FROM (SELECT unnest(related_to) AS x FROM okf_results) GROUP BY 2""")
def agg10(spark, sf):
    o = _o(spark, sf, "concept_type", "difficulty", "related_to")
    n = F.count(F.lit(1)).alias("n")
    a = o.groupBy(F.col("concept_type").alias("value")).agg(n).select(F.lit("type").alias("dimension"), "value", "n")
    b = o.groupBy(F.col("difficulty").alias("value")).agg(n).select(F.lit("difficulty").alias("dimension"), "value", "n")
    c = o.select(F.explode("related_to").alias("x")).groupBy(F.col("x.relation").alias("value")).agg(n).select(F.lit("relation").alias("dimension"), "value", "n")
    return a.unionByName(b).unionByName(c)


@query("agg12_documents", "SELECT d.doc_id, count(c.chunk_id) AS chunk_count FROM (SELECT DISTINCT doc_id FROM okf_results WHERE doc_id IS NOT NULL UNION SELECT DISTINCT doc_id FROM chunks) d LEFT JOIN (SELECT DISTINCT doc_id, chunk_id FROM chunks) c ON d.doc_id = c.doc_id GROUP BY 1")
def agg12(spark, sf):
    c = read(spark, sf, "chunks", "doc_id", "chunk_id").distinct()
    d = _o(spark, sf, "doc_id").where("doc_id is not null").unionByName(c.select("doc_id")).distinct()
    return d.join(c, "doc_id", "left").groupBy("doc_id").agg(F.count("chunk_id").alias("chunk_count"))


@query("agg14_extracted_chunks", "SELECT count(DISTINCT {'d': doc_id, 'c': chunk_id}) AS n FROM okf_results WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL")
def agg14(spark, sf):
    return _o(spark, sf, "doc_id", "chunk_id").agg(F.count_distinct("doc_id", "chunk_id").alias("n"))


@query("agg15_filled_summaries", f"""WITH b AS (SELECT concept_name, arg_max(coalesce(summary, ''), {{'l': length(coalesce(summary, '')), 'r': -rec_id}}) AS best FROM okf_results GROUP BY 1)
 SELECT rec_id, CASE WHEN {D.strip("coalesce(summary, '')")} = '' THEN best ELSE summary END AS summary FROM okf_results JOIN b USING (concept_name)""")
def agg15(spark, sf):
    o = _o(spark, sf, "rec_id", "concept_name", "summary").where("concept_name is not null")
    s = F.coalesce("summary", F.lit(""))
    best = o.groupBy("concept_name").agg(F.max_by(s, F.struct(F.length(s), -F.col("rec_id"))).alias("best"))
    return o.join(best, "concept_name").select("rec_id", F.when(T.strip(s) == "", F.col("best")).otherwise(F.col("summary")).alias("summary"))


@query("agg16_chapters", "SELECT doc_id, section_title, min(page_number) AS page FROM chunks WHERE trim(coalesce(section_title, '')) <> '' GROUP BY 1, 2")
def agg16(spark, sf):
    return read(spark, sf, "chunks", "doc_id", "section_title", "page_number").where("trim(coalesce(section_title, '')) <> ''").groupBy("doc_id", "section_title").agg(F.min("page_number").alias("page"))


@query("agg17_dataset_stats", """SELECT split_name, count(*) AS n, round(100.0 * count(*) FILTER (regexp_matches(output, '^\\s*\\[\\s*\\]\\s*$')) / count(*), 2) AS empty_pct, round(100.0 * count(*) FILTER (contains(lower(coalesce(doc_id, '')), 'textbooks')) / count(*), 2) AS textbook_pct,
 count(DISTINCT {'d': doc_id, 'c': chunk_id}) FILTER (doc_id IS NOT NULL AND chunk_id IS NOT NULL) AS unique_chunks FROM sft_pairs GROUP BY 1""")
def agg17(spark, sf):
    p = read(spark, sf, "sft_pairs", "split_name", "output", "doc_id", "chunk_id")
    n = F.count(F.lit(1))
    return p.groupBy("split_name").agg(
        n.alias("n"), F.round(F.lit(100.0) * F.count_if(F.col("output").rlike(r"^\s*\[\s*\]\s*$")) / n, 2).alias("empty_pct"),
        F.round(F.lit(100.0) * F.count_if(F.contains(F.lower(F.coalesce("doc_id", F.lit(""))), F.lit("textbooks"))) / n, 2).alias("textbook_pct"), F.count_distinct("doc_id", "chunk_id").alias("unique_chunks"),
    )


@query("agg18_latency_percentiles", "SELECT tag, round(quantile_cont(latency_s, 0.5), 6) AS p50, round(quantile_cont(latency_s, 0.95), 6) AS p95, round(quantile_cont(latency_s, 0.99), 6) AS p99, round(avg(latency_s), 6) AS mean FROM lib_qwen_ingestion_eval GROUP BY 1")
def agg18(spark, sf):
    e = read(spark, sf, "lib_qwen_ingestion_eval", "tag", "latency_s")
    p = lambda x: F.round(F.percentile("latency_s", x), 6)
    return e.groupBy("tag").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.round(F.avg("latency_s"), 6).alias("mean"))


_SETS = f"""WITH e AS (SELECT eval_id, list_distinct(list_transform(coalesce(pred_names, []), lambda x: {D.concept_key('x')})) AS p, list_distinct(list_transform(coalesce(gold_names, []), lambda x: {D.concept_key('x')})) AS g FROM lib_qwen_ingestion_eval),
 c AS (SELECT eval_id, len(p) AS np, len(g) AS ng, len(list_intersect(p, g)) AS tp FROM e)
 SELECT eval_id, tp, np - tp AS fp, ng - tp AS fn, round(CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN np = 0 OR ng = 0 OR tp = 0 THEN 0.0 ELSE 2.0 * tp / (np + ng) END, 6) AS f1 FROM c"""


@query("agg19_set_f1", _SETS)
def agg19(spark, sf):
    e = read(spark, sf, "lib_qwen_ingestion_eval", "eval_id", "pred_names", "gold_names")
    keys = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), N.concept_key))
    e = e.select("eval_id", keys("pred_names").alias("p"), keys("gold_names").alias("g"))
    c = e.select("eval_id", F.size("p").alias("np"), F.size("g").alias("ng"), F.size(F.array_intersect("p", "g")).alias("tp"))
    f1 = F.when((F.col("np") == 0) & (F.col("ng") == 0), 1.0).when((F.col("np") == 0) | (F.col("ng") == 0) | (F.col("tp") == 0), 0.0).otherwise(F.lit(2.0) * F.col("tp") / (F.col("np") + F.col("ng")))
    return c.select("eval_id", "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn"), F.round(f1, 6).alias("f1"))


@query("agg20_tag_means", "SELECT tag, count(*) AS n, round(avg(f1_exact), 6) AS f1_exact, round(avg(f1_alias), 6) AS f1_alias, round(avg(CASE WHEN json_ok THEN 1.0 ELSE 0.0 END), 6) AS json_ok FROM lib_qwen_ingestion_eval GROUP BY 1")
def agg20(spark, sf):
    e = read(spark, sf, "lib_qwen_ingestion_eval", "tag", "f1_exact", "f1_alias", "json_ok")
    return e.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f1_exact"), 6).alias("f1_exact"), F.round(F.avg("f1_alias"), 6).alias("f1_alias"), F.round(F.avg(F.when(F.col("json_ok"), 1.0).otherwise(0.0)), 6).alias("json_ok"))


# --- canonical names and aliases over whole tables ---

_CMAP = f"""WITH c AS (SELECT n, {D.canonical('n')} AS c FROM (SELECT DISTINCT concept_name AS n FROM okf_results WHERE trim(coalesce(concept_name, '')) <> '')), k AS (SELECT *, {D.merge_key('lower(c)')} AS k FROM c),
 b AS (SELECT k, arg_min(c, {{'l': length(c), 'c': c}}) AS best FROM k WHERE length(k) > 3 GROUP BY 1) SELECT n AS name, coalesce(best, c) AS canonical FROM k LEFT JOIN b USING (k)"""


@query("can6_canonical_map", _CMAP)
def can6(spark, sf):
    return R.canonical_map(_o(spark, sf, "concept_name"))


@query("can6_fuzzy_pairs")
def can6b(spark, sf):
    return R.fuzzy_merges(_o(spark, sf, "concept_name").select(N.canonical_name(F.col("concept_name"))), 90.0)


@query("can7_mapped_references", f"WITH {_REFS}, m AS ({_CMAP}) SELECT rec_id, kind, pos, coalesce(canonical, {D.canonical('target')}) AS target FROM refs LEFT JOIN m ON refs.target = m.name WHERE target IS NOT NULL")
def can7(spark, sf):
    refs = L.references(_o(spark, sf, "rec_id", "concept_name", "prerequisites", "unlocks", "related_to")).where("target is not null")
    return R.apply_map(refs, R.canonical_map(_o(spark, sf, "concept_name"))).select("rec_id", "kind", "pos", "target")


_REF_COLS = ("rec_id", "concept_name", "prerequisites", "unlocks", "related_to")


@query("can6_clustered_map")
def can6c(spark, sf):
    return R.clustered_map(R.record_names(_o(spark, sf, *_REF_COLS)))


@query("can7_clustered_references")
def can7b(spark, sf):
    o = _o(spark, sf, *_REF_COLS)
    return R.apply_map(L.references(o).where("target is not null"), R.clustered_map(R.record_names(o))).select("rec_id", "kind", "pos", "target")


_FIXED = " UNION ALL ".join(f"SELECT {D.q(k)} AS alias, {D.q(v)} AS canonical" for k, v in N.ALIAS_MAP.items())
_INDEX = f"""n AS (SELECT ref_id AS ord, canonical_name AS name, {D.canonical('canonical_name')} AS c FROM concept_reference), x AS (SELECT ord, c, unnest(list_distinct(list_concat(list_concat({D.aliases('c')}, {D.aliases('name')}), [lower(trim(c)), lower(trim(name))]))) AS alias FROM n),
 idx AS (SELECT alias, arg_max(c, {{'o': ord, 'c': c}}) AS canonical FROM x GROUP BY 1), fx AS ({_FIXED}), al AS (SELECT * FROM idx UNION ALL SELECT * FROM fx WHERE alias NOT IN (SELECT alias FROM idx))"""


def _index(spark, sf):
    return R.alias_index(read(spark, sf, "concept_reference", "ref_id", "canonical_name"))


@query("can10_alias_index", f"WITH {_INDEX} SELECT alias, canonical FROM al")
def can10(spark, sf):
    return _index(spark, sf)


@query("can5_alias_map", f"SELECT n, {D.canonical('n')} AS canonical FROM (SELECT DISTINCT unnest(tags) AS n FROM okf_results)")
def can5(spark, sf):
    return _o(spark, sf, F.explode("tags").alias("n")).distinct().where("n is not null").select("n", N.canonical_name(F.col("n")).alias("canonical"))


_RESOLVED = f"""WITH {_INDEX}, o AS (SELECT DISTINCT concept_name AS name FROM okf_results WHERE concept_name IS NOT NULL), l AS (SELECT name, lower({D.strip('name')}) AS low FROM o),
 f AS (SELECT name, unnest([low, replace(replace(low, '-', ' '), '_', ' '), replace(low, ' ', ''), replace(low, ' ', '-')]) AS alias, unnest([0, 1, 2, 3]) AS p FROM l), h AS (SELECT name, arg_min(canonical, p) AS hit FROM f JOIN al USING (alias) GROUP BY 1)
 SELECT o.name, coalesce(hit, {D.canonical('o.name')}) AS canonical FROM o LEFT JOIN h ON o.name = h.name"""


@query("can11_resolved_names", _RESOLVED)
def can11(spark, sf):
    return R.resolve_names(_o(spark, sf, "concept_name"), _index(spark, sf))


@query("can12_equivalent_names", f"SELECT canonical, count(*) AS n_names FROM ({_RESOLVED}) GROUP BY 1")
def can12(spark, sf):
    return R.resolve_names(_o(spark, sf, "concept_name"), _index(spark, sf)).groupBy("canonical").agg(F.count(F.lit(1)).alias("n_names"))


# --- joins and sets ---


@query("jon4_replaced_records", "WITH new AS (SELECT * FROM okf_results WHERE source_category = 'papers') SELECT rec_id, doc_id FROM okf_results WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM new WHERE doc_id IS NOT NULL) UNION ALL SELECT rec_id, doc_id FROM new")
def jon4(spark, sf):
    o = _o(spark, sf, "rec_id", "doc_id", "source_category")
    return R.replace_by_key(o, o.where("source_category = 'papers'"), "doc_id").select("rec_id", "doc_id")


@query("jon16_fallback_lookup", """WITH a AS (SELECT lower(concept_name) AS n, doc_id, chunk_id, arg_min(summary, rec_id) AS s FROM okf_results GROUP BY 1, 2, 3), b AS (SELECT lower(concept_name) AS n, doc_id, arg_min(summary, rec_id) AS s FROM okf_results GROUP BY 1, 2),
 c AS (SELECT lower(concept_name) AS n, arg_min(summary, rec_id) AS s FROM okf_results GROUP BY 1), e AS (SELECT DISTINCT eval_id, doc_id, chunk_id, lower(g) AS n FROM (SELECT eval_id, doc_id, chunk_id, unnest(gold_names) AS g FROM lib_qwen_ingestion_eval))
 SELECT e.eval_id, e.n, CASE WHEN a.n IS NOT NULL THEN 'chunk' WHEN b.n IS NOT NULL THEN 'document' WHEN c.n IS NOT NULL THEN 'name' ELSE 'none' END AS level
 FROM e LEFT JOIN a ON e.n = a.n AND e.doc_id = a.doc_id AND e.chunk_id = a.chunk_id LEFT JOIN b ON e.n = b.n AND e.doc_id = b.doc_id LEFT JOIN c ON e.n = c.n""")
def jon16(spark, sf):
    o = _o(spark, sf, "rec_id", "doc_id", "chunk_id", F.lower("concept_name").alias("n"), F.coalesce("summary", F.lit("")).alias("summary")).where("n is not null")
    e = read(spark, sf, "lib_qwen_ingestion_eval", "eval_id", "doc_id", "chunk_id", F.explode("gold_names").alias("g")).select("eval_id", "doc_id", "chunk_id", F.lower("g").alias("n")).distinct()
    for level, keys in (("a", ["n", "doc_id", "chunk_id"]), ("b", ["n", "doc_id"]), ("c", ["n"])):
        e = e.join(o.groupBy(*keys).agg(F.min_by("summary", "rec_id").alias(level)), keys, "left")
    level = F.when(F.col("a").isNotNull(), "chunk").when(F.col("b").isNotNull(), "document").when(F.col("c").isNotNull(), "name").otherwise("none")
    return e.select("eval_id", "n", level.alias("level"))


_OLD = "old AS (SELECT DISTINCT lower(concept_name) AS n, concept_type AS t, difficulty AS d FROM okf_results WHERE source_category = 'textbooks'), new AS (SELECT DISTINCT lower(concept_name) AS n, concept_type AS t, difficulty AS d FROM okf_results WHERE source_category = 'papers')"


def _versions(spark, sf):
    # the inventories of two kinds of sources are compared as the old and the new version of a graph
    o = _o(spark, sf, "source_category", F.lower("concept_name").alias("n"), F.col("concept_type").alias("t"), F.col("difficulty").alias("d"))
    return o.where("source_category = 'textbooks'").select("n", "t", "d").distinct(), o.where("source_category = 'papers'").select("n", "t", "d").distinct()


@query("jon17_compare_versions", f"WITH {_OLD} SELECT coalesce(old.n, new.n) AS n, coalesce(old.t, new.t) AS t, coalesce(old.d, new.d) AS d, CASE WHEN old.n IS NULL THEN 'added' WHEN new.n IS NULL THEN 'deleted' ELSE 'same' END AS status FROM old FULL JOIN new ON old.n = new.n AND old.t = new.t AND old.d = new.d WHERE coalesce(old.t, new.t) IS NOT NULL AND coalesce(old.d, new.d) IS NOT NULL")
def jon17(spark, sf):
    old, new = _versions(spark, sf)
    j = old.where("n is not null and t is not null and d is not null").withColumn("o", F.lit(1)).join(new.where("n is not null and t is not null and d is not null").withColumn("w", F.lit(1)), ["n", "t", "d"], "full")
    return j.select("n", "t", "d", F.when(F.col("o").isNull(), "added").when(F.col("w").isNull(), "deleted").otherwise("same").alias("status"))


@query("set3_added_deleted", f"WITH {_OLD} SELECT 'added' AS side, * FROM (SELECT * FROM new EXCEPT SELECT * FROM old) UNION ALL SELECT 'deleted', * FROM (SELECT * FROM old EXCEPT SELECT * FROM new) UNION ALL SELECT 'common', * FROM (SELECT * FROM old INTERSECT SELECT * FROM new)")
def set3(spark, sf):
    old, new = _versions(spark, sf)
    tag = lambda df, s: df.select(F.lit(s).alias("side"), "n", "t", "d")
    return tag(new.subtract(old), "added").unionByName(tag(old.subtract(new), "deleted")).unionByName(tag(old.intersect(new), "common"))


@query("set1_union_records", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM okf_results UNION ALL SELECT doc_id FROM chunks) GROUP BY 1")
def set1(spark, sf):
    return _o(spark, sf, "doc_id").unionByName(read(spark, sf, "chunks", "doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("set5_split_leaks", "SELECT doc_id, chunk_id FROM sft_pairs WHERE split_name = 'train' INTERSECT SELECT doc_id, chunk_id FROM sft_pairs WHERE split_name = 'test'")
def set5(spark, sf):
    p = read(spark, sf, "sft_pairs", "doc_id", "chunk_id", "split_name")
    return p.where("split_name = 'train'").select("doc_id", "chunk_id").intersect(p.where("split_name = 'test'").select("doc_id", "chunk_id"))


@query("set6_overlap_jaccard", f"WITH a AS (SELECT rec_id, {D.content_words('summary')} AS s, {D.content_words('source_passage')} AS p FROM okf_results) SELECT rec_id, len(list_intersect(s, p)) AS common, len(list_distinct(list_concat(s, p))) AS together FROM a")
def set6(spark, sf):
    o = _o(spark, sf, "rec_id", "summary", "source_passage").select("rec_id", T.content_words(F.col("summary")).alias("s"), T.content_words(F.col("source_passage")).alias("p"))
    return o.select("rec_id", F.size(F.array_intersect("s", "p")).alias("common"), F.size(F.array_union("s", "p")).alias("together"))


# --- windows and top-k ---


@query("win1_first_and_last", "SELECT doc_id, chunk_id, arg_min(rec_id, rec_id) AS first_rec, arg_max(concept_name, rec_id) AS last_name FROM okf_results WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2")
def win1(spark, sf):
    o = _o(spark, sf, "rec_id", "doc_id", "chunk_id", "concept_name").where("doc_id is not null and chunk_id is not null")
    return o.groupBy("doc_id", "chunk_id").agg(F.min("rec_id").alias("first_rec"), F.max_by("concept_name", "rec_id").alias("last_name"))


@query("win2_running_title", """WITH c AS (SELECT DISTINCT doc_id, chunk_id, nullif(trim(coalesce(section_title, '')), '') AS t, regexp_extract(chunk_id, '(\\d+)$', 1)::bigint AS no FROM chunks)
 SELECT doc_id, chunk_id, last_value(t IGNORE NULLS) OVER w AS title, count(t) OVER w AS section_no FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY no, chunk_id, t ROWS UNBOUNDED PRECEDING)""")
def win2(spark, sf):
    c = read(spark, sf, "chunks", "doc_id", "chunk_id", "section_title").select("doc_id", "chunk_id", F.nullif(F.trim(F.coalesce("section_title", F.lit(""))), F.lit("")).alias("t"), F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("bigint").alias("no")).distinct()
    w = Window.partitionBy("doc_id").orderBy("no", "chunk_id", F.col("t").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.select("doc_id", "chunk_id", F.last("t", ignorenulls=True).over(w).alias("title"), F.count("t").over(w).alias("section_no"))


@query("win9_top_targets", f"WITH {_REFS} SELECT {D.slug('target')} AS target, count(*) AS n FROM refs WHERE target IS NOT NULL AND kind = 'prereq' GROUP BY 1 ORDER BY n DESC, target LIMIT 5")
def win9(spark, sf):
    r = L.references(_o(spark, sf, "rec_id", "concept_name", "prerequisites", "unlocks", "related_to")).where("target is not null and kind = 'prereq'")
    return r.groupBy(T.slug(F.col("target")).alias("target")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "target").limit(5)


@query("win10_examples", "SELECT concept_type, rec_id FROM (SELECT concept_type, rec_id, row_number() OVER (PARTITION BY concept_type ORDER BY rec_id) AS r FROM okf_results WHERE trim(coalesce(summary, '')) = '') WHERE r <= 25")
def win10(spark, sf):
    # the report shows at most 25 examples of each kind; the ids are kept by a bounded aggregate, not by a window over a kind
    o = _o(spark, sf, "rec_id", "concept_type", "summary").where("trim(coalesce(summary, '')) = ''")
    w = Window.partitionBy("concept_type").orderBy("rec_id")
    return o.withColumn("r", F.row_number().over(w)).where("r <= 25").select("concept_type", "rec_id")


@query("win13_longest_names", f"SELECT concept_type, canonical_name FROM (SELECT concept_type, canonical_name, row_number() OVER (PARTITION BY concept_type ORDER BY length(canonical_name) DESC, canonical_name) AS r FROM concept_reference) WHERE r <= 8")
def win13(spark, sf):
    w = Window.partitionBy("concept_type").orderBy(F.desc(F.length("canonical_name")), "canonical_name")
    return read(spark, sf, "concept_reference", "concept_type", "canonical_name").withColumn("r", F.row_number().over(w)).where("r <= 8").select("concept_type", "canonical_name")


@query("win14_seeded_quota", f"SELECT source_category, rec_id FROM (SELECT source_category, rec_id, row_number() OVER (PARTITION BY source_category ORDER BY md5('42:' || rec_id), rec_id) AS r FROM okf_results) WHERE r <= 20")
def win14(spark, sf):
    # a quota per stratum is the feature: the first of a seeded order
    w = Window.partitionBy("source_category").orderBy(F.md5(F.concat(F.lit("42:"), F.col("rec_id").cast("string"))), "rec_id")
    return _o(spark, sf, "rec_id", "source_category").withColumn("r", F.row_number().over(w)).where("r <= 20").select("source_category", "rec_id")
