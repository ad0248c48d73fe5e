"""Queries of chunking, filters, projections and names, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..operators import chunking as C
from ..operators import filters as L
from ..tables import read
from . import duck as D

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_BODY = D.strip("coalesce(text, '')")
_TITLE = f"(CASE WHEN s = '' OR regexp_matches(s, {D.q(C.PREPRINT)}) OR {D.numeric_fraction('s')} > 0.3 OR {D.alpha_ratio('s')} < 0.4 THEN '' ELSE s END)"
_KIND = rf"""CASE WHEN b = '' THEN 'empty' WHEN regexp_matches(lower(coalesce(t, '')), '^(reference|bibliograph|works cited)') THEN 'reference'
 WHEN len(list_filter(ls, lambda x: regexp_matches(x, '^\s*(\[\d+\]|\d+\.\s)')))::double / len(ls) > 0.6 THEN 'reference'
 WHEN len(list_filter(ls, lambda x: regexp_matches(x, {D.q(C.CITATION)})))::double / len(ls) > 0.85 THEN 'reference'
 WHEN {D.count_matches('b', C.EMAIL)} >= 2 AND length(b) - length(replace(b, '.', '')) < 12 THEN 'frontmatter'
 WHEN {D.numeric_fraction('b')} > 0.28 THEN 'table'
 WHEN (length(b) - length(translate(b, {D.q(C.MATH_SIGNS)}, '')))::double / length(regexp_replace(b, '\s', '', 'g')) > 0.12 OR {D.alpha_ratio('b')} < 0.55 THEN 'math' ELSE 'prose' END"""
_ANNOTATED = rf"""WITH a AS (SELECT *, {D.strip("coalesce(section_title, '')")} AS s, {_BODY} AS b FROM chunks), c AS (SELECT *, {_TITLE} AS t FROM a),
 d AS (SELECT *, list_filter(string_split_regex(b, '\r\n|\n|\r'), lambda x: regexp_matches(x, '\S')) AS ls FROM c)"""


@query("chk7_chunk_kind", f"{_ANNOTATED} SELECT doc_id, chunk_id, {_KIND.replace('coalesce(t,', 'coalesce(section_title,')} AS kind FROM d")
def chk7(spark, sf):
    c = read(spark, sf, "chunks", "doc_id", "chunk_id", "text", "section_title")
    return c.select("doc_id", "chunk_id", C.chunk_kind(F.col("text"), F.col("section_title")).alias("kind"))


@query("chk8_section_title", f"{_ANNOTATED} SELECT doc_id, chunk_id, t AS title FROM c")
def chk8(spark, sf):
    return read(spark, sf, "chunks", "doc_id", "chunk_id", "section_title").select("doc_id", "chunk_id", C.sanitize_title(F.col("section_title")).alias("title"))


@query("chk9_annotate", f"{_ANNOTATED} SELECT doc_id, chunk_id, t AS section_title, {_KIND} AS chunk_kind FROM d")
def chk9(spark, sf):
    return C.annotate(read(spark, sf, "chunks", "doc_id", "chunk_id", "section_title", "text")).select("doc_id", "chunk_id", "section_title", "chunk_kind")


@query("agg13_kind_counts", f"{_ANNOTATED} SELECT {_KIND} AS chunk_kind, count(*) AS n FROM d GROUP BY 1")
def agg13(spark, sf):
    return C.annotate(read(spark, sf, "chunks", "section_title", "text")).groupBy("chunk_kind").agg(F.count(F.lit(1)).alias("n"))


@query("chk10_numeric_fraction", f"SELECT doc_id, round({D.numeric_fraction('text')}, 6) AS fraction FROM documents")
def chk10(spark, sf):
    return read(spark, sf, "documents", "doc_id", "text").select("doc_id", F.round(T.numeric_token_fraction(F.col("text")), 6).alias("fraction"))


@query("chk11_alpha_ratio", f"SELECT doc_id, round({D.alpha_ratio('text')}, 6) AS ratio FROM documents")
def chk11(spark, sf):
    return read(spark, sf, "documents", "doc_id", "text").select("doc_id", F.round(T.alpha_ratio(F.col("text")), 6).alias("ratio"))


@query("chk12_truncate", r"""WITH a AS (SELECT doc_id, text, substring(text, 1, 1800) AS s FROM documents),
 b AS (SELECT *, reverse(s) AS r FROM a), c AS (SELECT *, length(s) - instr(r, chr(10) || chr(10)) - 1 AS p, greatest(length(s) - instr(r, ' .') - 1, length(s) - instr(r, chr(10))) AS e,
 instr(r, chr(10) || chr(10)) > 0 AS hp, instr(r, ' .') > 0 OR instr(r, chr(10)) > 0 AS he FROM b)
 SELECT doc_id, length(CASE WHEN length(text) <= 1800 THEN text WHEN hp AND p > 900 THEN s[1:p] WHEN he AND e > 900 THEN s[1:e + 1] ELSE s END) AS n,
 md5(CASE WHEN length(text) <= 1800 THEN text WHEN hp AND p > 900 THEN s[1:p] WHEN he AND e > 900 THEN s[1:e + 1] ELSE s END) AS digest FROM c""")
def chk12(spark, sf):
    t = T.truncate_at_break(F.col("text"))
    return read(spark, sf, "documents", "doc_id", "text").select("doc_id", F.length(t).alias("n"), F.md5(t).alias("digest"))


@query("chk3_text_chunks")
def chk3(spark, sf):
    return C.chunk_text(read(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")


@query("chk2_markdown_chunks", r"""WITH a AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(#{1,3}\s+.+)$', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS ps FROM documents),
 b AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS part_no FROM a), c AS (SELECT doc_id, part_no, regexp_replace(p, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS p FROM b),
 d AS (SELECT *, regexp_matches(p, '^#{1,3}\s+') AS h FROM c),
 e AS (SELECT *, coalesce(last_value(CASE WHEN h THEN trim(regexp_replace(p, '^#{1,3}\s+', '')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY part_no ROWS UNBOUNDED PRECEDING), 'Introduction') AS section_title FROM d),
 f AS (SELECT *, unnest(generate_series(0, (length(p) - 1) // 1600)) AS slice_no FROM e WHERE NOT h AND length(p) >= 200),
 g AS (SELECT *, regexp_replace(substring(p, (slice_no * 1600 + 1)::bigint, 1600), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM f)
 SELECT doc_id, part_no, slice_no, section_title, md5(t) AS digest FROM g WHERE length(t) >= 200""")
def chk2(spark, sf):
    c = C.chunk_markdown(read(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")
    return c.select("doc_id", "part_no", "slice_no", "section_title", F.md5("text").alias("digest"))


def _blocks(spark, sf):
    # a chunk is taken for a block; a change of the section opens a heading in front of it
    c = read(spark, sf, "chunks", "doc_id", "chunk_id", "section_title", "page_number", "text").distinct()
    no = F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("bigint")
    body = c.select("doc_id", (no * 2 + 1).alias("ord"), F.col("page_number").alias("page"), "text", F.lit(False).alias("heading"))
    head = c.where("trim(coalesce(section_title, '')) <> ''").select("doc_id", (no * 2).alias("ord"), F.col("page_number").alias("page"), F.col("section_title").alias("text"), F.lit(True).alias("heading"))
    return head.unionByName(body)


@query("chk1_section_chunks")
def chk1(spark, sf):
    return C.section_chunks(_blocks(spark, sf))


@query("chk5_headings", r"""SELECT doc_id, chunk_id, regexp_replace(coalesce(section_title, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS title,
 length(regexp_replace(coalesce(section_title, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) >= 2 AND (block_h > 200 + 1.5 OR regexp_matches(regexp_replace(coalesce(section_title, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^(\d+\.?\d*\.?\d*)\s+[A-Z]')
 OR regexp_matches(regexp_replace(coalesce(section_title, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '(?i)^(Chapter|Section|Appendix)\s+\w')) AS heading FROM chunks WHERE block_h IS NOT NULL""")
def chk5(spark, sf):
    c = read(spark, sf, "chunks", "doc_id", "chunk_id", "section_title", "block_h").where("block_h is not null")
    return c.select("doc_id", "chunk_id", T.strip(F.coalesce("section_title", F.lit(""))).alias("title"), C.is_heading(F.col("section_title"), F.col("block_h"), F.lit("Regular"), F.lit(200.0)).alias("heading"))


@query("chk6_body_size", """WITH s AS (SELECT doc_id, round(block_w / 100, 1) AS z, sum(length(trim(text))) AS n FROM chunks WHERE page_number <= 10 GROUP BY 1, 2),
 b AS (SELECT doc_id, arg_max(z, {'n': n, 'z': -z}) AS body_size FROM s WHERE n > 0 AND z IS NOT NULL GROUP BY 1)
 SELECT d.doc_id, round(coalesce(body_size, 10.0), 1) AS body_size FROM (SELECT DISTINCT doc_id FROM chunks) d LEFT JOIN b USING (doc_id)""")
def chk6(spark, sf):
    c = read(spark, sf, "chunks", "doc_id", "page_number", "block_w", "text").withColumn("size", F.col("block_w") / 100).withColumn("page_number", F.when(F.col("size").isNotNull(), F.col("page_number")))
    return C.body_size(c, "doc_id", "page_number", "size", "text").select("doc_id", F.round("body_size", 1).alias("body_size"))


# --- filters ---


@query("flt1_valid_name", f"SELECT rec_id, {D.valid('concept_name')} AS valid FROM okf_results")
def flt1(spark, sf):
    return read(spark, sf, "okf_results", "rec_id", "concept_name").select("rec_id", N.valid_name(F.col("concept_name")).alias("valid"))


@query("flt2_name_patterns", f"""SELECT count(*) FILTER (regexp_matches(concept_name, {D.q(N.JUNK_NAME)})) AS junk, count(*) FILTER (regexp_matches(concept_name, {D.q(N.NUMERIC_NAME)})) AS numeric_,
 count(*) FILTER (regexp_matches(concept_name, {D.q(N.FORMULA_NAME)})) AS formula FROM okf_results""")
def flt2(spark, sf):
    n = F.col("concept_name")
    return read(spark, sf, "okf_results", "concept_name").agg(F.count_if(n.rlike(N.JUNK_NAME)).alias("junk"), F.count_if(n.rlike(N.NUMERIC_NAME)).alias("numeric_"), F.count_if(n.rlike(N.FORMULA_NAME)).alias("formula"))


_BIB = rf"(s <> '' AND (regexp_matches(s, {D.q(L.BIBLIOGRAPHY)}) OR regexp_matches(lower(s), 'references|bibliography|works cited') AND length(s) < 80))"


@query("flt3_bibliography", f"SELECT doc_id, chunk_id, {_BIB} AS bibliography FROM (SELECT *, {D.strip('''coalesce(section_title, '')''')} AS s FROM chunks)")
def flt3(spark, sf):
    return read(spark, sf, "chunks", "doc_id", "chunk_id", "section_title").select("doc_id", "chunk_id", L.is_bibliography(F.col("section_title")).alias("bibliography"))


@query("flt4_domain_scope", f"""SELECT rec_id, CASE WHEN list_contains({D.items(L.DENYLIST)}, lower({D.strip("coalesce(concept_name, '')")})) THEN 'denylisted'
 WHEN regexp_matches(coalesce(source_passage, ''), {D.q(L.EXAMPLE_PASSAGE)}) THEN 'example_passage' ELSE 'kept' END AS verdict FROM okf_results""")
def flt4(spark, sf):
    return read(spark, sf, "okf_results", "rec_id", "concept_name", "source_passage").select("rec_id", L.scope_verdict(F.col("concept_name"), F.col("source_passage")).alias("verdict"))


_TERMS = ["masking", "graph", "token"]


@query("flt5_domain_terms", "SELECT rec_id, concept_name FROM okf_results WHERE list_has_any([contains(lower(concept_name), 'masking'), contains(lower(concept_name), 'graph'), contains(lower(concept_name), 'token')], [true])")
def flt5(spark, sf):
    return read(spark, sf, "okf_results", "rec_id", "concept_name").where(L.in_domain(F.col("concept_name"), _TERMS))


def _ground(passage: str) -> str:
    return f"""a AS (SELECT rec_id, lower(coalesce({passage}, '')) AS p, lower({D.strip("coalesce(concept_name, '')")}) AS n, {D.strip("coalesce(summary, '')")} AS s FROM src),
 b AS (SELECT *, contains(p, n) AS exact, {D.content_words('n')} AS nw, {D.content_words('s')} AS sw, {D.content_words('p')} AS pw FROM a),
 c AS (SELECT *, exact OR len(list_filter(nw, lambda w: contains(p, w))) > 0 AS hit, coalesce(len(list_intersect(sw, pw))::double / nullif(len(sw), 0), 0.0) AS share FROM b)
 SELECT rec_id, CASE WHEN p = '' OR n = '' THEN 'kept' WHEN NOT hit THEN CASE WHEN share >= 0.30 THEN 'rescued' ELSE 'ungrounded' END WHEN s = '' AND NOT exact THEN 'empty_summary' ELSE 'kept' END AS verdict FROM c"""


@query("flt6_grounding", f"WITH src AS (SELECT * FROM okf_results), {_ground('source_passage')}")
def flt6(spark, sf):
    return read(spark, sf, "okf_results", "rec_id", "concept_name", "summary", "source_passage").select("rec_id", L.grounding_verdict(F.col("concept_name"), F.col("summary"), F.col("source_passage")).alias("verdict"))


@query("flt7_weak_records", f"WITH ch AS (SELECT doc_id, chunk_id, min(text) AS ctext FROM chunks GROUP BY 1, 2), src AS (SELECT o.*, ch.ctext FROM okf_results o LEFT JOIN ch ON o.doc_id = ch.doc_id AND o.chunk_id = ch.chunk_id), {_ground('coalesce(ctext, source_passage)')}")
def flt7(spark, sf):
    o = read(spark, sf, "okf_results", "rec_id", "concept_name", "summary", "source_passage", "doc_id", "chunk_id")
    return L.weak_records(o, read(spark, sf, "chunks", "doc_id", "chunk_id", "text")).select("rec_id", "verdict")


@query("flt8_content_words", f"SELECT rec_id, len(w) AS n, array_to_string(list_sort(w), '|') AS words FROM (SELECT rec_id, {D.content_words('summary')} AS w FROM okf_results)")
def flt8(spark, sf):
    o = read(spark, sf, "okf_results", "rec_id", "summary").withColumn("w", T.content_words(F.col("summary")))
    return o.select("rec_id", F.size("w").alias("n"), F.array_join(F.array_sort("w"), "|").alias("words"))


_REFS = """refs AS (SELECT rec_id, concept_name, 'prereq' AS kind, generate_subscripts(prerequisites, 1) - 1 AS pos, unnest(prerequisites) AS target, 'requires' AS relation FROM okf_results
 UNION ALL SELECT rec_id, concept_name, 'unlock', generate_subscripts(unlocks, 1) - 1, unnest(unlocks), 'enables' FROM okf_results
 UNION ALL SELECT rec_id, concept_name, 'related', pos, x.concept, lower(trim(coalesce(x.relation, 'uses'))) FROM (SELECT rec_id, concept_name, generate_subscripts(related_to, 1) - 1 AS pos, unnest(related_to) AS x FROM okf_results))"""
_VERDICT = f"""v AS (SELECT *, {D.canonical('target')} AS canon FROM refs), w AS (SELECT *, CASE WHEN target IS NULL OR {D.strip('target')} = '' THEN 'invalid'
 WHEN {D.concept_key('canon')} <> '' AND {D.concept_key('canon')} = {D.concept_key('concept_name')} THEN 'self' WHEN NOT {D.valid('canon')} THEN 'invalid' ELSE 'kept' END AS verdict FROM v)"""


def _records(spark, sf, *more):
    return read(spark, sf, "okf_results", "rec_id", "concept_name", "prerequisites", "unlocks", "related_to", *more)


@query("flt9_reference_reasons", f"WITH {_REFS}, {_VERDICT} SELECT kind, verdict, count(*) AS n FROM w GROUP BY 1, 2")
def flt9a(spark, sf):
    r = L.references(_records(spark, sf)).withColumn("verdict", L.reference_verdict(F.col("target"), F.col("concept_name")))
    return r.groupBy("kind", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("flt9_pruned_references", f"""WITH {_REFS}, {_VERDICT}, k AS (SELECT rec_id, kind, pos, canon, CASE WHEN kind <> 'related' OR list_contains({D.items(L.RELATIONS)}, relation) THEN relation ELSE 'uses' END AS relation FROM w WHERE verdict = 'kept')
 SELECT rec_id, kind, relation, min(pos) AS pos, arg_min(canon, pos) AS target FROM k GROUP BY rec_id, kind, relation, lower(canon)""")
def flt9b(spark, sf):
    return L.pruned_references(L.references(_records(spark, sf)))


@query("flt10_unresolved", f"WITH {_REFS} SELECT rec_id, kind, pos, CASE WHEN target IS NULL OR {D.strip('target')} = '' THEN 'empty' WHEN lower({D.strip('target')}) = lower({D.strip('''coalesce(concept_name, '')''')}) THEN 'self' ELSE 'kept' END AS verdict FROM refs")
def flt10(spark, sf):
    return L.references(_records(spark, sf)).select("rec_id", "kind", "pos", L.unresolved_verdict(F.col("target"), F.col("concept_name")).alias("verdict"))


def _inverted(t: str, p: str, td: str, pd: str, blocked) -> str:
    pairs = D.items([f"{a}>{b}" for a, b in blocked])
    ts, ps = D.slug(f"coalesce({t}, '')"), D.slug(f"coalesce({p}, '')")
    return (
        f"({ts} = {ps} OR list_contains({pairs}, {ts} || '>' || {ps}) OR coalesce({D.rank(pd)} - {D.rank(td)} >= 2, false) OR (contains(lower(coalesce({t}, '')), 'neural network') AND regexp_matches(lower({p}), '{L.SPECIAL_NETWORKS}') "
        f"AND regexp_matches(lower({p}), 'graph|convolutional|recurrent') AND NOT regexp_matches(lower({t}), 'graph|convolutional')))"
    )


def _prereqs(blocked) -> str:
    return f"""WITH lv AS (SELECT lower(trim(concept_name)) AS n, arg_max(coalesce(difficulty, 'intermediate'), rec_id) AS d FROM okf_results WHERE concept_name IS NOT NULL GROUP BY 1),
 p AS (SELECT rec_id, concept_name, difficulty, generate_subscripts(prerequisites, 1) - 1 AS pos, unnest(prerequisites) AS prerequisite FROM okf_results)
 SELECT rec_id, pos, prerequisite, {_inverted('concept_name', 'prerequisite', "coalesce(difficulty, 'intermediate')", 'd', blocked)} AS inverted FROM p LEFT JOIN lv ON lower(p.prerequisite) = lv.n WHERE trim(coalesce(prerequisite, '')) <> ''"""


@query("flt12_inverted_prerequisites", _prereqs(L.BLOCKED_PAIRS))
def flt12(spark, sf):
    return L.prerequisite_checks(_records(spark, sf, "difficulty"))


@query("flt11_inverted_levels", f"WITH a AS ({_prereqs(L.BLOCKED_PAIRS)}) SELECT inverted, count(*) AS n FROM a GROUP BY 1")
def flt11(spark, sf):
    return L.prerequisite_checks(_records(spark, sf, "difficulty")).groupBy("inverted").agg(F.count(F.lit(1)).alias("n"))


@query("flt13_plausible_pairs", f"SELECT a.ref_id AS target, b.ref_id AS prereq, NOT {_inverted('a.canonical_name', 'b.canonical_name', 'a.difficulty', 'b.difficulty', L.BLOCKED_AT_READ)} AS plausible FROM concept_reference a JOIN concept_reference b ON a.concept_type = b.concept_type AND a.ref_id <> b.ref_id")
def flt13(spark, sf):
    r = read(spark, sf, "concept_reference", "ref_id", "canonical_name", "difficulty", "concept_type")
    a, b = r.alias("a"), r.alias("b")
    j = a.join(b, (F.col("a.concept_type") == F.col("b.concept_type")) & (F.col("a.ref_id") != F.col("b.ref_id")))
    bad = L.inverted_prerequisite(F.col("a.canonical_name"), F.col("b.canonical_name"), F.col("a.difficulty"), F.col("b.difficulty"), L.BLOCKED_AT_READ)
    return j.select(F.col("a.ref_id").alias("target"), F.col("b.ref_id").alias("prereq"), (~bad).alias("plausible"))


# --- projections ---


@query("prj1_strip_fences", r"SELECT eval_id, trim(regexp_replace(regexp_replace(regexp_replace(raw_preview, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^```[a-zA-Z]*\s*', ''), '\s*```$', '')) AS body FROM lib_qwen_ingestion_eval")
def prj1(spark, sf):
    return read(spark, sf, "lib_qwen_ingestion_eval", "eval_id", "raw_preview").select("eval_id", T.strip_fences(F.col("raw_preview")).alias("body"))


@query("prj2_json_payload", r"""WITH a AS (SELECT pair_id, trim(regexp_replace(regexp_replace(regexp_replace(output, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^```[a-zA-Z]*\s*', ''), '\s*```$', '')) AS s FROM sft_pairs),
 b AS (SELECT pair_id, s, instr(s, '[') AS a1, length(s) - instr(reverse(s), ']') + 1 AS a2, instr(s, ']') AS a3, instr(s, '{') AS o1, length(s) - instr(reverse(s), '}') + 1 AS o2, instr(s, '}') AS o3 FROM a)
 SELECT pair_id, coalesce(CASE WHEN a1 > 0 AND a3 > 0 AND a2 > a1 THEN s[a1:a2] END, CASE WHEN o1 > 0 AND o3 > 0 AND o2 > o1 THEN s[o1:o2] END) AS payload FROM b""")
def prj2(spark, sf):
    return read(spark, sf, "sft_pairs", "pair_id", "output").select("pair_id", T.json_payload(F.col("output")).alias("payload"))


@query("prj3_string_list", f"""SELECT rec_id, array_to_string(list_distinct_ordered, '|') AS items FROM (SELECT rec_id, list_filter(xs, lambda x, i: list_position(xs, x) = i) AS list_distinct_ordered
 FROM (SELECT rec_id, list_transform(list_filter(prerequisites, lambda x: x IS NOT NULL AND {D.strip('x')} <> ''), lambda x: {D.strip('x')}) AS xs FROM okf_results WHERE prerequisites IS NOT NULL))""")
def prj3(spark, sf):
    o = read(spark, sf, "okf_results", "rec_id", "prerequisites").where("prerequisites is not null")
    xs = F.transform(F.filter("prerequisites", lambda x: x.isNotNull() & (T.strip(x) != "")), T.strip)
    return o.select("rec_id", F.array_join(F.array_distinct(xs), "|").alias("items"))


@query("prj8_slug", f"SELECT DISTINCT concept_name, {D.slug('concept_name')} AS concept_id FROM okf_results WHERE concept_name IS NOT NULL")
def prj8(spark, sf):
    return read(spark, sf, "okf_results", "concept_name").where("concept_name is not null").distinct().select("concept_name", T.slug(F.col("concept_name")).alias("concept_id"))


# --- names ---

_NAMES = "(SELECT DISTINCT concept_name AS n FROM okf_results WHERE concept_name IS NOT NULL)"


def _names(spark, sf):
    return read(spark, sf, "okf_results", F.col("concept_name").alias("n")).where("n is not null").distinct()


@query("can1_concept_key", f"SELECT n, {D.concept_key('n')} AS key FROM {_NAMES}")
def can1(spark, sf):
    return _names(spark, sf).select("n", N.concept_key(F.col("n")).alias("key"))


@query("can2_same_concept", f"WITH k AS (SELECT {D.concept_key('n')} AS key, count(*) AS c FROM {_NAMES} GROUP BY 1) SELECT key, c * (c - 1) // 2 AS same_pairs FROM k WHERE key <> '' AND c > 1")
def can2(spark, sf):
    k = _names(spark, sf).groupBy(N.concept_key(F.col("n")).alias("key")).agg(F.count(F.lit(1)).alias("c"))
    return k.where("key <> '' and c > 1").select("key", F.expr("c * (c - 1) div 2").alias("same_pairs"))


@query("can3_merge_key", f"SELECT n, {D.merge_key('lower(n)')} AS key FROM {_NAMES}")
def can3(spark, sf):
    return _names(spark, sf).select("n", N.merge_key(F.lower("n")).alias("key"))


@query("can4_canonical_name", f"SELECT n, {D.canonical('n')} AS canonical FROM {_NAMES}")
def can4(spark, sf):
    return _names(spark, sf).select("n", N.canonical_name(F.col("n")).alias("canonical"))


@query("can8_acronym", f"SELECT n, {D.acronym('n')} AS acronym FROM {_NAMES}")
def can8(spark, sf):
    return _names(spark, sf).select("n", N.acronym(F.col("n")).alias("acronym"))


@query("can9_aliases", f"SELECT n, unnest({D.aliases('n')}) AS alias FROM {_NAMES}")
def can9(spark, sf):
    return _names(spark, sf).select("n", F.explode(N.aliases(F.col("n"))).alias("alias"))


@query("can16_norm_key", r"SELECT n, trim(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g')) AS key FROM " + _NAMES)
def can16(spark, sf):
    return _names(spark, sf).select("n", F.trim(F.regexp_replace(F.lower("n"), "[^a-z0-9]+", " ")).alias("key"))


@query("src12_source_category", f"SELECT DISTINCT doc_id, {D.category('doc_id')} AS category FROM okf_results")
def src12(spark, sf):
    return read(spark, sf, "okf_results", "doc_id").distinct().select("doc_id", T.source_category(F.col("doc_id")).alias("category"))
