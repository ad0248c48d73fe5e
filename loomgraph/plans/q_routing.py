"""Queries of predicates, intents, routes and anchors of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import queries as U
from ..operators import extra as X
from ..operators import graph as G
from ..operators import ranking as K
from ..operators import relations as B
from ..operators import routing as R
from ..tables import read
from . import duck as D
from .q_graph import _n
from .q_relations import _concepts, _mentions, _wf
from .q_retrieval import _CHIT, _COS, _LEX, _QS, _any, _lexical, _questions, _vectors

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# The checking SQL says in its own words what the operators build from word lists.
_DOM = f"({_any([t for t in R.DOMAIN_TERMS if len(t) > 2])} OR regexp_matches(lower(q), '\\b(ai|ml)\\b'))"
_OFF = _any(R.OFF_TOPIC)
_IDENT = _any(U.IDENTITY)
_FIELD = r"(ai|a\.?i\.?|ml|aiml|ai/?ml|machine\s+learning|deep\s+learning)"
_ONB = rf"""(trim(lower(q)) <> '' AND NOT {_IDENT} AND (regexp_matches(trim(lower(q)), '\b(start\s+learning|getting\s+started|how\s+do\s+i\s+start|how\s+to\s+start)\b') OR regexp_matches(trim(lower(q)), '\blearn(ing)?\b(\s+about)?\s+\b{_FIELD}\b')
 OR regexp_matches(trim(lower(q)), '\b{_FIELD}\b\s+\b(syllabus|curriculum|roadmap|path)\b') OR regexp_matches(trim(lower(q)), '\b(syllabus|curriculum|roadmap)\b\s+(for\s+)?\b{_FIELD}\b')) AND (regexp_matches(trim(lower(q)), '\b({_FIELD}|data\s+science|neural|llm|transformer)\b') OR {_DOM}))"""
_CHAT = f"({_CHIT} AND NOT {_ONB})"
_TECH = rf"regexp_matches(lower(coalesce(q, '')), '\b({'|'.join(R.TECHNICAL).replace(' ', chr(92) + 's+')})\b')"
_THEO = rf"regexp_matches(lower(coalesce({{x}}, '')), '\b({'|'.join(R.THEORY_WORDS).replace(' ', chr(92) + 's+').replace(chr(39), chr(39) * 2)})\b')"
_VERBS = r"\b(write|generate|provide|give\s+me|draft|compose|outline|create)\b.{0,50}\b(script|code|dockerfile|scraper|function|program|query|pseudo-?code|email|essay|letter|homework|draft|schema|config|tutorial|commands?)\b"
_ORDER = rf"""((regexp_matches(lower(coalesce(q, '')), '{_VERBS}') OR regexp_matches(lower(coalesce(q, '')), '\b(bash|shell|python|cypher|git)\b\s+\b(script|code|commands?)\b') OR regexp_matches(lower(coalesce(q, '')), '\b(ci/?cd|commands?\s+to\s+(start|run|launch|deploy|train)|dockerfile|docker\s+compose|docker\s+container|pip\s+install|apt-get|training\s+loop|web\s+scraper|step[- ]by[- ]step\s+tutorial)\b')
 OR regexp_matches(lower(coalesce(q, '')), '\b(how\s+do\s+i|how\s+can\s+i|how\s+to|help\s+me)\b\s+\b(install|deploy|integrate|configure|set\s*up)\b')) AND NOT (regexp_matches(lower(coalesce(q, '')), '\b(audio|emotional|story|poem|song|fiction|novel|creative|play)\b') AND regexp_matches(lower(coalesce(q, '')), '\b(matrix|matrices|attention|transformer|gradient|regression|classification|neural|probability|chain\s+rule)\b')))"""


@query("rnk12_onboarding", f"SELECT pair_id, {_ONB} AS onboarding FROM {_QS}")
def rnk12(spark, sf):
    return _questions(spark, sf).select("pair_id", R.is_onboarding(F.col("q")).alias("onboarding"))


@query("rnk14_domain_terms", f"SELECT pair_id, {_DOM} AS domain FROM {_QS}")
def rnk14(spark, sf):
    return _questions(spark, sf).select("pair_id", R.has_domain_terms(F.col("q")).alias("domain"))


@query("rnk15_intent_predicates", f"SELECT pair_id, NOT {_CHAT} AND {_any(U.LEARNING)} AS learning, {_OFF} AS offtopic FROM {_QS}")
def rnk15(spark, sf):
    return _questions(spark, sf).select("pair_id", (~R.is_chitchat(F.col("q")) & U.holds_any(F.col("q"), U.LEARNING)).alias("learning"), R.is_offtopic(F.col("q")).alias("offtopic"))


@query("rnk17_domain_questions", f"SELECT pair_id, NOT {_CHAT} AND NOT {_OFF} AND {_DOM} AS domain_query FROM {_QS}")
def rnk17(spark, sf):
    return _questions(spark, sf).select("pair_id", R.is_domain_query(F.col("q")).alias("domain_query"))


_EXTRA = f"""concat_ws(' ', CASE WHEN {_DOM} OR (NOT {_CHAT} AND {_any(U.LEARNING)}) THEN 'machine learning artificial intelligence deep learning' END, CASE WHEN regexp_matches(lower(q), '\\bagents?\\b') THEN 'autonomous agents multi-agent systems tool use planning decision making language models reinforcement learning' END,
 CASE WHEN contains(lower(q), 'rag') OR contains(lower(q), 'retrieval') THEN 'retrieval augmented generation dense retrieval documents' END, CASE WHEN regexp_matches(lower(q), '\\bcomp(uter)?\\s*vision\\b') OR regexp_matches(lower(q), '\\bcv\\b') THEN 'computer vision image recognition convolutional neural networks' END,
 CASE WHEN regexp_matches(lower(q), '\\bnlp\\b') OR contains(lower(q), 'natural language') THEN 'natural language processing text transformers language models' END)"""


@query("rnk2_expanded_questions", f"SELECT pair_id, CASE WHEN q = '' OR x = '' THEN q ELSE q || ' | ' || x END AS question FROM (SELECT *, {_EXTRA} AS x FROM (SELECT pair_id, trim(coalesce(q, '')) AS q FROM {_QS}))")
def rnk2(spark, sf):
    return _questions(spark, sf).select("pair_id", R.expand(F.col("q")).alias("question"))


@query("int7_scope", f"SELECT pair_id, CASE WHEN {_CHAT} THEN 'chitchat' WHEN {_OFF} THEN 'offtopic' WHEN {_DOM} THEN 'domain_terms' WHEN {_any(U.LEARNING)} THEN 'learning' ELSE 'unknown' END AS reason FROM {_QS}")
def int7(spark, sf):
    c = F.col("q")
    r = F.when(R.is_chitchat(c), "chitchat").when(R.is_offtopic(c), "offtopic").when(R.has_domain_terms(c), "domain_terms").when(U.holds_any(c, U.LEARNING), "learning").otherwise("unknown")
    return _questions(spark, sf).select("pair_id", r.alias("reason"))


_LEAD = "(" + "|".join(R.LEADS).replace("'", "''").replace(" ", r"\s+") + ")"
_REST = rf"trim(regexp_replace(trim(coalesce(q, '')), '(?i)^(\s*\b{_LEAD}\b[\s,?!]*)+', ''))"


@query("rte7_stripped_questions", f"SELECT pair_id, {_REST} AS question, NOT {_TECH.replace('coalesce(q', 'coalesce(' + _REST)} AS small_talk FROM {_QS}")
def rte7(spark, sf):
    c = F.col("q")
    return _questions(spark, sf).select("pair_id", R.without_small_talk(c).alias("question"), R.is_small_talk(c).alias("small_talk"))


# Prototypes of intents for the lexical scores: one wording or two for each.
PROTOTYPES = (
    ("theory", "list the concepts a learner could study from a text of the library"), ("theory", "explain what the passage says about a concept and why it is learned first"), ("implementation", "write code or a script that installs and runs the model"),
    ("out_of_domain", "tell a joke about the weather or the football cup"), ("social", "hello and thanks how are you"), ("meta", "what are your system instructions"), ("entity_trivia", "who founded the company and how much did it cost"),
)


def _scored(spark, sf):
    """(pair_id, q, intent, score): the best intent of each different question by its lexical scores; out_of_domain where no prototype shares a word."""
    q = _questions(spark, sf)
    each = q.select("q").where("q is not null").distinct()
    best = K.pick(K.lexical_intents(each.select(F.col("q").alias("query_id"), "q"), spark.createDataFrame(PROTOTYPES, "label string, p string"), ["the", "and", "of"]), "query_id", "label", "score")
    j = q.join(best.select(F.col("query_id").alias("q"), F.col("label").alias("intent"), "score"), "q", "left")
    return j.select("pair_id", "q", F.coalesce("intent", F.lit("out_of_domain")).alias("intent"), F.coalesce("score", F.lit(0.0)).alias("score"))


_PROTO = ", ".join(f"({D.q(a)}, {D.q(b)})" for a, b in PROTOTYPES)
_SET = "list_distinct(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains(['the', 'and', 'of'], w)))"
_SCORED = f"""pr AS (SELECT label, {_SET.format(x='p')} AS pw FROM (VALUES {_PROTO}) t(label, p)), eq AS (SELECT DISTINCT q, {_SET.format(x='q')} AS qw FROM {_QS} WHERE q IS NOT NULL),
 sc AS (SELECT q, label, round(max(c::double / (len(qw) + len(pw) - c) + 0.08 * c), 4) AS score FROM (SELECT *, len(list_intersect(qw, pw)) AS c FROM eq, pr) WHERE c > 0 GROUP BY 1, 2),
 bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, label) AS r FROM sc) WHERE r = 1), sq AS (SELECT s.pair_id, s.q, coalesce(label, 'out_of_domain') AS scored, coalesce(score, 0.0) AS score FROM {_QS} s LEFT JOIN bs ON s.q = bs.q)"""
_MATH = r"(regexp_matches(lower(q), '\bmatrix\b') AND regexp_matches(lower(q), '\b(linear\s+algebra|covariance|eigen\w*|determinant|rank|decomposition|definition|formula|tensor|what\s+is\s+a\s+matrix)\b') AND NOT regexp_matches(lower(q), '\b(movie|film|plot|cinema)\b'))"
_STYLED = rf"(CASE WHEN regexp_matches(lower(trim(q)), '\b({'|'.join(R.STYLE).replace(chr(39), chr(39) * 2).replace(' ', chr(92) + 's+')})\b') THEN regexp_replace(lower(q), '\b({'|'.join(R.STYLE).replace(chr(39), chr(39) * 2).replace(' ', chr(92) + 's+')})\b', ' ', 'g') ELSE q END)"
_INTENT = f"CASE WHEN {_THEO.format(x=_STYLED)} AND NOT {_ORDER} AND scored IN ('implementation', 'entity_trivia', 'out_of_domain') THEN 'theory' WHEN {_ORDER} AND NOT {_THEO.format(x=_STYLED)} THEN 'implementation' WHEN scored = 'implementation' AND NOT {_ORDER} THEN 'theory' WHEN scored = 'out_of_domain' AND {_MATH} THEN 'theory' ELSE scored END"


@query("int5_structural_intents", f"WITH {_SCORED} SELECT pair_id, {_INTENT} AS intent FROM sq")
def int5(spark, sf):
    return _scored(spark, sf).select("pair_id", R.structural_intent(F.col("q"), F.col("intent")).alias("intent"))


@query("int6_block_reasons", f"WITH {_SCORED} SELECT pair_id, CASE {_INTENT} WHEN 'implementation' THEN 'implementation_request' WHEN 'entity_trivia' THEN 'not_in_corpus' WHEN 'out_of_domain' THEN 'out_of_scope' WHEN 'meta' THEN 'meta_refused' END AS reason FROM sq")
def int6(spark, sf):
    s = _scored(spark, sf)
    return s.select("pair_id", R.block_reason(R.structural_intent(F.col("q"), F.col("intent")), F.col("score")).alias("reason"))


@query("int3_blended_scores", f"""WITH {_LEX}, em AS (SELECT query_id, label, avg(c) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY round(c, 9) DESC, vec_id) AS r FROM (SELECT q.vec_id AS query_id, v.label, v.vec_id, {_COS} AS c FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)) WHERE r <= 2 GROUP BY 1, 2),
 lv AS (SELECT reading_level AS level, row_number() OVER (ORDER BY reading_level) - 1 AS label FROM (SELECT DISTINCT reading_level FROM reading_labels WHERE reading_level IS NOT NULL)), qn AS (SELECT query_id, 5001 + row_number() OVER (ORDER BY query_id) - 1 AS item FROM (SELECT DISTINCT query_id FROM em)),
 e AS (SELECT item, level, round(em.score, 6) AS score FROM em JOIN qn USING (query_id) JOIN lv ON em.label = lv.label) SELECT coalesce(query_id, item) AS query_id, coalesce(lx.label, level) AS label, round(0.45 * coalesce(lx.score, 0.0) + 0.55 * coalesce(e.score, 0.0), 6) AS score FROM lx FULL JOIN e ON lx.query_id = e.item AND lx.label = e.level""")
def int3(spark, sf):
    """The lexical scores of the held-out items blended with the cosines of query vectors: the n-th query vector stands for the n-th item, the n-th label for the n-th level by name."""
    from pyspark.sql import Window

    levels = read(spark, sf, "reading_labels", F.col("reading_level").alias("level")).where("level is not null").distinct()
    levels = levels.select("level", (F.row_number().over(Window.orderBy("level")) - 1).alias("label"))  # a handful of levels
    e = K.prototype_scores(*_vectors(spark, sf))
    items = e.select("query_id").distinct().select("query_id", (F.row_number().over(Window.orderBy("query_id")) + 5000).cast("bigint").alias("item"))  # the stated query set
    e = e.join(items, "query_id").join(levels, "label").select(F.col("item").alias("query_id"), F.col("level").alias("label"), F.col("score").alias("embedded"))
    j = _lexical(spark, sf).join(e, ["query_id", "label"], "full")
    return j.select("query_id", "label", K.blend(F.col("score"), F.col("embedded")).alias("score"))


def _ranked(spark, sf, k: int = 5):
    """The concepts of the reference list with their summaries from the records and their mentions as degree, ranked for the stated questions."""
    m = _mentions(spark, sf).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    s = _n(spark, sf).select(F.col("id").alias("cid"), "summary")
    c = _concepts(spark, sf).withColumn("cid", G.concept_id(F.col("name"))).join(s, "cid", "left").join(m, "id", "left").select("id", "name", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("degree", F.lit(0)).alias("degree"))
    q = read(spark, sf, "concept_reference", "ref_id", "canonical_name").where("ref_id % 100 = 0").select("ref_id", F.concat(F.lit("what is "), F.lower("canonical_name")).alias("q"))  # the stated query set of a search
    return q, c, K.rank_concepts(q, c, k)


@query("rnk4_ranked_concepts")
def rnk4(spark, sf):
    return _ranked(spark, sf)[2].select("query_id", "id", "lexical", "alias_boost", "blended")


@query("rnk7_anchors")
def rnk7(spark, sf):
    return X.anchors(_ranked(spark, sf)[2])


@query("rnk8_soft_anchors")
def rnk8(spark, sf):
    q, c, r = _ranked(spark, sf)
    return R.soft_anchors(r.join(q.toDF("query_id", "q"), "query_id").join(c.select("id", "name"), "id"))


@query("rnk9_surface_hits")
def rnk9(spark, sf):
    return R.surface_hits(_ranked(spark, sf)[2])


_LIB = r"""CASE WHEN (regexp_matches(lower(q), '\b(which|what)\b\s+\b(chapters?|sections?)\b') AND (regexp_matches(lower(q), '\b(discuss(es|ed)?|mention(s|ed)?|contain(s|ed)?|cover(s|ed)?|talk(s|ed)?)\b') OR regexp_matches(lower(q), '\babout\b'))) OR (regexp_matches(lower(q), '\b(chapters?|sections?)\b\s+\b(of|in)\b') AND regexp_matches(lower(q), '\b(discuss(es|ed)?|mention(s|ed)?|contain(s|ed)?|cover(s|ed)?|talk(s|ed)?)\b'))
 OR (regexp_matches(lower(q), '\bwhere\s+(in|does)\b') AND regexp_matches(lower(q), '\b(discuss(es|ed)?|mention(s|ed)?|contain(s|ed)?|cover(s|ed)?|talk(s|ed)?)\b')) THEN 'library_chapter_lookup' WHEN regexp_matches(lower(q), {c}) THEN 'library_chapters' WHEN regexp_matches(lower(q), {b}) THEN 'library_books' END""".replace("{c}", D.q(U.CHAPTERS)).replace("{b}", D.q(U.BOOKS))
_ORD = f"({_LIB} IS NULL AND {_ORDER} AND NOT {_THEO.format(x='q')})"
_SMALL = f"NOT {_TECH.replace('coalesce(q', 'coalesce(' + _REST)}"
_ROUTE = f"""CASE WHEN contains(lower(q), 'my dataset') OR contains(lower(q), 'my data') THEN 'out_of_scope' WHEN {_CHAT} AND NOT {_TECH} THEN 'general_chat' WHEN {_ORD} THEN 'out_of_scope' WHEN {_IDENT} THEN 'identity' WHEN {_ONB} THEN 'onboarding' WHEN {_LIB} IS NOT NULL THEN {_LIB}
 WHEN {_SMALL} AND NOT m AND NOT {_DOM} AND NOT {_any(U.LEARNING)} THEN 'small_talk' WHEN {_OFF} AND NOT m THEN 'out_of_scope' WHEN m THEN 'graph_strong' WHEN {_DOM} THEN 'graph_soft' WHEN {_any(U.LEARNING)} THEN 'low_similarity_reject' ELSE 'general_chat' END"""
_NAMED = f"al AS (SELECT DISTINCT id, {_wf('a')} AS alias FROM (SELECT canonical_name AS id, unnest({D.aliases('canonical_name')}) AS a FROM concept_reference)), w AS (SELECT q, ' ' || {_wf('q')} || ' ' AS w FROM (SELECT DISTINCT q FROM {_QS})), nm AS (SELECT DISTINCT q FROM w JOIN al ON contains(w, ' ' || alias || ' ') WHERE length(alias) >= 2)"


@query("rte1_routes", f"""WITH {_NAMED}, s AS (SELECT pair_id, q, q IN (SELECT q FROM nm) AS m FROM {_QS}), r AS (SELECT pair_id, {_ROUTE} AS route, CASE WHEN {_ORD} THEN 'implementation_request' ELSE 'out_of_scope' END AS why, NOT {_CHAT} AND NOT {_OFF} AND {_DOM} AS dom FROM s)
 SELECT pair_id, CASE WHEN route = 'out_of_scope' AND why = 'out_of_scope' AND dom THEN 'low_similarity_reject' ELSE route END AS route, CASE WHEN route = 'out_of_scope' AND NOT (why = 'out_of_scope' AND dom) THEN why END AS block_reason FROM r""")
def rte1(spark, sf):
    """RTE-1 and RTE-2."""
    q = _questions(spark, sf)
    return R.routes(q, B.mentions(q, _concepts(spark, sf), ["pair_id"], "q"), "pair_id", "q")


@query("rte2_route_counts", f"""WITH {_NAMED}, s AS (SELECT pair_id, q, q IN (SELECT q FROM nm) AS m FROM {_QS}), r AS (SELECT pair_id, {_ROUTE} AS route, CASE WHEN {_ORD} THEN 'implementation_request' ELSE 'out_of_scope' END AS why, NOT {_CHAT} AND NOT {_OFF} AND {_DOM} AS dom FROM s)
 SELECT CASE WHEN route = 'out_of_scope' AND why = 'out_of_scope' AND dom THEN 'low_similarity_reject' ELSE route END AS route, count(*) AS n FROM r GROUP BY 1""")
def rte2(spark, sf):
    return rte1(spark, sf).groupBy("route").agg(F.count(F.lit(1)).alias("n"))
