"""Ranking of concepts and intents for questions (RNK-3..10, INT-1..4, JON-19, JON-20, WIN-5)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.fuzzy import partial_ratio, token_set_ratio
from ..functions.names import aliases
from ..functions.queries import query_words

# Parts of names of special cases, and weights of the blended score.
VARIANTS = r"applied to|via |with |batching|speedup|scaling factor|variant|efficient |extended|for |based on|using "


@F.pandas_udf(DoubleType())
def _token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) / 100 for x, y in zip(a, b)])


@F.pandas_udf(DoubleType())
def _partial(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x, y) / 100 if y else 0.0 for x, y in zip(a, b)])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of numbers, in double; null if one is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """WIN-5: (query_id, vec_id, score): the k nearest vectors of each query by cosine, the query itself left out.

    The query set is small beside the vectors and is sent to them only if Spark's size threshold allows; each task keeps its own best k before the merge.
    """
    j = vectors.join(queries.toDF("query_id", "q"), F.col("vec_id") != F.col("query_id"))
    s = j.select("query_id", "vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return s.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def prototype_scores(vectors: DataFrame, queries: DataFrame, top: int = 2) -> DataFrame:
    """INT-1 and JON-20: (query_id, label, score): per label the mean of the `top` best cosines with its prototypes."""
    j = vectors.join(queries.toDF("query_id", "q"), F.col("vec_id") != F.col("query_id"))
    s = j.select("query_id", "label", "vec_id", cosine(F.col("embedding"), F.col("q")).alias("c"))
    w = Window.partitionBy("query_id", "label").orderBy(F.desc(F.round("c", 9)), "vec_id")
    return s.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).groupBy("query_id", "label").agg(F.round(F.avg("c"), 6).alias("score"))


def pick(scores: DataFrame, query: str, label: str, score: str) -> DataFrame:
    """INT-4: (query, label, score, margin): the best label and its lead over the second; ties by label."""
    w = Window.partitionBy(query).orderBy(F.desc(score), label)
    s = scores.withColumn("__next", F.lead(score).over(w)).withColumn("__r", F.row_number().over(w))
    return s.where("__r = 1").select(query, label, score, F.round(F.col(score) - F.coalesce("__next", F.lit(0.0)), 6).alias("margin"))


def lexical_intents(queries: DataFrame, prototypes: DataFrame, stop: list[str]) -> DataFrame:
    """INT-2: (query_id, label, score): per label the best Jaccard overlap of content words with a prototype, plus 0.08 for each common one."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(*stop)))
    q = queries.toDF("query_id", "q").select("query_id", words(F.col("q")).alias("qw"))
    p = prototypes.toDF("label", "p").select("label", words(F.col("p")).alias("pw"))
    # words meet in an equi-join, so pairs without a common word cost nothing
    qe = q.select("query_id", F.size("qw").alias("nq"), F.explode("qw").alias("w"))
    pe = p.withColumn("pid", F.xxhash64("label", "pw")).select("pid", "label", F.size("pw").alias("np"), F.explode("pw").alias("w"))
    m = qe.join(pe, "w").groupBy("query_id", "pid", "label", "nq", "np").agg(F.count(F.lit(1)).alias("c"))
    score = F.col("c") / (F.col("nq") + F.col("np") - F.col("c")) + 0.08 * F.col("c")
    return m.groupBy("query_id", "label").agg(F.round(F.max(score), 4).alias("score"))


def blend(lexical: Column, embedded: Column) -> Column:
    """INT-3."""
    return F.round(0.45 * F.coalesce(lexical, F.lit(0.0)) + 0.55 * F.coalesce(embedded, F.lit(0.0)), 6)


def lexical_fit(query: Column, name: Column, summary: Column) -> Column:
    """RNK-3: 0.7 x the better of name and summary similarity plus 0.3 x the share of the name's words in the question."""
    q, n = F.lower(query), F.lower(name)
    nw = query_words(n)
    share = F.coalesce(F.size(F.array_intersect(query_words(q), nw)) / F.nullif(F.size(nw), F.lit(0)), F.lit(0.0))
    return F.greatest(_token_set(q, n), _partial(q, F.substring(F.coalesce(summary, F.lit("")), 1, 300)) * 0.85) * 0.7 + share * 0.3


def rank_concepts(queries: DataFrame, concepts: DataFrame, k: int = 5) -> DataFrame:
    """RNK-4, RNK-5 and JON-19: (query_id, id, lexical, alias_boost, core_bonus, blended): the k best concepts (id, name, summary, degree) of each question, offline:
    the lexical fit stands for the cosine. Candidates are the concepts that share a word with the question in their name, an alias or the beginning of their
    summary; they are found by an equi-join over words, so only candidates are scored."""
    c = concepts.select("id", "name", "summary", "degree", aliases(F.col("name")).alias("al"))
    qs = queries.toDF("query_id", "q")
    own = F.array_distinct(F.concat(query_words(F.col("name")), F.flatten(F.transform("al", query_words)), query_words(F.substring(F.coalesce("summary", F.lit("")), 1, 300))))
    found = qs.select("query_id", F.explode(query_words(F.col("q"))).alias("w")).join(c.select("id", F.explode(own).alias("w")), "w").select("query_id", "id").distinct()
    j = found.join(qs, "query_id").join(c, "id")
    ql, nl = F.lower("q"), F.lower("name")
    qw = query_words(ql)
    core = F.regexp_replace(F.regexp_replace(ql, r"^(what is|what's|whats|explain|tell me about|how does|define)\s+", ""), r"^[ ?!.]+|[ ?!.]+$", "")
    exact = F.array_contains("al", core)
    token = F.exists(qw, lambda w: F.array_contains("al", w))
    part = F.exists("al", lambda a: (F.length(a) >= 3) & (F.contains(ql, a) | F.contains(a, ql)))
    boost = F.when(exact, 0.28).when(token, 0.26).when(part, 0.12).otherwise(0.0)
    words = F.size(F.split(nl, r"\s+"))
    acr = (F.length(core) <= 6) & core.rlike("^[a-z]+$")
    bonus = F.when(exact | (core == nl), 0.35).otherwise(0.0) + F.when(
        acr, F.when(exact, 0.30).otherwise(0.0) + F.when(words <= 4, 0.12).when(words >= 6, -0.18).otherwise(0.0) - F.when(nl.rlike(VARIANTS) & (words > 3), 0.22).otherwise(0.0)
    ).otherwise(0.0)
    whole = F.size(F.array_except(F.filter(F.split(nl, r"\s+"), lambda w: w != ""), qw)) == 0
    j = j.withColumn("boost", boost).withColumn("bonus", bonus).withColumn("whole", F.when(whole, 0.20).otherwise(0.0))
    j = j.withColumn("fit", lexical_fit(F.col("q"), F.col("name"), F.col("summary"))).withColumn("ts", _token_set(ql, nl)).withColumn("pt", _partial(ql, F.substring(F.coalesce("summary", F.lit("")), 1, 240)))
    lex = F.when(F.col("boost") >= 0.26, F.greatest("fit", F.lit(0.85))).otherwise(F.col("fit"))
    deg = F.col("degree") / (F.col("degree") + 12.0)
    score = F.col("fit") + 0.15 * F.col("ts") + F.col("whole") + 0.08 * F.col("pt") + 0.12 * lex + F.col("boost") + 0.08 * deg + F.col("bonus")
    j = j.select("query_id", "id", F.round(lex, 6).alias("lexical"), F.col("boost").alias("alias_boost"), F.round("bonus", 6).alias("core_bonus"), F.round(score, 6).alias("blended"))
    w = Window.partitionBy("query_id").orderBy(F.desc("blended"), "id")
    return j.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
