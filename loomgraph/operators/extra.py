"""Edges by hand, gold comparison, anchors, scrubbing of training records, citations in answers (CAN-15, CIT-10, CMP-3, EVL-1, GRF-3, JON-18, RNK-7, TRN-4, TRN-16, TRN-19, TRN-24, TRN-25, TRN-28, TRN-31)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ..functions.fuzzy import token_set_ratio
from ..functions.names import concept_key, valid_name
from ..functions.text import let, strip, tokens
from ..session import discard, materialize
from . import filters as L
from . import graph as G
from .records import identical_survivors

# Spellings of names in training rows.
TRAINING_SPELLINGS = ((r"(?i)\bfine-tuning\b", "Fine-Tuning"), (r"(?i)\bself-attention\b", "Self-Attention"), (r"(?i)\bgraph rag\b", "Graph RAG"), (r"(?i)\bpre-training\b", "Pre-Training"))


def training_name(c: Column) -> Column:
    """CAN-15 and TRN-31: a name in the spelling of the training rows."""
    n = strip(F.coalesce(c, F.lit("")))
    for p, r in TRAINING_SPELLINGS:
        n = F.regexp_replace(n, p, r)
    return n


def edge_verdict(src: Column, dst: Column, relation: Column, known: Column) -> Column:
    """GRF-3: created, self, unknown_relation or exists for an edge to be made by hand; `known` says that the pair and type are there."""
    types = F.create_map(*[F.lit(x) for kv in G.EDGE_TYPES.items() for x in kv])
    return F.when(F.try_element_at(types, F.lower(relation)).isNull(), "unknown_relation").when(src == dst, "self").when(F.coalesce(known, F.lit(False)), "exists").otherwise("created")


def of_document(doc_id: Column, wanted: Column) -> Column:
    """GRF-10: a record is a document's by path, as the end of a path, or by file name."""
    return (doc_id == wanted) | doc_id.endswith(wanted) | (F.substring_index(doc_id, "/", -1) == F.substring_index(wanted, "/", -1))


@F.pandas_udf(DoubleType())
def _token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b)])


def gold_matches(mine: DataFrame, gold: DataFrame, least: float = 90.0) -> DataFrame:
    """EVL-1 and JON-18: (gold, name, how): exact by key; the rest by token similarity from `least`, the best first, each name used once per gold entry.

    Only names that share a word with the entry can reach the threshold, so they meet in an equi-join over words.
    """
    m = mine.toDF("name").where("name is not null").distinct().withColumn("k", concept_key(F.col("name")))
    g = gold.toDF("gold").where("gold is not null").distinct().withColumn("k", concept_key(F.col("gold")))
    exact = g.join(m.where("k <> ''").groupBy("k").agg(F.min("name").alias("name")), "k").select("gold", "name", F.lit("exact").alias("how"))
    left = g.join(exact.select("gold"), "gold", "left_anti")
    free = m.join(exact.select("name"), "name", "left_anti")
    words = lambda df, c: df.select(c, F.explode(F.array_distinct(tokens(F.lower(c)))).alias("w"))
    pairs = words(left, "gold").join(words(free, "name"), "w").select("gold", "name").distinct()
    scored = pairs.withColumn("s", _token_set(F.lower("gold"), F.lower("name"))).where(F.col("s") >= least)
    best = scored.groupBy("gold").agg(F.max_by("name", F.struct("s", "name")).alias("name"))
    return exact.unionByName(best.select("gold", "name", F.lit("fuzzy").alias("how")))


def anchors(ranked: DataFrame) -> DataFrame:
    """RNK-7, RNK-9 and RNK-10: (query_id, id, strong): the best concept of each question and whether it is strong evidence: an alias hit, or a good lexical fit."""
    w = Window.partitionBy("query_id").orderBy(F.desc("blended"), "id")
    top = ranked.withColumn("r", F.row_number().over(w)).where("r = 1")
    return top.select("query_id", "id", ((F.col("alias_boost") >= 0.26) | (F.col("lexical") >= 0.60)).alias("strong"))


def clean_training_records(records: DataFrame) -> DataFrame:
    """TRN-4, TRN-19 and TRN-25: (rec_id, name, prerequisites, unlocks, tags): the name in training spelling, references canonical, once and not the record itself, at most
    4, 6 and 5 of them, joined with bars."""
    own = F.lower(training_name(F.col("concept_name")))

    def few(c: str, n: int) -> Column:
        xs = F.transform(F.filter(c, lambda x: strip(F.coalesce(x, F.lit(""))) != ""), lambda x: training_name(x))
        return F.coalesce(F.array_join(F.slice(F.array_distinct(F.filter(xs, lambda x: F.lower(x) != own)), 1, n), "|"), F.lit(""))

    return records.select("rec_id", training_name(F.col("concept_name")).alias("name"), few("prerequisites", 4).alias("prerequisites"), few("unlocks", 6).alias("unlocks"), few("tags", 5).alias("tags"))


def first_failure(records: DataFrame) -> DataFrame:
    """TRN-24: (rec_id, reason): the first rule that a record breaks, or null."""
    n, s = strip(F.coalesce("concept_name", F.lit(""))), strip(F.coalesce("summary", F.lit("")))
    reason = (
        F.when(n == "", "missing_name").when(F.length(n) > 60, "long_name").when(~valid_name(F.col("concept_name")), "invalid_name").when(F.col("concept_type").isNull(), "missing_type")
        .when(F.col("difficulty").isNull(), "missing_difficulty").when(F.length(s) < 15, "short_summary")
    )
    return records.select("rec_id", reason.alias("reason"))


def near_words(text: Column, name: Column, gap: int = 100) -> Column:
    """TRN-16: the name is in the text, or its first and last word within `gap` characters of each other."""
    def check(v: Column) -> Column:
        ws = F.filter(F.split(v["n"], "[^a-z0-9]+"), lambda w: F.length(w) > 2)
        a, b = F.call_function("instr", v["t"], F.try_element_at(ws, F.lit(1))), F.call_function("instr", v["t"], F.try_element_at(ws, F.lit(-1)))
        return F.contains(v["t"], v["n"]) | F.coalesce((a > 0) & (b > 0) & (F.abs(a - b) <= gap), F.lit(False))

    return let(F.struct(F.lower(text).alias("t"), F.lower(F.trim(name)).alias("n")), check)


def rebuilt_rows(pairs: DataFrame, least: int = 40, most: int = 1800) -> DataFrame:
    """TRN-28: (pair_id, text, empty): rows with a passage of at least `least` characters, cut at `most`; `empty` says that it must teach nothing (contact data or citations)."""
    from .chunking import CITATION, EMAIL
    from .dataset import instruction_text

    t = pairs.select("pair_id", F.substring(instruction_text(F.col("instruction")), 1, most).alias("text"))
    return t.where(F.length("text") >= least).select("pair_id", "text", ((F.regexp_count("text", F.lit(EMAIL)) >= 2) | (F.regexp_count("text", F.lit(CITATION)) >= 12)).alias("empty"))


_ID = re.compile(r"\[?\(?\bS(\d+)\b\)?\]?")


def cleanse(text: str, topics: dict[str, str]) -> str:
    """CIT-10: an answer whose citations are all supplied ones on their topic: invented ids go, and so does an id in a sentence that doesn't name its topic;
    with no citation left a footer lists the supplied ones."""
    out, kept = [], False
    for sentence in re.split(r"(?<=[.!?])\s+", text or ""):
        low = sentence.lower()

        def keep(m: re.Match) -> str:
            nonlocal kept
            topic = topics.get("S" + m.group(1))
            if topic is None or not any(w in low for w in topic.lower().split()):  # noqa: B023
                return ""
            kept = True
            return f"[S{m.group(1)}]"

        out.append(re.sub(r"\s+([.,;!?])", r"\1", re.sub(r"\s{2,}", " ", _ID.sub(keep, sentence))).strip())
    body = " ".join(s for s in out if s)
    return body if kept or not topics else f"{body}\n\nSources: " + ", ".join(f"[{k}] {v}" for k, v in sorted(topics.items(), key=lambda x: int(x[0][1:])))


@F.pandas_udf(StringType())
def cleanse_udf(text: pd.Series, topics: pd.Series) -> pd.Series:
    return pd.Series([cleanse(t, dict(m or ())) for t, m in zip(text, topics)])


def build(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """CMP-3: concepts, edges without those that close cycles, and the edges dropped: clean records, graph, cycle break."""
    ok = records.where(valid_name(F.col("concept_name")) & (L.grounding_verdict(F.col("concept_name"), F.col("summary"), F.col("source_passage")).isin("kept", "rescued")))
    # the verdicts cost far more than the rows, and graph and cycle break read them again and again
    grounded = materialize(ok.drop("source_passage"), "grounded")
    first = identical_survivors(grounded).select("rec_id")
    ok = materialize(grounded.join(first, "rec_id", "left_semi").drop("section_title", "page_number"), "clean")
    discard(grounded)
    n, e = materialize(G.nodes(ok), "nodes"), materialize(G.edges(ok), "edges")
    discard(ok)
    drop = materialize(G.break_cycles(G.learn_arcs(e).select("before", "after"), n), "dropped")
    bad = drop.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.lit("REQUIRES").alias("edge_type")).unionByName(drop.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("UNLOCKS").alias("edge_type")))
    return n, e.join(bad, ["src", "dst", "edge_type"], "left_anti"), drop


