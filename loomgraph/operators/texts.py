"""Rendered texts and lookups (LIB-2, LIB-14, CIT-11, TXT-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .evidence import page_display

# Words between a book and a concept in a lookup, filler of lookups, openings of questions.
SPLITTERS = ("discusses", "discussed", "discuss", "mentioning", "mentions", "mentioned", "mention", "containing", "contains", "contained", "contain", "covering", "covers", "covered", "cover")
LOOKUP_FILLER = r"(?i)\b(which|chapter|section|of|book|paper|where|in)\b"
QUESTION_HEAD = r"(?i)^(?:what is|what's|whats|explain|tell me about|how does|define|describe|teach me)\s+(?:an?\s+|the\s+)?"



def lookup_parts(q: DataFrame, key: str, text: str) -> DataFrame:
    """LIB-2: (key, book, concept): a question cut at the first splitter in list order that it holds; without one both are the whole question."""
    low = F.lower(text)
    word = F.try_element_at(F.filter(F.array(*[F.lit(s) for s in SPLITTERS]), lambda s: F.contains(low, s)), F.lit(1))
    j = q.select(key, F.col(text).alias("__q"), word.alias("__w")).withColumn("__p", F.call_function("instr", F.lower("__q"), F.col("__w")))
    trim = lambda c: F.regexp_replace(c, r"^[ :\"'?.]+|[ :\"'?.]+$", "")
    book = trim(F.regexp_replace(F.substr("__q", F.lit(1), F.col("__p") - 1), LOOKUP_FILLER, ""))
    concept = trim(F.substr("__q", F.col("__p") + F.length("__w")))
    return j.select(key, F.when(F.col("__w").isNull(), F.col("__q")).otherwise(book).alias("book"), F.when(F.col("__w").isNull(), F.col("__q")).otherwise(concept).alias("concept"))


def rendered(evidence_id: Column, title: Column, section: Column, labels: Column, page: Column) -> Column:
    """CIT-11: `[S1] title, section, page`; parts that aren't known are left out."""
    part = lambda c: F.coalesce(F.concat(F.lit(", "), F.nullif(c, F.lit(""))), F.lit(""))
    return F.concat(F.lit("["), evidence_id, F.lit("] "), title, part(F.trim(section)), part(page_display(labels, page)))


def missing_topic(q: Column) -> Column:
    """TXT-1: what a question is about, without its opening."""
    return let(F.regexp_replace(F.regexp_replace(F.trim(q), QUESTION_HEAD, ""), r"^[ ?.!:]+|[ ?.!:]+$", ""), lambda t: F.coalesce(F.nullif(t, F.lit("")), F.lit("that topic")))


def chapter_answers(chunks: DataFrame, most: int = 40) -> DataFrame:
    """LIB-9 and LIB-14: (doc_id, listing): a document's chapters by page, at most `most`: the length of the rendered list."""
    c = chunks.where("trim(coalesce(section_title, '')) <> ''").groupBy("doc_id", "section_title").agg(F.min("page_number").alias("page"))
    w = Window.partitionBy("doc_id").orderBy("page", "section_title")
    top = c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return top.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "section_title"))), lambda x: x["section_title"]), "; ").alias("listing"))
