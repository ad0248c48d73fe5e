"""Expressions and helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import hot_join, materialize, salted_join, salts_for

# Ligatures that typesetting puts in place of letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}

# Names that stand for "no source".
NO_SOURCE = ("", "unknown", "none", "null", "nan", "n/a", "na", "-", "?")


def fold_ligatures(c: Column) -> Column:
    for k, v in LIGATURES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def alnum(c: Column) -> Column:
    """Only letters and digits, in lower case."""
    return F.regexp_replace(F.lower(fold_ligatures(c)), r"[^\p{L}\p{N}]+", "")


def let(value: Column, then) -> Column:
    """`then(value)` with `value` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _path(doc_id: Column) -> Column:
    p = F.replace(F.lower(F.replace(doc_id, F.lit("\\"), F.lit("/"))), F.lit("%2f"), F.lit("/"))
    p = F.regexp_replace(F.regexp_replace(p, r"%20|[\s\u00a0\u200b]+", " "), r" */[ /]*", "/")
    p = F.trim(F.regexp_replace(F.trim(p), r"^(?:\./|/|pdfs/)+", ""))
    return F.regexp_replace(p, r"[ _-]+", "_")


def _last(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def source_path(doc_id: Column) -> Column:
    """One spelling of a source path: slashes, case, prefixes and blanks made alike; null if it names no source."""
    return let(_path(doc_id), lambda p: F.when(~_last(p).isin(*NO_SOURCE), p))


def source_name(doc_id: Column) -> Column:
    """The file name of a source, in one spelling; null if it names none."""
    return let(_last(_path(doc_id)), lambda n: F.when(~n.isin(*NO_SOURCE), n))


def source_category(doc_id: Column) -> Column:
    """The first part of a source path; null where only a file name is given."""
    return let(source_path(doc_id), lambda p: F.when(F.contains(p, F.lit("/")), F.substring_index(p, "/", 1)))


CHUNK_TAIL = r"chunk[\s\u00a0_-]*0*(\d+)\s*$"


def chunk_number(chunk_id: Column) -> Column:
    """The number of a chunk however it is written; null where it cannot be told."""
    return F.nullif(F.regexp_extract(F.lower(chunk_id), CHUNK_TAIL, 1), F.lit(""))


def chunk_source(chunk_id: Column) -> Column:
    """The source that a chunk id carries in front of the chunk number, if any."""
    head = F.regexp_replace(F.lower(chunk_id), r"[\s:_/-]*" + CHUNK_TAIL, "\u0001")
    return F.when(F.lower(chunk_id).rlike(CHUNK_TAIL), source_name(F.replace(head, F.lit("\u0001"), F.lit(""))))


def unit_hash(c: Column, seed: str) -> Column:
    """A number in [0, 1) from the MD5 of seed and value; any SQL engine with md5 gets the same one."""
    h = F.substring(F.md5(F.concat(F.lit(seed + ":"), c.cast("string"))), 1, 12)
    return F.conv(h, 16, 10).cast("double") / F.lit(float(16**12))


def running_offset(df: DataFrame, classes: list[str], order: list[str], weight: str, out: str, buckets: int = 64) -> DataFrame:
    """Adds `out`: the sum of `weight` over the rows of the same class that come before, without a window over a whole class.

    Rows are spread over hash buckets of `order`; bucket totals (at most |classes| x buckets rows) give each bucket its
    start, and a window inside (class, bucket) the rest. The order is (bucket, *order): total if `order` is unique.
    """
    b = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sums = b.groupBy(*classes, "__b").agg(F.sum(weight).alias("__w"))
    before = Window.partitionBy(*classes).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*classes, "__b", F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*classes, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("__in", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return b.join(sums, [*classes, "__b"]).withColumn(out, F.col("__start") + F.col("__in")).drop("__b", "__start", "__in")


__all__ = [
    "alnum", "chunk_number", "chunk_source", "fold_ligatures", "hot_join", "materialize", "running_offset", "salted_join", "salts_for",
    "source_category", "source_name", "source_path", "unit_hash",
]
