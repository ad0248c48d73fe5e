"""Problem 4: duplicates hidden by formatting differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard
from .common import alnum, materialize, salted_join, salts_for

FIELD = r"^[^\p{L}\p{N}]*\p{L}[\p{L}\p{N} _-]*[\"']?\s*[:=]"
# a comma divides fields where a label follows it
COMMA = r",(\s*[\"']?\p{L}[\p{L}\p{N} _-]*[\"']?\s*[:=])"


def summary_key(c: Column) -> Column:
    """Letters and digits of a text; of a text made of labelled fields (`label: value` divided by lines, bars, semicolons, or commas before a
    label) those of its fields, sorted."""
    parts = F.filter(F.split(F.regexp_replace(c, COMMA, ";$1"), r"[\n|;]"), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    labelled = (F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(FIELD))
    return F.when(labelled, F.array_join(F.array_sort(F.transform(parts, alnum)), "\u0001")).otherwise(alnum(c))


def histogram(c: Column) -> Column:
    """A hash of how often each letter occurs: the same for any order of the same letters."""
    return F.xxhash64(*[F.length(c) - F.length(F.replace(c, F.lit(x), F.lit(""))) for x in "etaoinsrhldcumfpgwybvkxjqz"])


def duplicate_keys(records: DataFrame, id_col: str, plain: list[str], fielded: list[str]) -> DataFrame:
    """(id, key) of the records that share all of `plain` and `fielded` with another one when only letters and digits count.

    Partition refinement: classes of equal stripped lengths; inside those with several members, classes of equal letter
    histograms; and only inside those the full key, for which labelled fields are sorted. The first two steps move ids and
    hashes only; texts are moved once, to the ids that are left. Hot classes are salted. The key is the MD5 of the normal
    forms. Fields of `fielded` must hold text: records with a null or blank one, or with a null in `plain`, are no duplicates. Ids must be unique.
    """
    cols = [*plain, *fielded]
    r = records.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__t{i}") for i, c in enumerate(cols)])
    for i, c in enumerate(cols):
        r = r.where(F.col(f"__t{i}").isNotNull() if c in plain else F.col(f"__t{i}").rlike(r"[^\s ​﻿]"))
    stripped = r
    for i in range(len(cols)):
        stripped = stripped.withColumn(f"__s{i}", alnum(F.col(f"__t{i}")))
    forms = [F.col(f"__s{i}") for i in range(len(cols))]
    cheap = materialize(stripped.select("__id", F.xxhash64(*[F.length(s) for s in forms]).alias("__c"), F.xxhash64(*[histogram(s) for s in forms]).alias("__h")), "dup-classes")
    left = _shared(cheap, ["__c"], cheap)
    left = materialize(_shared(left, ["__c", "__h"], cheap).select("__id"), "dup-ids")
    r = r.join(left, "__id", "left_semi")
    forms = [alnum(F.col(f"__t{i}")) if c in plain else summary_key(F.col(f"__t{i}")) for i, c in enumerate(cols)]
    keyed = materialize(r.select("__id", F.md5(F.concat_ws("\u0002", *forms)).alias("key")), "dup-keys")
    discard(cheap, left)
    out = keyed.select(F.col("__id").alias(id_col), "key")
    out.written_at = keyed.written_at
    return out


def _shared(r: DataFrame, keys: list[str], sized: DataFrame) -> DataFrame:
    classes = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*keys)
    return salted_join(r, classes, keys, "__id", salts_for(sized))


def duplicate_members(keyed: DataFrame, id_col: str, first: str) -> DataFrame:
    """(first, id): every copy but the smallest id, beside the smallest."""
    heads = _heads(keyed, id_col, first).where("copies > 1")
    return salted_join(keyed, heads.select("key", first), ["key"], id_col, salts_for(keyed)).where(F.col(id_col) > F.col(first)).select(first, id_col)


def _heads(keyed: DataFrame, id_col: str, first: str) -> DataFrame:
    return keyed.groupBy("key").agg(F.min(id_col).alias(first), F.count(F.lit(1)).alias("copies"))


def collapse(records: DataFrame, id_col: str, plain: list[str], fielded: list[str]) -> DataFrame:
    """(id, copies): one row per record that is left when copies are collapsed into the smallest id, with their number.

    Records that are no cases (see duplicate_keys) stand alone with one copy. An empty table gives an empty result.
    """
    keyed = duplicate_keys(records, id_col, plain, fielded)
    heads = _heads(keyed, id_col, "__first").where("copies > 1")
    others = duplicate_members(keyed, id_col, "__first").select(F.col(id_col))
    left = records.select(id_col).join(others, id_col, "left_anti")
    return left.join(heads.select(F.col("__first").alias(id_col), "copies"), id_col, "left").select(id_col, F.coalesce("copies", F.lit(1).cast("bigint")).alias("copies"))
