"""Problem 1: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, salted_join, salts_for, source_category, source_name, unit_hash

MAX_TARGETS = 10_000


def with_category(records: DataFrame, doc_col: str) -> DataFrame:
    """`records` with source_category in place of `doc_col`: the first part of the path; a bare file name gets the category
    that other rows give the same file (the smallest, if several), else null. Rows without a source get null."""
    keep = [c for c in records.columns if c != doc_col]
    r = records.select(*keep, source_name(F.col(doc_col)).alias("__n"), source_category(F.col(doc_col)).alias("__c"))
    known = r.where("__c is not null").groupBy("__n").agg(F.min("__c").alias("__k"))
    # many rows may name one file
    bare = salted_join(r.where("__c is null and __n is not null"), known, ["__n"], keep[0], salts_for(records), "left")
    full = r.where("__c is not null or __n is null")
    return full.select(*keep, F.col("__c").alias("source_category")).unionByName(bare.select(*keep, F.col("__k").alias("source_category")))


def mixing_rates(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Rates per category from `sizes` (id, source_category, n) and `targets` (source_category, target_share, max_repeats).

    Without `total`, the mix is the largest in which every category reaches its share of the whole under its cap; categories
    without any size can't be reached and are left out of that. A rate is share x total / available, at most max_repeats.
    Null, negative or zero shares and caps count as zero. Duplicate target rows of a category: shares add up, the largest cap holds.
    """
    t = targets.groupBy("source_category").agg(
        F.sum(F.greatest(F.coalesce(F.col("target_share"), F.lit(0.0)), F.lit(0.0))).alias("target_share"),
        F.max(F.greatest(F.coalesce(F.col("max_repeats"), F.lit(0)), F.lit(0))).alias("max_repeats"),
    )
    have = sizes.groupBy("source_category").agg(F.sum("n").alias("available"), F.count(F.lit(1)).alias("records"))
    j = t.join(have, "source_category", "left").fillna(0, ["available", "records"])
    # one row per target category: its size is that of the targets, which is checked
    rows = j.limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target categories")
    if total is None:
        reach = [r.max_repeats * r.available / r.target_share for r in rows if r.target_share > 0 and r.available > 0 and r.max_repeats > 0]
        total = min(reach, default=0.0)
    out = [
        (r.source_category, float(r.target_share), int(r.max_repeats), int(r.available), int(r.records), min(float(r.max_repeats), r.target_share * total / r.available) if r.available else 0.0)
        for r in rows
    ]
    return sizes.sparkSession.createDataFrame(out, "source_category string, target_share double, max_repeats int, available bigint, records bigint, rate double")


def mix(records: DataFrame, targets: DataFrame, id_col: str, doc_col: str, size: Column, seed: str = "mix-1", total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(emitted, report). emitted: (id, source_category, copy_no, n), each record floor(rate) times plus one copy where the
    hash of its id falls under the fraction, so no record comes more than max_repeats times. report: per target category
    the target share, the share reached, sizes and rate.

    A null size counts as 0; records whose category is unknown or has no target are in neither (report has a row for all
    of them together with a null category); empty tables give empty results. A null id hashes as the word null.
    """
    # named apart from the caller's columns, so that none can clash
    base = records.select(F.col(id_col).alias("__id"), F.col(doc_col).alias("__doc"), F.coalesce(size, F.lit(0)).cast("bigint").alias("n"))
    sizes = materialize(with_category(base, "__doc"), "mix-sizes")
    rates = mixing_rates(sizes, targets, total)
    u = unit_hash(F.coalesce(F.col("__id").cast("string"), F.lit("null")), seed)
    copies = F.floor("rate").cast("int") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    emitted = (
        sizes.join(F.broadcast(rates.select("source_category", "rate")), "source_category")  # at most MAX_TARGETS rows
        .withColumn("__copies", copies).where("__copies > 0")
        .select(F.col("__id").alias(id_col), "source_category", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("copy_no"), "n")
    )
    got = emitted.groupBy("source_category").agg(F.sum("n").alias("emitted"), F.count(F.lit(1)).alias("copies"))
    report = rates.join(got, "source_category", "left").fillna(0, ["emitted", "copies"])
    whole = got.agg(F.sum("emitted").alias("__t"))
    report = report.crossJoin(F.broadcast(whole)).select(  # one row on the right
        "source_category", "target_share", F.coalesce(F.col("emitted") / F.nullif(F.col("__t"), F.lit(0)), F.lit(0.0)).alias("actual_share"),
        "max_repeats", "records", "available", "copies", "emitted", "rate",
    )
    return emitted, report
