"""Problem 3: splits that keep related records together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard
from .common import materialize, salted_join, salts_for

MAX_SPLITS = 1_000


def components(edges: DataFrame, seed: int = 7) -> DataFrame:
    """(vertex, label) of every vertex of `edges` (u string, v string): random-mate contraction.

    In each round every vertex throws a coin; a tails vertex with heads neighbours is contracted into the smallest of them.
    Each edge goes with probability 1/2 a round at least, so about log2(edges) rounds remain. Rounds are written tables, so a
    lost executor costs no more than one round, and hot vertices are salted in the joins. Self loops and null ends are
    ignored; repeated edges count once. The label is some vertex of the component, the same for all.
    """
    e = edges.where("u is not null and v is not null and u <> v")
    e = materialize(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges0")
    parents: list[DataFrame] = []
    while n := e.count():  # from the footers of the files
        r, salts = len(parents), max(8, n // 1_000_000)
        e0 = e
        coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(seed), F.lit(r)), F.lit(2))  # noqa: B023, E731
        both = e.withColumn("__cu", coin("u")).withColumn("__cv", coin("v")).where("__cu <> __cv")
        p = both.select(F.when(F.col("__cu") == 0, F.col("u")).otherwise(F.col("v")).alias("child"), F.when(F.col("__cu") == 0, F.col("v")).otherwise(F.col("u")).alias("parent"))
        p = materialize(p.groupBy("child").agg(F.min("parent").alias("parent")), f"parents{r}")
        parents.append(p)
        e = salted_join(e, p.select(F.col("child").alias("u"), F.col("parent").alias("__pu")), ["u"], "v", salts, "left")
        e = salted_join(e, p.select(F.col("child").alias("v"), F.col("parent").alias("__pv")), ["v"], "u", salts, "left")
        e = e.select(F.coalesce("__pu", "u").alias("u"), F.coalesce("__pv", "v").alias("v")).where("u <> v")
        last, e = e0, materialize(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"edges{r + 1}")
        discard(last)
    labels = unwind(parents, edges)
    discard(e, *parents)
    return labels


def unwind(parents: list[DataFrame], edges: DataFrame) -> DataFrame:
    """Labels from the contraction's tables, the last round first: a child has its parent's label, a parent without one is a root."""
    if not parents:
        return edges.select(F.col("u").alias("vertex"), F.col("v").alias("label")).limit(0)
    roots = None
    labels = None
    for k, p in enumerate(reversed(parents)):
        if labels is None:
            labels = p.select(F.col("child").alias("vertex"), F.col("parent").alias("label"))
            continue
        up = salted_join(p, labels.select(F.col("vertex").alias("parent"), "label"), ["parent"], "child", salts_for(p), "left")
        labels = labels.unionByName(up.select(F.col("child").alias("vertex"), F.coalesce("label", "parent").alias("label")))
        if k % 3 == 2:
            labels = materialize(labels, "labels")
    roots = labels.select(F.col("label").alias("vertex"), "label").distinct()
    return materialize(labels.unionByName(roots), "labels")


def group_records(records: DataFrame, id_col: str, keys: list[Column]) -> DataFrame:
    """(id, label): records that share a value of any key, directly or over others, have one label.

    `keys` are string columns; a null key joins nothing, a record without any key is alone under the label `row:<id>`.
    Values of different keys never mix. Only distinct combinations of keys become edges, so copies of a record cost nothing.
    """
    named = [F.concat(F.lit(f"{i}:"), k.cast("string")).alias(f"k{i}") for i, k in enumerate(keys)]
    r = records.select(F.col(id_col).alias("__id"), *named)
    cols = [f"k{i}" for i in range(len(keys))]
    r = r.withColumn("__first", F.coalesce(*cols))
    combos = r.select("__first", *cols).where("__first is not null").distinct()
    edges = reduce(DataFrame.unionByName, [combos.select(F.col("__first").alias("u"), F.col(c).alias("v")) for c in cols])
    labels = components(edges)
    r = salted_join(r.select("__id", "__first"), labels.select(F.col("vertex").alias("__first"), "label"), ["__first"], "__id", salts_for(records), "left")
    alone = F.concat(F.lit("row:"), F.coalesce(F.col("__id").cast("string"), F.lit("null")))
    return materialize(r.select(F.col("__id").alias(id_col), F.coalesce("label", "__first", alone).alias("label")), "groups")


def assign_splits(grouped: DataFrame, id_col: str, targets: DataFrame, buckets: int = 256) -> DataFrame:
    """(id, split_name): whole groups in the proportions of `targets` (split_name, target_share), counted in records.

    Groups are laid on a line by their size in powers of two, large ones first, then in hash order; the middle of a group decides its
    split, so the last and smallest groups level out what large ones miss. Positions come from bucket sums, so no window spans all
    groups. Shares that don't add up to 1 are scaled; null or negative shares count as 0; without targets the result is empty.
    """
    rows = targets.groupBy("split_name").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("s")).limit(MAX_SPLITS + 1).collect()
    if len(rows) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits")
    rows = sorted(((r.split_name, r.s) for r in rows if r.s > 0), key=lambda x: (-x[1], str(x[0])))
    weights = grouped.groupBy("label").agg(F.count(F.lit(1)).alias("w"))
    if not rows:
        return grouped.select(id_col, F.lit(None).cast("string").alias("split_name")).limit(0)
    total = weights.agg(F.sum("w")).first()[0] or 0
    weights = weights.withColumn("__rank", -F.floor(F.log2("w")).cast("int")).withColumn("__b", F.pmod(F.xxhash64("label", F.lit(11)), F.lit(buckets)).cast("int"))
    # at most 64 x buckets rows under one window
    sums = weights.groupBy("__rank", "__b").agg(F.sum("w").alias("__w"))
    before = Window.orderBy("__rank", "__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__rank", "__b", F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__rank", "__b").orderBy(F.xxhash64("label", F.lit(13)), "label").rowsBetween(Window.unboundedPreceding, -1)
    mid = F.col("__start") + F.coalesce(F.sum("w").over(inside), F.lit(0)) + F.col("w") / 2
    placed = weights.join(F.broadcast(starts), ["__rank", "__b"]).select("label", (mid / F.lit(float(total or 1))).alias("__at"))
    scale, at, case = sum(s for _, s in rows), 0.0, None
    for name, s in rows[:-1]:
        at += s / scale
        case = F.when(F.col("__at") < at, F.lit(name)) if case is None else case.when(F.col("__at") < at, F.lit(name))
    placed = placed.select("label", (case.otherwise(F.lit(rows[-1][0])) if case is not None else F.lit(rows[-1][0])).alias("split_name"))
    return salted_join(grouped, placed, ["label"], id_col, max(8, total // 1_000_000)).select(id_col, "split_name")


def group_members(grouped: DataFrame, id_col: str, first: str) -> DataFrame:
    """(first, id): every member of a group but the smallest, beside the smallest; groups of one give nothing."""
    heads = grouped.groupBy("label").agg(F.min(id_col).alias(first), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return salted_join(grouped, heads, ["label"], id_col, max(8, grouped.count() // 1_000_000)).where(F.col(id_col) > F.col(first)).select(first, id_col)
