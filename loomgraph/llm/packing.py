"""Problem 8: filling fixed-capacity containers with items."""

from __future__ import annotations

import base64
import bisect
import os
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, running_offset

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# the pre-tokenisation of that vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUPS = 48
LARGE = 0.25
MAX_CAPACITY = 1 << 20
MAX_LIMITS = 100
MAX_VOCABULARY = 1 << 26
_ENCODERS: dict = {}


def encoder(path: str, data: bytes | None = None):
    """The tokenizer of a vocabulary file (or of its content `data`), loaded once per worker."""
    if path not in _ENCODERS:
        import tiktoken

        if data is None:
            with open(path, "rb") as f:
                data = f.read()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _ENCODERS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _sizes(path: str, data):
    def run(batches):
        enc = encoder(path, data.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            # whole texts are read; encode_ordinary keeps its memory in proportion to the text
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts], pa.int64())], names=["id", "n_tokens"])

    return run


def token_sizes(docs: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens) of every row; a null or empty text has 0 tokens. The vocabulary file is read on the driver and goes with the job, if it has at
    most MAX_VOCABULARY bytes."""
    with open(tokenizer, "rb") as f:
        data = f.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of more than {MAX_VOCABULARY} bytes")
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    return src.mapInArrow(_sizes(tokenizer, docs.sparkSession.sparkContext.broadcast(data)), "id bigint, n_tokens bigint")


# --- the plan, made from histograms of sizes on the driver: its input is bounded by the capacity, not by the data ---


def linear_groups(sizes: np.ndarray, counts: np.ndarray, groups: int = GROUPS) -> tuple[list[tuple[int, int, int]], int]:
    """Groups of equal cardinality over large sizes in falling order: (rounded size, first rank, last rank + 1), and their
    cardinality (groups of one rounded size are joined)."""
    n = int(counts.sum())
    if not n:
        return [], 1
    per = -(-n // groups)
    ends = np.cumsum(counts)
    out = []
    for lo in range(0, n, per):
        k = int(np.searchsorted(ends, lo, side="right"))  # the size of the group's largest item
        out.append((int(sizes[k]), lo, min(n, lo + per)))
    merged: list[tuple[int, int, int]] = []
    for size, lo, hi in out:
        if merged and merged[-1][0] == size:
            merged[-1] = (size, merged[-1][1], hi)
        else:
            merged.append((size, lo, hi))
    return merged, per


def configurations(sizes: list[int], capacity: int, most: int) -> list[tuple[int, ...]]:
    """All multisets of at most `most` group numbers that fit; with large items there are few per container."""
    out: list[tuple[int, ...]] = []

    def grow(start: int, room: int, have: tuple[int, ...]) -> None:
        if have:
            out.append(have)
        if len(have) == most:
            return
        for g in range(start, len(sizes)):
            if sizes[g] <= room:
                grow(g, room - sizes[g], (*have, g))

    grow(0, capacity, ())
    return out


def solve(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Containers per configuration: the linear programme over configurations by the revised simplex method, rounded down, and the
    rest by first-fit decreasing."""
    g = len(sizes)
    if not g:
        return []
    configs = configurations(sizes, capacity, capacity // min(sizes))
    a = np.zeros((g, len(configs)))
    for c, items in enumerate(configs):
        for i in items:
            a[i, c] += 1
    first = {i: capacity // sizes[i] for i in range(g)}
    index = {tuple(items): c for c, items in enumerate(configs)}
    basis = [index[(i,) * first[i]] for i in range(g)]
    d = np.array(demand, dtype=float)
    for _ in range(50 * g + 200):
        b = a[:, basis]
        y = np.linalg.solve(b.T, np.ones(g))
        gain = y @ a
        c = int(np.argmax(gain))
        if gain[c] <= 1 + 1e-9:
            break
        x = np.linalg.solve(b, d)
        step = np.linalg.solve(b, a[:, c])
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, np.maximum(x, 0) / step, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[out] = c
    x = np.maximum(np.linalg.solve(a[:, basis], d), 0)
    left = list(demand)
    plan: list[tuple[tuple[int, ...], int]] = []
    for c, v in zip(basis, x):
        n = int(v + 1e-9)
        while n and any(n * configs[c].count(i) > left[i] for i in set(configs[c])):
            n -= 1
        if n:
            plan.append((configs[c], n))
            for i in configs[c]:
                left[i] -= n
    # at most a few items per group remain
    open_: list[list] = []
    for i in sorted(range(g), key=lambda i: -sizes[i]):
        while left[i] > 0:
            room = next((o for o in open_ if o[0] >= sizes[i]), None)
            if room is None:
                k = min(left[i], capacity // sizes[i])
                n = left[i] // k
                if n > 4:
                    plan.append(((i,) * k, n - 1))
                    left[i] -= (n - 1) * k
                    continue
                room = [capacity, []]
                open_.append(room)
            room[0] -= sizes[i]
            room[1].append(i)
            left[i] -= 1
    plan += [(tuple(sorted(o[1])), 1) for o in open_]
    return plan


def best_fit(rooms: dict[int, int], sizes: list[tuple[int, int]], capacity: int) -> tuple[list[tuple], int]:
    """Small items into free room, by histogram: largest size first, each into the fullest containers that take it.

    rooms: free room -> containers. sizes: (size, items). Returns rows (size, first item, items end, room, first container, items per
    container) and the number of new containers; these have room -1 and numbers from 0. A row's items fill `k` per container.
    """
    lots: dict[int, list[tuple[int, int, int]]] = {}
    for room, n in rooms.items():
        lots.setdefault(room, []).append((room, 0, n))
    order = sorted(lots)
    rows, fresh = [], 0

    def put(room: int, lot: tuple[int, int, int]) -> None:
        if lot[1] >= lot[2]:
            return
        if room not in lots:
            lots[room] = []
            bisect.insort(order, room)
        lots[room].append(lot)

    for size, items in sorted(sizes, reverse=True):
        at = 0
        while at < items:
            k = bisect.bisect_left(order, size)
            if k == len(order):
                per = capacity // size
                n = -(-(items - at) // per)
                put(capacity, (-1, fresh, fresh + n))
                fresh += n
                continue
            room = order[k]
            src, lo, hi = lots[room].pop()
            if not lots[room]:
                del lots[room]
                order.pop(k)
            per = room // size
            full = min(hi - lo, (items - at) // per)
            if full:
                rows.append((size, at, at + full * per, src, lo, per))
                at += full * per
                put(room - per * size, (src, lo, lo + full))
                lo += full
            if at < items and lo < hi:
                part = items - at
                rows.append((size, at, items, src, lo, part))
                put(room - part * size, (src, lo, lo + 1))
                at, lo = items, lo + 1
            put(room, (src, lo, hi))
    return rows, fresh


class Plan:
    """What goes where for one limit, made from its histogram of item sizes (at most `capacity` rows)."""

    def __init__(self, hist: list[tuple[int, int]], capacity: int, base: int):
        self.capacity, self.base = capacity, base
        self.least = max(1, int(capacity * LARGE))
        big = sorted(((s, c) for s, c in hist if s > self.least), reverse=True)
        self.small = [(s, c) for s, c in hist if s <= self.least]
        groups, self.per = linear_groups(np.array([s for s, _ in big]), np.array([c for _, c in big]))
        used = [g[1] for g in groups]
        self.slots: list[tuple[int, int, int, int]] = []  # cell of ranks, first and last rank + 1, container of the first
        self.n_big = 0
        for config, n in solve([g[0] for g in groups], [g[2] - g[1] for g in groups], capacity):
            for i in config:
                lo, hi = used[i], used[i] + n
                self.slots += [(cell, lo, hi, base + self.n_big) for cell in range(lo // self.per, (hi - 1) // self.per + 1)]
                used[i] = hi
            self.n_big += n
        # rank of a large item among all of them: those of larger sizes come before
        self.before, run = [], 0
        for s, c in big:
            self.before.append((s, run))
            run += c

    def fill(self, rooms: dict[int, int]) -> tuple[list[tuple], list[tuple]]:
        """The stretches of small items of a size that go into containers of a room, by cells of ranks: (size, cell, from, to, room, first seat,
        items per container), and the width of the cells per size; a cell meets two stretches on average."""
        rows, _ = best_fit(rooms, self.small, self.capacity)
        count, parts = dict(self.small), Counter(r[0] for r in rows)
        width = {s: max(1, -(-count[s] // n)) for s, n in parts.items()}
        cells = [(s, cell, lo, hi, room, seat, per) for s, lo, hi, room, seat, per in rows for cell in range(lo // width[s], (hi - 1) // width[s] + 1)]
        return cells, sorted(width.items())


def pack(sizes: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_name, container_id, doc_id, piece_no, n_tokens): the contents of each container, for every limit.

    Linear grouping scheme: items above a quarter of the capacity are put in groups of equal cardinality and rounded up to the group's
    largest; the linear programme over the configurations of the few group sizes is solved on the driver (its input is a histogram with at
    most `capacity` rows); items take their group's slots by rank; the room that is really left is filled with the small items,
    best fit first, again by histogram. Ranks come from bucket sums, so no task holds all items of a size. All limits go through the same
    steps at once. The plans are tables of at most a few rows per token of capacity; they are joined by cells of ranks.

    An item is split only if it alone exceeds the capacity: into pieces that fill whole containers and a last one that is packed like any item.
    Items without tokens take no room and are put into container 0. Null ids are kept. Limits with a null or non-positive capacity are left out.
    """
    spark = sizes.sparkSession
    rows = limits.where("capacity_tokens > 0").select("limit_name", "capacity_tokens").limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS or any(r.capacity_tokens > MAX_CAPACITY for r in rows):
        raise ValueError("more limits or larger capacities than the plan on the driver is bounded for")
    named = list(enumerate((r.limit_name, int(r.capacity_tokens)) for r in sorted(rows, key=lambda r: str(r.limit_name))))
    sizes = materialize(sizes.select("id", "n_tokens"), "token-sizes")
    if not named:
        return sizes.select(F.lit(None).cast("string").alias("limit_name"), F.col("id").alias("container_id"), F.col("id").alias("doc_id"), F.lit(0).alias("piece_no"), "n_tokens").limit(0)
    table = lambda data, schema: spark.createDataFrame(data or [tuple(-1 for _ in schema.split(","))], schema)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("lim"), F.lit(c).cast("bigint").alias("cap")) for k, (_, c) in named]))
    s = sizes.select("id", "n_tokens", each.alias("l")).select("id", "n_tokens", "l.lim", "l.cap").withColumn("whole", F.floor(F.col("n_tokens") / F.col("cap")))
    s = s.withColumn("whole", F.when(F.col("n_tokens") > F.col("cap"), F.col("whole")).otherwise(0))

    full = running_offset(s.where("whole > 0"), ["lim"], ["id"], "whole", "at")
    pieces = full.select("lim", "id", F.posexplode(F.sequence(F.lit(0), (F.col("whole") - 1).cast("int"))).alias("piece_no", "i"), "cap", "at")
    pieces = pieces.select("lim", (F.col("at") + F.col("i")).alias("container_id"), "id", "piece_no", F.col("cap").alias("n"))

    items = s.select("lim", "id", (F.col("n_tokens") - F.col("whole") * F.col("cap")).alias("n"), F.col("whole").cast("int").alias("piece_no"))
    empty = items.where("n = 0 and piece_no = 0").select("lim", F.lit(0).cast("bigint").alias("container_id"), "id", "piece_no", "n")
    items = materialize(running_offset(items.where("n > 0").withColumn("one", F.lit(1)), ["lim", "n"], ["id"], "one", "rank").drop("one"), "pack-items")

    hist: dict[int, list] = {k: [] for k, _ in named}
    for r in items.groupBy("lim", "n").agg(F.count(F.lit(1)).alias("c")).collect():  # a row per limit and size
        hist[r.lim].append((r.n, r.c))
    base = {r.lim: r.w for r in s.groupBy("lim").agg(F.sum("whole").alias("w")).collect()}
    plans = {k: Plan(hist[k], c, base.get(k) or 0) for k, (_, c) in named}
    least = F.element_at(F.create_map(*[x for k, p in plans.items() for x in (F.lit(k), F.lit(p.least))]), F.col("lim"))
    per = F.element_at(F.create_map(*[x for k, p in plans.items() for x in (F.lit(k), F.lit(p.per))]), F.col("lim"))

    first = table([(k, *x) for k, p in plans.items() for x in p.before], "lim int, n bigint, before bigint")
    slot = table([(k, *x) for k, p in plans.items() for x in p.slots], "lim int, cell bigint, lo bigint, hi bigint, at bigint")
    # both tables are bounded by the capacities and the number of configurations
    large = items.where(F.col("n") > least).join(F.broadcast(first), ["lim", "n"]).withColumn("r", F.col("before") + F.col("rank"))
    large = large.withColumn("cell", F.floor(F.col("r") / per)).join(F.broadcast(slot), ["lim", "cell"]).where("r >= lo and r < hi")
    large = materialize(large.select("lim", (F.col("at") + F.col("r") - F.col("lo")).alias("container_id"), "id", "piece_no", "n"), "pack-large")

    caps = F.element_at(F.create_map(*[x for k, (_, c) in named for x in (F.lit(k), F.lit(c).cast("bigint"))]), F.col("lim"))
    rooms = large.groupBy("lim", "container_id").agg(F.sum("n").alias("n")).select("lim", "container_id", (caps - F.col("n")).alias("room")).where("room > 0")
    rooms = materialize(running_offset(rooms.withColumn("one", F.lit(1)), ["lim", "room"], ["container_id"], "one", "seat").drop("one"), "pack-rooms")
    free: dict[int, dict] = {k: {} for k, _ in named}
    for r in rooms.groupBy("lim", "room").agg(F.count(F.lit(1)).alias("c")).collect():  # at most `capacity` rows per limit
        free[r.lim][r.room] = r.c
    cells, widths = [], []
    for k, p in plans.items():
        c, w = p.fill(free[k])
        cells += [(k, *x) for x in c]
        widths += [(k, *x) for x in w]
    width = table(widths, "lim int, n bigint, width bigint")
    fill = table(cells, "lim int, n bigint, cell bigint, lo bigint, hi bigint, room bigint, seat0 bigint, per bigint")
    tiny = items.where(F.col("n") <= least).join(F.broadcast(width), ["lim", "n"]).withColumn("cell", F.floor(F.col("rank") / F.col("width")))
    tiny = tiny.join(F.broadcast(fill), ["lim", "n", "cell"]).where("rank >= lo and rank < hi")
    tiny = tiny.select("lim", "id", "piece_no", "n", "room", (F.col("seat0") + F.floor((F.col("rank") - F.col("lo")) / F.col("per"))).alias("seat"))
    old = tiny.where("room >= 0").join(rooms, ["lim", "room", "seat"]).select("lim", "container_id", "id", "piece_no", "n")
    start = F.element_at(F.create_map(*[x for k, p in plans.items() for x in (F.lit(k), F.lit(p.base + p.n_big).cast("bigint"))]), F.col("lim"))
    new = tiny.where("room < 0").select("lim", (start + F.col("seat")).alias("container_id"), "id", "piece_no", "n")
    out = pieces.unionByName(large).unionByName(old).unionByName(new).unionByName(empty)
    names = F.element_at(F.array(*[F.lit(x) for _, (x, _) in named]), F.col("lim") + 1)
    return out.select(names.alias("limit_name"), "container_id", F.col("id").alias("doc_id"), "piece_no", F.col("n").alias("n_tokens"))


def pack_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_name, capacity_tokens, containers, tokens, lower_bound, fill): how full the containers are."""
    per = packed.groupBy("limit_name").agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    j = per.join(limits.select("limit_name", "capacity_tokens"), "limit_name")
    return j.select(
        "limit_name", "capacity_tokens", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("lower_bound"),
        (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"),
    )
