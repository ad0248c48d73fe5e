"""Problem 7: same or near-same records across splits."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, materialize, salted_join, salts_for
from .words import banded_distance, normal_words, passage_of

SHARE = 0.14
SPARE = 3
MAX_SEGMENT = 5
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def errors(n: int, share: float = SHARE) -> int:
    """Edits allowed for a passage of n words."""
    return int(n * share) + 1


def segment_length(n: int, share: float = SHARE) -> int:
    """Words of a segment, so that k + SPARE segments fit into n words."""
    return max(1, min(MAX_SEGMENT, n // (errors(n, share) + SPARE)))


class _Hashes(dict):
    def __missing__(self, w):
        b = w.encode("utf-8", "replace")
        v = (zlib.crc32(b) << 32) ^ zlib.crc32(b[::-1], 0x5BD1E995)
        if len(self) < 1_000_000:
            self[w] = v
        return v


_HASH = _Hashes()


def windows(words: list[str], q: int) -> np.ndarray:
    """A 64-bit hash of every stretch of q words."""
    n = len(words) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    ids = np.fromiter(map(_HASH.__getitem__, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        h = np.full(n, np.uint64(q), dtype=np.uint64) * _M1
        for k in range(q):
            h = (h ^ ids[k : k + n]) * _M2
            h ^= h >> np.uint64(31)
    return h.view(np.int64)


def _normal(batches):
    for batch in batches:
        cols = [batch.column(k) for k in range(batch.num_columns - 1)]
        texts = batch.column(batch.num_columns - 1).to_pylist()
        yield pa.RecordBatch.from_arrays([*cols, pa.array([" ".join(normal_words(passage_of(t))) if t is not None else None for t in texts], pa.string())], names=batch.schema.names)


def _emit(rows, names):
    cols = [np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in zip(*rows)] if rows else [np.zeros(0, dtype=np.int64)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def _segments(share: float):
    def run(batches):
        for batch in batches:
            rows = []
            for cls, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.split(" ")
                n = len(words)
                q = segment_length(n, share)
                at = np.arange(0, n - q + 1, q)
                rows.append((np.full(len(at), cls), windows(words, q)[at], at, np.full(len(at), n), np.full(len(at), errors(n, share))))
            yield _emit(rows, ["e", "h", "at", "n", "k"])

    return run


def _stretches(share: float):
    def run(batches):
        for batch in batches:
            rows = []
            for cls, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.split(" ")
                n = len(words)
                # the lengths that an evaluation text within its edits of this one can have
                lens = range(max(1, int((n - 1) / (1 + share))), int((n + 1) / (1 - share)) + 2)
                for q in {segment_length(x, share) for x in lens}:
                    h = windows(words, q)
                    rows.append((np.full(len(h), cls), h, np.arange(len(h)), np.full(len(h), n)))
                if len(rows) > 512:
                    yield _emit(rows, ["t", "h", "pos", "m"])
                    rows = []
            yield _emit(rows, ["t", "h", "pos", "m"])

    return run


def _verify(share: float):
    def run(batches):
        for batch in batches:
            e, t = batch.column(0), batch.column(1)
            keep = []
            for k, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = a.split(" "), b.split(" ")
                limit = errors(len(x), share)
                # words of one text that the other lacks each cost an edit
                if max(len(x), len(y)) - (Counter(x) & Counter(y)).total() > limit:
                    continue
                if banded_distance(x, y, limit) <= limit:
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([e.take(at), t.take(at)], names=["e", "t"])

    return run


class Overlap:
    """Classes of equal passages, and links between classes with evaluation rows and classes with training rows."""

    def __init__(self, members: DataFrame, links: DataFrame):
        self.members = members  # (cls, id, train, split, doc)
        self.links = links  # (e, t): class with evaluation rows, class with training rows; e = t where a class has both


def find_overlaps(pairs: DataFrame, id_col: str, text_col: str, split_col: str, doc_col: str, share: float = SHARE, train: str = "train") -> Overlap:
    """Passages of evaluation rows that training rows carry too, the same or within `share` of their words in edits.

    Equal passages (in their normal form) become one class first, so copies cost nothing. Edit-distance segment join: every evaluation
    class is cut into at least k + SPARE segments and the k + SPARE that are rarest in training are kept (of any k + c segments, c
    survive k edits); training stretches of that length match at positions shifted by at most k, and a pair is a candidate with
    SPARE different matches; candidates are verified by dynamic programming in the band. All positions of whole passages are used.

    Rows with a null id, text or split, and blank passages, take no part; a split other than `train` counts as evaluation. Empty
    tables give empty results.
    """
    src = pairs.select(F.col(id_col).cast("bigint").alias("id"), F.lower(F.trim(F.col(split_col))).alias("split"), F.col(doc_col).cast("string").alias("doc"), F.col(text_col).alias("text"))
    src = src.where("id is not null and text is not null and split is not null")
    rows = src.mapInArrow(_normal, "id bigint, split string, doc string, text string").where("text <> ''")
    rows = materialize(rows.withColumn("key", F.unhex(F.md5("text"))).withColumn("train", F.col("split") == train), "passages")
    classes = rows.groupBy("key").agg(F.min("id").alias("cls"), F.first("text").alias("text"), F.max("train").alias("t"), F.max(~F.col("train")).alias("e"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes, "classes")
    members = hot_join(rows.select("id", "split", "doc", "train", "key"), classes.select("key", "cls"), ["key"], "id", classes.select("key", "n"), rows.count()).drop("key")

    evals = classes.where("e").select("cls", "text")
    trains = classes.where("t").select("cls", "text")
    segs = materialize(evals.mapInArrow(_segments(share), "e bigint, h bigint, at bigint, n bigint, k bigint"), "segments")
    wins = trains.mapInArrow(_stretches(share), "t bigint, h bigint, pos bigint, m bigint")
    hits = materialize(wins.join(segs.select("h").distinct(), "h", "left_semi"), "hits")
    freq = materialize(hits.groupBy("h").agg(F.count(F.lit(1)).alias("f")), "frequencies")
    rare = Window.partitionBy("e").orderBy(F.coalesce("f", F.lit(0)), "at")
    chosen = segs.join(freq, "h", "left").withColumn("__r", F.row_number().over(rare)).withColumn("need", F.least(F.count(F.lit(1)).over(Window.partitionBy("e")) - F.col("k"), F.lit(SPARE))).where(f"__r <= k + {SPARE} and f is not null")
    cand = hot_join(hits, chosen.drop("f", "__r"), ["h"], "t", freq.select("h", F.col("f").alias("n")), hits.count()).where("abs(pos - at) <= k and abs(n - m) <= k and e <> t")
    cand = cand.groupBy("e", "t").agg(F.min("need").alias("need"), F.count_distinct("at").alias("c")).where("c >= need").select("e", "t")
    texts = classes.select("cls", "text")
    both = cand.join(texts.select(F.col("cls").alias("e"), F.col("text").alias("a")), "e").join(texts.select(F.col("cls").alias("t"), F.col("text").alias("b")), "t")
    near = both.select("e", "t", "a", "b").mapInArrow(_verify(share), "e bigint, t bigint")
    same = classes.where("e and t").select(F.col("cls").alias("e"), F.col("cls").alias("t"))
    return Overlap(members, materialize(near.unionByName(same), "links"))


def row_pairs(o: Overlap) -> DataFrame:
    """(pair_id_a, pair_id_b): every pair of an evaluation and a training row whose passages overlap, the smaller id first."""
    ev = o.members.where("not train").select(F.col("cls").alias("e"), F.col("id").alias("x"))
    tr = o.members.where("train").select(F.col("cls").alias("t"), F.col("id").alias("y"))
    # the training rows of a class that a third of all rows share are split; pairs are made last
    p = salted_join(tr, o.links, ["t"], "y", salts_for(o.members)).join(ev, "e")
    return p.select(F.least("x", "y").alias("pair_id_a"), F.greatest("x", "y").alias("pair_id_b"))


def overlap_report(o: Overlap, source: Column) -> DataFrame:
    """(split_name, source, n_rows, n_overlapping, n_pairs) of the evaluation splits; `source` is an expression over `doc`.

    Pairs are counted from class sizes, without making them.
    """
    trained = o.members.where("train").groupBy("cls").agg(F.count(F.lit(1)).alias("c"))
    per = o.links.join(trained.withColumnRenamed("cls", "t"), "t").groupBy("e").agg(F.sum("c").alias("c")).withColumnRenamed("e", "cls")
    ev = salted_join(o.members.where("not train").withColumn("source", F.coalesce(source, F.lit("unknown"))), per, ["cls"], "id", salts_for(o.links), "left")
    return ev.groupBy(F.col("split").alias("split_name"), "source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("c").alias("n_overlapping"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_pairs")
    )
