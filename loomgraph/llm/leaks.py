"""Problem 9: evaluation texts leaking into training text."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .words import masks, myers_search, normal_words

BUDGET = 0.45
STRETCHES = 2
COVER = 0.55
RUN = 3
WIDE = 8
BLOCK_CHARS = 8_000_000
_ONE, _TOP = np.uint64(1), np.uint64(63)
_P = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def intact(m: int, q: int, budget: float = BUDGET, stretches: int = STRETCHES) -> int:
    """The least number of q-word pieces of an item of m words that the error budget leaves intact.

    A copy within the budget keeps R of the m words in at most `stretches` stretches and changes c of these R; lost and changed
    words are at most floor(budget * m), and at most one in four kept words is changed. A changed word breaks at most q pieces, an
    end of a stretch q - 1, so at least R - q c - (q - 1) stretches pieces survive; this is the minimum over all R and c.
    """
    k = int(budget * m)
    least = m
    for kept in range(m - k, m + 1):
        changed = min(kept // 4, k - (m - kept))
        least = min(least, kept - q * changed - (q - 1) * stretches)
    return least


def piece_length(m: int) -> int:
    """Words of a piece: the longest of 3, 2 and 1 of which the error budget can't break all."""
    return next(q for q in (3, 2, 1) if q == 1 or q <= m and intact(m, q) >= 1)


class _Vocabulary(dict):
    def __missing__(self, _):
        return -1


class ItemIndex:
    """The pieces of a block of items at every offset, by hash, and the positions of their words as bits."""

    def __init__(self, items: list[tuple]):
        self.vocab = _Vocabulary()
        self.ids: list = []
        self.words: list[np.ndarray] = []
        self.long: dict = {}
        for item_id, text in items:
            ws = normal_words(text or "")
            if ws:
                self.ids.append(item_id)
                self.words.append(np.array([self.vocab.setdefault(w, len(self.vocab)) for w in ws], dtype=np.int64))
        self.m = np.array([len(w) for w in self.words], dtype=np.int64)
        self.budget = (self.m * BUDGET).astype(np.int64)
        kinds = np.array([piece_length(len(w)) for w in self.words], dtype=np.int64)
        self.need = np.array([max(1, intact(len(w), int(q))) for w, q in zip(self.words, kinds)], dtype=np.int64)
        self.tables = []
        for q in sorted(set(kinds.tolist())):
            which = np.nonzero(kinds == q)[0]
            h = np.concatenate([_rolling(self.words[k], q) for k in which])
            item = np.concatenate([np.full(len(self.words[k]) - q + 1, k) for k in which])
            at = np.concatenate([np.arange(len(self.words[k]) - q + 1) for k in which])
            order = np.argsort(h, kind="stable")
            keys, first, count = np.unique(h[order], return_index=True, return_counts=True)
            self.tables.append((q, keys, first, count, item[order], at[order]))
        self._masks()

    def _masks(self) -> None:
        """(item, word) -> a row of `bits`, the positions of the word in the item, 64 to a column."""
        self.width = int(-(-self.m.max() // 64)) if len(self.m) else 1
        v = len(self.vocab)
        item = np.repeat(np.arange(len(self.m)), self.m)
        at = np.concatenate([np.arange(n) for n in self.m]) if len(self.m) else np.zeros(0, dtype=np.int64)
        keys, inverse = np.unique(item * v + (np.concatenate(self.words) if self.words else at), return_inverse=True)
        self.bits = np.zeros((self.width, len(keys) + 1), dtype=np.uint64)  # the last row is for words that the item lacks
        np.bitwise_or.at(self.bits, (at // 64, inverse), _ONE << (at % 64).astype(np.uint64))
        self.keys = keys
        self.dense = None
        if len(self.m) * v <= 16_000_000:  # a table instead of a binary search; the same rows
            self.dense = np.full(len(self.m) * v + 1, len(keys), dtype=np.int32)
            self.dense[keys] = np.arange(len(keys))

    def rows_of(self, item: np.ndarray, word: np.ndarray) -> np.ndarray:
        v = len(self.vocab)
        if self.dense is not None:
            return self.dense[np.where(word >= 0, item * v + word, len(self.dense) - 1)]
        key = np.where(word >= 0, item * v + word, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, len(self.keys))

    def peq(self, item: int) -> dict:
        if item not in self.long:
            self.long[item] = masks(self.words[item].tolist())
        return self.long[item]

    def search(self, docs: list[list[str]]) -> list[tuple[int, object]]:
        """(index of the document, item id) of every document that holds an item, for a batch of documents as words."""
        lens = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
        total = int(lens.sum())
        if not total or not len(self.m):
            return []
        ids = np.fromiter(map(self.vocab.__getitem__, chain.from_iterable(docs)), dtype=np.int64, count=total)
        starts = np.cumsum(lens) - lens
        doc = np.repeat(np.arange(len(docs)), lens)
        found: list[tuple[int, int, int, int]] = []
        for table in self.tables:
            found += self.windows(table, ids, doc, starts, lens)
        if not found:
            return []
        d, it, lo, hi = (np.array(x, dtype=np.int64) for x in zip(*found))
        dist = self.distances(it, ids, lo, hi)
        out: set = set()
        for k in np.nonzero(dist <= self.budget[it])[0].tolist():
            key = (int(d[k]), int(it[k]))
            if key not in out:
                pattern = self.words[key[1]].tolist()
                if covered(pattern, ids[lo[k] : hi[k]].tolist()) >= min(COVER * len(pattern), len(pattern) - self.budget[key[1]]):
                    out.add(key)
        return [(a, self.ids[b]) for a, b in sorted(out)]

    def windows(self, table, ids, doc, starts, lens) -> list[tuple[int, int, int, int]]:
        """(document, item, from, to) of the stretches where as many pieces as the budget must leave are intact.

        Hits are counted in bands of diagonals as wide as the item that overlap by half, so words of a copy that drift apart by up to half
        the item's length share a band.
        """
        q, keys, first, count, items, offsets = table
        if len(ids) < q:
            return []
        h = _rolling(ids, q)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        j = np.nonzero((doc[: len(h)] == doc[q - 1 :]) & (keys[at] == h))[0]
        if not len(j):
            return []
        n = count[at[j]]
        rows = np.repeat(first[at[j]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        d, item = doc[np.repeat(j, n)], items[rows]
        m = self.m[item]
        along = np.repeat(j, n) - starts[d] - offsets[rows] + m
        pair = d * len(self.m) + item
        bands = int(lens.max() // m.min()) + 3
        out = []
        for half in (0, 1):
            key = pair * bands + (along + half * (m // 2)) // m
            size = len(lens) * len(self.m) * bands
            if size <= 16 * len(key):
                c = np.bincount(key)
                k = np.nonzero(c)[0]
                c = c[k]
            else:
                k, c = np.unique(key, return_counts=True)
            it = k // bands % len(self.m)
            ok = c >= self.need[it]
            k, it = k[ok], it[ok]
            a = k // bands // len(self.m)
            lo = (k % bands) * self.m[it] - self.m[it] - half * (self.m[it] // 2)
            hi = np.minimum(lo + 2 * self.m[it], lens[a])
            out += zip(a.tolist(), it.tolist(), (starts[a] + np.maximum(lo, 0)).tolist(), (starts[a] + hi).tolist())
        return out

    def distances(self, item: np.ndarray, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: int = 4096) -> np.ndarray:
        """The least edit distance of each item to any stretch of its window: Myers' bit-parallel recurrence, many windows abreast."""
        out = np.zeros(len(item), dtype=np.int64)
        order = np.lexsort((hi - lo, -(-self.m[item] // 64)))
        for s in range(0, len(order), step):
            k = order[s : s + step]
            out[k] = self._distances(item[k], ids, lo[k], hi[k])
        return out

    def _distances(self, item, ids, lo, hi):
        n, m = len(item), self.m[item]
        width = int(-(-m.max() // 64))
        if width > WIDE:  # whole-number arithmetic of any length is faster for a long item than many columns abreast
            return np.array([myers_search(self.peq(int(k)), int(self.m[k]), ids[a:b].tolist())[0] for k, a, b in zip(item, lo, hi)], dtype=np.int64)
        last = (m - 1) // 64
        top = _ONE << ((m - 1) % 64).astype(np.uint64)
        tops = [np.where(last == b, top, np.uint64(0)) for b in range(width)]
        pv = [np.full(n, ~np.uint64(0)) for _ in range(width)]
        mv = [np.zeros(n, dtype=np.uint64) for _ in range(width)]
        score, best = m.copy(), m.copy()
        for t in range(int((hi - lo).max())):
            p = lo + t
            word = np.where(p < hi, ids[np.minimum(p, len(ids) - 1)], -1)
            row = self.rows_of(item, word)
            carry = np.zeros(n, dtype=np.uint64)
            up, down = carry, carry
            more, less = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
            for b in range(width):
                eq = self.bits[b][row]
                xv = eq | mv[b]
                a = (eq & pv[b]) + pv[b]
                over = a < pv[b]
                a2 = a + carry
                carry = (over | (a2 < a)).astype(np.uint64)
                xh = (a2 ^ pv[b]) | eq
                ph = mv[b] | ~(xh | pv[b])
                mh = pv[b] & xh
                more |= (ph & tops[b]) != 0
                less |= (mh & tops[b]) != 0
                ph1, mh1 = (ph << _ONE) | up, (mh << _ONE) | down
                up, down = ph >> _TOP, mh >> _TOP
                pv[b] = mh1 | ~(xv | ph1)
                mv[b] = ph1 & xv
            score = score + more - less
            # beyond its end a window has only words that the item lacks, which never lower the score
            np.minimum(best, score, out=best)
        return best


def _rolling(ids: np.ndarray, piece: int) -> np.ndarray:
    """A 64-bit hash of every `piece` words in a row."""
    n = len(ids) - piece + 1
    u = ids.astype(np.uint64) + np.uint64(1)
    h = np.zeros(max(n, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(piece):
            h = (h ^ (u[k : k + n] * _P[k % 3])) * _P[(k + 1) % 3]
            h ^= h >> np.uint64(29)
    return h


def covered(pattern: list[int], window: list[int], run: int = RUN) -> int:
    """Words of `pattern` in the best chain of runs of at least `run` equal words, in order and close together; a single changed
    word between two runs counts as covered. Patterns shorter than three runs are covered by runs of any length."""
    run = min(run, max(1, len(pattern) // 3))
    grams: dict = {}
    for j in range(len(window) - run + 1):
        grams.setdefault(tuple(window[j : j + run]), []).append(j)
    runs = []
    for i in range(len(pattern) - run + 1):
        for j in grams.get(tuple(pattern[i : i + run]), ()):
            if i and j and pattern[i - 1] == window[j - 1]:
                continue  # inside a run
            n = run
            while i + n < len(pattern) and j + n < len(window) and pattern[i + n] == window[j + n]:
                n += 1
            runs.append((i, j, n))
    best: list[int] = []
    for r, (i, j, n) in enumerate(runs):
        most = n
        for q in range(r):
            a, b, c = runs[q]
            # overlapping ends are cut
            over = max(0, a + c - i, b + c - j)
            if a < i and b < j and over < n and j - (b + c) <= len(pattern) // 2:
                extra = 1 if i - (a + c) == 1 and j - (b + c) == 1 else 0
                most = max(most, best[q] + n - over + extra)
        best.append(most)
    return max(best, default=0)


def _normal(batches):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(normal_words(t)) for t in texts], pa.string())], names=["d", "t"])


def _search(index, words):
    def run(batches):
        ix = index.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            step = 256
            where, items = [], []
            for s in range(0, len(texts), step):
                for d, item in ix.search([words(t) for t in texts[s : s + step]]):
                    where.append(s + d)
                    items.append(item)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(where, pa.int64())), pa.array(items, pa.int64())], names=["d", "i"])

    return run


def blocks_of(items: DataFrame, block_chars: int) -> list[DataFrame]:
    """`items` (i, t) in parts by hash, none of more than `block_chars` characters unless it is a single item."""
    sized = items.select("i", F.length("t").alias("c"))
    chars = sized.agg(F.sum("c")).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    if n == 1:
        return [items]
    while True:
        part = F.pmod(F.xxhash64("i"), F.lit(n))
        over = sized.groupBy(part.alias("b")).agg(F.sum("c").alias("c"), F.count_distinct("i").alias("k")).where((F.col("c") > block_chars) & (F.col("k") > 1))
        if not over.take(1):
            return [items.where(part == b) for b in range(n)]
        n *= 2


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id): documents that hold at least about three fifths of an item's words, close together and in order.

    Pigeonhole edit matching: an item of m words has an error budget of BUDGET x m words lost or changed (at most one in four kept words
    changed, kept words in at most STRETCHES stretches). Its pieces at every offset are looked up in whole documents, and a document is a
    candidate where at least as many hit as the budget can't break (`intact`, so no copy within the budget is missed); a candidate is verified by
    Myers' bit-parallel distance against the budget, and by the share of the item in common runs of RUN words or more, in which a
    single changed word counts. Items too short for that must be there whole in their order but for the budget.

    Items are a stated query set, taken in blocks of at most `block_chars` characters (checked), each broadcast once and set against all
    documents; with several blocks the documents' words are made once and written.

    Null or blank texts match nothing; repeated documents or items each have their row; ids must be bigint (other integers are cast);
    empty tables give no rows. Other columns are not touched.
    """
    spark = docs.sparkSession
    left = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t"))
    q = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t"))
    parts = blocks_of(q, block_chars)
    words = normal_words
    if len(parts) > 1:
        left, words = materialize(left.mapInArrow(_normal, "d bigint, t string"), "leak-words"), str.split
    out = None
    for part in parts:
        index = spark.sparkContext.broadcast(ItemIndex([(r.i, r.t) for r in part.toLocalIterator()]))
        got = left.mapInArrow(_search(index, words), "d bigint, i bigint")
        out = got if out is None else out.unionByName(got)
    return out.select(F.col("d").alias("doc_id"), F.col("i").alias("item_id")).distinct()
