"""A language model of character trigrams, fitted on labelled documents: tells the language of a text without word lists."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_LANGUAGE = 400
LEAST_DOCS = 5
LEAST_CHARS = 200
MAX_LANGUAGES = 64
MAX_GRAMS = 20_000
CACHE = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def grams(word: str):
    padded = " " + word + " "
    return (padded[k : k + 3] for k in range(len(padded) - 2))


class LanguageModel:
    """Log probabilities of a word's trigrams in each language; texts get the language in which their words are likeliest."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.languages = sorted(counts)
        every = {g for c in counts.values() for g in c}
        self.table: dict[str, tuple[float, ...]] = {}
        totals = {k: sum(c.values()) + len(every) + 1 for k, c in counts.items()}
        for g in every:
            self.table[g] = tuple(math.log((counts[k].get(g, 0) + 0.5) / totals[k]) for k in self.languages)
        self.unseen = tuple(math.log(0.5 / totals[k]) for k in self.languages)
        self._rows: dict[str, int] = {}
        self._logs = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_rows", "_logs")} | {"_rows": {}, "_logs": None}

    def word(self, w: str) -> np.ndarray:
        return np.array([self.table.get(g, self.unseen) for g in grams(w)]).sum(axis=0)

    def scores(self, counts: Counter) -> np.ndarray:
        """The log probability of counted words in each language."""
        if self._logs is None:
            self._logs = np.zeros((1024, len(self.languages)))
        rows = list(map(self._rows.get, counts))
        if None in rows:
            out = np.zeros(len(self.languages))
            for w, n in counts.items():
                out += n * self._row(w)
            return out
        return np.fromiter(counts.values(), dtype=float, count=len(rows)) @ self._logs[rows]

    def _row(self, w: str) -> np.ndarray:
        k = self._rows.get(w)
        if k is not None:
            return self._logs[k]
        v = self.word(w)
        if len(self._rows) < CACHE and len(w) <= 64:  # a cache only, the values are the same without it
            k = self._rows[w] = len(self._rows)
            if k >= len(self._logs):
                self._logs = np.concatenate([self._logs, np.zeros_like(self._logs)])
            self._logs[k] = v
        return v

    def of_words(self, words) -> str | None:
        """The likeliest language of words in lower case (or of a Counter of them); None where fewer than four words hold letters or none leads by a
        factor of e."""
        counts = Counter(words)
        for w in [w for w in counts if w.isdigit()]:
            del counts[w]
        if len(self.languages) < 2 or counts.total() < 4:
            return None
        sums = self.scores(counts)
        best, second = np.argsort(-sums, kind="stable")[:2]
        return self.languages[best] if sums[best] - sums[second] > 1 else None

    def of_text(self, text: str) -> str | None:
        return self.of_words(_WORD.findall(text.lower()))


def label(lang):
    """A language label as its first two letters in lower case: `en-GB` and `EN` are `en`."""
    return F.lower(F.substring(F.trim(lang), 1, 2))


def _count(batches):
    for batch in batches:
        out: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            c = out.setdefault(lang, Counter())
            for w, n in Counter(_WORD.findall(text.lower())).items():
                for g in grams(w):
                    c[g] += n
        rows = [(k, g, n) for k, c in out.items() for g, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [[], [], []], (pa.string(), pa.string(), pa.int64()))], names=["lang", "gram", "n"])


def fit_languages(docs: DataFrame, id_col: str, text: str, lang: str, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """The model from about `per_language` documents of each label (chosen by the hash of their id), so its size and cost are bounded
    however many documents there are; a few wrong labels don't matter. Labels with under LEAST_DOCS documents are left out, documents
    without a label or under LEAST_CHARS characters are not used. At most MAX_LANGUAGES labels (the commonest, ties by name) and the MAX_GRAMS
    commonest trigrams of each are kept. Without labels the model knows no language and says None.
    """
    src = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), label(F.col(lang)).alias("lang"), F.col(text).alias("t")).where("lang rlike '^[a-z]{2}$'")
    n = src.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not n:
        return LanguageModel({})
    part = F.element_at(F.create_map(*[x for r in n for x in (F.lit(r.lang), F.lit(min(1.0, per_language / r.n)))]), F.col("lang"))
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = src.where(share < part).where(F.length("t") >= LEAST_CHARS).select("lang", "t")
    counted = chosen.mapInArrow(_count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counted.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "gram")), asc=False), 1, MAX_GRAMS).alias("g")).collect()
    return LanguageModel({r.lang: {x.gram: x.n for x in r.g} for r in best})
