"""Problem 10: reading level of each document."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .language import LanguageModel
from .text_stats import COMMON, HOME, NAMES, text_stats

VOCABULARY = 65_536
SHARES = (0.9, 0.75, 0.5)
LONG = 150
MIN_WORDS = 4
MAX_LEVELS = 1_000
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_ASCII = re.compile(r"[a-z]+(?:'[a-z]+)*")
_BREAK = re.compile(r"(?<=[^\W\d_])-\n\s*(?=[^\W\d_])")
_CAPITALS = frozenset(w.capitalize() for w in COMMON)
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)]*\s+")
_I = {n: k for k, n in enumerate(NAMES)}


def joined(text: str) -> str:
    """A text with the words put together that line ends break."""
    return _BREAK.sub("", text) if "-\n" in text else text


def word_counts(text: str) -> Counter:
    """The words of a text in lower case, with how often each occurs."""
    low = joined(text).lower()
    return Counter((_ASCII if low.isascii() else _WORDS).findall(low))


def _count_words(batches):
    for batch in batches:
        c: Counter = Counter()
        for t in batch.column(0).to_pylist():
            c.update(word_counts(t))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])


def frequency_ranks(docs: DataFrame, text: str, vocabulary: int = VOCABULARY) -> DataFrame:
    """(word, n): the `vocabulary` most frequent words of all documents, ties in alphabetical order.

    Counts are summed per batch before the shuffle. A histogram of counts on a logarithmic scale (some hundred rows) says below which
    count no word can be among them, so that the final sort gets few words more than are wanted, however many there are.
    """
    counts = docs.where(F.col(text).isNotNull()).select(text).mapInArrow(_count_words, "word string, n bigint")
    counts = materialize(counts.groupBy("word").agg(F.sum("n").alias("n")).withColumn("bin", F.floor(F.log2("n") * 16).cast("int")), "word-counts")
    least, have = 0, 0
    for r in counts.groupBy("bin").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("bin")).collect():
        least, have = r.bin, have + r.c
        if have >= vocabulary:
            break
    return counts.where(F.col("bin") >= least).drop("bin").orderBy(F.desc("n"), "word").limit(vocabulary)


def prose(text: str) -> bool:
    """Whether a text as a whole is running prose: most of its tokens stand outside lists, tables and references, and
    function words join them."""
    c, d = text_stats(text)
    g = {n: c[k] for n, k in _I.items()}
    words = g["words"]
    if words < MIN_WORDS or g["prose_tokens"] * 2 < g["tokens"]:
        return False
    if g["common"] * 100 < words * 14:
        return False
    if g["singles"] * 10 >= g["tokens"] * 4 or g["damaged"] * 5 >= g["tokens"] or words >= MIN_WORDS * 5 and d <= 30 and d * 4 <= words:
        return False
    apart = g["plain_short"] + g["items"] + g["cells"] + g["toc"] + g["listings"]
    return not (apart * 10 >= g["lines"] * 8 and g["lines"] >= 4 and g["terminals"] * 20 < words) and (g["terminals"] > 0 or words >= MIN_WORDS * 5)


def sentence_length(text: str) -> int:
    """Words (divided by blanks) of the sentence in which the middle word of the text stands, with its sentences in order of length; 0 where none can be told. A
    stretch that holds several sentences without marks (function words with a capital inside it) or is too long for one tells nothing."""
    lengths: Counter = Counter()
    for s in _SENTENCE.split(text):
        tokens = s.split()
        n = len(tokens)
        if n and not (n > LONG or n > 8 and not _CAPITALS.isdisjoint(tokens[1:])):
            lengths[n] += n
    half, have = sum(lengths.values()) / 2, 0
    for n in sorted(lengths):
        have += lengths[n]
        if have >= half:
            return n
    return 0


class _Ranks(dict):
    """Ranks by word; words beyond the vocabulary share the rank after it."""

    def __missing__(self, _):
        return len(self) + 1


def coverage_ranks(counted: list[tuple[int, int]], shares=SHARES) -> list[int]:
    """For each share the size of the smallest frequency-ranked vocabulary that covers it, from (rank, tokens) of a document's words."""
    total = sum(n for _, n in counted)
    need = [math.ceil(s * total) for s in shares]
    out, have, k = [0] * len(shares), 0, len(shares) - 1
    for rank, n in sorted(counted):
        have += n
        while k >= 0 and have >= need[k]:
            out[k] = rank
            k -= 1
    return out


def _features(ranks, model):
    def run(batches):
        get = _Ranks(ranks.value).__getitem__
        lm = model.value if model is not None else None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at, cover, sentence = [], [], []
            for k, t in enumerate(texts):
                if lm is not None and not prose(t):
                    continue
                words = word_counts(t)
                if words.total() < MIN_WORDS or lm is not None and lm.of_words(words) != HOME:
                    continue
                at.append(k)
                cover.append(coverage_ranks([(get(w), n) for w, n in words.items()]))
                sentence.append(sentence_length(joined(t)))
            cols = [pa.array([c[k] for c in cover], pa.int64()) for k in range(len(SHARES))]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *cols, pa.array(sentence, pa.int64())], names=["id", *[f"c{k}" for k in range(len(SHARES))], "sentence"])

    return run


def _document_table(df: DataFrame, id_col: str, text: str, ranks, model) -> DataFrame:
    src = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    kind = src.schema["id"].dataType.simpleString()
    rows = src.mapInArrow(_features(ranks, model), f"id {kind}, {', '.join(f'c{k} bigint' for k in range(len(SHARES)))}, sentence bigint")
    # ranks and sentence lengths act on a logarithmic scale; without punctuation there is no sentence length
    return rows.select("id", *[F.log2(f"c{k}").alias(f"x{k}") for k in range(len(SHARES))], F.when(F.col("sentence") > 0, F.log2("sentence")).alias(f"x{len(SHARES)}"))


FEATURES = tuple(f"x{k}" for k in range(len(SHARES) + 1))
FLOOR = 0.1


def reading_levels(docs: DataFrame, labelled: DataFrame, doc_id: str, text: str, passage_id: str, passage: str, level: str, model: LanguageModel, vocabulary: int = VOCABULARY) -> DataFrame:
    """(doc_id, reading_level) of every document that is running prose in the language HOME, as `model` tells it.

    Words are ranked by frequency over all documents. For each document the smallest frequency-ranked vocabularies that cover SHARES
    of its tokens are found (their ranks), and the sentence length that half of its words reach. SQL calibrates ranks and sentence
    complexity on the labelled passages (mean and deviation per level) and gives each document the likeliest level. As ranks and
    sentence length are quantiles over a document's words, the level in which most of it is written prevails. Ranks above
    `vocabulary` count as one class, so the table sent to the executors is bounded.

    Null and blank texts, texts of under MIN_WORDS words, other languages, lists and tables have no row, whatever their labels
    say. Ties go to the level that comes first by name. Without labels nothing can be levelled and the result is empty.
    """
    spark = docs.sparkSession
    ranked = [r.word for r in frequency_ranks(docs, text, vocabulary).collect()]  # at most `vocabulary` words
    ranks = spark.sparkContext.broadcast({w: k + 1 for k, w in enumerate(ranked)})
    lm = spark.sparkContext.broadcast(model)  # bounded by the model's languages and trigrams
    marks = labelled.where(F.col(level).isNotNull()).select(F.col(passage_id).alias("__p"), F.col(passage).alias("__t"), F.col(level).alias("__l"))
    known = _document_table(marks.select(F.struct("__p", "__l").alias("__k"), "__t"), "__k", "__t", ranks, None).withColumn("level", F.col("id.__l"))
    stats = known.groupBy("level").agg(
        *[F.avg(x).alias(f"m{k}") for k, x in enumerate(FEATURES)], *[F.stddev_pop(x).alias(f"s{k}") for k, x in enumerate(FEATURES)]
    ).orderBy("level").limit(MAX_LEVELS + 1).collect()
    if len(stats) > MAX_LEVELS:
        raise ValueError(f"more than {MAX_LEVELS} reading levels")
    rows = _document_table(docs, doc_id, text, ranks, lm)
    if not stats:
        return rows.select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("reading_level")).limit(0)
    scores = []
    for r in stats:
        s = F.lit(0.0)
        for k, x in enumerate(FEATURES):
            if r[f"m{k}"] is None:
                continue
            sd = max(r[f"s{k}"] or 0.0, FLOOR)
            z = (F.col(x) - F.lit(float(r[f"m{k}"]))) / F.lit(float(sd))
            s = s + F.coalesce(-z * z / 2 - F.lit(math.log(sd)), F.lit(0.0))
        scores.append(F.struct(s.alias("s"), F.lit(r.level).alias("l")))
    best = F.aggregate(F.array(*scores[1:]), scores[0], lambda a, x: F.when(x["s"] > a["s"], x).otherwise(a)) if len(scores) > 1 else scores[0]
    return rows.select(F.col("id").alias("doc_id"), best["l"].alias("reading_level"))
