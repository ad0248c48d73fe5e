"""Problem 2: per-document text quality statistics, as counts that add up over the chunks of a text."""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .language import LanguageModel

CELL = 65_536
CHUNK_CHARS = 4 * CELL
HOME = "en"
FAN_IN = 16
BINS = 64

# The commonest function words of English.
COMMON = frozenset(
    "the a an of to and in is that for it as with by on be are this which from or can but not we each then when if so one its their other"
    " than more only at has have had was were you your they he she his her my our all any some who what how why there here will would could may"
    " do does did no into while whenever since because although before after without both between whose these those them it's don't never often".split()
)
# Words of page furniture.
FURNITURE = frozenset("home menu search subscribe share print download login log in cookies cookie accept all help back next prev previous top page of sign up out contact sitemap privacy policy terms skip".split())

WORD, COMMONW, NUMBER, TERMINAL, DAMAGED, SINGLE, SEPARATOR, LONG, NAV, STARTS = (1 << k for k in range(10))
_BLANK = re.compile(r"\s")
_CORE = re.compile(r"^[^\w]*(.*?)[^\w]*$", re.S)
_WORD = re.compile(r"[^\W\d_]+(?:['’\-/][^\W\d_]+)*$")
_NUMBER = re.compile(r"[-+±~≈<>$€£]?\d[\d.,:/%×x±–-]*%?$|^(?:n/a|yes|no|-)$")
_TERM = re.compile(r"[.!?…][\"'”’)\]»*_]*$")
_MOJIBAKE = re.compile(r"[ÃÂâ][\x80-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ¡-¿]|�|Ã")
_DEBRIS = re.compile(r"</?\w+|&\w+;|0x[0-9a-f]{6,}|^[:=_~#*]{4,}$|^=$")
_DOTS = re.compile(r"\.{4,}|(?:\. ){3,}|…{2,}")
_ITEM = re.compile(r"\s*(?:\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|[-–—•*·▪◦»>+]|\[\d+\]|(?:week|chapter|section|unit|lecture|day|part|module|session)\s+\d+\s*[:|.\-–—(])(?:\s|$)", re.I)
_NUMBERED = re.compile(r"\s*\d+(?:\.\d+)+\.?\s")
_LABEL = re.compile(r"\s*(?:keywords?|topics?|see also|index|terms?|tags?|contents?|glossary|related|concepts?|references?|further reading|subjects?)\s*:", re.I)
_GAP = re.compile(r"\S(?:\t+| {3,})(?=\S)")
_CELLS = re.compile(r"\s[|&]\s|\t")
_SYMBOLS = re.compile(r"[^\w\s.,;:'’\"“”()?!-]")
_TIGHT = re.compile(r"[^\s,],(?=[^\s,])")
_RUN_TOGETHER = re.compile(r"[^\W\d_]{25,}")
_LISTING = re.compile(r"\s/\s|[;,]\s|\s[·•|]\s")


def _token(tok: str) -> tuple[int, int]:
    """(flags, letters) of a token cut at blanks."""
    core = _CORE.match(tok).group(1)
    low = core.lower()
    flags = 0
    letters = sum(ch.isalpha() for ch in core)
    if core and _WORD.match(core):
        flags |= WORD
        if low in COMMON and (len(low) > 1 or len(tok) == 1 or tok[-1] != "."):
            flags |= COMMONW
        if len(core) == 1 and low not in ("a", "i"):
            flags |= SINGLE
    elif len(core) == 1 and core.isalpha():
        flags |= SINGLE
    elif _NUMBER.match(tok) or _NUMBER.match(core or tok):
        flags |= NUMBER
    elif letters and not core.isalnum() and _damaged(core):
        flags |= DAMAGED
    if _MOJIBAKE.search(tok) or _DEBRIS.search(tok):
        flags |= DAMAGED
    if low in FURNITURE or tok in ("«", "»", "‹", "›"):
        flags |= NAV
    if _TERM.search(tok) and letters and not _DOTS.search(tok):
        flags |= TERMINAL
    if tok in ("|", "&", "||"):
        flags |= SEPARATOR
    if len(core) > 30 and "-" not in core and "_" not in core and not core.isalpha():
        flags |= LONG
    if len(core) > 45:
        flags |= LONG
    if core[:1].isupper():
        flags |= STARTS
    return flags, len(core) if flags & WORD else 0


def _damaged(core: str) -> bool:
    """Signs among letters where no word has them."""
    odd = sum(not (ch.isalnum() or ch in "'’-/.,_:;()^+*=\\­") for ch in core)
    return odd >= 1


# A token's counts in one integer, FIELD bits each, so that a line's counts are one sum. No field can overflow: a text has under 2^31
# characters, so no count or sum of lengths reaches 2^FIELD.
FIELD = 40
_MASK = (1 << FIELD) - 1
_PACKED = (WORD, COMMONW, NUMBER, TERMINAL, DAMAGED, SINGLE, SEPARATOR, NAV, STARTS)


class _Packed(dict):
    def __missing__(self, tok):
        flags, letters = _token(tok)
        v = letters
        for k, f in enumerate(_PACKED, 1):
            if flags & f:
                v |= 1 << FIELD * k
        if flags & LONG:
            v |= len(tok) << FIELD * 10
        v |= len(_SYMBOLS.findall(tok)) << FIELD * 11
        if len(self) < 300_000 and len(tok) <= 64:
            self[tok] = v
        return v


class _Bins(dict):
    def __missing__(self, tok):
        v = zlib.crc32(_CORE.match(tok).group(1).lower().encode("utf-8", "replace")) % BINS
        if len(self) < 300_000 and len(tok) <= 64:
            self[tok] = v
        return v


_COUNTS, _BIN = _Packed(), _Bins()


# The counts of a text; each is a sum over its tokens or lines.
NAMES = (
    "tokens", "words", "letters", "common", "numbers", "terminals", "damaged", "singles", "long_chars", "nav", "chars",
    "lines", "ended", "items", "cells", "toc", "listings", "labels", "symbols", "starts", "plain_short", "foreign", "prose_tokens", "item_words",
)
_I = {n: k for k, n in enumerate(NAMES)}


@dataclass
class Stats:
    """Counts of a chunk: closed lines as sums, and the cut lines at its two ends as state.

    `whole` says that the chunk has no line break: then `left` is all of it. Merging is associative: (a+b)+c == a+(b+c).
    After soft_breaks a line is shorter than 2 x CELL, so the state is of constant size.
    """

    sums: list[int] = field(default_factory=lambda: [0] * len(NAMES))
    bins: list[int] = field(default_factory=lambda: [0] * BINS)
    left: str = ""
    right: str = ""
    whole: bool = True


def soft_breaks(text: str, cell: int = CELL) -> list[str]:
    """`text` cut behind its first blank in every full cell of `cell` characters that has no line break: the pieces, which count as lines of their own.

    The cells lie on a grid from the start of the text, so a chunk that starts on the grid is cut alike alone and as part of its
    document. A cell without any blank is cut at its start. Texts below a cell are not touched.
    """
    if len(text) < cell:
        return [text]
    out, at = [], 0
    for lo in range(0, len(text) - cell + 1, cell):
        hi = lo + cell
        if text.find("\n", lo, hi) >= 0:
            continue
        m = _BLANK.search(text, lo, hi)
        cut = m.end() if m else lo
        if cut > at:
            out.append(text[at:cut])
            at = cut
    out.append(text[at:])
    return out


def lines_of(text: str, cell: int = CELL) -> list[str]:
    """The lines of a text, with soft breaks in overlong ones."""
    return [line for part in soft_breaks(text, cell) for line in part.split("\n")]


def add_line(sums: list[int], bins: list[int], line: str, model: LanguageModel | None = None) -> None:
    """Adds one whole line to the counts; `model` tells the words of lines in another language than HOME."""
    toks = line.split()
    if not toks:
        return
    packed = sum(map(_COUNTS.__getitem__, toks))
    letters, words, common, numbers, terms, damaged, singles, seps, nav, starts, longc, symbols = (packed >> FIELD * k & _MASK for k in range(12))
    for b in set(map(_BIN.__getitem__, toks)):
        bins[b] += 1
    n = len(toks)
    last = toks[-1]
    ended = 1 if _COUNTS[last] >> FIELD * 4 & 1 else 0
    item = 1 if _ITEM.match(line) or _NUMBERED.match(line) else 0
    toc = 1 if (".." in line or ". ." in line or "…" in line) and _DOTS.search(line) and (last.isdigit() or _COUNTS[last] >> FIELD * 3 & 1) else 0
    label = 1 if _LABEL.match(line) else 0
    cells = 0
    if not item and not toc:
        gaps = len(_CELLS.findall(line)) if "|" in line or "&" in line or "\t" in line else 0
        gaps += len(_GAP.findall(line)) if "   " in line or "\t" in line else 0
        tight = len(_TIGHT.findall(line)) if common <= 1 and "," in line and not _RUN_TOGETHER.search(line) else 0
        if seps >= 1 or gaps >= 1 or (tight >= 1 and common <= 1):
            cells = 1 if common * 5 < n or gaps + seps >= 3 else 0
    listing = 0
    if not cells and common * 10 < n and not item:
        listing = len(_LISTING.findall(line))
        listing = 1 if listing >= 4 and terms <= 1 or label else 0
    foreign = 0
    if model is not None and common * 4 < words and words >= 8 and model.of_text(line) not in (None, HOME):
        foreign = words
    if cells or toc:
        damaged = longc = singles = 0
    chars = len(line)
    for k, v in (
        ("tokens", n), ("words", words), ("letters", letters), ("common", common), ("numbers", numbers), ("terminals", terms), ("damaged", damaged),
        ("singles", singles), ("long_chars", longc), ("nav", nav), ("chars", chars), ("lines", 1), ("ended", ended), ("items", item), ("cells", cells),
        ("toc", toc), ("listings", listing), ("labels", label), ("symbols", symbols), ("starts", starts),
        ("plain_short", 1 if not (item or cells or toc) and n <= 14 and not terms else 0),
        ("foreign", foreign), ("prose_tokens", n if not (item or cells or toc or listing) else 0), ("item_words", common if item else 0),
    ):
        if v:
            sums[_I[k]] += v


def chunk_stats(text: str, model: LanguageModel | None = None, cell: int = CELL) -> Stats:
    """The partial counts of one chunk that starts on the grid of cells."""
    s = Stats()
    lines = lines_of(text, cell)
    if len(lines) == 1:
        s.left = text
        return s
    s.whole = False
    s.left, s.right = lines[0], lines[-1]
    for line in lines[1:-1]:
        add_line(s.sums, s.bins, line, model)
    return s


def merge(a: Stats, b: Stats, model: LanguageModel | None = None) -> Stats:
    """The counts of two chunks that follow each other: the line across the boundary is put together and counted once."""
    out = Stats([x + y for x, y in zip(a.sums, b.sums)], [x + y for x, y in zip(a.bins, b.bins)])
    if a.whole and b.whole:
        out.left = a.left + b.left
        return out
    out.whole = False
    if a.whole:
        out.left, out.right = a.left + b.left, b.right
    elif b.whole:
        out.left, out.right = a.left, a.right + b.left
    else:
        out.left, out.right = a.left, b.right
        add_line(out.sums, out.bins, a.right + b.left, model)
    return out


def close(s: Stats, model: LanguageModel | None = None) -> Stats:
    """The counts of a whole text: the first and last line are closed."""
    out = Stats(list(s.sums), list(s.bins), whole=False)
    add_line(out.sums, out.bins, s.left, model)
    if not s.whole:
        add_line(out.sums, out.bins, s.right, model)
    return out


def text_stats(text: str, model: LanguageModel | None = None) -> tuple[list[int], int]:
    """(counts in the order of NAMES, estimate of distinct words) of a whole text."""
    sums, bins = [0] * len(NAMES), [0] * BINS
    for line in lines_of(text):
        add_line(sums, bins, line, model)
    return sums, distinct(bins)


def distinct(bins: list[int]) -> int:
    """Linear counting over the word bins."""
    free = bins.count(0)
    return round(-BINS * math.log(free / BINS)) if free else 10 * BINS


_STATE = "no int, n int, sums array<bigint>, words int, bins array<bigint>, left string, right string, whole boolean"
_TYPES = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), pa.string(), pa.string(), pa.bool_())
_COLUMNS = ("no", "n", "sums", "words", "bins", "left", "right", "whole")


def _batch(ids, where: list[int], rows: list[tuple]):
    cols = list(zip(*rows)) if rows else [[]] * len(_COLUMNS)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(where, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, _TYPES)]], names=["__id", *_COLUMNS])


def _first(model, chunk_chars: int):
    """A text of one chunk becomes its counts, a longer one its chunks (as `left`, without counts)."""

    def run(batches):
        lm = model.value if model is not None else None
        for batch in batches:
            ids, where, rows, held = batch.column(0), [], [], 0
            for k, text in enumerate(batch.column(1).to_pylist()):
                if len(text) <= chunk_chars:
                    sums, words = text_stats(text, lm)
                    where.append(k)
                    rows.append((0, 1, sums, words, None, None, None, None))
                    continue
                n = -(-len(text) // chunk_chars)
                for no in range(n):
                    where.append(k)
                    rows.append((no, n, None, None, None, text[no * chunk_chars : (no + 1) * chunk_chars], None, None))
                    held += chunk_chars
                    if held > 16 * chunk_chars:  # a batch of chunks stays small
                        yield _batch(ids, where, rows)
                        where, rows, held = [], [], 0
            yield _batch(ids, where, rows)

    return run


def _partials(model, cell: int):
    def run(batches):
        lm = model.value if model is not None else None
        for batch in batches:
            d = batch.to_pydict()
            rows = []
            for no, n, text in zip(d["no"], d["n"], d["left"]):
                s = chunk_stats(text, lm, cell)
                rows.append((no, n, s.sums, None, s.bins, s.left, s.right, s.whole))
            yield _batch(batch.column(0), list(range(len(rows))), rows)

    return run


def _merge_group(model):
    def run(pdf):
        import pandas as pd

        lm = model.value if model is not None else None
        pdf = pdf.sort_values("no")
        states = [Stats(list(r.sums), list(r.bins), r.left, r.right, bool(r.whole)) for r in pdf.itertuples()]
        s = states[0]
        for x in states[1:]:
            s = merge(s, x, lm)
        n = -(-int(pdf.n.iloc[0]) // FAN_IN)
        if n == 1:
            s = close(s, lm)
        row = {"no": pdf.no.iloc[0] // FAN_IN, "n": n, "sums": s.sums, "words": distinct(s.bins), "bins": s.bins, "left": s.left if n > 1 else "", "right": s.right if n > 1 else "", "whole": s.whole}
        return pd.DataFrame([{"__id": pdf["__id"].iloc[0], **row}])

    return run


def document_stats(df: DataFrame, id_col: str, text_col: str, model: LanguageModel | None = None, chunk_chars: int = CHUNK_CHARS, cell: int = CELL) -> DataFrame:
    """(id, the counts of NAMES, distinct_words) of every row with a text; ids must be unique.

    Texts above `chunk_chars` (a multiple of `cell`) are cut into chunks that are spread over all tasks, counted apart with the cut lines as boundary
    state (of constant size, see soft_breaks), and merged in a tree of fan-in FAN_IN, so no task gets more than FAN_IN chunks. Null texts have no
    row; an empty text has zero counts. Without a `model` no line counts as foreign. Other columns are not kept.
    """
    spark = df.sparkSession
    chunk_chars = max(cell, chunk_chars // cell * cell)
    lm = spark.sparkContext.broadcast(model) if model is not None else None  # bounded by the model's languages and trigrams
    src = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    schema = f"__id {src.schema['__id'].dataType.simpleString()}, {_STATE}"
    states = materialize(src.mapInArrow(_first(lm, chunk_chars), schema), "text-stats")
    done, rest = states.where("n = 1"), states.where("n > 1")
    if rest.take(1):
        rest = materialize(rest.repartition("__id", "no").mapInArrow(_partials(lm, cell), schema), "text-stats")
        while rest.take(1):
            step = rest.withColumn("__g", F.floor(F.col("no") / FAN_IN)).groupBy("__id", "__g").applyInPandas(_merge_group(lm), schema)
            step = materialize(step, "text-stats")
            done, rest = done.unionByName(step.where("n = 1")), step.where("n > 1")
    return done.select(F.col("__id").alias(id_col), *[F.col("sums")[_I[n]].alias(n) for n in NAMES], F.col("words").cast("bigint").alias("distinct_words"))


def ratio(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))


def ratios() -> list[Column]:
    """The statistics of a document as shares, from its counts."""
    return [
        F.col("words").alias("word_count"), ratio("letters", "words").alias("mean_word_length"), ratio("symbols", "chars").alias("symbol_ratio"),
        ratio("ended", "lines").alias("line_end_share"), ratio("common", "words").alias("common_word_share"),
    ]


def passage_kind() -> Column:
    """prose, list, table or junk from the counts; null for a text without tokens. The first rule that holds decides."""
    share = lambda a, b, least: F.col(a) >= F.lit(least) * F.col(b)
    sentences = (F.col("terminals") >= 1) & share("common", "words", 0.12) & share("prose_tokens", "tokens", 0.5)
    return (
        F.when(F.col("tokens") == 0, F.lit(None).cast("string"))
        .when(share("damaged", "tokens", 0.2) | share("singles", "tokens", 0.4) | share("long_chars", "chars", 0.4), "junk")
        .when(share("nav", "tokens", 0.5) & (F.col("terminals") == 0), "junk")
        .when((F.col("words") >= 20) & (F.col("distinct_words") <= 30) & (F.col("distinct_words") * 4 <= F.col("words")) & ~share("cells", "lines", 0.5), "junk")
        .when(share("cells", "lines", 0.5) & ~sentences, "table")
        .when((F.col("items") + F.col("toc") + F.col("listings") >= F.lit(0.5) * F.col("lines")) & (F.col("item_words") * 5 < F.col("tokens")) & ~sentences, "list")
        .when((F.col("items") + F.col("toc") >= F.lit(0.5) * F.col("lines")) & (F.col("terminals") == 0), "list")
        .when(share("plain_short", "lines", 0.8) & (F.col("lines") >= 4) & (F.col("terminals") == 0), "list")
        .when(~share("common", "words", 0.05) & (F.col("foreign") * 4 < F.col("words")) & (F.col("words") >= 8), "list")
        .otherwise("prose")
    )
