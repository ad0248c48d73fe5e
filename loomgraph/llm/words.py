"""Kernels over word sequences: normal form, bit-parallel and diagonal edit distance, longest common subsequence."""

from __future__ import annotations

import re
import unicodedata

_HYPHEN = re.compile(r"(?<=[^\W\d_])[-­‐‑]\s*(?=[^\W\d_])")
_DROP = re.compile("[​‌‍﻿­]")
_WORDS = re.compile(r"[^\W_]+")


def normal_words(text: str) -> list[str]:
    """Words in lower case without any formatting: compatibility forms folded, words broken at line ends or written with
    hyphens joined, everything but letters and digits a boundary."""
    if not text.isascii():
        text = _DROP.sub("", unicodedata.normalize("NFKC", text))
    if "-" in text or not text.isascii():
        text = _HYPHEN.sub("", text)
    return _WORDS.findall(text.lower())


# Closing lines of prompts, in normal form, that stand after the passage.
ENDINGS = frozenset({"answer with the json array and nothing else"})


def passage_of(instruction: str, endings: frozenset = ENDINGS) -> str:
    """The passage after `TEXT:`; the whole text if there is no mark. A last line that is one of the known prompt endings goes, any other
    last line belongs to the passage."""
    p = instruction.split("TEXT:", 1)[-1].rstrip()
    body, cut, last = p.rpartition("\n")
    return body if cut and " ".join(normal_words(last)) in endings else p


def masks(pattern) -> dict:
    """Positions of each symbol of a pattern as bits."""
    out: dict = {}
    for i, x in enumerate(pattern):
        out[x] = out.get(x, 0) | 1 << i
    return out


def myers_search(peq: dict, m: int, text) -> tuple[int, int]:
    """(distance, end): the least edit distance of a pattern of m symbols to any stretch of `text`, and where that ends (Myers 1999)."""
    full = (1 << m) - 1
    top = 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    get = peq.get
    for j, x in enumerate(text):
        eq = get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


def lcs_length(peq: dict, m: int, text) -> int:
    """Length of the longest common subsequence of a pattern of m symbols and `text`, bit-parallel."""
    full = (1 << m) - 1
    v = full
    get = peq.get
    for x in text:
        u = v & get(x, 0)
        v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def banded_distance(a, b, k: int) -> int:
    """Edit distance of two sequences if it is at most k, else k + 1: dynamic programming over the 2k + 1 diagonals of the
    band, each cell the farthest row reached with a number of edits."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return k + 1
    goal = m - n

    def slide(i: int, d: int) -> int:
        j = i + d
        while i < n and j < m and a[i] == b[j]:
            i += 1
            j += 1
        return i

    reach = {0: slide(0, 0)}
    if goal == 0 and reach[0] >= n:
        return 0
    for e in range(1, k + 1):
        new = {}
        for d in range(-e, e + 1):
            best = -1
            x = reach.get(d)
            if x is not None:
                best = x + 1  # substitution
            x = reach.get(d + 1)
            if x is not None and x + 1 > best:
                best = x + 1  # symbol of a dropped
            x = reach.get(d - 1)
            if x is not None and x > best:
                best = x  # symbol of b dropped
            if best < 0:
                continue
            best = min(best, n, m - d)
            if best < 0 or best + d < 0:
                continue
            new[d] = slide(best, d)
        reach = new
        if reach.get(goal, -1) >= n:
            return e
    return k + 1


def osa_distance(a: str, b: str, k: int) -> int:
    """Edits with swaps of neighbours counted as one, if at most k, else k + 1."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return k + 1
    before, last = None, list(range(m + 1))
    for i in range(1, n + 1):
        now = [i] + [0] * m
        for j in range(1, m + 1):
            c = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                c = min(c, before[j - 2] + 1)
            now[j] = c
        if min(now) > k:
            return k + 1
        before, last = last, now
    return min(last[m], k + 1)
