"""Fuzzy scores of strings from 0 to 100, as pure Python over bit-parallel longest common subsequences; the same for many pairs at once with NumPy."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str | None, b: str | None) -> float:
    """Normalised similarity by insertions and deletions: 200 x LCS / (|a| + |b|)."""
    a, b = a or "", b or ""
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str | None, b: str | None) -> float:
    """The best ratio of the shorter string with any stretch of its length of the longer one.

    The letters that a stretch has in common with the shorter string bound its ratio; stretches are tried in falling order of that
    bound, and none that can't beat the best so far.
    """
    a, b = a or "", b or ""
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long_ else 0.0
    n = len(short)
    need: dict[str, int] = {}
    for ch in short:
        need[ch] = need.get(ch, 0) + 1
    have: dict[str, int] = {}
    common, stretches = 0, []
    for end in range(1, len(long_) + n):  # the stretch that ends before `end`
        if end <= len(long_):
            ch = long_[end - 1]
            have[ch] = have.get(ch, 0) + 1
            if have[ch] <= need.get(ch, 0):
                common += 1
        if end > n:
            ch = long_[end - n - 1]
            if have[ch] <= need.get(ch, 0):
                common -= 1
            have[ch] -= 1
        size = min(end, len(long_)) - max(0, end - n)
        stretches.append((-200.0 * common / (n + size), end))
    best = 0.0
    for bound, end in sorted(stretches):
        if -bound <= best:
            break
        best = max(best, ratio(short, long_[max(0, end - n) : end]))
    return best


def token_set_ratio(a: str | None, b: str | None) -> float:
    """Similarity of the sets of words: the common words against each side's rest; 100 where one side holds the other."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    common, only_a, only_b = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not only_a or not only_b):
        return 100.0
    left, right = (common + " " + only_a).strip(), (common + " " + only_b).strip()
    scores = [ratio(left, right)]
    if common:
        scores += [ratio(common, left), ratio(common, right)]
    return max(scores)


def _flags(n: int, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """n whole numbers of 64 bits, with bit at[i] of number row[i] set."""
    out = np.zeros((n, 64), bool)
    out[row, at] = True
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64).ravel()


class Coded:
    """Texts as arrays: lengths, letters (up to WORD of them, as numbers of `letters`), 64 bits that tell which letters occur once and twice, and twice 64 bits
    that tell which pairs of neighbours occur."""

    WORD = 64

    def __init__(self, texts: Sequence[str]):
        self.texts = list(texts)
        n = len(self.texts)
        self.size = np.fromiter(map(len, self.texts), np.int64, n)
        chars = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        number = np.zeros(int(chars.max(initial=0)) + 1, np.int32)
        number[chars] = 1
        self.letters = np.flatnonzero(number)
        number[self.letters] = np.arange(len(self.letters))
        code = number[chars]
        row = np.repeat(np.arange(n), self.size)
        col = np.arange(len(chars)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        width = int(min(self.WORD, self.size.max(initial=0)))
        # the number after the last letter stands for no letter
        self.code = np.full((n, width), len(self.letters), np.uint8 if len(self.letters) < 256 else np.int32)
        self.code[row[col < width], col[col < width]] = code[col < width]
        # letters that are 32 apart count as one
        count = np.bincount(row * 32 + (chars - 97) % 32, minlength=n * 32)
        owner, letter = np.divmod(np.flatnonzero(count), 32)
        twice = count[owner * 32 + letter] > 1
        self.bits = _flags(n, np.concatenate([owner, owner[twice]]), np.concatenate([2 * letter, 2 * letter[twice] + 1]))
        pair = ((chars[:-1] * 40503 + chars[1:] * 30011) >> 3) % 128 if len(chars) else chars
        own = row[1:] == row[:-1]
        self.pairs = [_flags(n, row[1:][own & (pair // 64 == k)], pair[own & (pair // 64 == k)] % 64) for k in (0, 1)]


def _masks(c: Coded, rows: np.ndarray) -> np.ndarray:
    """Per row and letter, the bits of the places where the letter is; none for the number that stands for no letter."""
    out = np.zeros((len(rows), len(c.letters) + 1), np.uint64)
    for j in range(c.code.shape[1]):
        out[np.arange(len(rows)), c.code[rows, j]] |= np.uint64(1) << np.uint64(j)
    out[:, -1] = 0
    return out


def _lcs_of(c: Coded, masks: np.ndarray, pattern: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """lcs() of texts a and b pair by pair; `pattern` is the row of `masks` of each a."""
    v = np.full(len(a), ~np.uint64(0))
    flat, start, letters = masks.ravel(), pattern * masks.shape[1], np.ascontiguousarray(c.code[b].T)
    # pairs in order of length would save little: texts that are alike are about as long
    for j in range(int(min(c.code.shape[1], c.size[b].max(initial=0)))):
        u = v & flat[start + letters[j]]
        v = (v + u) | (v - u)
    size = c.size[a]
    used = np.where(size >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(size, 63).astype(np.uint64)) - np.uint64(1))
    out = size - np.bitwise_count(v & used).astype(np.int64)
    for i in np.flatnonzero((size > c.WORD) | (c.size[b] > c.WORD)):
        out[i] = lcs(c.texts[a[i]], c.texts[b[i]])
    return out


ROOM = 1 << 18
BATCH = 1 << 13


def alike(c: Coded, xs: np.ndarray, ys: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions in (xs, ys) of all pairs of texts whose ratio, rounded, reaches `threshold`.

    An insertion or deletion changes one length, one count of a letter, so at most one bit, and at most three pairs of neighbours, so at most three bits:
    pairs of texts further apart than the ratio leaves edits are out before the subsequence is measured. All numbers are whole, so nothing depends on rounding.
    """
    t = 2 * math.ceil(threshold) - 1
    xs, ys = np.asarray(xs, np.int64), np.asarray(ys, np.int64)
    got: list[tuple[np.ndarray, np.ndarray]] = []
    if len(xs) and len(ys):
        x_at, y_at = np.argsort(c.size[xs], kind="stable"), np.argsort(c.size[ys], kind="stable")
        xs, ys = xs[x_at], ys[y_at]
        x_size, y_size, y_bits = c.size[xs], c.size[ys], c.bits[ys]
        both = np.arange(0, 2 * int(c.size.max(initial=0)) + 1)
        edits = both * (200 - t) // 200
        edits -= (edits ^ both) & 1  # as many as both lengths together, but for whole pairs
        few = np.clip(edits, 0, 64).astype(np.uint8)

        def measure(p: np.ndarray, q: np.ndarray) -> None:
            which, pattern = np.unique(p, return_inverse=True)
            both = x_size[p] + y_size[q]
            ok = (400 * _lcs_of(c, _masks(c, xs[which]), pattern, xs[p], ys[q]) >= t * both) & (both > 0)
            got.append((x_at[p[ok]], y_at[q[ok]]))

        room = max(1, min(BATCH, (1 << 22) // (len(c.letters) + 1)))
        p, q = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = 0
        while at < len(xs):
            # texts of one length meet those of the lengths that the ratio leaves
            end = int(np.searchsorted(x_size, x_size[at], "right"))
            low = int(np.searchsorted(y_size, -(-t * int(x_size[at]) // (400 - t))))
            high = int(np.searchsorted(y_size, (400 - t) * int(x_size[at]) // t, "right")) if t > 0 else len(ys)
            end = min(end, at + ROOM // max(high - low, 1) + 1)
            if low < high:
                most = few[int(x_size[at]) + y_size[low:high]]
                near = np.bitwise_count(c.bits[xs[at:end]][:, None] ^ y_bits[None, low:high]) <= most
                i, j = np.divmod(np.flatnonzero(near), high - low)
                i, j = i + at, j + low
                apart = sum(np.bitwise_count(w[xs[i]] ^ w[ys[j]]).astype(np.int64) for w in c.pairs)
                ok = apart <= 3 * edits[x_size[i] + y_size[j]]
                p, q = np.concatenate([p, i[ok]]), np.concatenate([q, j[ok]])
                while len(p) >= room:
                    measure(p[:room], q[:room])
                    p, q = p[room:], q[room:]
            at = end
        if len(p):
            measure(p, q)
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in got]), np.concatenate([b for _, b in got])


def first_alike(xs: Sequence[str], ys: Sequence[str], threshold: float) -> np.ndarray:
    """For each x the position of the first y whose ratio, rounded, reaches `threshold`, else -1."""
    c = Coded([*xs, *ys])
    i, j = alike(c, np.arange(len(xs)), len(xs) + np.arange(len(ys)), threshold)
    out = np.full(len(xs), len(ys), np.int64)
    np.minimum.at(out, i, j)
    return np.where(out == len(ys), -1, out)


FOLD_STEP = 1024


def kept_first(texts: Sequence[str], keys: Sequence[str | None], joins: Sequence[bool], joined: Sequence[bool], threshold: float) -> np.ndarray:
    """The ordered fold: text after text joins the first kept one whose ratio reaches `threshold` (of those that may be joined), or is kept itself: -1; what
    has the key of a kept one isn't kept either: its own position, if nothing kept is alike. Texts that don't join are kept."""
    c = Coded(texts)
    n = len(c.texts)
    joins, joined = np.asarray(joins, bool), np.asarray(joined, bool)
    out = np.full(n, -1, np.int64)
    kept, n_kept = np.zeros(n, np.int64), 0
    seen: set[str] = set()
    for at in range(0, n, FOLD_STEP):
        rows = np.arange(at, min(at + FOLD_STEP, n))
        able = rows[joins[rows]]
        first = np.full(len(rows), n, np.int64)
        i, j = alike(c, able, kept[:n_kept], threshold)
        np.minimum.at(first, able[i] - at, kept[j])
        free = rows[first[rows - at] == n]
        i, j = alike(c, free[joins[free]], free[joined[free]], threshold)
        own: dict[int, list[int]] = {}
        for x, y in zip(free[joins[free]][i].tolist(), free[joined[free]][j].tolist()):
            if y < x:
                own.setdefault(x, []).append(y)
        for x in rows.tolist():
            y = int(first[x - at])
            if y == n:
                y = min((y for y in own.get(x, ()) if out[y] == -1), default=n)
            if y < n:
                out[x] = y
            elif joins[x] and keys[x] is not None and keys[x] in seen:
                out[x] = x
            else:
                if joined[x]:
                    kept[n_kept] = x
                    n_kept += 1
                if keys[x] is not None:
                    seen.add(keys[x])
    return out
