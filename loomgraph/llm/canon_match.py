"""Problem 5: mapping free-entered values to a canonical list."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize, salted_join, salts_for
from .words import osa_distance

THRESHOLD = 0.2
MAX_EDITS = 3
ACRONYM = 3
_DROP = re.compile("[​‌‍﻿­]")
_DOTTED = re.compile(r"\b((?:[^\W\d_]\.){2,})\.*")
_PAREN = re.compile(r"[(\[][^)\]]*[)\]]")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W_]+\.?")

# Wording that people put around a name.
LEADING = (("the", "concept", "of"), ("concept", "of"), ("introduction", "to"), ("intro", "to"), ("basics", "of"), ("overview", "of"), ("the",), ("a",), ("an",), ("on",), ("basic",), ("about",))
TRAILING = (("overview",), ("method",), ("methods",), ("technique",), ("techniques",), ("approach",), ("algorithm",), ("basics",), ("basic",))


def normal_value(v: str) -> str:
    """A value as words in lower case: abbreviation dots stay, brackets, framing words and formatting go, `B, A` becomes `A B`."""
    t = _DROP.sub("", unicodedata.normalize("NFKC", v)).strip()
    if not re.search(r"\s", t):
        t = _CAMEL.sub(" ", t)
    bare = _PAREN.sub(" ", t)
    if re.search(r"\w", bare):
        t = bare
    t = _DOTTED.sub(lambda m: m.group(1).replace(".", ""), t)
    parts = t.split(",")
    if len(parts) == 2 and all(re.search(r"\w", p) for p in parts):
        t = parts[1] + " " + parts[0]
    t = re.sub(r"\.\s*$", "", t) if not re.search(r"\w{3,}\.\s*$", t) else t
    words = _WORD.findall(t.lower())
    words = [w[:-1] if w.endswith(".") and len(w) < 4 else w for w in words]
    changed = True
    while changed and len(words) > 1:
        changed = False
        for lead in LEADING:
            if len(words) > len(lead) and tuple(words[: len(lead)]) == lead:
                words, changed = words[len(lead) :], True
                break
        for tail in TRAILING:
            if len(words) > len(tail) and tuple(w.rstrip(".") for w in words[-len(tail) :]) == tail:
                words, changed = words[: -len(tail)], True
                break
    return " ".join(words)


def tokens(words: str) -> list[str]:
    """The trigrams of each word, padded at its ends (not at the cut end of an abbreviation)."""
    out = set()
    for w in words.split():
        p = "_" + (w[:-1] if w.endswith(".") else w + "_")
        out.update(p[i : i + 3] for i in range(max(1, len(p) - 2)))
    return sorted(out)


def _spelling(w: str) -> str:
    return re.sub(r"iz(?=e|ation|ing)", "is", w)


def word_cost(v: str, s: str, known: bool) -> float | None:
    """Cost of a written word for a listed one, or None. A word that is listed itself is no misspelling of another."""
    if v == s:
        return 0.0
    if v.endswith("."):
        v = v[:-1]
        if v == s:
            return 0.0
        if len(v) >= 3 and s.startswith(v):
            return 0.5
    if _spelling(v) == _spelling(s):
        return 0.1
    if known:
        return None
    if v in (s + "s", s + "es"):
        return 0.2
    k = 1 if len(s) <= 4 else 2 if len(s) < 8 else 3
    d = osa_distance(v, s, k)
    if d > k:
        return None
    if d == 2 and len(s) < 9 and len(v) == len(s) and sum(a != b for a, b in zip(v, s)) == 2 and sorted(v) != sorted(s) and osa_distance(v[1:], s[1:], 1) <= 1:
        return None  # a first letter and another one replaced: rather another word
    return float(d)


def name_cost(value: str, surface: str, known: set[str]) -> float | None:
    """Cost of a normal value for a listed name, or None if it doesn't mean it."""
    if value == surface:
        return 0.0
    if value.rstrip(".") == surface:
        return 0.0
    v, s = value.split(), surface.split()
    if len(s) == 1 and len(s[0]) <= ACRONYM:
        return None  # an acronym holds as it is: any other letter makes another one
    if len(v) == len(s):
        total = 0.0
        for a, b in zip(v, s):
            c = word_cost(a, b, a.rstrip(".") in known)
            if c is None:
                break
            total += c
        else:
            return total if total <= MAX_EDITS else None
        if len(v) == 1:
            return None
        return None
    a, b = "".join(w.rstrip(".") for w in v), "".join(s)
    if a == b:
        return 0.05
    if len(v) == 1 and v[0] in known:
        return None
    d = osa_distance(a, b, 2)
    return d + 0.5 if d <= 2 and len(b) > 8 and abs(len(v) - len(s)) <= 2 else None


def _prepare(batches):
    for batch in batches:
        raw = batch.column(0)
        forms = [normal_value(v) for v in raw.to_pylist()]
        yield pa.RecordBatch.from_arrays([raw, pa.array(forms, pa.string()), pa.array([tokens(f) for f in forms], pa.list_(pa.string()))], names=["raw", "form", "toks"])


def _confirm(threshold: float):
    """(form, ref_id, share, cost) of the candidate pairs whose trigram sets are similar enough and whose words can mean the same."""

    def run(batches):
        sets: dict[str, frozenset] = {}

        def trigrams(x: str) -> frozenset:
            if x not in sets:
                if len(sets) > 100_000:
                    sets.clear()  # a cache only
                sets[x] = frozenset(tokens(x))
            return sets[x]

        for batch in batches:
            form, name, ref, known = (batch.column(k).to_pylist() for k in range(4))
            at, shares, costs = [], [], []
            for k, (f, s, w) in enumerate(zip(form, name, known)):
                mine, theirs = trigrams(f), trigrams(s)
                common = len(mine & theirs)
                share = common / (len(mine) + len(theirs) - common)
                if share >= threshold:
                    cost = name_cost(f, s, set(w or ()))
                    if cost is not None:
                        at.append(k)
                        shares.append(share)
                        costs.append(cost)
            pick = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(2).take(pick), pa.array(shares, pa.float64()), pa.array(costs, pa.float64())], names=["form", "ref_id", "share", "cost"])

    return run


def surfaces(reference: DataFrame, ref_id: str, name: str, aliases: str) -> DataFrame:
    """(ref_id, surface): names, listed aliases, and the initials (three letters or more) that only one entry has and none lists."""
    r = reference.where(F.col(name).isNotNull()).select(F.col(ref_id).cast("bigint").alias("ref_id"), F.col(name).alias("name"), F.col(aliases).alias("al"))
    names = r.select("ref_id", F.col("name").alias("surface"))
    al = r.select("ref_id", F.explode("al").alias("surface")).where("surface is not null")
    words = F.filter(F.split(F.trim("name"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    ini = r.where(F.size(words) >= 3).select("ref_id", F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")).alias("surface"))
    one = ini.groupBy("surface").agg(F.min("ref_id").alias("ref_id"), F.count_distinct("ref_id").alias("n")).where("n = 1")
    free = one.join(al.select("surface").distinct(), "surface", "left_anti").select("ref_id", "surface")
    return names.unionByName(al).unionByName(free)


def match_values(values: DataFrame, reference: DataFrame, ref_id: str, name: str, aliases: str, threshold: float = THRESHOLD) -> DataFrame:
    """(raw, ref_id) of every distinct non-null value of the one column of `values`: the entry it means, or -1.

    Prefix-filter set-similarity join: each side's trigrams are put in order of global rarity; only the first |x| - ceil(t|x|) + 1 are
    joined; length and position filters prune; the Jaccard similarity is verified exactly. The most similar entry of `threshold` or more is kept
    among those that an exact check of words confirms (misspellings, abbreviations, spelling variants, formatting; words in common alone don't
    do), ties by the cheaper words, then the smaller id. Values are reduced to distinct forms first, so frequent ones cost nothing.

    Empty reference: all -1. Blank values are -1. Repeated entries with one name: the smallest id.
    """
    raw = values.toDF("raw").where("raw is not null").distinct()
    v = materialize(raw.mapInArrow(_prepare, "raw string, form string, toks array<string>"), "values")
    s = surfaces(reference, ref_id, name, aliases).select("ref_id", "surface")
    prepared = materialize(s.select("surface").distinct().mapInArrow(_prepare, "raw string, form string, toks array<string>"), "surface-forms")
    s = s.join(prepared.withColumnRenamed("raw", "surface"), "surface")
    s = materialize(s.where("size(toks) > 0").groupBy("form").agg(F.min("ref_id").alias("ref_id"), F.first("toks").alias("toks")), "surfaces")
    forms = v.where("size(toks) > 0").groupBy("form").agg(F.first("toks").alias("toks"))

    rarity = forms.select(F.explode("toks").alias("tok")).unionByName(s.select(F.explode("toks").alias("tok"))).groupBy("tok").agg(F.count(F.lit(1)).alias("f"))
    rarity = materialize(rarity, "rarity")

    def prefixes(side: DataFrame, out: str) -> DataFrame:
        ranked = side.select(F.xxhash64("form").alias(out), F.explode("toks").alias("tok")).join(rarity, "tok")
        ranked = ranked.groupBy(out).agg(F.array_sort(F.collect_list(F.struct("f", "tok"))).alias("o"))  # a form's own trigrams
        n = F.size("o")
        keep = n - F.ceil(F.lit(threshold) * n).cast("int") + 1
        first = F.transform(F.slice("o", 1, keep), lambda x: x["tok"])
        return ranked.select(out, n.alias(f"n_{out}"), F.posexplode(first).alias(f"i_{out}", "tok"))

    # forms are known by a 64-bit hash here (two of n share one with a chance of n^2 / 2^65), what is verified are the forms themselves
    pv, ps = prefixes(forms, "v"), prefixes(s, "s")
    need = F.ceil(F.lit(threshold) / (1 + threshold) * (F.col("n_v") + F.col("n_s")))
    # a trigram that many values hold is split, the reference's side is repeated
    pairs = hot_join(pv, ps, ["tok"], "v", rarity.select("tok", F.col("f").alias("n")), rarity.agg(F.sum("f")).first()[0] or 0).where(
        (F.col("n_s") >= F.lit(threshold) * F.col("n_v")) & (F.col("n_v") >= F.lit(threshold) * F.col("n_s"))
        & (F.least(F.col("n_v") - F.col("i_v"), F.col("n_s") - F.col("i_s")) + F.least("i_v", "i_s") >= need)
    )
    pairs = pairs.select("v", "s").distinct()

    names = prepared.join(reference.select(F.col(name).alias("raw")).distinct(), "raw", "left_semi")
    listed = names.select(F.explode(F.split("form", " ")).alias("w")).distinct()
    spelled = forms.select("form", F.explode(F.split("form", " ")).alias("x")).withColumn("w", F.rtrim(F.col("x"), F.lit(".")))
    known = spelled.join(listed, "w").groupBy("form").agg(F.collect_set("w").alias("known"))  # at most a form's own words
    texts = forms.select("form").join(known, "form", "left").select(F.xxhash64("form").alias("v"), "form", "known")
    sure = pairs.join(s.select(F.xxhash64("form").alias("s"), F.col("form").alias("name"), "ref_id"), "s").join(texts, "v")
    sure = sure.select("form", "name", "ref_id", "known").mapInArrow(_confirm(threshold), "form string, ref_id bigint, share double, cost double")
    # the most similar entry is kept, then the one with the cheapest words, then the smallest id
    best = sure.groupBy("form").agg(F.max_by("ref_id", F.struct("share", -F.col("cost"), -F.col("ref_id"))).alias("ref_id"))
    return v.select("raw", "form").join(best, "form", "left").select("raw", F.coalesce("ref_id", F.lit(-1).cast("bigint")).alias("ref_id"))


BLANK = r"^[\s  -‏  　﻿]*$"


def field_values(records: DataFrame, id_col: str, scalar: list[str], arrays: list[str]) -> DataFrame:
    """(id, field_name, pos, raw): every non-blank value of the named fields, with its index in the array (0 for a scalar)."""
    parts = [records.select(F.col(id_col), F.lit(c).alias("field_name"), F.lit(0).alias("pos"), F.col(c).alias("raw")) for c in scalar]
    parts += [records.select(F.col(id_col), F.lit(c).alias("field_name"), F.posexplode(c).alias("pos", "raw")) for c in arrays]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("raw").isNotNull() & ~F.col("raw").rlike(BLANK))


def canonicalise_fields(records: DataFrame, reference: DataFrame, id_col: str, scalar: list[str], arrays: list[str], ref_id: str, name: str, aliases: str) -> DataFrame:
    """(id, field_name, pos, ref_id) of every non-blank value that is not exactly a canonical name; -1 where it names none.

    Null arrays and null or blank elements give no row; a value that a third of the rows share is salted in the join back.
    """
    occ = field_values(records, id_col, scalar, arrays)
    exact = reference.where(F.col(name).isNotNull()).select(F.col(name).alias("raw")).distinct()
    occ = materialize(occ.join(exact, "raw", "left_anti"), "occurrences")
    found = match_values(occ.select("raw"), reference, ref_id, name, aliases)
    return salted_join(occ, found, ["raw"], id_col, salts_for(occ)).select(id_col, "field_name", "pos", "ref_id")
