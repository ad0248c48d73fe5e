"""Column builders for text: everything stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content of their own in grounding checks.
STOPWORDS = (
    "the", "a", "an", "of", "and", "or", "to", "in", "on", "for", "with", "by", "is", "are", "was", "were", "be", "been", "being", "that", "this",
    "these", "those", "it", "its", "as", "at", "from", "which", "can", "we", "you", "they", "their", "our", "not", "but", "if", "then", "than",
    "also", "such", "each", "other", "into", "over", "under", "between", "through", "when", "where", "how", "what", "all", "any", "some", "more",
    "most", "used", "using", "use", "based", "one", "two", "may", "will", "would", "should", "could", "has", "have", "had", "do", "does", "done",
    "there", "about", "both", "very", "given", "well", "only", "called",
)


def let(value: Column, then) -> Column:
    """`then(value)` with `value` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def strip(c: Column) -> Column:
    """Without white space at both ends (any kind, not only blanks)."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def tokens(c: Column) -> Column:
    """The tokens between white space."""
    return F.filter(F.split(c, r"[\s\p{Z}]+"), lambda t: t != "")


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def title_case(c: Column) -> Column:
    """Every run of letters starts with a capital: unlike initcap also after hyphens and digits."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def slug(c: Column) -> Column:
    """A stable id of a name: lower case, runs of anything but letters and digits as `_`; `concept` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("concept"))


def content_words(c: Column) -> Column:
    """The set of words of more than two characters that are no stopwords."""
    ws = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+"), lambda w: F.length(w) > 2)
    return F.array_except(ws, F.array(*[F.lit(w) for w in STOPWORDS]))


def numeric_token_fraction(c: Column) -> Column:
    t = tokens(c)
    return let(t, lambda t: F.coalesce(F.size(F.filter(t, lambda x: x.rlike(r"^[-+]?\d[\d.,%/±]*$"))) / F.nullif(F.size(t), F.lit(0)), F.lit(0.0)))


def alpha_ratio(c: Column) -> Column:
    """Share of letters among all characters that are no white space."""
    return F.coalesce(F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.nullif(F.length(F.regexp_replace(c, r"[\s\p{Z}]", "")), F.lit(0)), F.lit(0.0))


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def strip_fences(c: Column) -> Column:
    """A model's answer without a code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip(c), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def json_payload(c: Column) -> Column:
    """The text from the first bracket that opens an array (else an object) to the last that closes it; null if there is none."""
    def cut(s: Column, a: str, b: str) -> Column:
        start, end = F.instr(s, a), F.length(s) - F.instr(F.reverse(s), b) + 1
        return F.when((start > 0) & (F.instr(s, b) > 0) & (end > start), F.substr(s, start, end - start + 1))

    return let(strip_fences(c), lambda s: F.coalesce(cut(s, "[", "]"), cut(s, "{", "}")))


def truncate_at_break(c: Column, limit: int = 1800, least: int = 900) -> Column:
    """At most `limit` characters, cut at the last blank line, else at the last sentence or line end, if that lies beyond `least`."""
    def cut(s: Column) -> Column:
        back = F.reverse(s)
        para = F.length(s) - F.instr(back, "\n\n") - 1
        sent = F.greatest(F.length(s) - F.instr(back, " .") - 1, F.length(s) - F.instr(back, "\n"))
        p_ok = (F.instr(back, "\n\n") > 0) & (para > least)
        s_ok = ((F.instr(back, " .") > 0) | (F.instr(back, "\n") > 0)) & (sent > least)
        return F.when(p_ok, F.substr(s, F.lit(1), para)).when(s_ok, F.substr(s, F.lit(1), sent + 1)).otherwise(s)

    return F.when(F.length(c) > limit, let(F.substring(c, 1, limit), cut)).otherwise(c)


def source_category(doc_id: Column) -> Column:
    """The coarse kind of a source from its path: folder first, then extension."""
    p = F.lower(F.replace(F.coalesce(doc_id, F.lit("")), F.lit("\\"), F.lit("/")))
    return (
        F.when(p.startswith("textbooks/"), "textbook").when(p.startswith("papers/"), "paper").when(p.startswith("web_syllabi/"), "web_syllabus")
        .when(p.endswith(".pdf"), "pdf").when(p.rlike(r"\.(?:md|markdown)$"), "markdown").when(p.rlike(r"\.(?:txt|text)$"), "text").otherwise("unknown")
    )


def difficulty_rank(c: Column) -> Column:
    d = F.lower(F.trim(c))
    return F.when(d == "foundational", 1).when(d == "intermediate", 2).when(d == "advanced", 3).when(d == "expert", 4)


def portable_bucket(key: Column, buckets: int) -> Column:
    """A bucket from the first six digits of the MD5: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("bigint") % buckets
