"""Column builders for concept names: keys, canonical forms, acronyms, aliases, validity."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, squeeze, strip, title_case, tokens

# Aliases that collapse into one name.
ALIAS_MAP = {
    "gpt": "GPT",
    "openai gpt": "GPT",
    "lora": "Low-Rank Adaptation",
    "qlora": "Quantized Low-Rank Adaptation",
    "multi-head self-attention": "Multi-Head Attention",
    "multi head self attention": "Multi-Head Attention",
    "preference datasets": "Preference Data",
}
# Last words that don't tell concepts apart; words left out of keys; words left out of acronyms.
GENERIC_SUFFIXES = ("architecture", "mechanism", "method", "methods", "technique", "techniques", "search")
KEY_FILLERS = ("full", "basic", "standard", "general")
ACRONYM_STOP = ("OF", "FOR", "AND", "OR", "THE", "A", "AN", "IN", "ON", "AT", "TO", "FROM", "BY", "WITH")
# Patterns of names that are no concepts.
JUNK_NAME = (
    r"(?i)\b(authors?|contributors?|chairs?|funding|acknowledg|thank|grants?|projects?|universit|institute|canada\s+cifar|research\s+chair|cifar\s+ai|nserc|"
    r"phd\s+program|fellowship|scholarship|discovery\s+grant|ai\s+chairs?|computational\s+resources\s+provided|table\s+\d+|caption)\b|best\s+model\s+without|underlined"
)
NUMERIC_NAME = r"^\d[\d\s%\.x\-/]*$"
FORMULA_NAME = (
    r"(?i)([{}=∑∆ΔΦ]|\.{2,}|\bvs\.?\b|\bcomparison\b|\b\d+%|\b\d+\s*of\s+tokens\b|\breplacement\s+token\s*\(\d|\b(system|hyperparameter)\s+dev\b|"
    r"\b(dev|test)\s+(f1|acc|accuracy|score)\b|^test\s+scores?$|\bstate-of-the-art\b.*\b(bleu|f1|accuracy|score)\b|\bbatch\b|\bwithout\s+gold\s+access\b)"
)


def alias_of(c: Column) -> Column:
    """The canonical name of a lower-case alias, or null."""
    return F.create_map(*[F.lit(x) for x in chain(*ALIAS_MAP.items())])[c]


def concept_key(c: Column) -> Column:
    """A key under which spellings of one concept meet: brackets, hyphens, signs and filler words gone, longer words singular."""
    s = F.regexp_replace(F.replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^)]*\)", "")), F.lit("-"), F.lit(" ")), r"[^a-z0-9\s]", " ")
    ws = F.filter(tokens(s), lambda w: ~w.isin(*KEY_FILLERS))
    return F.array_join(F.transform(ws, lambda w: F.when((F.length(w) > 4) & w.endswith("s"), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)), " ")


def same_concept(a: Column, b: Column) -> Column:
    """Both name the same concept: equal keys that are not empty."""
    return (concept_key(a) != "") & (concept_key(a) == concept_key(b))


def merge_key(c: Column) -> Column:
    """A canonical name (lower case) without one generic last word, its last word singular."""
    ws = tokens(c)

    def shorten(ws: Column) -> Column:
        return F.when((F.size(ws) > 1) & F.element_at(ws, -1).isin(*GENERIC_SUFFIXES), F.slice(ws, 1, F.size(ws) - 1)).otherwise(ws)

    def singular(w: Column) -> Column:
        n = F.length(w)
        return (
            F.when(w.endswith("ies") & (n > 4), F.concat(F.substr(w, F.lit(1), n - 3), F.lit("y")))
            .when(w.endswith("s") & ~w.rlike("(?:ss|us|is)$") & (n > 3), F.substr(w, F.lit(1), n - 1)).otherwise(w)
        )

    def last(ws: Column) -> Column:
        return F.when(F.size(ws) > 0, F.array_join(F.concat(F.slice(ws, 1, F.size(ws) - 1), F.array(singular(F.element_at(ws, -1)))), " ")).otherwise("")

    return let(let(ws, shorten), last)


def canonical_name(c: Column) -> Column:
    """The canonical form of a concept name; an empty string for null."""
    def shape(n: Column) -> Column:
        return F.when(n == F.lower(n), title_case(n)).when((n == F.upper(n)) & (F.length(n) > 5), title_case(n)).otherwise(n)

    def shorten(n: Column) -> Column:
        n = F.regexp_replace(n, r"\s*\([^)]{1,10}\)\s*$", "")
        n = let(n, lambda n: F.when(F.length(n) > 60, F.trim(F.substring_index(n, ",", 1))).otherwise(n))
        n = let(n, lambda n: F.when(F.length(n) > 60, F.trim(F.substring_index(n, " - ", 1))).otherwise(n))
        return let(F.trim(n), shape)

    base = F.regexp_replace(squeeze(F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" "))), r"\.+$", "")
    return let(base, lambda n: F.coalesce(alias_of(F.lower(n)), shorten(n)))


def valid_name(c: Column) -> Column:
    """Whether a name can be a concept: 3 to 60 characters, at most five words, no number, metadata or formula."""
    return let(
        strip(F.coalesce(c, F.lit(""))),
        lambda n: (F.length(n) >= 3) & (F.length(n) <= 60) & (F.size(tokens(n)) <= 5) & ~n.rlike(NUMERIC_NAME) & ~n.rlike(JUNK_NAME) & ~n.rlike(FORMULA_NAME),
    )


def acronym(c: Column) -> Column:
    """The first acronym in brackets, else the initials of significant words; empty if there is none."""
    given = F.regexp_extract(c, r"\(([A-Za-z0-9]{2,12})\)", 1)
    ws = F.filter(F.split(F.upper(c), r"[\s\-_/.,]+"), lambda w: ~w.isin(*ACRONYM_STOP) & (F.length(w) > 1) & w.rlike(r"^\p{L}+$"))
    made = F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), "")
    return F.coalesce(F.when(given != "", F.upper(given)).otherwise(made), F.lit(""))


def aliases(c: Column) -> Column:
    """All aliases of a name, sorted: itself, without brackets, acronyms, and the forms with blanks, hyphens or neither."""
    name = F.lower(strip(c))
    base = F.lower(strip(F.regexp_replace(c, r"\s*\([^)]*\)\s*", " ")))
    given = F.transform(F.regexp_extract_all(c, F.lit(r"\(([A-Za-z0-9]{2,12})\)"), F.lit(1)), lambda x: F.lower(x))
    short = F.lower(acronym(c))
    all_ = F.concat(F.array(name), F.when(base != "", F.array(base)).otherwise(F.array().cast("array<string>")), given, F.when(F.length(short) >= 2, F.array(short)).otherwise(F.array().cast("array<string>")))
    forms = lambda a: F.concat(
        a, F.transform(a, lambda x: F.replace(F.replace(x, F.lit("-"), F.lit(" ")), F.lit("_"), F.lit(" "))),
        F.transform(a, lambda x: F.replace(x, F.lit(" "), F.lit(""))), F.transform(a, lambda x: F.replace(x, F.lit(" "), F.lit("-"))),
    )
    return F.array_sort(F.array_distinct(let(all_, forms)))
