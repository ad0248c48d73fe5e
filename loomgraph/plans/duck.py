"""Expressions of the checking SQL, as text: the same meaning as the column builders, in DuckDB's words."""

from __future__ import annotations

from ..functions import names as N
from ..functions import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def items(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"


def toks(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '[\s\p{{Z}}]+'), lambda t: t <> '')"


def title_case(x: str) -> str:
    return rf"coalesce(array_to_string(list_transform(regexp_extract_all(lower({x}), '(\p{{L}}+|\P{{L}}+)', 1), lambda w: upper(w[1]) || w[2:]), ''), '')"


def slug(x: str) -> str:
    return rf"coalesce(nullif(trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', '_', 'g'), '_'), ''), 'concept')"


def content_words(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({items(T.STOPWORDS)}, w)))"


def numeric_fraction(x: str) -> str:
    return rf"coalesce(len(list_filter({toks(x)}, lambda t: regexp_full_match(t, '[-+]?\d[\d.,%/±]*')))::double / nullif(len({toks(x)}), 0), 0.0)"


def alpha_ratio(x: str) -> str:
    return rf"coalesce(length(regexp_replace({x}, '[^\p{{L}}]', '', 'g'))::double / nullif(length(regexp_replace({x}, '[\s\p{{Z}}]', '', 'g')), 0), 0.0)"


def count_matches(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def concept_key(x: str) -> str:
    s = rf"regexp_replace(replace(lower(regexp_replace(coalesce({x}, ''), '\([^)]*\)', '', 'g')), '-', ' '), '[^a-z0-9\s]', ' ', 'g')"
    ws = f"list_filter({toks(s)}, lambda w: NOT list_contains({items(N.KEY_FILLERS)}, w))"
    return f"coalesce(array_to_string(list_transform({ws}, lambda w: CASE WHEN length(w) > 4 AND w LIKE '%s' THEN w[:-2] ELSE w END), ' '), '')"


def canonical(x: str) -> str:
    n1 = rf"regexp_replace({squeeze(f'''replace(coalesce({x}, ''), '_', ' ')''')}, '\.+$', '')"
    n2 = rf"regexp_replace({n1}, '\s*\([^)]{{1,10}}\)\s*$', '')"
    n3 = f"(CASE WHEN length({n2}) > 60 THEN trim(split_part({n2}, ',', 1)) ELSE {n2} END)"
    n4 = f"trim(CASE WHEN length({n3}) > 60 THEN trim(split_part({n3}, ' - ', 1)) ELSE {n3} END)"
    alias = "CASE lower(" + n1 + ") " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in N.ALIAS_MAP.items()) + " END"
    return f"coalesce({alias}, (SELECT CASE WHEN z = lower(z) THEN {title_case('z')} WHEN z = upper(z) AND length(z) > 5 THEN {title_case('z')} ELSE z END FROM (SELECT {n4} AS z)))"


def merge_key(x: str) -> str:
    ws = toks(x)
    short = f"(CASE WHEN len({ws}) > 1 AND list_contains({items(N.GENERIC_SUFFIXES)}, ({ws})[-1]) THEN ({ws})[:-2] ELSE {ws} END)"
    w = f"({short})[-1]"
    sing = f"(CASE WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN {w}[:-4] || 'y' WHEN {w} LIKE '%s' AND NOT regexp_matches({w}, '(ss|us|is)$') AND length({w}) > 3 THEN {w}[:-2] ELSE {w} END)"
    return f"(CASE WHEN len({short}) > 0 THEN array_to_string(list_append(({short})[:-2], {sing}), ' ') ELSE '' END)"


def valid(x: str) -> str:
    n = strip(f"coalesce({x}, '')")
    return f"(length({n}) >= 3 AND length({n}) <= 60 AND len({toks(n)}) <= 5 AND NOT regexp_matches({n}, {q(N.NUMERIC_NAME)}) AND NOT regexp_matches({n}, {q(N.JUNK_NAME)}) AND NOT regexp_matches({n}, {q(N.FORMULA_NAME)}))"


def acronym(x: str) -> str:
    given = rf"regexp_extract({x}, '\(([A-Za-z0-9]{{2,12}})\)', 1)"
    ws = rf"list_filter(string_split_regex(upper({x}), '[\s\-_/.,]+'), lambda w: NOT list_contains({items(N.ACRONYM_STOP)}, w) AND length(w) > 1 AND regexp_full_match(w, '\p{{L}}+'))"
    return f"coalesce(CASE WHEN {given} <> '' THEN upper({given}) ELSE coalesce(array_to_string(list_transform({ws}, lambda w: w[1]), ''), '') END, '')"


def aliases(x: str) -> str:
    base = f"lower({strip(rf"regexp_replace({x}, '\s*\([^)]*\)\s*', ' ', 'g')")})"
    given = rf"list_transform(regexp_extract_all({x}, '\(([A-Za-z0-9]{{2,12}})\)', 1), lambda g: lower(g))"
    short = f"lower({acronym(x)})"
    a = f"list_concat(list_concat([lower({strip(x)})], CASE WHEN {base} <> '' THEN [{base}] ELSE []::varchar[] END), list_concat({given}, CASE WHEN length({short}) >= 2 THEN [{short}] ELSE []::varchar[] END))"
    return (
        f"list_sort(list_distinct(list_concat(list_concat({a}, list_transform({a}, lambda y: replace(replace(y, '-', ' '), '_', ' '))), "
        f"list_concat(list_transform({a}, lambda y: replace(y, ' ', '')), list_transform({a}, lambda y: replace(y, ' ', '-'))))))"
    )


def rank(x: str) -> str:
    return f"CASE lower(trim({x})) WHEN 'foundational' THEN 1 WHEN 'intermediate' THEN 2 WHEN 'advanced' THEN 3 WHEN 'expert' THEN 4 END"


def category(x: str) -> str:
    p = rf"lower(replace(coalesce({x}, ''), '\', '/'))"
    return (
        f"CASE WHEN starts_with({p}, 'textbooks/') THEN 'textbook' WHEN starts_with({p}, 'papers/') THEN 'paper' WHEN starts_with({p}, 'web_syllabi/') THEN 'web_syllabus' "
        rf"WHEN {p} LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches({p}, '\.(md|markdown)$') THEN 'markdown' WHEN regexp_matches({p}, '\.(txt|text)$') THEN 'text' ELSE 'unknown' END"
    )


def bucket(x: str, n: int) -> str:
    return f"(('0x' || substring(md5({x}), 1, 6))::bigint % {n})"
