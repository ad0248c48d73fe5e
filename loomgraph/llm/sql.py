"""SQL for the queries that SQL can express on whole tables; the others are tested against brute force (tests/llm)."""

from __future__ import annotations

from .common import CHUNK_TAIL, LIGATURES, NO_SOURCE
from .dups import COMMA, FIELD


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fold(x: str) -> str:
    for k, v in LIGATURES.items():
        x = f"replace({x}, {_q(k)}, {_q(v)})"
    return x


def _path(x: str) -> str:
    p = rf"replace(lower(replace({x}, '\', '/')), '%2f', '/')"
    p = rf"regexp_replace(regexp_replace({p}, '%20|[\s\x{{a0}}\x{{200b}}]+', ' ', 'g'), ' */[ /]*', '/', 'g')"
    p = rf"trim(regexp_replace(trim({p}), '^(\./|/|pdfs/)+', ''))"
    return f"regexp_replace({p}, '[ _-]+', '_', 'g')"


def _name(x: str) -> str:
    n = f"regexp_extract({_path(x)}, '[^/]*$')"
    return f"(CASE WHEN {n} NOT IN ({', '.join(map(_q, NO_SOURCE))}) THEN {n} END)"


_NO_SOURCE = ", ".join(map(_q, NO_SOURCE))
_TAIL = CHUNK_TAIL.replace("\\u00a0", "\\x{a0}")

SOURCES = rf"""src AS (SELECT pair_id, {_path('doc_id')} AS p, {_name('doc_id')} AS n, length(output) AS chars FROM sft_pairs),
 cat AS (SELECT pair_id, n, coalesce(chars, 0) AS chars, CASE WHEN n IS NOT NULL AND contains(p, '/') THEN split_part(p, '/', 1) END AS c FROM src),
 known AS (SELECT n, min(c) AS k FROM cat WHERE c IS NOT NULL GROUP BY 1), sized AS (SELECT pair_id, chars AS n_chars, coalesce(c, k) AS source_category FROM cat LEFT JOIN known ON cat.n = known.n AND cat.c IS NULL),
 tg AS (SELECT source_category, sum(greatest(coalesce(target_share, 0.0), 0.0)) AS target_share, max(greatest(coalesce(max_repeats, 0), 0)) AS max_repeats FROM mix_targets GROUP BY 1),
 have AS (SELECT source_category, sum(n_chars) AS available, count(*) AS records FROM sized GROUP BY 1), j AS (SELECT tg.*, coalesce(available, 0) AS available, coalesce(records, 0) AS records FROM tg LEFT JOIN have USING (source_category)),
 total AS (SELECT coalesce(min(max_repeats * available / target_share), 0.0) AS t FROM j WHERE target_share > 0 AND available > 0 AND max_repeats > 0),
 rates AS (SELECT j.*, CASE WHEN available > 0 THEN least(max_repeats::double, target_share * t / available) ELSE 0.0 END AS rate FROM j, total),
 u AS (SELECT pair_id, sized.source_category, n_chars, rate, ('0x' || substring(md5('mix-1:' || pair_id), 1, 12))::bigint / 281474976710656.0 AS u FROM sized JOIN rates USING (source_category)),
 cp AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::int AS copies FROM u),
 mixed AS (SELECT pair_id, source_category, unnest(generate_series(1, copies)) AS copy_no, n_chars FROM cp WHERE copies > 0)"""

_CHUNK = rf"nullif(regexp_extract(lower(chunk_id), {_q(_TAIL)}, 1), '')"
_HEAD = rf"regexp_replace(lower(chunk_id), {_q(r'[\s:_/-]*' + _TAIL)}, '')"
PAIRS = rf"""k AS (SELECT pair_id, nullif(coalesce({_name('doc_id')}, CASE WHEN regexp_matches(lower(chunk_id), {_q(_TAIL)}) THEN {_name(_HEAD)} END), '') AS s, {_CHUNK} AS c FROM sft_pairs),
 g AS (SELECT s, c, min(pair_id) AS first_pair_id FROM k WHERE s IS NOT NULL AND c IS NOT NULL GROUP BY 1, 2)"""


def _alnum(x: str) -> str:
    return rf"regexp_replace(lower({_fold(x)}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


_PARTS = rf"list_filter(string_split_regex(regexp_replace(summary, {_q(COMMA)}, ';\1', 'g'), '[\n|;]'), lambda p: regexp_matches(p, '[\p{{L}}\p{{N}}]'))"
DUPLICATES = rf"""a AS (SELECT rec_id, {_alnum('concept_name')} AS n, {_alnum('doc_id')} AS d, summary, {_PARTS} AS ps FROM okf_results WHERE concept_name IS NOT NULL AND doc_id IS NOT NULL AND regexp_matches(summary, '[^\s\x{{a0}}\x{{200b}}\x{{feff}}]')),
 b AS (SELECT rec_id, n, d, CASE WHEN len(ps) > 1 AND len(list_filter(ps, lambda p: NOT regexp_matches(p, {_q(FIELD)}))) = 0 THEN array_to_string(list_sort(list_transform(ps, lambda p: {_alnum('p')})), chr(1)) ELSE {_alnum('summary')} END AS s FROM a),
 g AS (SELECT n, d, s, min(rec_id) AS first_rec_id, count(*) AS copies FROM b GROUP BY 1, 2, 3)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_mix": f"WITH {SOURCES} SELECT * FROM mixed",
        "p1_shares": f"""WITH {SOURCES}, e AS (SELECT source_category, count(*) AS copies, sum(n_chars) AS emitted FROM mixed GROUP BY 1), w AS (SELECT sum(emitted) AS t FROM e)
 SELECT source_category, target_share, round(coalesce(emitted::double / nullif(t, 0), 0.0), 6) AS actual_share, records, available AS available_chars, coalesce(copies, 0) AS copies, coalesce(emitted, 0) AS emitted_chars, round(rate, 6) AS rate FROM rates LEFT JOIN e USING (source_category), w""",
        "p3_found": f"WITH {PAIRS} SELECT first_pair_id, pair_id FROM k JOIN g ON k.s = g.s AND k.c = g.c WHERE pair_id > first_pair_id",
        "p4_found": f"WITH {DUPLICATES} SELECT first_rec_id, rec_id FROM b JOIN g ON b.n = g.n AND b.d = g.d AND b.s = g.s WHERE rec_id > first_rec_id",
        "p4_collapsed": f"WITH {DUPLICATES}, o AS (SELECT rec_id FROM b JOIN g ON b.n = g.n AND b.d = g.d AND b.s = g.s WHERE rec_id > first_rec_id) SELECT r.rec_id, coalesce(g.copies, 1) AS copies FROM okf_results r LEFT JOIN g ON g.first_rec_id = r.rec_id WHERE r.rec_id NOT IN (SELECT rec_id FROM o)",
    }
