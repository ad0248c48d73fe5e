"""Problem 6: broken prompt and response pairs."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import LanguageModel
from .words import lcs_length, masks, normal_words, passage_of

SHINGLE = 5
COPY_SHARE = 0.8
COPY_PART = 0.35
COPY_SHORT = 0.9
REFUSAL_SHARE = 0.8
PREVIEW_CHARS = 220

_THINK = re.compile(r"^\s*<think>.*?(?:</think>\s*|\Z)", re.S)
_FENCE = re.compile(r"^```[\w-]*[ \t]*\n?(.*?)(?:\n?```\s*)?$", re.S)
_END = re.compile(r"[.!?。][\"'”’»)\]*_`]*\s*$|[”\"’»]\s*$")
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)("?)')
_SUMMARY = re.compile(r'"summary"\s*:\s*"((?:[^"\\]|\\.)*)("?)')

# Openings and cores of refusals, aligned with an answer's words.
REFUSALS = tuple(
    tuple(normal_words(t))
    for t in (
        "I can't help with this passage", "I cannot help with that", "I can't assist with this request", "I am not able to produce these records",
        "I'm unable to help with this", "I am unable to provide this", "it would not be appropriate for me to answer", "I must decline to list anything from this text",
        "I must decline this request", "I have to pass on this one", "I won't be completing this request", "I will not be able to do this", "answering falls outside what I am allowed to do",
        "this is not something I can do", "I do not feel comfortable working on this material", "I do not feel comfortable answering", "request declined",
        "I'm not able to comply with this request", "I cannot comply with this request", "I'm sorry but I can't", "as an AI language model I cannot",
    )
)
_REFUSAL_MASKS = tuple((masks(t), len(t)) for t in REFUSALS)
_IN_REFUSALS: dict[str, tuple[int, ...]] = {w: tuple(k for k, t in enumerate(REFUSALS) if w in t) for t in REFUSALS for w in t}
# Words that introduce a refusal.
_LEADS = frozenset(normal_words("sorry I'm am apologise apologize regrettably unfortunately but as an assistant AI please note that we"))
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+|\n+")


def refuses(text: str) -> bool:
    """Whether a sentence of a text, wherever it stands, opens like a refusal: the longest common subsequence of its first words with a
    template is at least REFUSAL_SHARE of the template. Templates with too few words in the sentence need no alignment."""
    for sentence in _SENTENCE.split(text):
        words = normal_words(sentence)
        hits: dict[int, int] = {}
        for w in set(words):
            for k in _IN_REFUSALS.get(w, ()):
                hits[k] = hits.get(k, 0) + 1
        near = [k for k, n in hits.items() if n >= 2 and n >= REFUSAL_SHARE * len(set(REFUSALS[k]))]
        if not near:
            continue
        lead = 0
        while lead < len(words) and words[lead] in _LEADS:
            lead += 1
        for start in {0, lead, max(0, lead - 1), max(0, lead - 2)}:
            for k in near:
                peq, m = _REFUSAL_MASKS[k]
                if lcs_length(peq, m, words[start : start + m + 2]) >= max(2, REFUSAL_SHARE * m):
                    return True
    return False


def unwrap(answer: str) -> str:
    """The answer without an empty think block, code fence or lead-in before its JSON."""
    t = _THINK.sub("", answer).strip("﻿ \t\r\n ​")
    m = _FENCE.match(t)
    if m:
        t = m.group(1).strip()
    if t[:1] not in "[{\"" and t:
        at = re.search(r"\[\s*\{\s*\"|\[\s*\]\s*$|```(?:json)?\s*\n\s*[\[{]", t)
        if at and at.start() <= 120 and not re.search(r"[.!?]\s", t[: at.start()]):
            t = t[at.start() :]
            m = _FENCE.match(t)
            if m:
                t = m.group(1).strip()
    return t


def _texts(v) -> list[str]:
    """The free texts of a parsed answer: summaries and other sentences, not names or tags."""
    if isinstance(v, str):
        return [v]
    if isinstance(v, list):
        return [t for x in v for t in (_texts(x) if isinstance(x, (dict, list)) else [])]
    if isinstance(v, dict):
        keys = [k for k in ("summary", "error", "message", "answer", "text", "content", "description") if isinstance(v.get(k), str)]
        return [v[k] for k in keys] + [t for x in v.values() if isinstance(x, (dict, list)) for t in _texts(x)]
    return []


def _names(v) -> list[str]:
    if isinstance(v, list):
        return [n for x in v for n in _names(x)]
    if isinstance(v, dict) and isinstance(v.get("concept_name"), str):
        return [v["concept_name"]]
    return []


def copies(answer: list[str], source: list[str]) -> bool:
    """Whether an answer gives back the source or most of it: by the share of its shingles that the source has, and where
    shingles leave it open by the longest common subsequence. An answer too short for shingles is a copy if it is nearly all of the source."""
    n = len(answer)
    if not n or not source:
        return False
    if n < SHINGLE + 3:
        return n >= COPY_SHARE * len(source) and lcs_length(masks(answer), n, source) >= COPY_SHORT * max(n, len(source))
    mine = [tuple(answer[i : i + SHINGLE]) for i in range(n - SHINGLE + 1)]
    theirs = {tuple(source[i : i + SHINGLE]) for i in range(len(source) - SHINGLE + 1)}
    share = sum(x in theirs for x in mine) / len(mine)
    if share < COPY_SHARE:
        if share < 0.4:
            return False
        if lcs_length(masks(answer), n, source) < 0.9 * n:
            return False
    return n >= COPY_PART * len(source) or n >= 25


def defect(prompt: str | None, context: str | None, answer: str | None, limit: int = 0, model: LanguageModel | None = None) -> str | None:
    """The defect of an answer, or None. `prompt` is the instruction, `context` the text of the chunk where the prompt isn't kept;
    `limit` > 0 says that answers of that length were cut on purpose. The first defect that holds is given: empty, refusal,
    copy, language, truncated. Whole answers are read; without a `model` no language is told."""
    cut = limit > 0 and answer is not None and len(answer) >= limit
    body = unwrap(answer or "")
    if not re.search(r"\w", body):
        return None if re.fullmatch(r"\[\s*\]|\{\s*\}", body) and body[0] == "[" else (None if cut else "empty")
    parsed = None
    is_json = body[0] in "[{\""
    whole = False
    if is_json:
        try:
            parsed = json.loads(body)
            whole = True
        except ValueError:
            pass
    if whole and isinstance(parsed, str):
        texts, names = [parsed], []
        if not parsed.strip():
            return "empty"
    elif whole:
        if isinstance(parsed, dict) and not parsed:
            return "empty"
        texts, names = _texts(parsed), _names(parsed)
    elif is_json and '"' in body:
        texts = [m.group(1) for m in _SUMMARY.finditer(body)] or ([m.group(1) for m in re.finditer(r'"(?:error|message|answer)"\s*:\s*"((?:[^"\\]|\\.)*)', body)])
        names = re.findall(r'"concept_name"\s*:\s*"([^"]*)"', body)
    else:
        texts, names = [body], []
    free = " ".join(texts)
    if any(map(refuses, texts)) or any(len(n.split()) <= 3 and re.search("declin|refus", n, re.I) for n in names[:1]):
        return "refusal"
    passage = context or ""
    if prompt is not None:
        passage = passage_of(prompt)
    words = normal_words(free)
    if words:
        source = normal_words(passage)
        if not is_json or not names or whole and isinstance(parsed, str):
            if copies(words, source) or (prompt is not None and copies(words, normal_words(prompt))):
                return "copy"
        elif any(copies(normal_words(t), source) for t in texts) or copies(words, source) and len(texts) > 1:
            return "copy"
        if model is not None and len(words) >= 8:
            spoken, asked = model.of_words(words), model.of_words(source)
            if spoken and asked and spoken != asked:
                return "language"
    if cut:
        return None
    if not whole and is_json:
        return "truncated"
    if any(t.strip() and not _END.search(t) for t in texts):
        return "truncated"
    return None


def _flag(model):
    def run(batches):
        lm = model.value if model is not None else None
        for batch in batches:
            origin, row, prompt, context, answer, limit = (batch.column(k) for k in range(6))
            out = [defect(*x, lm) for x in zip(prompt.to_pylist(), context.to_pylist(), answer.to_pylist(), limit.to_pylist())]
            yield pa.RecordBatch.from_arrays([origin, row, pa.array(out, pa.string())], names=["origin", "row_id", "defect"])

    return run


def _judged(rows: DataFrame, model: LanguageModel | None) -> DataFrame:
    src = rows.select("origin", F.col("row_id").cast("bigint"), "prompt", "context", "answer", F.col("limit").cast("int"))
    bc = rows.sparkSession.sparkContext.broadcast(model) if model is not None else None  # bounded by the model's languages and trigrams
    return src.mapInArrow(_flag(bc), "origin string, row_id bigint, defect string")


def flag_pairs(rows: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """(origin, row_id, defect) of the defective rows of (origin string, row_id bigint, prompt string, context string, answer string,
    limit int); one map over the rows, no shuffle.

    A null answer is empty; a null prompt and context leave only the tests that need neither. An empty JSON array is a proper
    answer. Repeated rows each come out. An empty table gives no rows.
    """
    return _judged(rows, model).where("defect is not null")


def flag_in_contexts(rows: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """As flag_pairs for rows that come once for each of several contexts under one (origin, row_id): a copy of any context is a copy,
    another defect must hold in all of them (the first by name if they differ). One row comes out for each (origin, row_id)."""
    per = _judged(rows, model).groupBy("origin", "row_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("defect").alias("c"), F.min("defect").alias("d"), F.max(F.coalesce(F.col("defect") == "copy", F.lit(False))).alias("copy")
    )
    return per.select("origin", "row_id", F.when(F.col("copy"), F.lit("copy")).when(F.col("n") == F.col("c"), F.col("d")).alias("defect")).where("defect is not null")
