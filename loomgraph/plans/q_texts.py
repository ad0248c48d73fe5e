"""Queries of rendered texts, scope decisions and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import texts as X
from ..tables import read
from . import duck as D
from .q_relations import _PAGE
from .q_retrieval import _QS, _questions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_SPLIT = f"list_filter({D.items(X.SPLITTERS)}, lambda p: contains(lower(q), p))[1]"


@query("lib2_lookup_parts", rf"""SELECT pair_id, CASE WHEN {_SPLIT} IS NULL THEN q ELSE regexp_replace(regexp_replace(q[1:instr(lower(q), {_SPLIT}) - 1], {D.q(X.LOOKUP_FILLER)}, '', 'g'), '^[ :"''?.]+|[ :"''?.]+$', '', 'g') END AS book,
 CASE WHEN {_SPLIT} IS NULL THEN q ELSE regexp_replace(q[instr(lower(q), {_SPLIT}) + length({_SPLIT}):], '^[ :"''?.]+|[ :"''?.]+$', '', 'g') END AS concept FROM {_QS}""")
def lib2(spark, sf):
    return X.lookup_parts(_questions(spark, sf), "pair_id", "q")


@query("cit11_rendered_citations", f"SELECT DISTINCT doc_id, chunk_id, '[S1] ' || coalesce(doc_title, doc_id) || coalesce(', ' || nullif(trim(section_title), ''), '') || coalesce(', ' || nullif(coalesce('p. ' || {_PAGE}, CASE WHEN page_number > 0 THEN 'PDF page ' || page_number END, ''), ''), '') AS citation FROM chunks")
def cit11(spark, sf):
    c = read(spark, sf, "chunks", "doc_id", "chunk_id", "doc_title", "section_title", "page_label_map", "page_number")
    return c.select("doc_id", "chunk_id", X.rendered(F.lit("S1"), F.coalesce("doc_title", "doc_id"), F.col("section_title"), F.col("page_label_map"), F.col("page_number")).alias("citation")).distinct()


@query("txt1_missing_topics", rf"""SELECT pair_id, coalesce(nullif(regexp_replace(regexp_replace(trim(q), {D.q(X.QUESTION_HEAD)}, ''), '^[ ?.!:]+|[ ?.!:]+$', '', 'g'), ''), 'that topic') AS topic FROM {_QS}""")
def txt1(spark, sf):
    return _questions(spark, sf).select("pair_id", X.missing_topic(F.col("q")).alias("topic"))


@query("lib14_chapter_answers", "SELECT doc_id, string_agg(section_title, '; ' ORDER BY page, section_title) AS listing FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, section_title) AS r FROM (SELECT doc_id, section_title, min(page_number) AS page FROM chunks WHERE trim(coalesce(section_title, '')) <> '' GROUP BY 1, 2)) WHERE r <= 40 GROUP BY 1")
def lib14(spark, sf):
    return X.chapter_answers(read(spark, sf, "chunks", "doc_id", "section_title", "page_number"))
