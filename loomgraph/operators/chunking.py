"""Chunking of documents and classification of chunks (CHK-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alpha_ratio, count_matches, let, numeric_token_fraction, strip

MAX_CHARS = 1600
MIN_CHARS = 200
# Marks of citations, addresses, preprint headers, and the signs of formulas.
CITATION = r"(\[\d+\]|\bet al\.?,?\s*\d{4}|\(\d{4}\))"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PREPRINT = r"(?i)arxiv:\s*\d"
MATH_SIGNS = "=+−-*/^_∑∫∇∂≤≥≈≠∈∀∃√∞θλμσαβγδπΣΠ⊤⟨⟩{}|"


def sanitize_title(c: Column) -> Column:
    """CHK-8: a section title, or empty for running headers and table rows taken for titles."""
    return let(
        strip(F.coalesce(c, F.lit(""))),
        lambda t: F.when((t == "") | t.rlike(PREPRINT) | (numeric_token_fraction(t) > 0.3) | (alpha_ratio(t) < 0.4), "").otherwise(t),
    )


def chunk_kind(text: Column, title: Column) -> Column:
    """CHK-7: empty, reference, frontmatter, table, math or prose; the first rule that holds decides."""
    def kind(body: Column) -> Column:
        lines = F.filter(F.split(body, r"\r\n|\n|\r"), lambda x: x.rlike(r"\S"))
        keyed = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*(\[\d+\]|\d+\.\s)")))
        cited = F.size(F.filter(lines, lambda x: x.rlike(CITATION)))
        solid = F.length(F.regexp_replace(body, r"\s", ""))
        signs = F.length(body) - F.length(F.translate(body, MATH_SIGNS, ""))
        return (
            F.when(body == "", "empty")
            .when(F.lower(F.coalesce(title, F.lit(""))).rlike("^(?:reference|bibliograph|works cited)"), "reference")
            .when(keyed / F.size(lines) > 0.6, "reference").when(cited / F.size(lines) > 0.85, "reference")
            .when((count_matches(body, EMAIL) >= 2) & (F.length(body) - F.length(F.replace(body, F.lit("."), F.lit(""))) < 12), "frontmatter")
            .when(numeric_token_fraction(body) > 0.28, "table")
            .when((signs / solid > 0.12) | (alpha_ratio(body) < 0.55), "math").otherwise("prose")
        )

    return let(strip(F.coalesce(text, F.lit(""))), kind)


def annotate(chunks: DataFrame) -> DataFrame:
    """CHK-9: section_title sanitised, then chunk_kind set from text and title."""
    c = chunks.withColumn("section_title", sanitize_title(F.col("section_title")))
    return c.withColumn("chunk_kind", chunk_kind(F.col("text"), F.col("section_title")))


def is_heading(text: Column, size: Column, font: Column, body: Column) -> Column:
    """CHK-5: a span is a heading by larger type, by bold type while short, or by its numbering."""
    t = strip(F.coalesce(text, F.lit("")))
    return (F.length(t) >= 2) & (
        (size > body + 1.5) | (font.rlike("Bold|Medi|bold") & (F.length(t) < 120)) | t.rlike(r"^(\d+\.?\d*\.?\d*)\s+[A-Z]") | t.rlike(r"(?i)^(Chapter|Section|Appendix)\s+\w")
    )


def body_size(spans: DataFrame, doc: str, page: str, size: str, text: str) -> DataFrame:
    """CHK-6: (doc, body_size): the type size with most characters on the first ten pages; 10.0 where there is none; the smaller size wins a tie."""
    s = spans.where(F.col(page) <= 10).groupBy(doc, F.round(size, 1).alias("__s")).agg(F.sum(F.length(F.trim(text))).alias("__n"))
    best = s.where("__n > 0").groupBy(doc).agg(F.max_by("__s", F.struct("__n", -F.col("__s"))).alias("body_size"))
    return spans.select(doc).distinct().join(best, doc, "left").select(doc, F.coalesce("body_size", F.lit(10.0)).alias("body_size"))


def pack_paragraphs(text: Column, limit: int = MAX_CHARS, least: int = MIN_CHARS) -> Column:
    """CHK-3: the chunks of a text: paragraphs packed greedily up to `limit` characters; only the last chunk must have `least`."""
    paras = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(acc: Column, p: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(p) > limit) & (acc["cur"] != "")
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(strip(acc["cur"])))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.concat(p, F.lit("\n\n"))).otherwise(F.concat(acc["cur"], p, F.lit("\n\n"))).alias("cur"),
        )

    def close(acc: Column) -> Column:
        rest = strip(acc["cur"])
        return F.when(F.length(rest) >= least, F.concat(acc["done"], F.array(rest))).otherwise(acc["done"])

    return F.aggregate(paras, zero, add, close)


def chunk_text(docs: DataFrame, doc: str, text: str, limit: int = MAX_CHARS, least: int = MIN_CHARS) -> DataFrame:
    """CHK-3 over documents: (doc, chunk_no from 1, text). Nothing is shuffled: a document's chunks come from its row."""
    return docs.select(F.col(doc), F.posexplode(pack_paragraphs(F.col(text), limit, least)).alias("chunk_no", "text")).withColumn("chunk_no", F.col("chunk_no") + 1)


def chunk_markdown(docs: DataFrame, doc: str, text: str, limit: int = MAX_CHARS, least: int = MIN_CHARS) -> DataFrame:
    """CHK-2 over documents: (doc, part_no, slice_no, section_title, text): parts between headings, sliced every `limit` characters.

    The title of the last heading holds for a part (`Introduction` before the first one); parts and slices below `least` are left out.
    """
    marked = F.regexp_replace(F.col(text), r"(?m)^(#{1,3}\s+.+)$", "\u0001$1\u0001")
    parts = docs.select(F.col(doc), F.posexplode(F.split(marked, "\u0001")).alias("part_no", "part"))
    parts = parts.withColumn("part", strip(F.col("part"))).withColumn("__h", F.col("part").rlike(r"^#{1,3}\s+"))
    w = Window.partitionBy(doc).orderBy("part_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    title = F.when(F.col("__h"), F.trim(F.regexp_replace("part", r"^#{1,3}\s+", "")))
    parts = parts.withColumn("section_title", F.coalesce(F.last(title, ignorenulls=True).over(w), F.lit("Introduction")))
    parts = parts.where(~F.col("__h") & (F.length("part") >= least))
    n = F.floor((F.length("part") - 1) / limit).cast("int")
    s = parts.select(doc, "part_no", "section_title", "part", F.explode(F.sequence(F.lit(0), n)).alias("slice_no"))
    s = s.withColumn("text", strip(F.substr("part", F.col("slice_no") * limit + 1, F.lit(limit))))
    return s.where(F.length("text") >= least).select(doc, "part_no", "slice_no", "section_title", "text")


def section_chunks(blocks: DataFrame, limit: int = MAX_CHARS, least: int = MIN_CHARS) -> DataFrame:
    """CHK-1: sections and chunks of a table of blocks (doc_id, ord, page, text, heading boolean): one row per chunk with
    doc_id, chunk_id, section_title, page_number, page_start, page_end, text, first_ord.

    A heading of 3 to 149 characters opens a section; a section with under `least` characters joins the one before; blocks are packed up to
    `limit` characters and never split; the page is the one with most characters (the first of equals). The fold needs a document's
    blocks in order, so it runs per document.
    """
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        sections: list[list] = []
        for r in pdf.sort_values("ord").itertuples():
            text = (r.text or "").strip()
            if not text:
                continue
            if r.heading and 2 < len(text) < 150:
                sections.append([text, []])
            else:
                if not sections:
                    sections.append(["Introduction", []])
                sections[-1][1].append((int(r.ord), int(r.page or 0), text))
        merged: list[list] = []
        for title, body in sections:
            if merged and sum(len(t) for _, _, t in body) < least:
                merged[-1][1].extend(body)
            elif body:
                merged.append([title, list(body)])
        rows = []
        for title, body in merged:
            pack: list = []
            for b in [*body, None]:
                if pack and (b is None or sum(len(t) for _, _, t in pack) + len(b[2]) > limit):
                    by_page: dict[int, int] = {}
                    for _, p, t in pack:
                        by_page[p] = by_page.get(p, 0) + len(t)
                    rows.append((title, max(by_page, key=lambda p: by_page[p]), min(by_page), max(by_page), "\n".join(t for _, _, t in pack), pack[0][0]))
                    pack = []
                if b is not None:
                    pack.append(b)
        doc = pdf.doc_id.iloc[0]
        return pd.DataFrame([(doc, f"chunk_{i:03d}", *r) for i, r in enumerate(rows)], columns=["doc_id", "chunk_id", "section_title", "page_number", "page_start", "page_end", "text", "first_ord"])

    schema = "doc_id string, chunk_id string, section_title string, page_number bigint, page_start bigint, page_end bigint, text string, first_ord bigint"
    return blocks.select("doc_id", "ord", "page", "text", "heading").groupBy("doc_id").applyInPandas(fold, schema)
