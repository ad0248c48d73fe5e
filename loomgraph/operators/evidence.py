"""Evidence, citations and the library's documents and chapters (CIT-*, LIB-*, JON-9..11, JON-21, WIN-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of source kinds for book and paper queries.
BOOK_WEIGHTS = {"textbook": 1.6, "web_syllabus": 1.2, "paper": 0.7}
PAPER_WEIGHTS = {"textbook": 0.8, "web_syllabus": 0.9, "paper": 1.5}


def citation_quality(section: Column, text: Column, page: Column) -> Column:
    """CIT-4: how well a passage serves as a citation: bibliographies count against it, early pages and defining sections for it."""
    s, t = F.lower(F.coalesce(section, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    p = F.coalesce(page, F.lit(0))
    return (
        F.lit(1.0) - F.when(s.rlike("reference|bibliograph|works cited|acknowledg"), 2.5).otherwise(0.0)
        - F.when((F.regexp_count(t, F.lit("et al")) >= 3) | (F.regexp_count(t, F.lit("arxiv")) >= 2), 1.5).otherwise(0.0)
        + F.when((p > 0) & (p <= 5), 0.4).when(p >= 200, -0.2).otherwise(0.0) + F.when(s.rlike("intro|background|method|preliminar|definition"), 0.5).otherwise(0.0)
    )


def best_citations(evidence: DataFrame, limit: int = 2) -> DataFrame:
    """CIT-5 and WIN-6: the `limit` best passages per concept of (id, doc_id, chunk_id, page_number, section_title, text); ties by document, page, chunk."""
    q = evidence.withColumn("quality", F.round(citation_quality(F.col("section_title"), F.col("text"), F.col("page_number")), 2))
    w = Window.partitionBy("id").orderBy(F.desc("quality"), "doc_id", "page_number", "chunk_id")
    return q.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def printed_page(labels: Column, page: Column) -> Column:
    """CIT-8: the printed label of a physical page by the label map (the first label in order), or null."""
    hit = F.array_sort(F.transform(F.filter(F.map_entries(labels), lambda e: e["value"] == page), lambda e: e["key"]))
    return F.when(labels.isNotNull() & page.isNotNull(), F.try_element_at(hit, F.lit(1)))


def page_display(labels: Column, page: Column) -> Column:
    """CIT-20: `p. <printed>` where the map has the page, else `PDF page <n>`, else empty."""
    return F.coalesce(F.concat(F.lit("p. "), printed_page(labels, page)), F.when(page > 0, F.concat(F.lit("PDF page "), page.cast("string"))), F.lit(""))


def page_url(doc: Column, page: Column) -> Column:
    """CIT-12: a link to a page of a document."""
    return F.concat(F.lit("/pdfs/"), F.replace(doc, F.lit(" "), F.lit("%20")), F.when(page > 0, F.concat(F.lit("#page="), page.cast("string"))).otherwise(""))


def markdown_link(label: Column, doc: Column, page: Column) -> Column:
    return F.concat(F.lit("["), F.replace(F.coalesce(label, doc, F.lit("source")), F.lit("]"), F.lit("\\]")), F.lit("]("), page_url(doc, page), F.lit(")"))


def bounding_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """CIT-3: a box only if all four numbers are there."""
    return F.when(x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull(), F.concat_ws(",", *[F.round(c, 1).cast("string") for c in (x, y, w, h)]))


def evidence_rows(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """CIT-1 and JON-9: concept -> chunk -> document: the passages that name each concept."""
    return mentions.join(chunks, ["doc_id", "chunk_id"])


def edge_evidence(e: DataFrame, mentions: DataFrame) -> DataFrame:
    """CIT-2, JON-11 and JON-21: (src, dst, edge_type, level, chunk): the chunk stated as provenance, else the first that names both ends, else
    the first that names the source, else none."""
    k = F.concat_ws(":", "doc_id", "chunk_id")
    m = mentions.select("id", k.alias("k")).distinct()
    pairs = e.select("src", "dst", "edge_type", "source").join(mentions.select(k.alias("source")).distinct().withColumn("known", F.lit(1)), "source", "left")
    both = e.select("src", "dst").distinct().join(m.select(F.col("id").alias("src"), "k"), "src").join(m.select(F.col("id").alias("dst"), "k"), ["dst", "k"]).groupBy("src", "dst").agg(F.min("k").alias("b"))
    one = m.groupBy(F.col("id").alias("src")).agg(F.min("k").alias("o"))
    j = pairs.join(both, ["src", "dst"], "left").join(one, "src", "left")
    level = F.when(F.col("known").isNotNull(), "provenance").when(F.col("b").isNotNull(), "both").when(F.col("o").isNotNull(), "source").otherwise("none")
    return j.select("src", "dst", "edge_type", level.alias("level"), F.when(F.col("known").isNotNull(), F.col("source")).otherwise(F.coalesce("b", "o")).alias("chunk"))


def cited_ids(text: Column) -> Column:
    """CIT-9: the evidence ids S1, S2, ... that a text cites, each once, by number."""
    ids = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\bS(\d+)\b"), F.lit(1)))
    return F.transform(F.array_sort(F.transform(ids, lambda x: x.cast("int"))), lambda x: F.concat(F.lit("S"), x.cast("string")))


def offending_ids(text: Column, known: Column) -> Column:
    """CIT-9: cited ids that were not supplied."""
    return F.array_except(cited_ids(text), known)


def first_sentence(text: Column, limit: int = 140) -> Column:
    """CIT-13: the first sentence of a passage, at most `limit` characters."""
    s = F.regexp_extract(F.trim(F.regexp_replace(text, r"\s+", " ")), r"^(.+?[.!?])(?:\s|$)", 1)
    return F.substring(F.when(s == "", F.trim(F.regexp_replace(text, r"\s+", " "))).otherwise(s), 1, limit)


def strip_latex(text: Column) -> Column:
    """CIT-16: formulas and commands gone, braces opened."""
    t = F.regexp_replace(F.regexp_replace(text, r"\$\$[^$]*\$\$|\$[^$\n]*\$", " "), r"\\[a-zA-Z]+\*?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[{}\\]", ""), r"[ \t]+", " "))


def document_scores(mentions: DataFrame, category: DataFrame, prefer_papers: bool = False) -> DataFrame:
    """LIB-4 and LIB-5: (id, doc_id, mentions, score): documents per concept by (1 + mentions) x weight of the source kind, with the boosts of
    book queries. `category`: doc_id, category."""
    weights = PAPER_WEIGHTS if prefer_papers else BOOK_WEIGHTS
    w = F.lit(1.0)
    for k, v in weights.items():
        w = F.when(F.col("category") == k, v).otherwise(w)
    d = F.lower("doc_id")
    if not prefer_papers:
        w = w * F.when(F.contains(d, F.lit("textbooks/")), 1.35).otherwise(1.0) * F.when(d.rlike("syllab|seed"), 1.15).otherwise(1.0) * F.when(d.startswith("papers/") | (F.col("category") == "paper"), 0.85).otherwise(1.0)
    n = mentions.select("id", "doc_id", "chunk_id").distinct().groupBy("id", "doc_id").agg(F.count(F.lit(1)).alias("mentions"))
    return n.join(category, "doc_id").select("id", "doc_id", "mentions", F.round((1.0 + F.col("mentions")) * w, 6).alias("score"))
