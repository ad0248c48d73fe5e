"""Sources and sinks: folders of documents, JSON lines, snapshots and exports (SRC-*, SNK-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators.chunking import chunk_markdown, chunk_text
from .office import office_pages

TEXT_SUFFIXES = ("md", "markdown", "txt", "text")
ALL_SUFFIXES = (*TEXT_SUFFIXES, "pdf", "docx", "doc")
MIN_BYTES = 10_000
# The first bytes of the formats that can be downloaded.
SIGNATURES = {"pdf": "%PDF", "docx": "PK\u0003\u0004", "zip": "PK\u0003\u0004"}


def relative_id(path: Column, root: str) -> Column:
    """SRC-11: the path below the corpus root, else the file name."""
    p = F.regexp_replace(path, r"^[a-z]+:/+", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return F.when(F.contains(p, F.lit(base)), F.substring_index(p, base, -1)).otherwise(F.substring_index(p, "/", -1))


def scan(spark: SparkSession, root: str, suffixes: tuple = ALL_SUFFIXES) -> DataFrame:
    """SRC-1, SRC-2, SRC-7 and SRC-11: every file below a folder with a known suffix: (doc_id, suffix, n_bytes, doc_hash, content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    f = files.select(relative_id(F.col("path"), root).alias("doc_id"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"), F.col("length").alias("n_bytes"), "content")
    return f.where(F.col("suffix").isin(*suffixes)).withColumn("doc_hash", F.sha2("content", 256))


def chunk_files(files: DataFrame) -> DataFrame:
    """SRC-2..6 and CHK-4: chunks of every file by the chunker of its suffix: (doc_id, chunk_id, section_title, text, doc_hash). Markdown and DOCX by sections, PDF
    page by page, everything else as text; a `.doc` file stops the run, as it can't be read."""
    t = files.where(~F.col("suffix").isin("docx", "pdf", "doc")).withColumn("text", F.decode("content", "UTF-8"))
    pages = office_pages(files).where("text is not null").join(files.select("doc_id", "suffix"), "doc_id")
    sections = t.where(F.col("suffix").isin("md", "markdown")).select("doc_id", "text").unionByName(pages.where("suffix = 'docx'").select("doc_id", "text"))
    md = chunk_markdown(sections, "doc_id", "text")
    md = md.select("doc_id", F.format_string("chunk_%03d_%03d", F.col("part_no"), F.col("slice_no")).alias("chunk_id"), "section_title", "text")
    tx = chunk_text(t.where(~F.col("suffix").isin("md", "markdown")), "doc_id", "text")
    tx = tx.select("doc_id", F.format_string("chunk_%03d", F.col("chunk_no")).alias("chunk_id"), F.lit("Section").alias("section_title"), "text")
    pdf = chunk_text(pages.where("suffix = 'pdf'").select(F.struct("doc_id", "page_number").alias("p"), "text"), "p", "text")
    pdf = pdf.select("p.doc_id", F.format_string("page_%04d_%03d", F.col("p.page_number"), F.col("chunk_no")).alias("chunk_id"), F.concat(F.lit("Page "), F.col("p.page_number").cast("string")).alias("section_title"), "text")
    none = F.lit(None).cast("string")
    doc = files.where("suffix = 'doc'").select("doc_id", none.alias("chunk_id"), none.alias("section_title"), F.raise_error(F.concat(F.lit("a .doc file can't be read: "), "doc_id")).cast("string").alias("text"))
    return md.unionByName(tx).unionByName(pdf).unionByName(doc).join(files.select("doc_id", "doc_hash"), "doc_id")


def download_reject(content: Column, n_bytes: Column, suffix: Column, content_type: Column) -> Column:
    """SRC-14: why a downloaded file isn't what it should be, or null: too small, a page instead of a document, wrong type or first bytes."""
    head = F.lower(F.decode(F.substring(content, 1, 256), "ISO-8859-1"))
    page = head.rlike(r"<!doctype html|<html")
    sig = F.create_map(*[F.lit(x) for kv in SIGNATURES.items() for x in kv])
    return let(
        F.struct(F.try_element_at(sig, suffix).alias("s"), head.alias("h"), page.alias("p")),
        lambda v: F.when(n_bytes < MIN_BYTES, "too_small").when(v["s"].isNull() & v["p"], "html_page").when(v["s"].isNotNull() & F.lower(content_type).rlike("^text/html"), "content_type")
        .when(v["s"].isNotNull() & ~F.startswith(v["h"], F.lower(v["s"])), F.when(v["p"], "html_page").otherwise("signature")),
    )


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """SRC-13: JSON lines; blank lines are skipped, lines that don't parse are kept in `_corrupt_record` where the schema has it."""
    r = spark.read.option("mode", "PERMISSIVE")
    return (r.schema(schema) if schema else r).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def edition(*fields: Column) -> Column:
    """SRC-10: the first edition that a metadata field names."""
    one = [F.nullif(F.regexp_extract(F.coalesce(f, F.lit("")), r"(?i)\b((?:\d+(?:st|nd|rd|th)|first|second|third|fourth|fifth|revised)\s+(?:ed\.|edition))", 1), F.lit("")) for f in fields]
    return F.coalesce(*one)


def cytoscape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SNK-4: one element per row as JSON: nodes by id, then edges with ids from their ends and type."""
    n = nodes.select(F.concat(F.lit("n:"), "id").alias("key"), F.to_json(F.struct(F.struct("id", F.col("name").alias("label"), "concept_type", "difficulty").alias("data"))).alias("element"))
    eid = F.concat_ws(":", F.lit("e"), "src", "dst", "edge_type")
    e = edges.select(eid.alias("key"), F.to_json(F.struct(F.struct(eid.alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), "edge_type", "relation").alias("data"))).alias("element"))
    return n.unionByName(e)


def gold_template(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """SNK-5: (doc_id, chunk_id, id, n_edges): the concepts of each chunk with the number of their outgoing edges."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return mentions.distinct().join(out, "id", "left").select("doc_id", "chunk_id", "id", F.coalesce("n", F.lit(0)).alias("n_edges"))


def write_snapshot(tables: dict[str, DataFrame], root: str, version: int) -> None:
    """SNK-1: a numbered snapshot of all tables; the pointer is written last, so readers see whole snapshots only."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/v={version}/{name}")
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").json(f"{root}/CURRENT")


def read_snapshot(spark: SparkSession, root: str, table: str) -> DataFrame:
    version = spark.read.schema("version int").json(f"{root}/CURRENT").first()[0]
    return spark.read.parquet(f"{root}/v={version}/{table}")
