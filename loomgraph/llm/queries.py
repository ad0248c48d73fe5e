"""The queries pN_... over the tables of a data folder; every one runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import read
from . import canon_match, common, dups, language, leaks, mix, overlap, packing, pairs, reading, splits, text_stats


def _mixed(spark: SparkSession, sf: str):
    p = read(spark, sf, "sft_pairs", "pair_id", "doc_id", "output")
    return mix.mix(p, read(spark, sf, "mix_targets"), "pair_id", "doc_id", F.length("output"))


def p1_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of the mix, with the number of its copy."""
    return _mixed(spark, sf)[0].select("pair_id", "source_category", "copy_no", F.col("n").alias("n_chars"))


def p1_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target share and share reached per category."""
    r = _mixed(spark, sf)[1]
    return r.select("source_category", "target_share", F.round("actual_share", 6).alias("actual_share"), "records", F.col("available").alias("available_chars"), "copies", F.col("emitted").alias("emitted_chars"), F.round("rate", 6).alias("rate"))


def _model(spark: SparkSession, sf: str) -> language.LanguageModel:
    return language.fit_languages(read(spark, sf, "documents", "doc_id", "text", "lang"), "doc_id", "text", "lang")


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    return text_stats.document_stats(read(spark, sf, "okf_results", "rec_id", "source_passage"), "rec_id", "source_passage", _model(spark, sf))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _passages(spark, sf).select("rec_id", text_stats.passage_kind().alias("passage_kind")).where("passage_kind <> 'prose'")


def p2_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics of every passage and its kind."""
    return _passages(spark, sf).select("rec_id", *text_stats.ratios(), F.col("lines").alias("line_count"), text_stats.passage_kind().alias("passage_kind"))


def _grouped_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "sft_pairs", "pair_id", "doc_id", "chunk_id")
    source = F.coalesce(common.source_name(F.col("doc_id")), common.chunk_source(F.col("chunk_id")))
    key = F.concat(F.nullif(source, F.lit("")), F.lit("#"), common.chunk_number(F.col("chunk_id")))
    spelled = F.when(key.isNotNull(), F.concat_ws("|", F.coalesce("doc_id", F.lit("")), "chunk_id"))
    return splits.group_records(p, "pair_id", [spelled, key])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.group_members(_grouped_pairs(spark, sf), "pair_id", "first_pair_id")


def p3_split(spark: SparkSession, sf: str) -> DataFrame:
    """The new split of every pair."""
    return splits.assign_splits(_grouped_pairs(spark, sf), "pair_id", read(spark, sf, "split_targets")).select("pair_id", "split_name")


def p3_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached share of each split."""
    got = p3_split(spark, sf).groupBy("split_name").agg(F.count(F.lit(1)).alias("n_pairs"))
    whole = got.agg(F.sum("n_pairs").alias("t"))
    return read(spark, sf, "split_targets").join(got, "split_name", "left").crossJoin(F.broadcast(whole)).select(  # one row on the right
        "split_name", "target_share", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.round(F.coalesce("n_pairs", F.lit(0)) / F.col("t"), 6).alias("actual_share")
    )


_P4 = ("rec_id", ["concept_name", "doc_id"], ["summary"])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "okf_results", "rec_id", "concept_name", "summary", "doc_id")
    return dups.duplicate_members(dups.duplicate_keys(o, *_P4), "rec_id", "first_rec_id")


def p4_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """One record of each group, with the number of its copies."""
    return dups.collapse(read(spark, sf, "okf_results", "rec_id", "concept_name", "summary", "doc_id"), *_P4)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "okf_results", "rec_id", "concept_name", "prerequisites", "unlocks")
    ref = read(spark, sf, "concept_reference", "ref_id", "canonical_name", "aliases")
    return canon_match.canonicalise_fields(o, ref, "rec_id", ["concept_name"], ["prerequisites", "unlocks"], "ref_id", "canonical_name", "aliases")


def p5_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Values that name nothing in the list, with how often they are used."""
    o = read(spark, sf, "okf_results", "rec_id", "concept_name", "prerequisites", "unlocks")
    ref = read(spark, sf, "concept_reference", "ref_id", "canonical_name", "aliases")
    occ = canon_match.field_values(o, "rec_id", ["concept_name"], ["prerequisites", "unlocks"]).groupBy("raw").agg(F.count(F.lit(1)).alias("n_uses"))
    found = canon_match.match_values(occ.select("raw"), ref, "ref_id", "canonical_name", "aliases")
    return occ.join(found.where("ref_id = -1"), "raw").select(F.col("raw").alias("value"), "n_uses")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    model = _model(spark, sf)
    none = F.lit(None).cast("string")
    p = read(spark, sf, "sft_pairs", "pair_id", "instruction", "output").select(
        F.lit("sft_pairs").alias("origin"), F.col("pair_id").alias("row_id"), F.col("instruction").alias("prompt"), none.alias("context"), F.col("output").alias("answer"), F.lit(0).alias("limit")
    )
    # every different text that a key has is a context
    chunks = read(spark, sf, "chunks", "doc_id", "chunk_id", "text").distinct()
    e = read(spark, sf, "lib_qwen_ingestion_eval", "eval_id", "doc_id", "chunk_id", "raw_preview")
    e = common.salted_join(e, chunks, ["doc_id", "chunk_id"], "eval_id", 8, "left").select(
        F.lit("lib_qwen_ingestion_eval").alias("origin"), F.col("eval_id").alias("row_id"), none.alias("prompt"), F.col("text").alias("context"), F.col("raw_preview").alias("answer"), F.lit(pairs.PREVIEW_CHARS).alias("limit")
    )
    return pairs.flag_pairs(p, model).unionByName(pairs.flag_in_contexts(e, model))


def p6_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Defective answers per origin and defect."""
    return p6_found(spark, sf).groupBy("origin", "defect").agg(F.count(F.lit(1)).alias("n_rows"))


def _overlap(spark: SparkSession, sf: str) -> overlap.Overlap:
    return overlap.find_overlaps(read(spark, sf, "sft_pairs", "pair_id", "instruction", "split_name", "doc_id"), "pair_id", "instruction", "split_name", "doc_id")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.row_pairs(_overlap(spark, sf))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping rows and pairs of rows per evaluation split and source."""
    return overlap.overlap_report(_overlap(spark, sf), common.source_name(F.col("doc")))


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(packing.token_sizes(read(spark, sf, "documents", "doc_id", "text"), "doc_id", "text"), read(spark, sf, "pack_limits"))


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    """The contents of each container for every limit."""
    return _packed(spark, sf)


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """Containers used, their fill, and the least number that any packing needs."""
    r = packing.pack_report(_packed(spark, sf), read(spark, sf, "pack_limits"))
    return r.withColumn("fill", F.round("fill", 6))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.find_leaks(read(spark, sf, "documents", "doc_id", "text"), read(spark, sf, "heldout_items", "item_id", "item_text"), "doc_id", "text", "item_id", "item_text")


def p9_items(spark: SparkSession, sf: str) -> DataFrame:
    """For every item that leaked, the number of documents it is in."""
    items = read(spark, sf, "heldout_items", "item_id", "suite")
    n = p9_found(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return items.join(n, "item_id").select("item_id", "suite", "n_documents")


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    labels = read(spark, sf, "reading_labels", "passage_id", "passage_text", "reading_level")
    return reading.reading_levels(read(spark, sf, "documents", "doc_id", "text"), labels, "doc_id", "text", "passage_id", "passage_text", "reading_level", _model(spark, sf))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf)


def p10_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per source and reading level."""
    d = read(spark, sf, "documents", "doc_id", "source")
    return d.join(_levels(spark, sf), "doc_id").groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("n_documents"))


def queries() -> dict:
    names = (
        p1_mix, p1_shares, p2_found, p2_stats, p3_found, p3_split, p3_shares, p4_found, p4_collapsed, p5_found, p5_unmatched,
        p6_found, p6_counts, p7_found, p7_report, p8_pack, p8_report, p9_found, p9_items, p10_found, p10_profile,
    )
    return {f.__name__: f for f in names}
