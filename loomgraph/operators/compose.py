"""Whole cleaning runs composed of the operators (CMP-1, CMP-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import valid_name
from ..functions.text import strip
from ..session import materialize
from . import filters as L
from . import records as R
from .graph import break_cycles

_ORIGIN = ("doc_id", "chunk_id", "section_title")


def _sources() -> Column:
    return F.count_distinct(F.struct(*[F.coalesce(c, F.lit("")) for c in _ORIGIN], F.coalesce("page_number", F.lit(0))))


def _longest(s: Column) -> Column:
    return F.max_by(s, F.struct(F.length(s), -F.col("rec_id")))


def clean_pipeline(records: DataFrame, chunks: DataFrame, terms: list[str], threshold: float = 85.0) -> tuple[DataFrame, DataFrame]:
    """CMP-1: (concepts, facts) after FLT-7 (the record's own passage, else its chunk's text), AGG-3 and FLT-5 (without terms everything passes)."""
    own = F.coalesce(F.col("source_passage"), F.lit("")) != ""
    # weak_records prefers the chunk's text, so a record with a passage goes without its chunk
    keyed = records.withColumns({"doc_id": F.when(~own, F.col("doc_id")), "chunk_id": F.when(~own, F.col("chunk_id"))}).select("rec_id", "concept_name", "summary", "source_passage", "doc_id", "chunk_id")
    ok = L.weak_records(keyed, chunks).where(F.col("verdict").isin("kept", "rescued")).select("rec_id")
    k = materialize(records.join(ok, "rec_id", "left_semi").where("concept_name <> ''"), "grounded")
    mapping = materialize(R.first_seen_map(k, threshold), "first-seen")
    n = k.join(mapping.toDF("concept_name", "c"), "concept_name", "left").withColumn("name", F.coalesce("c", "concept_name"))
    s = F.coalesce("summary", F.lit(""))
    concepts = n.groupBy(F.lower("name").alias("name_key")).agg(
        F.min_by("name", "rec_id").alias("concept_name"), F.min("rec_id").alias("rec_id"), F.count(F.lit(1)).alias("n_records"), _longest(s).alias("summary"), _sources().alias("source_count")
    ).where(L.in_domain(F.col("concept_name"), terms))
    facts = R.merged_facts(k, last_wins=True, mapping=mapping).join(concepts.select("name_key"), "name_key", "left_semi")
    return concepts, facts


def clean_and_canonicalize(records: DataFrame, threshold: float = 90.0) -> tuple[DataFrame, DataFrame]:
    """CMP-2: (concepts, references) after all ordered steps: valid names, bibliography, scope, grounding, identical records, invalid references, merge by name,
    short names, canonical map, merge, invalid and unresolved references, cycles, inverted prerequisites.

    Empty summaries are filled by the merge: the one row of a name has the longest summary. References stay rows; their order is that of records and positions.
    """
    concepts, mapping, n, refs, at = _canonical_concepts(records, threshold)
    owner = n.select("rec_id", F.col("key").alias("name_key")).join(concepts.select("name_key", "concept_name", F.col("rec_id").alias("owner")), "name_key")
    refs = R.apply_map(refs.join(owner, "rec_id").select(F.col("owner").alias("rec_id"), "concept_name", "kind", F.col("at").alias("pos"), "target", "relation"), mapping)
    refs = L.pruned_references(refs).join(concepts.select("rec_id", "concept_name", "difficulty"), "rec_id")
    refs = refs.where((L.unresolved_verdict(F.col("target"), F.col("concept_name")) == "kept") & valid_name(F.col("target")))
    refs = materialize(refs.join(at.toDF("kind", "pos", "source"), ["kind", "pos"]), "references")

    a, b = F.lower("target"), F.lower("concept_name")
    arcs = refs.where("kind = 'prereq'").select(a.alias("a"), b.alias("b")).unionByName(refs.where("kind = 'unlock'").select(b.alias("a"), a.alias("b"))).where("a <> b").distinct()
    levels = concepts.groupBy(F.lower("concept_name").alias("id")).agg(F.max_by(F.coalesce("difficulty", F.lit("intermediate")), "rec_id").alias("difficulty"))
    gone = materialize(break_cycles(arcs, levels), "cycles")
    void = gone.select(F.lit("prereq").alias("kind"), F.col("a").alias("t"), F.col("b").alias("o")).unionByName(gone.select(F.lit("unlock").alias("kind"), F.col("b").alias("t"), F.col("a").alias("o")))
    refs = refs.withColumns({"t": a, "o": b}).join(void, ["kind", "t", "o"], "left_anti").join(levels.toDF("t", "level"), "t", "left")
    inverted = (F.col("kind") == "prereq") & L.inverted_prerequisite(F.col("concept_name"), F.col("target"), F.coalesce("difficulty", F.lit("intermediate")), F.col("level"))
    return concepts, refs.where(~inverted).select("concept_name", "kind", "relation", "target", "source")


def clean_concepts(records: DataFrame, threshold: float = 90.0) -> DataFrame:
    """CMP-2: the concepts alone; no step on references after the merge changes them, so those steps don't run."""
    return _canonical_concepts(records, threshold)[0]


def _canonical_concepts(records: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(concepts, canonical map, records with their key, references, origins of references) after the steps of CMP-2 up to the merge."""
    p = F.col("source_passage")
    r = records.where(valid_name(F.col("concept_name")) & ~L.is_bibliography(F.col("section_title")) & (L.scope_verdict(F.col("concept_name"), p) == "kept"))
    r = materialize(r.where(L.grounding_verdict(F.col("concept_name"), F.col("summary"), p).isin("kept", "rescued")), "clean")

    k = R.identical_key(r)
    own = F.concat_ws(":", F.coalesce("doc_id", F.lit("")), F.coalesce("chunk_id", F.lit("")))
    group = k.groupBy("k_doc", "k_name", "k_sum").agg(F.min("rec_id").alias("first"), F.min_by(own, "rec_id").alias("own"))
    same = k.join(group, ["k_doc", "k_name", "k_sum"]).select("rec_id", "first", "own", "relation_provenance")
    raw = L.references(r).where("target is not null")
    stated = F.try_element_at("relation_provenance", F.concat("kind", F.lit(":"), F.lower("target")))
    # a row of the merged lists is known by its kind and by (record, position) as `pos`
    at = raw.join(same, "rec_id").select("kind", F.struct("first", "rec_id", "pos").alias("at"), F.coalesce(stated, F.nullif("own", F.lit(":"))).alias("source"))

    refs = L.pruned_references(raw).join(same.select("rec_id", "first"), "rec_id").withColumn("at", F.struct("first", "rec_id", "pos"))
    key = R.merge_name_key(F.col("concept_name"))
    names = r.withColumn("key", key).groupBy("key").agg(F.min_by("concept_name", "rec_id").alias("name")).where(F.length("name") >= 3)
    mapping = materialize(R.clustered_map(names.select("name").unionByName(refs.select(F.col("target").alias("name"))).distinct(), threshold), "canonical")
    final = names.join(mapping, "name").select("key", F.col("canonical").alias("concept_name"))
    s = F.coalesce("summary", F.lit(""))
    n = r.withColumn("key", key).withColumnRenamed("concept_name", "written").join(final, "key")
    observed = F.struct(F.coalesce("doc_id", F.lit("")), F.lower(strip(F.col("written"))), strip(s))
    concepts = materialize(n.groupBy(key.alias("name_key")).agg(
        F.min_by(F.struct("concept_name", "concept_type", "difficulty"), "rec_id").alias("r"), F.min("rec_id").alias("rec_id"), F.count_distinct(observed).alias("n_records"),
        _longest(s).alias("summary"), _sources().alias("source_count"),
    ).select("name_key", "r.*", "rec_id", "n_records", "summary", "source_count"), "concepts")
    return concepts, mapping, n, refs, at
