"""Filters and predicates over extraction records (FLT-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import canonical_name, same_concept, valid_name
from ..functions.text import content_words, difficulty_rank, let, slug, strip

# Section titles without concepts; pairs that are no prerequisites (target, prerequisite).
BIBLIOGRAPHY = r"(?i)^\s*(references?|bibliography|works\s+cited|literature\s+cited|acknowledg(?:e)?ments?|appendix(\s+[a-z0-9]+)?|notes\s+and\s+references|further\s+reading)\b"
BLOCKED_PAIRS = (
    ("neural_network", "graph_neural_network"), ("neural_network", "dimensionality_reduction"), ("linear_regression", "neural_network"), ("eigenvalue", "neural_network"),
    ("linear_algebra", "linear_regression"), ("linear_regression", "support_vector_machine"), ("matrix_inverse", "linear_regression"), ("linear_algebra", "dimensionality_reduction"),
)
BLOCKED_AT_READ = (*BLOCKED_PAIRS, ("linear_algebra", "nearest_neighbor"), ("vector", "partial_derivative"), ("vector", "orthonormal_basis"))
SPECIAL_NETWORKS = "graph neural|convolutional neural|recurrent neural|deep neural|spiking neural|capsule network"
# Names and passages outside the domain.
DENYLIST = (
    "taylor swift", "travis kelce", "britney spears", "public figures", "news article", "podcast", "answer 1", "health", "policy", "influence", "directness", "diversity",
    "comprehensiveness", "verdant oasis plaza", "unity march", "harmony assembly", "jeopardy question", "jeopardy question generation", "community answers", "global answer",
    "maximum empowerment", "bart: batchable arma", "convex convex hull", "negative log-log", "positive log-lag", "negative log-lag", "positive log-log", "expanding exponential", "the theorem",
)
EXAMPLE_PASSAGE = (
    r"(?i)entertainment\s+articles?|public\s+figures\s+who|taylor\s+swift|travis\s+kelce|britney\s+spears|justin\s+bieber|verdant\s+oasis\s+plaza|unity\s+march|harmony\s+assembly"
)
# Relation labels that a record may use; `co_mention` is made by the pipeline itself.
RELATIONS = ("contrasts_with", "uses", "extends", "evaluated_by", "variant_of", "part_of")


def is_bibliography(title: Column) -> Column:
    """FLT-3: a section of references or the like."""
    t = strip(F.coalesce(title, F.lit("")))
    return (t != "") & (t.rlike(BIBLIOGRAPHY) | (F.lower(t).rlike("references|bibliography|works cited") & (F.length(t) < 80)))


def scope_verdict(name: Column, passage: Column, denylist: tuple = DENYLIST) -> Column:
    """FLT-4: denylisted, example_passage or kept."""
    return F.when(F.lower(strip(F.coalesce(name, F.lit("")))).isin(*denylist), "denylisted").when(F.coalesce(passage.rlike(EXAMPLE_PASSAGE), F.lit(False)), "example_passage").otherwise("kept")


def in_domain(name: Column, terms: list[str]) -> Column:
    """FLT-5: the name holds one of the terms; without terms everything passes."""
    if not terms:
        return F.lit(True)
    n = F.lower(F.coalesce(name, F.lit("")))
    return F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(n, t))


def grounding_verdict(name: Column, summary: Column, passage: Column, overlap: float = 0.30) -> Column:
    """FLT-6: kept, rescued, ungrounded or empty_summary: a record must be anchored in its passage.

    Kept without a passage or name. Otherwise a word of the name must be in the passage, or at least `overlap` of the summary's content words;
    without a summary the exact name must be there.
    """
    p, n, s = F.lower(F.coalesce(passage, F.lit(""))), F.lower(strip(F.coalesce(name, F.lit("")))), strip(F.coalesce(summary, F.lit("")))

    def decide(v: Column) -> Column:
        exact = F.contains(v["p"], v["n"])
        hit = exact | F.exists(content_words(v["n"]), lambda w: F.contains(v["p"], w))
        sw = content_words(v["s"])
        share = F.coalesce(F.size(F.array_intersect(sw, content_words(v["p"]))) / F.nullif(F.size(sw), F.lit(0)), F.lit(0.0))
        return (
            F.when((v["p"] == "") | (v["n"] == ""), "kept").when(~hit, F.when(share >= overlap, "rescued").otherwise("ungrounded"))
            .when((v["s"] == "") & ~exact, "empty_summary").otherwise("kept")
        )

    return let(F.struct(p.alias("p"), n.alias("n"), s.alias("s")), decide)


def weak_records(records: DataFrame, chunks: DataFrame, overlap: float = 0.3) -> DataFrame:
    """FLT-7 and JON-1: the grounding rule with the passage from the chunk table (left outer join on doc_id and chunk_id)."""
    c = chunks.groupBy("doc_id", "chunk_id").agg(F.min("text").alias("__text"))
    j = records.join(c, ["doc_id", "chunk_id"], "left")
    return j.withColumn("verdict", grounding_verdict(F.col("concept_name"), F.col("summary"), F.coalesce("__text", "source_passage"), overlap)).drop("__text")


def references(records: DataFrame) -> DataFrame:
    """The references of all records as rows: (rec_id, concept_name, kind, pos, target, relation); null or blank targets come out too."""
    base = ["rec_id", "concept_name"]
    pre = records.select(*base, F.lit("prereq").alias("kind"), F.posexplode("prerequisites").alias("pos", "target"), F.lit("requires").alias("relation"))
    unl = records.select(*base, F.lit("unlock").alias("kind"), F.posexplode("unlocks").alias("pos", "target"), F.lit("enables").alias("relation"))
    rel = records.select(*base, F.lit("related").alias("kind"), F.posexplode("related_to").alias("pos", "x"))
    rel = rel.select(*base, "kind", "pos", F.col("x.concept").alias("target"), F.lower(F.trim(F.coalesce("x.relation", F.lit("uses")))).alias("relation"))
    return pre.unionByName(unl).unionByName(rel)


def reference_verdict(target: Column, owner: Column) -> Column:
    """FLT-9: invalid, self or kept, after the target is canonicalised."""
    blank = target.isNull() | (strip(target) == "")
    canon = canonical_name(target)
    return F.when(blank, "invalid").when(same_concept(canon, owner), "self").when(~valid_name(canon), "invalid").otherwise("kept")


def pruned_references(refs: DataFrame) -> DataFrame:
    """FLT-9: the kept references, canonical, once per record, kind and (for related ones) relation; the first position wins."""
    kept = refs.where(reference_verdict(F.col("target"), F.col("concept_name")) == "kept").withColumn("target", canonical_name(F.col("target")))
    relation = F.when(F.col("kind") != "related", F.col("relation")).when(F.col("relation").isin(*RELATIONS), F.col("relation")).otherwise("uses")
    kept = kept.withColumn("relation", relation).withColumn("__t", F.lower("target"))
    return kept.groupBy("rec_id", "kind", "relation", "__t").agg(F.min("pos").alias("pos"), F.min_by("target", "pos").alias("target")).drop("__t")


def unresolved_verdict(target: Column, owner: Column) -> Column:
    """FLT-10: only blank targets and exact self references go; targets nobody extracted stay for other documents."""
    return F.when(target.isNull() | (strip(target) == ""), "empty").when(F.lower(strip(target)) == F.lower(strip(F.coalesce(owner, F.lit("")))), "self").otherwise("kept")


def inverted_prerequisite(target: Column, prereq: Column, target_difficulty: Column, prereq_difficulty: Column, blocked: tuple = BLOCKED_PAIRS) -> Column:
    """FLT-11 and FLT-13: the prerequisite can't come before the target: same id, blocked pair, two or more levels harder, or a special
    network before the general one."""
    t, p = slug(F.coalesce(target, F.lit(""))), slug(F.coalesce(prereq, F.lit("")))
    gap = F.coalesce(difficulty_rank(prereq_difficulty) - difficulty_rank(target_difficulty) >= 2, F.lit(False))
    tl, pl = F.lower(F.coalesce(target, F.lit(""))), F.lower(F.coalesce(prereq, F.lit("")))
    special = F.contains(tl, F.lit("neural network")) & pl.rlike(SPECIAL_NETWORKS) & pl.rlike("graph|convolutional|recurrent") & ~tl.rlike("graph|convolutional")
    pair = F.concat_ws(">", t, p).isin(*[f"{a}>{b}" for a, b in blocked])
    return (t == p) | pair | gap | special


def prerequisite_checks(records: DataFrame) -> DataFrame:
    """FLT-12 and JON-8: (rec_id, pos, prerequisite, inverted): the difficulty of a prerequisite is that of the last record of its
    name (no level where none has it)."""
    level = records.where("concept_name is not null").groupBy(F.lower(F.trim("concept_name")).alias("__n")).agg(F.max_by(F.coalesce("difficulty", F.lit("intermediate")), "rec_id").alias("__d"))
    p = records.select("rec_id", "concept_name", "difficulty", F.posexplode("prerequisites").alias("pos", "prerequisite")).where("trim(coalesce(prerequisite, '')) <> ''")
    j = p.withColumn("__n", F.lower("prerequisite")).join(level, "__n", "left")
    flag = inverted_prerequisite(F.col("concept_name"), F.col("prerequisite"), F.coalesce("difficulty", F.lit("intermediate")), F.col("__d"))
    return j.select("rec_id", "pos", "prerequisite", flag.alias("inverted"))
