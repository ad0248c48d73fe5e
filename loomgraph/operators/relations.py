"""Mentions of concepts in chunks, relations from them, and the evidence for both (REL-*, JON-5..11, EXT-*, CIT-1..2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import aliases, canonical_name
from ..functions.text import difficulty_rank, tokens
from ..session import is_empty, materialize
from .filters import references
from .records import resolve_names

MAX_ALIAS_WORDS = 6
CHUNK_CONCEPTS = 5
# Relation labels that mean unlocking; words between two concepts that mean unlocking or requiring.
UNLOCK_LABELS = ("enables", "unlocks", "leads_to", "leads to", "allows", "prerequisite_for", "pre-requisite", "extends")
UNLOCK_WORDS = r"\b(enables|unlocks|leads to|allows|is a prerequisite for|key to)\b"
REQUIRE_WORDS = r"\b(requires|builds on|depends on|is based on|needs|uses)\b"


def word_form(c: Column) -> Column:
    """Lower-case words with single blanks: the form in which aliases and texts are compared word by word."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def alias_table(concepts: DataFrame) -> DataFrame:
    """(id, alias): the distinct word forms of the aliases of (id, name), of two characters or more."""
    a = concepts.toDF("id", "name").where("name is not null").select("id", F.explode(aliases(F.col("name"))).alias("a"))
    return a.select("id", word_form(F.col("a")).alias("alias")).where("length(alias) >= 2").distinct()


def mentions(chunks: DataFrame, concepts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """JON-5: (key.., id): chunks that name a concept by one of its aliases, as whole words.

    A nested loop over chunks and aliases would grow with both: here the runs of words of a chunk, of just the lengths that aliases have, meet the aliases in
    an equi-join, however long an alias is.
    """
    al = materialize(alias_table(concepts).withColumn("n", F.size(F.split("alias", " "))), "aliases")
    lengths = sorted(r.n for r in al.select("n").distinct().collect())  # the different lengths of aliases
    c = chunks.select(*key, word_form(F.col(text)).alias("w")).where("w <> ''").withColumn("w", F.split("w", " "))
    size = F.size("w")

    def of_length(n: int) -> Column:
        if n == 1:
            return F.col("w")
        starts = F.sequence(F.lit(0), F.greatest(size - n, F.lit(0)))
        return F.when(size >= n, F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    joined = [of_length(n) for n in lengths]
    runs = F.concat(*joined) if joined else F.array().cast("array<string>")
    return c.select(*key, F.explode(runs).alias("alias")).join(al.select("alias", "id"), "alias").select(*key, "id").distinct()


def co_mentions(m: DataFrame, key: list[str]) -> DataFrame:
    """JON-6: (a, b, n_chunks, first): pairs of concepts named in one chunk, a < b, with the number of chunks and the first of them."""
    k = F.struct(*key)
    x, y = m.select(k.alias("k"), F.col("id").alias("a")), m.select(k.alias("k"), F.col("id").alias("b"))
    return x.join(y, "k").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("k").alias("first"))


def co_mention_candidates(pairs: DataFrame, existing: DataFrame, home: DataFrame) -> DataFrame:
    """REL-9 and JON-7: pairs without an edge (a, b in either direction), scored: the number of chunks, plus 100 where the concepts' own
    documents (`home`: id, doc) have none in common."""
    e = existing.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    p = pairs.join(e, ["a", "b"], "left_anti")
    docs = home.toDF("id", "doc").where("doc is not null").distinct()
    has = docs.select("id").distinct()
    shared = p.select("a", "b").join(docs.select(F.col("id").alias("a"), "doc"), "a").join(docs.select(F.col("id").alias("b"), "doc"), ["b", "doc"]).select("a", "b").distinct()
    p = p.join(shared.withColumn("s", F.lit(1)), ["a", "b"], "left")
    p = p.join(has.select(F.col("id").alias("a"), F.lit(1).alias("ha")), "a", "left").join(has.select(F.col("id").alias("b"), F.lit(1).alias("hb")), "b", "left")
    cross = F.col("s").isNull() & F.col("ha").isNotNull() & F.col("hb").isNotNull()
    return p.select("a", "b", (F.col("n_chunks") + F.when(cross, 100).otherwise(0)).alias("score"), "first")


def capped_edges(candidates: DataFrame, cap: int = 5) -> DataFrame:
    """WIN-4 and REL-9: greedy choice by falling score (then a, b) of pairs with fewer than `cap` chosen at both ends.

    The sequential fold is done in rounds: a pair whose rank among the undecided is within the room left at both ends is sure to be chosen, and one with a
    full end is sure not to be. Each round decides at least the best pair left, in practice most of them; rounds are written tables.
    """
    left = materialize(candidates.select("a", "b", "score"), "greedy")
    used = None
    taken = None
    while not is_empty(left):
        ends = left.select("a", "b", "score", F.explode(F.array("a", "b")).alias("v"))
        ends = ends.join(used, "v", "left") if used is not None else ends.withColumn("u", F.lit(0))
        w = Window.partitionBy("v").orderBy(F.desc("score"), "a", "b")
        ends = ends.withColumn("room", F.lit(cap) - F.coalesce("u", F.lit(0))).withColumn("r", F.row_number().over(w))
        state = ends.groupBy("a", "b", "score").agg(F.min(F.col("r") <= F.col("room")).alias("sure"), F.max(F.col("room") <= 0).alias("full"))
        state = materialize(state, "greedy")
        new = state.where("sure")
        taken = new.select("a", "b", "score") if taken is None else taken.unionByName(new.select("a", "b", "score"))
        taken = materialize(taken, "greedy-taken")
        used = taken.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).cast("int").alias("u"))
        left = state.where("not sure and not full").select("a", "b", "score")
    return taken if taken is not None else left


def validated(pairs: DataFrame, m: DataFrame, key: list[str]) -> DataFrame:
    """REL-4 and REL-5: the pairs (a, b) whose ends are named together in some chunk."""
    k = F.struct(*key)
    j = pairs.select("a", "b").distinct().join(m.select(F.col("id").alias("a"), k.alias("k")), "a").join(m.select(F.col("id").alias("b"), k.alias("k")), ["b", "k"])
    return j.select("a", "b").distinct()


def directions(pairs: DataFrame, texts: DataFrame, m: DataFrame, concepts: DataFrame, key: list[str]) -> DataFrame:
    """REL-7: (a, b, first, second): which of two concepts is learned first: by the order of their names in the chunks that have both, then the first
    chunk that names each (`texts`: key.., ord, text), then difficulty, then the alphabet. `concepts`: id, name, difficulty."""
    t = texts.select(F.struct(*key).alias("k"), "ord", F.lower("text").alias("t"))
    c = concepts.select("id", F.lower(F.trim("name")).alias("n"), F.coalesce(difficulty_rank(F.col("difficulty")), F.lit(2)).alias("r"))
    near = m.select(F.struct(*key).alias("k"), "id").join(c, "id").join(t, "k").withColumn("p", F.call_function("instr", F.col("t"), F.col("n"))).where("p > 0")
    near = near.select("k", "ord", "id", "p")
    firsts = near.groupBy("id").agg(F.min("ord").alias("o"))
    p = pairs.select("a", "b").distinct()
    vote = p.join(near.select(F.col("id").alias("a"), "k", F.col("p").alias("pa")), "a").join(near.select(F.col("id").alias("b"), "k", F.col("p").alias("pb")), ["b", "k"])
    vote = vote.groupBy("a", "b").agg(F.sum(F.signum(F.col("pb") - F.col("pa"))).cast("int").alias("score"))
    j = p.join(vote, ["a", "b"], "left")
    for side in ("a", "b"):
        j = j.join(firsts.select(F.col("id").alias(side), F.col("o").alias(f"o{side}")), side, "left").join(c.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("r").alias(f"r{side}")), side, "left")
    score = F.coalesce("score", F.lit(0))
    forward = (
        F.when(score != 0, score > 0).when(F.col("oa").isNotNull() & F.col("ob").isNotNull() & (F.col("oa") != F.col("ob")), F.col("oa") < F.col("ob"))
        .when(F.col("ra") != F.col("rb"), F.col("ra") < F.col("rb")).otherwise(F.col("na") < F.col("nb"))
    )
    return j.select("a", "b", F.when(forward, F.col("a")).otherwise(F.col("b")).alias("first"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("second"))


def trigger_unlocks(texts: DataFrame, concepts: DataFrame, key: list[str]) -> DataFrame:
    """REL-11: (src, dst, key..): src UNLOCKS dst, from a sentence of 15 characters or more that names one concept before the other with
    words of unlocking between them, or of requiring (then the later one unlocks the earlier one).

    Of several aliases of a concept in a sentence the first in order counts. The parts before, between and after are cut by position in word form.
    """
    s = texts.select(*key, F.explode(F.split(F.lower("text"), r"[.!?\n]")).alias("s")).where(F.length(F.trim("s")) >= 15)
    s = s.select(*key, word_form(F.col("s")).alias("s")).where(F.col("s").rlike(UNLOCK_WORDS) | F.col("s").rlike(REQUIRE_WORDS)).distinct()
    named = mentions_with_alias(s, concepts, [*key, "s"])
    at = F.expr("instr(concat(' ', s, ' '), concat(' ', alias, ' '))")
    n = named.withColumn("p", at).withColumn("e", F.col("p") + F.length("alias"))
    x = n.select(*key, "s", F.col("id").alias("x"), F.col("p").alias("px"), F.col("e").alias("ex"))
    y = n.select(*key, "s", F.col("id").alias("y"), F.col("p").alias("py"))
    j = x.join(y, [*key, "s"]).where("x <> y and px < py and py >= ex").withColumn("mid", F.expr("substring(s, ex, py - ex)"))
    fwd, back = F.col("mid").rlike(UNLOCK_WORDS), F.col("mid").rlike(REQUIRE_WORDS)
    out = j.where(fwd | back).select(F.when(fwd, F.col("x")).otherwise(F.col("y")).alias("src"), F.when(fwd, F.col("y")).otherwise(F.col("x")).alias("dst"), *key)
    return out.groupBy("src", "dst").agg(F.min(F.struct(*key)).alias("k")).select("src", "dst", "k.*")


def mentions_with_alias(texts: DataFrame, concepts: DataFrame, key: list[str]) -> DataFrame:
    """(key.., id, alias): the first alias (in order) by which a sentence `s` names a concept."""
    al = alias_table(concepts)
    ws = F.split("s", " ")
    size = F.size(ws)
    runs = F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.lit(MAX_ALIAS_WORDS)),
        lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), lambda i: F.array_join(F.slice(ws, i + 1, n), " "))).otherwise(F.array().cast("array<string>")),
    )))
    j = texts.select(*key, F.explode(runs).alias("alias")).join(al, "alias")
    return j.groupBy(*key, "id").agg(F.min("alias").alias("alias"))


def candidates_in_passage(records: DataFrame, names: DataFrame, cap: int = 8) -> DataFrame:
    """REL-1 and WIN-13: (rec_id, name): the names that a record's passage holds as whole words, without its own, the longest first, at most `cap`."""
    m = mentions(records.select("rec_id", "source_passage"), names.select(F.col("name").alias("id"), "name"), ["rec_id"], "source_passage")
    own = records.select("rec_id", F.lower(F.trim("concept_name")).alias("o"))
    m = m.join(own, "rec_id").where("lower(id) <> coalesce(o, '')")
    w = Window.partitionBy("rec_id").orderBy(F.desc(F.length("id")), "id")
    return m.withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap).select("rec_id", F.col("id").alias("name"))


def keyword_scores(texts: DataFrame, key: str, text: str, clusters: dict[str, list[str]], least: int = 2, top: int = 8) -> DataFrame:
    """EXT-3: (cluster, key, score): texts of 40 to 350 words by how many of a cluster's keywords they hold; the best `top` of each cluster."""
    n = F.size(tokens(F.col(text)))
    t = texts.select(key, F.lower(text).alias("t"), n.alias("n")).where("n between 40 and 350")
    scores = F.array(*[F.struct(F.lit(c).alias("cluster"), sum((F.contains(F.col("t"), F.lit(k)).cast("int") for k in ks), F.lit(0)).alias("score")) for c, ks in clusters.items()])
    s = t.select(key, F.explode(scores).alias("x")).select("x.cluster", key, "x.score").where(F.col("score") >= least)
    w = Window.partitionBy("cluster").orderBy(F.desc("score"), key)
    return s.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select("cluster", key, "score")


def closed_references(records: DataFrame, cap: int = CHUNK_CONCEPTS) -> DataFrame:
    """EXT-2: (rec_id, kind, pos, target): the references of all three kinds to concepts of the same chunk, of the first `cap` records of each chunk; the
    records beyond the cap still count as concepts of the chunk."""
    r = records.where("doc_id is not null and chunk_id is not null")
    w = Window.partitionBy("doc_id", "chunk_id").orderBy("rec_id")  # with the cap the ranks are bounded before the shuffle
    first = r.select("rec_id", "doc_id", "chunk_id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap).drop("r")
    names = r.select("doc_id", "chunk_id", F.col("concept_name").alias("target")).distinct()
    return references(r).join(first, "rec_id").join(names, ["doc_id", "chunk_id", "target"], "left_semi").select("rec_id", "kind", "pos", "target")


def oriented_edges(records: DataFrame, texts: DataFrame, m: DataFrame, concepts: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """REL-8: (src, dst, edge_type, relation, source): references resolved by the alias `index` to `concepts` (id, name, difficulty), whose ends are named
    together in some chunk, directed by REL-7: the later concept REQUIRES the earlier one, which UNLOCKS it; RELATED goes from the lesser id.

    Of one edge's assertions the first record and position gives relation and provenance (stated, else the record's chunk).
    """
    own = F.concat_ws(":", F.coalesce("doc_id", F.lit("")), F.coalesce("chunk_id", F.lit("")))
    stated = F.try_element_at("relation_provenance", F.concat("kind", F.lit(":"), F.lower("target")))
    r = references(records).where("trim(coalesce(target, '')) <> '' and trim(coalesce(concept_name, '')) <> ''").join(records.select("rec_id", "relation_provenance", own.alias("own")), "rec_id")
    r = r.select("rec_id", "kind", "pos", "relation", F.trim("concept_name").alias("na"), F.trim("target").alias("nb"), F.coalesce(stated, "own").alias("source"))
    form = lambda c: F.lower(F.trim(c))
    known = concepts.select("id", form(canonical_name(F.col("name"))).alias("f")).groupBy("f").agg(F.min("id").alias("id"))
    ids = resolve_names(r.select("na").union(r.select("nb")), index).withColumn("f", form(F.col("canonical"))).join(known, "f").select("name", "id")
    r = r.join(ids.toDF("na", "a"), "na").join(ids.toDF("nb", "b"), "nb").where("a <> b")
    r = materialize(r.select("rec_id", "kind", "pos", "relation", "source", "a", "b", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")), "oriented")
    ok = materialize(validated(r.select(F.col("lo").alias("a"), F.col("hi").alias("b")), m, key), "validated")
    d = directions(ok.join(r.where("kind <> 'related'").select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct(), ["a", "b"], "left_semi"), texts, m, concepts, key)
    r = r.join(ok.toDF("lo", "hi"), ["lo", "hi"], "left_semi").join(d.toDF("lo", "hi", "first", "second"), ["lo", "hi"], "left")
    src = F.when(F.col("kind") == "prereq", F.col("second")).when(F.col("kind") == "unlock", F.col("first")).otherwise(F.col("lo"))
    dst = F.when(F.col("kind") == "prereq", F.col("first")).when(F.col("kind") == "unlock", F.col("second")).otherwise(F.col("hi"))
    etype = F.when(F.col("kind") == "prereq", "REQUIRES").when(F.col("kind") == "unlock", "UNLOCKS").otherwise("RELATED")
    e = r.groupBy(src.alias("src"), dst.alias("dst"), etype.alias("edge_type")).agg(F.min_by(F.struct("relation", "source"), F.struct("rec_id", "pos", "relation")).alias("r"))
    return e.select("src", "dst", "edge_type", "r.relation", "r.source")
