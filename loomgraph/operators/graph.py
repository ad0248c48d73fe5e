"""Building, auditing, traversing and versioning the concept graph (GRF-*, TRV-*, REL-12..14, EVL-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import canonical_name, concept_key
from ..functions.text import difficulty_rank, slug
from ..session import discard, hot_join, is_empty, materialize
from .filters import references

SUMMARY_CHARS = 500
# The edge type of each relation.
EDGE_TYPES = {"requires": "REQUIRES", "enables": "UNLOCKS", "uses": "RELATED", "extends": "RELATED", "part_of": "RELATED", "contrasts_with": "RELATED", "evaluated_by": "RELATED", "variant_of": "RELATED", "co_mention": "RELATED"}
MATH_NAME = r"(?i)\b(algebra|calculus|matrix|matrices|vector|eigenvalues?|probability|statistics|derivatives?|gradient|integral|theorem|determinant|norm|lattice|manifold|tensor)\b"


def concept_id(name: Column) -> Column:
    return slug(canonical_name(name))


def nodes(records: DataFrame) -> DataFrame:
    """GRF-1: one concept per id; the first record's name, type, difficulty and summary (at most SUMMARY_CHARS characters)."""
    r = records.where("trim(coalesce(concept_name, '')) <> ''").withColumn("id", concept_id(F.col("concept_name")))
    first = r.groupBy("id").agg(F.min_by(F.struct(canonical_name(F.col("concept_name")).alias("name"), "concept_type", "difficulty", F.substring(F.coalesce("summary", F.lit("")), 1, SUMMARY_CHARS).alias("summary")), "rec_id").alias("r"))
    return first.select("id", "r.*")


def edges(records: DataFrame) -> DataFrame:
    """GRF-1, JON-2 and SET-2: (src, dst, edge_type, relation, source): references whose target was extracted, without self edges.

    One edge per pair and type (RELATED in either direction once, from the lesser id); the first record and position keeps its relation
    and provenance (stated, else the record's chunk).
    """
    refs = references(records).where("trim(coalesce(target, '')) <> '' and trim(coalesce(concept_name, '')) <> ''")
    own = records.select("rec_id", "relation_provenance", F.concat_ws(":", F.coalesce("doc_id", F.lit("")), F.coalesce("chunk_id", F.lit(""))).alias("own"))
    r = refs.join(own, "rec_id").select(
        "rec_id", "kind", "pos", "relation", concept_id(F.col("concept_name")).alias("a"), concept_id(F.col("target")).alias("b"),
        F.coalesce(F.try_element_at("relation_provenance", F.concat("kind", F.lit(":"), F.lower("target"))), "own").alias("source"),
    ).where("a <> b")
    known = r.select("b").distinct().join(records.select(concept_id(F.col("concept_name")).alias("b")).distinct(), "b", "left_semi")
    r = r.join(known, "b", "left_semi")
    etype = F.when(F.col("kind") == "prereq", "REQUIRES").when(F.col("kind") == "unlock", "UNLOCKS").otherwise("RELATED")
    both = F.col("kind") == "related"
    r = r.select(
        F.when(both, F.least("a", "b")).otherwise(F.col("a")).alias("src"), F.when(both, F.greatest("a", "b")).otherwise(F.col("b")).alias("dst"), etype.alias("edge_type"), "relation", "source", "rec_id", "pos",
    )
    first = r.groupBy("src", "dst", "edge_type").agg(F.min_by(F.struct("relation", "source"), F.struct("rec_id", "pos", "relation", "source")).alias("r"))
    return first.select("src", "dst", "edge_type", "r.relation", "r.source")


def unknown_targets(records: DataFrame) -> DataFrame:
    """JON-3: (target, n): references to concepts nobody extracted."""
    refs = references(records).where("trim(coalesce(target, '')) <> ''").select(concept_id(F.col("target")).alias("id"))
    known = records.where("trim(coalesce(concept_name, '')) <> ''").select(concept_id(F.col("concept_name")).alias("id")).distinct()
    return refs.join(known, "id", "left_anti").groupBy(F.col("id").alias("target")).agg(F.count(F.lit(1)).alias("n"))


def learn_arcs(e: DataFrame) -> DataFrame:
    """Arcs in the order of learning: (before, after) from A REQUIRES B as B, A and from A UNLOCKS B as A, B."""
    r = e.where("edge_type = 'REQUIRES'").select(F.col("dst").alias("before"), F.col("src").alias("after"))
    return r.unionByName(e.where("edge_type = 'UNLOCKS'").select(F.col("src").alias("before"), F.col("dst").alias("after"))).distinct()


def orphans(n: DataFrame, e: DataFrame) -> DataFrame:
    """JON-12 and AGG-11: concepts without any edge."""
    ends = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    return n.join(ends, "id", "left_anti").select("id")


def degrees(e: DataFrame) -> DataFrame:
    """AGG-5: (id, degree) over edges of all types, both ends."""
    return e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def k_hops(arcs: DataFrame, k: int) -> DataFrame:
    """TRV-1 and JON-14: (a, b, depth): everything within k steps of every vertex, with the least depth; k unrolled joins, each made distinct."""
    step = arcs.toDF("a", "b").where("a <> b").distinct()
    reach = frontier = step.withColumn("depth", F.lit(1))
    for d in range(2, k + 1):
        nxt = frontier.select("a", F.col("b").alias("m")).join(step.select(F.col("a").alias("m"), "b"), "m").where("a <> b").select("a", "b").distinct()
        frontier = nxt.join(reach, ["a", "b"], "left_anti").withColumn("depth", F.lit(d))
        reach = reach.unionByName(frontier)
    return reach


PIECE = 256
CHAIN_SALTS = 8


def chains(arcs: DataFrame, max_hops: int = 3) -> DataFrame:
    """TRV-2: (start, path, hops): simple paths of at most `max_hops` steps that can't be made longer within that; ids joined with `>`.

    Paths are never shuffled with their last two steps: the last one waits as pieces of at most about PIECE successors at the step before it, and is unrolled
    where the row is returned. A path of h steps ends early only at a vertex of at most h successors, so these few decide it and no longer path is made for that.
    """
    step = materialize(arcs.toDF("a", "b").where("a <> b").distinct(), "steps")
    spark = step.sparkSession
    degree = step.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    few = step.join(degree.where(F.col("n") < max_hops), "a").groupBy("a").agg(F.collect_list("b").alias("to"))  # fewer than `max_hops`
    ends = step.join(degree.where(F.col("n") >= max_hops).select(F.col("a").alias("b")), "b", "left_anti").select("a", "b")
    ends = ends.join(few.withColumnRenamed("a", "b"), "b", "left").select(F.col("a").alias("last"), F.col("b").alias("n"), F.coalesce("to", F.array().cast("array<string>")).alias("to"))
    out, cur = [], None
    for h in range(1, max_hops):
        if cur is None:
            done = ends.select(F.col("last").alias("a"), F.array("last", "n").alias("p"), "to")
        else:
            done = cur.join(ends, "last").where(~F.array_contains("p", F.col("n"))).select("a", F.array_append("p", F.col("n")).alias("p"), "to")
        out.append(done.where(F.size(F.array_except("to", "p")) == 0).select(F.col("a").alias("start"), F.array_join("p", ">").alias("path"), F.lit(h).alias("hops")))
        if h < max_hops - 1:
            nxt = None if cur is None else cur.join(step.select(F.col("a").alias("last"), F.col("b").alias("n")), "last").where(~F.array_contains("p", F.col("n")))
            cur = step.select("a", F.array("a", "b").alias("p"), F.col("b").alias("last")) if nxt is None else nxt.select("a", F.array_append("p", F.col("n")).alias("p"), F.col("n").alias("last"))
    if max_hops == 1:
        return step.select(F.col("a").alias("start"), F.concat_ws(">", "a", "b").alias("path"), F.lit(1).alias("hops"))
    pieces = step.join(degree, "a").groupBy(F.col("a").alias("c"), F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PIECE)).alias("k")).agg(F.collect_list("b").alias("ds")).drop("k")
    # few rows make many paths, so they are spread over all tasks by number, and the step before a hub by parts
    tasks = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rest = step.select(F.col("a").alias("last"), F.col("b").alias("c"))
    if cur is None:  # nothing follows the join, so it is what is spread
        rest, pieces = rest.repartition(tasks, "c"), pieces.repartition(tasks, "c")
    rest = rest.join(pieces, "c").select("last", "c", F.array_remove("ds", F.col("last")).alias("ds")).where("size(ds) > 0")
    if cur is None:
        last = rest.select(F.col("last").alias("start"), F.array("last").alias("p"), F.concat_ws(">", "last", "c").alias("path"), "ds")
    else:
        rest = rest.withColumn("s", F.pmod(F.xxhash64("c"), F.lit(CHAIN_SALTS)).cast("int")).repartition(tasks, "last", "s")
        cur = cur.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(CHAIN_SALTS - 1)))).repartition(tasks, "last", "s")
        last = rest.join(cur, ["last", "s"]).where(~F.array_contains("p", F.col("c"))).select(F.col("a").alias("start"), "p", F.concat_ws(">", F.array_join("p", ">"), "c").alias("path"), "ds")
    last = last.select("start", "p", "path", F.explode("ds").alias("d")).where(~F.array_contains("p", F.col("d")))
    out.append(last.select("start", F.concat("path", F.lit(">"), "d").alias("path"), F.lit(max_hops).alias("hops")))
    return reduce(DataFrame.unionByName, out)


def first_chains(arcs: DataFrame) -> DataFrame:
    """TRV-2 for TRV-3: of the chains of three hops those that can be among the first three of their start by path, and all shorter ones: (start, path, hops).

    Nothing that can matter is left out: behind a start and its next vertex the order of paths is that of their last two vertices. Behind c at most four d
    are needed, as only the start is not known yet; and of the c behind b, each with two d or more leaves a path to any start but c itself, so no path behind
    the fourth such second path is ever among three.
    """
    step = materialize(arcs.toDF("a", "b").where("a <> b").distinct(), "steps")
    degree = step.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    few = step.join(degree.where("n <= 2"), "a").groupBy("a").agg(F.collect_set("b").alias("to"))  # two at most
    ends = step.select(F.col("b").alias("v")).unionByName(step.select(F.col("a").alias("v"))).distinct()
    stops = materialize(ends.join(degree.where("n > 2"), F.col("v") == F.col("a"), "left_anti").join(few, F.col("v") == F.col("a"), "left").select("v", F.coalesce("to", F.array().cast("array<string>")).alias("to")), "stops")
    one = step.join(stops, F.col("b") == F.col("v")).where(F.size(F.array_except("to", F.array("a", "b"))) == 0).select(F.col("a").alias("start"), F.array("a", "b").alias("p"), F.lit(1).alias("hops"))
    two = step.join(stops, F.col("b") == F.col("v")).select(F.col("a").alias("m"), F.col("b").alias("c"), "to").join(step.select("a", F.col("b").alias("m")), "m").where("a <> c")
    two = two.where(F.size(F.array_except("to", F.array("a", "m", "c"))) == 0).select(F.col("a").alias("start"), F.array("a", "m", "c").alias("p"), F.lit(2).alias("hops"))

    # of each step its first successors: one of five may be the b before it and is left out below, so four stay
    w = Window.partitionBy("a").orderBy("b")
    heads = step.withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("ds"))
    rest = step.join(heads.select(F.col("a").alias("b"), "ds"), "b").select("a", F.col("b").alias("c"), F.slice(F.array_except("ds", F.array("a")), 1, 4).alias("ds")).where("size(ds) > 0")
    rest = rest.withColumn("tails", F.transform("ds", lambda d: F.concat("c", F.lit(">"), d)))
    bound = rest.where("size(ds) > 1").withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.element_at("tails", 2)))).where("r = 4").select("a", F.element_at("tails", 2).alias("most"))
    rest = rest.join(bound, "a", "left").select(F.col("a").alias("b"), "c", F.explode("ds").alias("d"), "most")
    rest = materialize(rest.where(F.col("most").isNull() | (F.concat("c", F.lit(">"), "d") <= F.col("most"))).drop("most"), "tails")
    three = step.join(rest, "b").where("a <> c and a <> d").select(F.col("a").alias("start"), F.array("a", "b", "c", "d").alias("p"), F.lit(3).alias("hops"))
    return one.unionByName(two).unionByName(three).select("start", F.array_join("p", ">").alias("path"), "hops")


def connected_components(e: DataFrame) -> DataFrame:
    """TRV-4: (id, component): each vertex with the least id of its component; labels spread and are followed two steps a round, every round a
    written table, of which only the last is kept. Hubs are split: a vertex's arcs meet its label in parts."""
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    counts = materialize(both.groupBy(F.col("b")).agg(F.count(F.lit(1)).alias("n")), "cc-degrees")
    rows = both.count()
    label = last = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).withColumnRenamed("a", "id"), "cc")
    while True:
        near = hot_join(both, label.select(F.col("id").alias("b"), "l"), ["b"], "a", counts, rows).groupBy(F.col("a").alias("id")).agg(F.min("l").alias("n"))
        new = label.join(near, "id").select("id", "l", F.least("l", "n").alias("m"))
        jump = label.select(F.col("id").alias("m"), F.col("l").alias("j"))
        new = materialize(new.join(jump, "m", "left").select("id", F.least("m", F.coalesce("j", "m")).alias("l"), (F.least("m", F.coalesce("j", "m")) != F.col("l")).alias("moved")), "cc")
        discard(last)
        label, last = new.select("id", "l"), new
        if is_empty(new.where("moved")):
            discard(both, counts)
            return label.select("id", F.col("l").alias("component"))


def cyclic_core(arcs: DataFrame) -> DataFrame:
    """TRV-4: the arcs on or between cycles: arcs from vertices without a way in or to ones without a way out are trimmed until none is left."""
    cur = materialize(arcs.toDF("a", "b").distinct(), "core")
    n = cur.count()
    while n:
        heads, tails = cur.select(F.col("b").alias("a")).distinct(), cur.select(F.col("a").alias("b")).distinct()
        last, cur = cur, materialize(cur.join(heads, "a", "left_semi").join(tails, "b", "left_semi").select("a", "b"), "core")
        m = cur.count()
        discard(last)
        if m == n:
            break
        n = m
    return cur


def strong_components(arcs: DataFrame) -> DataFrame:
    """(id, scc): the strong component of every vertex of a cyclic core (a, b), by colouring: in each round the least id that reaches a vertex spreads
    forward as its colour; inside a colour, what reaches the colour's own vertex backwards is one strong component and leaves; the rest goes on.

    Every step is a join over arcs and every round a written table, so no component is ever held by one task.
    """
    left = materialize(arcs.toDF("a", "b").where("a <> b").distinct(), "scc-arcs")
    out = None
    while left.count():
        colour = last = materialize(left.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("c", F.col("id")), "scc-colour")
        while True:
            got = left.join(colour.select(F.col("id").alias("a"), "c"), "a").groupBy(F.col("b").alias("id")).agg(F.min("c").alias("m"))
            new = materialize(colour.join(got, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") < F.col("c")).alias("moved")), "scc-colour")
            discard(last)
            colour, last = new.select("id", "c"), new
            if is_empty(new.where("moved")):
                break
        inside = materialize(left.join(colour.toDF("a", "ca"), "a").join(colour.toDF("b", "cb"), "b").where("ca = cb").select("a", "b", F.col("ca").alias("c")), "scc-inside")
        member = front = materialize(colour.where("id = c").select("id", "c"), "scc-member")
        while not is_empty(front):
            back = inside.join(front.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id"), "c").distinct()
            front = materialize(back.join(member, ["id", "c"], "left_anti"), "scc-front")
            member = materialize(member.unionByName(front), "scc-member")
        out = member if out is None else out.unionByName(member)
        last = left
        left = materialize(left.join(member.select(F.col("id").alias("a")), "a", "left_anti").join(member.select(F.col("id").alias("b")), "b", "left_anti"), "scc-arcs")
        discard(last, inside)
    return out.select("id", F.col("c").alias("scc")) if out is not None else left.select(F.col("a").alias("id"), F.col("b").alias("scc"))


def closing_arcs(a: list[int], b: list[int], level: list[int]) -> list[int]:
    """The places of the arcs a[i] -> b[i] that would close a cycle with the arcs kept before them; those that go up a level come first and are kept.

    The vertices are held in an order that all kept arcs follow, at first that of the levels: an arc along it closes no cycle. One against it is searched for
    from both ends, only between its ends in that order, the end with less work first; if one side runs out before they meet, its vertices move past the
    other end. The order is a linked list with numbers that leave gaps, numbered anew where a gap is used up.
    """
    n = len(level)
    line = sorted(range(n), key=level.__getitem__)
    # n stands before the first and after the last vertex
    after_it, before_it = [n] * (n + 1), [n] * (n + 1)
    for v, w in zip([n, *line], [*line, n]):
        after_it[v], before_it[w] = w, v
    mark = [0] * (n + 1)

    def number() -> None:
        v, k = after_it[n], 1
        while v != n:
            mark[v] = k << 32
            v, k = after_it[v], k + 1

    def move(vs: list[int], left: int) -> None:
        """Puts vs, in their order, behind `left`, which is none of them."""
        for v in sorted(vs, key=mark.__getitem__):
            p, q = before_it[v], after_it[v]
            after_it[p], before_it[q] = q, p
            q = after_it[left]
            after_it[left], before_it[v], after_it[v], before_it[q] = v, left, q, v
            low, high = (mark[left] if left != n else 0), (mark[q] if q != n else mark[left] + (1 << 33))
            mark[v] = (low + high) // 2
            if not low < mark[v] < high:
                # those still to come keep their order among themselves, as they do in the list
                number()
            left = v

    number()
    after, before = [[] for _ in range(n)], [[] for _ in range(n)]
    out = []
    for i, (x, y) in enumerate(zip(a, b)):
        low, high = mark[y], mark[x]
        if low <= high:
            ahead, behind = {y}, {x}
            front, back = [y], [x]
            f = g = work_f = work_g = 0
            met = x == y
            while not met and f < len(front) and g < len(back):
                if work_f <= work_g:
                    near = after[front[f]]
                    f, work_f = f + 1, work_f + len(near) + 1
                    met = not behind.isdisjoint(near)
                    new = [v for v in near if mark[v] < high and v not in ahead]
                    ahead.update(new)
                    front += new
                else:
                    near = before[back[g]]
                    g, work_g = g + 1, work_g + len(near) + 1
                    met = not ahead.isdisjoint(near)
                    new = [v for v in near if mark[v] > low and v not in behind]
                    behind.update(new)
                    back += new
            if met:
                out.append(i)
                continue
            if f == len(front):
                move(front, x)
            else:
                move(back, before_it[y])
        after[x].append(y)
        before[y].append(x)
    return out


def break_cycles(arcs: DataFrame, levels: DataFrame) -> DataFrame:
    """REL-12 and GRF-4: (a, b) of the arcs to drop so that no cycle is left: only arcs inside a strong component can close one.

    Arcs are taken in order of how well they fit (difficulty of b above a, then shorter names, then ids), and one that would close a cycle is dropped.
    Arcs that go up in difficulty can't close a cycle among themselves, so they are taken without a search. The order is a fold, so it runs per
    strong component; all else is done by joins. The fold's memory grows with the arcs of one strong component, about 200 bytes each.
    """
    import numpy as np
    import pandas as pd

    core = cyclic_core(arcs)
    comp = strong_components(core)
    lv = levels.select("id", F.coalesce(difficulty_rank(F.col("difficulty")), F.lit(2)).alias("r"))
    c = core.join(comp.select(F.col("id").alias("a"), F.col("scc").alias("component")), "a").join(comp.select(F.col("id").alias("b"), F.col("scc").alias("other")), "b").where("component = other")
    c = c.join(lv.select(F.col("id").alias("a"), F.col("r").alias("ra")), "a", "left").join(lv.select(F.col("id").alias("b"), F.col("r").alias("rb")), "b", "left")
    c = c.withColumn("ra", F.coalesce("ra", F.lit(2))).select("a", "b", "component", "ra", (F.coalesce("rb", F.lit(2)) - F.col("ra")).alias("gap"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, code = np.unique(np.concatenate([pdf.a.to_numpy(object), pdf.b.to_numpy(object)]), return_inverse=True)
        size = np.array([len(x) for x in ids])
        a, b, gap = code[: len(pdf)], code[len(pdf) :], pdf.gap.to_numpy()
        # ids are numbered in their order, so their numbers break ties as they do
        o = np.lexsort((b, a, size[b], size[a], -gap))
        level = np.zeros(len(ids), np.int64)
        level[a], level[b] = pdf.ra, pdf.ra + gap
        dropped = o[closing_arcs(a[o].tolist(), b[o].tolist(), level.tolist())]
        return pd.DataFrame({"a": ids[a[dropped]], "b": ids[b[dropped]]}, columns=["a", "b"])

    return c.groupBy("component").applyInPandas(fold, "a string, b string")


def math_direction(e: DataFrame, n: DataFrame) -> DataFrame:
    """REL-13 and REL-14: UNLOCKS edges from an advanced concept to a mathematical one are turned round."""
    d = n.select("id", "name", "difficulty")
    j = e.join(d.select(F.col("id").alias("src"), F.col("difficulty").alias("sd"), F.col("name").alias("sn")), "src").join(d.select(F.col("id").alias("dst"), F.col("name").alias("dn")), "dst")
    turn = (F.col("edge_type") == "UNLOCKS") & F.col("sd").isin("advanced", "expert") & F.col("dn").rlike(MATH_NAME) & ~F.col("sn").rlike(MATH_NAME)
    return j.select(F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst"), "edge_type", turn.alias("turned"))


def belongs_to(source: Column, doc: Column) -> Column:
    """GRF-9 and JON-15: a provenance `document:chunk` is the document's own, by path or by file name."""
    head = F.substring_index(source, ":", 1)
    return (head == doc) | (F.substring_index(head, "/", -1) == F.substring_index(doc, "/", -1))


def delete_document(n: DataFrame, e: DataFrame, mentions: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """GRF-8: (concepts, edges) of the next snapshot without a document: its edges and mentions go, then concepts with neither."""
    d = F.lit(doc)
    left = e.where(~F.coalesce(belongs_to(F.col("source"), d), F.lit(False)))
    said = mentions.where(F.col("doc_id").isNull() | (F.col("doc_id") != d)).select("id").distinct()
    ends = left.select(F.col("src").alias("id")).unionByName(left.select(F.col("dst").alias("id"))).distinct()
    kept = n.join(said.unionByName(ends).distinct(), "id", "left_semi")
    return kept, left


def diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """GRF-13 and JON-17: (key, status): added, deleted, modified or same by the given fields."""
    o = old.select(key, F.struct(*fields).alias("__o"))
    w = new.select(key, F.struct(*fields).alias("__w"))
    return o.join(w, key, "full").select(key, F.when(F.col("__o").isNull(), "added").when(F.col("__w").isNull(), "deleted").when(~F.col("__o").eqNullSafe(F.col("__w")), "modified").otherwise("same").alias("status"))


def prune_orphans(n: DataFrame, e: DataFrame, threshold: float = 0.20) -> DataFrame:
    """GRF-7: concepts without edges go, but only if they are at least `threshold` of all."""
    o = orphans(n, e).withColumn("__o", F.lit(1))
    share = n.join(o, "id", "left").agg((F.count("__o") / F.count(F.lit(1))).alias("__s"))
    return n.join(o, "id", "left").crossJoin(F.broadcast(share)).where((F.col("__o").isNull()) | (F.col("__s") < threshold)).drop("__o", "__s")  # one row on the right


def compare_sets(mine: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """EVL-1, EVL-2 and SET-4: (tp, fp, fn, precision, recall, f1) of two sets of rows."""
    m, g = mine.select(*keys).distinct().withColumn("m", F.lit(1)), gold.select(*keys).distinct().withColumn("g", F.lit(1))
    c = m.join(g, keys, "full").agg(F.count_if(F.col("m").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("m").isNull()).alias("fn"))
    p = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(F.lit(2.0) * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    return c.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def direction_accuracy(mine: DataFrame, gold: DataFrame) -> DataFrame:
    """EVL-2: of the gold edges found in either direction, the share found in the right one."""
    g = gold.select("src", "dst").distinct()
    m = mine.select("src", "dst").distinct()
    right = g.join(m, ["src", "dst"], "left_semi").agg(F.count(F.lit(1)).alias("right"))
    turned = g.join(m.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").join(m, ["src", "dst"], "left_anti").agg(F.count(F.lit(1)).alias("turned"))
    return right.crossJoin(turned).select("right", "turned", F.round(F.coalesce(F.col("right") / F.nullif(F.col("right") + F.col("turned"), F.lit(0)), F.lit(0.0)), 6).alias("accuracy"))


def audit(n: DataFrame, e: DataFrame) -> DataFrame:
    """AGG-7: one row of counts: empty summaries, placeholder names, self edges by id or key, pairs that require each other, edges without provenance."""
    a = n.agg(F.count(F.lit(1)).alias("concepts"), F.count_if(F.trim("summary") == "").alias("empty_summaries"), F.count_if(F.col("id") == "concept").alias("placeholders"))
    names = n.select("id", concept_key(F.col("name")).alias("k"))
    j = e.join(names.select(F.col("id").alias("src"), F.col("k").alias("ks")), "src", "left").join(names.select(F.col("id").alias("dst"), F.col("k").alias("kd")), "dst", "left")
    b = j.agg(F.count(F.lit(1)).alias("edges"), F.count_if((F.col("src") == F.col("dst")) | (F.col("ks") == F.col("kd"))).alias("self_edges"), F.count_if(~F.coalesce(F.col("source").rlike("^[^:]+:[^:]+$"), F.lit(False))).alias("no_provenance"))
    r = e.where("edge_type = 'REQUIRES'").select("src", "dst")
    c = r.join(r.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").where("src < dst").agg(F.count(F.lit(1)).alias("mutual_requires"))
    return a.crossJoin(b).crossJoin(c)  # one row each


