"""Evidence with fallbacks, payloads in order, and texts made of them (CIT-7, CIT-17..19, CIT-21, TRV-3, LIB-10, LIB-13, TXT-2, TXT-3, EVL-6, SNK-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .evidence import best_citations
from .graph import compare_sets, direction_accuracy

# Words of questions that name no topic.
TOPIC_STOP = ("the", "and", "for", "what", "whats", "how", "does", "about", "tell", "explain", "before", "starting", "know", "need", "can", "you", "please", "learn", "want", "wanna", "with", "this", "that")
# How kinds of sources are called in lists of books.
KINDS = {"textbook": "textbook", "paper": "paper", "web_syllabus": "syllabus", "markdown": "notes"}
NO_CITATIONS = "No specific source citations found in the database.\n"
NONE = "None extracted"


def span(text: Column, start: Column, end: Column) -> Column:
    """CIT-7: the stretch of a text from offset `start` (from 0) to before `end` where both lie in it, else the whole text."""
    t = F.coalesce(text, F.lit(""))
    return F.when((start >= 0) & (start < end) & (end <= F.length(t)), F.substr(t, (start + 1).cast("int"), (end - start).cast("int"))).otherwise(t)


def concept_evidence(concepts: DataFrame, indexed: DataFrame, legacy: DataFrame) -> DataFrame:
    """CIT-17: (id, doc_id, chunk_id, origin): the passages that the index has for a concept; for one without any the best passage of the older lookup."""
    have = concepts.select("id").join(indexed.select("id", "doc_id", "chunk_id").distinct(), "id").withColumn("origin", F.lit("index"))
    rest = concepts.select("id").join(indexed.select("id").distinct(), "id", "left_anti")
    return have.unionByName(best_citations(legacy.join(rest, "id", "left_semi"), 1).select("id", "doc_id", "chunk_id").withColumn("origin", F.lit("legacy")))


def prerequisite_evidence(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """CIT-18: (target, prereq, orientation, source): the provenance of an edge from target to prerequisite, else of one the other way round; pairs with
    neither have no row. Of several edges of a pair the strongest type counts."""
    rank = F.when(F.col("edge_type") == "REQUIRES", 1).when(F.col("edge_type") == "UNLOCKS", 2).otherwise(3)
    one = edges.where("source is not null").groupBy("src", "dst").agg(F.min_by("source", F.struct(rank, F.col("source"))).alias("source"))
    ways = [one.select(F.col("src").alias("target"), F.col("dst").alias("prereq"), F.lit("forward").alias("orientation"), "source"), one.select(F.col("dst").alias("target"), F.col("src").alias("prereq"), F.lit("turned").alias("orientation"), "source")]
    both = pairs.select("target", "prereq").distinct().join(ways[0].unionByName(ways[1]), ["target", "prereq"])
    return both.groupBy("target", "prereq").agg(F.min(F.struct("orientation", "source")).alias("r")).select("target", "prereq", "r.*")


def payloads(nodes: DataFrame, edges: DataFrame, best: DataFrame, texts: DataFrame, per: int = 4) -> DataFrame:
    """CIT-19: (target, evidence_no, id, topic, doc_id, chunk_id, text_span): the evidence of each concept and then of its prerequisites and unlocks (at most
    `per` of each, by name), numbered in that order; `best`: id, doc_id, chunk_id, rank; `texts`: doc_id, chunk_id, text, start, end."""
    names = nodes.select("id", "name")
    w = Window.partitionBy("src", "edge_type").orderBy("name", "dst")
    near = edges.where("edge_type in ('REQUIRES', 'UNLOCKS')").join(names.select(F.col("id").alias("dst"), "name"), "dst").withColumn("r", F.row_number().over(w)).where(F.col("r") <= per)
    role = F.when(F.col("edge_type") == "REQUIRES", 1).otherwise(2)
    items = names.select(F.col("id").alias("target"), "id", "name", F.lit(0).alias("role"), F.lit(0).alias("r")).unionByName(near.select(F.col("src").alias("target"), F.col("dst").alias("id"), "name", role.alias("role"), "r"))
    # a concept that is named twice keeps its first place
    items = items.groupBy("target", "id").agg(F.min(F.struct("role", "r", "name")).alias("x")).select("target", "id", "x.*")
    j = items.join(best.select("id", "doc_id", "chunk_id", "rank"), "id").join(texts, ["doc_id", "chunk_id"])
    order = Window.partitionBy("target").orderBy("role", "r", "id", "rank", "doc_id", "chunk_id")  # at most 2 x per + 1 concepts
    return j.select("target", F.row_number().over(order).alias("evidence_no"), "id", F.col("name").alias("topic"), "doc_id", "chunk_id", span(F.col("text"), F.col("start"), F.col("end")).alias("text_span"))


def narrative(nodes: DataFrame, edges: DataFrame, best: DataFrame, most: int = 3, per: int = 4) -> DataFrame:
    """CIT-21: (id, recipe): prerequisites with their summaries, the concept, what it unlocks (at most `per` of each, by name), and its best `most` citations."""
    info = nodes.select("id", "name", F.coalesce("summary", F.lit("")).alias("summary"))

    def side(kind: str, out: str, line: Column, glue: str) -> DataFrame:
        w = Window.partitionBy("src").orderBy("name", "dst")
        x = edges.where(F.col("edge_type") == kind).join(info.select(F.col("id").alias("dst"), "name", "summary"), "dst").withColumn("r", F.row_number().over(w)).where(F.col("r") <= per)
        return x.groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))), lambda y: y["l"]), glue).alias(out))  # `per` at most

    pre = side("REQUIRES", "pre", F.concat(F.lit("   - "), "name", F.lit(": "), "summary"), "\n")
    un = side("UNLOCKS", "un", F.col("name"), ", ")
    c = best.where(F.col("rank") <= most)
    text = F.format_string(
        "Citation %d:\n- Document: %s (Page: %s, Section: %s)\n- Text Passage: \"%s\"\n", F.col("rank"), F.col("doc_id"), F.coalesce(F.col("page_number").cast("string"), F.lit("")), F.coalesce("section_title", F.lit("")), strip(F.coalesce("text", F.lit("")))
    )
    cites = c.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("l")))), lambda y: y["l"]), "\n").alias("cites"))  # `most` at most
    j = info.join(pre, "id", "left").join(un, "id", "left").join(cites, "id", "left")
    recipe = F.concat(
        F.lit("1. Upstream Prerequisites:\n"), F.coalesce("pre", F.lit("   - " + NONE)), F.lit("\n2. Target Concept:\n   - "), F.col("name"), F.lit(": "), F.col("summary"),
        F.lit("\n3. Downstream Applications (Unlocks):\n   - "), F.coalesce("un", F.lit(NONE)), F.lit("\nTEXTUAL CITATIONS:\n"), F.coalesce("cites", F.lit(NO_CITATIONS)),
    )
    return j.select("id", recipe.alias("recipe"))


def path_section(paths: DataFrame) -> DataFrame:
    """TRV-3: (start, section): the learning paths of a concept as text: its three longest of two hops or more, else the first two of one hop."""
    multi = F.col("hops") >= 2
    w = Window.partitionBy("start").orderBy(F.desc("hops"), "path")
    x = paths.withColumn("any", F.max(multi).over(Window.partitionBy("start"))).where(~F.col("any") | multi).withColumn("r", F.row_number().over(w))
    x = x.where(F.col("r") <= F.when(F.col("any"), 3).otherwise(2))
    line = F.concat(F.col("r").cast("string"), F.lit(". "), F.replace("path", F.lit(">"), F.lit(" → ")), F.when(F.col("any"), F.concat(F.lit("\n   _"), F.col("hops").cast("string"), F.lit(" hops_"))).otherwise(""))
    head = F.when(F.max("any"), "**Multi-hop curriculum path:**").otherwise("**Learning path (from graph prerequisites):**")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))), lambda y: y["l"])  # three at most
    return x.groupBy("start").agg(F.concat(head, F.lit("\n"), F.array_join(lines, "\n")).alias("section"))


def topic_words(q: Column) -> Column:
    """The words of a question that may name a topic, and their singulars; each once."""
    ws = F.filter(F.regexp_extract_all(F.lower(F.coalesce(q, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: F.length(w) >= 3)
    one = F.transform(F.filter(ws, lambda w: w.endswith("s") & (F.length(w) >= 4)), lambda w: F.substr(w, F.lit(1), F.length(w) - 1))
    return F.array_except(F.array_distinct(F.concat(ws, one)), F.array(*[F.lit(w) for w in TOPIC_STOP]))


def related_concepts(questions: DataFrame, concepts: DataFrame) -> DataFrame:
    """LIB-10: (q, id): the concepts (id, label, aliases) of which the id, the label or an alias holds a topic word of the question, also inside a word.

    No loop over words and names: every stretch of a name that is as long as some topic word meets the words in an equi-join.
    """
    q = questions.select("q").distinct().select("q", F.explode(topic_words(F.col("q"))).alias("w"))
    wanted = q.select("w").distinct()
    names = concepts.select("id", F.explode(F.array_distinct(F.transform(F.filter(F.concat(F.array("id", "label"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull()), F.lower))).alias("n"))
    lengths = F.broadcast(wanted.agg(F.array_sort(F.collect_set(F.length("w"))).alias("ls")))  # one row: the different lengths of words
    cut = names.crossJoin(lengths).select(
        "id", F.explode(F.flatten(F.transform("ls", lambda k: F.when(F.length("n") >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.length("n") - k + 1, F.lit(1))), lambda i: F.substr(F.col("n"), i, k))).otherwise(F.array().cast("array<string>"))))).alias("w")
    ).distinct()
    return q.join(cut.join(wanted, "w", "left_semi"), "w").select("q", "id").distinct()


def not_indexed(questions: DataFrame, related: DataFrame, closest: DataFrame, most: int = 3) -> DataFrame:
    """TXT-2: (q, reply): what to say of a topic that isn't there: the related concepts if there are any, else the closest ones, at most `most` by name;
    `closest`: (q, id, rank)."""
    w = Window.partitionBy("q").orderBy("id")
    rel = related.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).withColumn("kind", F.lit(1))
    near = closest.select("q", "id", F.col("rank").alias("r")).where(F.col("r") <= most).join(related.select("q").distinct(), "q", "left_anti").withColumn("kind", F.lit(2))
    names = rel.unionByName(near).groupBy("q", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda y: y["id"]), ", ").alias("names"))  # `most` at most
    j = questions.select("q").distinct().join(names, "q", "left")
    tail = F.when(F.col("kind") == 1, F.concat(F.lit(" Related topics that are covered: "), "names", F.lit("."))).when(F.col("kind") == 2, F.concat(F.lit(" The closest topics are: "), "names", F.lit("."))).otherwise("")
    return j.select("q", F.concat(F.lit("This topic isn't covered by the indexed library."), tail).alias("reply"))


def rendered_books(books: DataFrame, topic: str, title: str, kind: str, doc: str, mentions: str) -> DataFrame:
    """LIB-13: (topic, listing): the books of each topic as a list, in the order of their mentions, then by document; ten at most."""
    w = Window.partitionBy(topic).orderBy(F.desc(mentions), doc)
    k = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    name = F.coalesce(F.try_element_at(k, F.col(kind)), F.nullif(F.col(kind), F.lit("")), F.lit("source"))
    b = books.withColumn("r", F.row_number().over(w)).where("r <= 10")
    line = F.concat(F.col("r").cast("string"), F.lit(". **"), F.coalesce(title, doc), F.lit("** _"), name, F.lit("_ (`"), F.col(doc), F.lit("`)\n   - Mentions: "), F.col(mentions).cast("string"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))), lambda y: y["l"])  # ten at most
    return b.groupBy(topic).agg(F.concat(F.lit("Recommended reading for: **"), F.col(topic), F.lit("**\n"), F.array_join(lines, "\n")).alias("listing"))


def gold_report(mine_names: DataFrame, gold_names: DataFrame, mine_edges: DataFrame, gold_edges: DataFrame) -> DataFrame:
    """EVL-6: (measure, value) of a graph against a gold graph: names, directed and undirected edges, and the direction of those found."""
    turn = lambda e: e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    parts = {
        "concepts": compare_sets(mine_names.toDF("key"), gold_names.toDF("key"), ["key"]), "edges": compare_sets(mine_edges, gold_edges, ["src", "dst"]), "links": compare_sets(turn(mine_edges), turn(gold_edges), ["src", "dst"]),
    }
    out = None
    for name, df in parts.items():
        x = df.select(F.explode(F.array(*[F.struct(F.lit(f"{name}_{m}").alias("measure"), F.col(m).cast("double").alias("value")) for m in ("tp", "fp", "fn", "precision", "recall", "f1")])).alias("x")).select("x.*")
        out = x if out is None else out.unionByName(x)
    return out.unionByName(direction_accuracy(mine_edges, gold_edges).select(F.lit("direction_accuracy").alias("measure"), F.col("accuracy").cast("double").alias("value")))


def full_export(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """SNK-3: (id, line): one JSON line per concept with its sources (id, doc_id, chunk_id) and outgoing edges, both in order. A concept's lists are what the format holds."""
    src = sources.select("id", "doc_id", "chunk_id").distinct().groupBy("id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "chunk_id"))).alias("sources"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dst", "edge_type", "relation"))).alias("edges"))
    j = nodes.join(src, "id", "left").join(out, "id", "left")
    return j.select("id", F.to_json(F.struct("id", "name", "concept_type", "difficulty", "summary", F.coalesce("sources", F.array().cast("array<struct<doc_id:string,chunk_id:string>>")).alias("sources"), F.coalesce("edges", F.array().cast("array<struct<dst:string,edge_type:string,relation:string>>")).alias("edges"))).alias("line"))
