"""Routes, snapshots over time, evidence, nested rows, strong components and binary documents on small inputs."""

import io
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import queries as U
from loomgraph.functions.fuzzy import partial_ratio, ratio
from loomgraph.operators import answers, dataset, graph, lifecycle, ranking, relations, routing, rows
from loomgraph.sources import files, office


def ask(spark, qs, f):
    d = spark.createDataFrame(list(enumerate(qs)), "i int, q string")
    return [r.v for r in d.select("i", f(F.col("q")).alias("v")).orderBy("i").collect()]


def test_predicates(spark):
    assert ask(spark, ["i wanna learn ML", "I want to learn about stars", "machine learning roadmap", "who are you", None, ""], routing.is_onboarding) == [True, False, True, False, False, False]
    assert ask(spark, ["what he said", "is ai hard", "explain attention", None], routing.has_domain_terms) == [False, True, True, False]
    assert ask(spark, ["what is the weather", "train a model", "hello"], routing.is_domain_query) == [False, True, False]
    assert ask(spark, ["hi, well what is attention", "good morning", None], routing.without_small_talk) == ["what is attention", "", ""]
    assert ask(spark, ["explain LoRA using gen z slang", "eli5"], routing.without_style) == ["explain LoRA", "eli5"]
    assert ask(spark, ["AI agents", "rags", "soup"], routing.expand)[2] == "soup" and "autonomous agents" in ask(spark, ["AI agents"], routing.expand)[0]


def test_intents_and_routes(spark):
    qs = ["write python code for attention", "define the covariance matrix", "write a poem on attention", "what is a matrix", "plot of the matrix movie"]
    d = spark.createDataFrame([(q, "out_of_domain") for q in qs], "q string, s string")
    got = {r.q: r.v for r in d.select("q", routing.structural_intent(F.col("q"), F.col("s")).alias("v")).collect()}
    assert [got[q] for q in qs] == ["implementation", "theory", "out_of_domain", "theory", "out_of_domain"]
    q = ["hello", "who are you", "i want to learn ai", "suggest books on attention", "which chapters discuss attention", "how to install docker", "what is the weather", "explain lora", "what is soup", "tell me about neural models", "look at my data", None]
    df = spark.createDataFrame(list(enumerate(q)), "id int, q string")
    named = spark.createDataFrame([(7,)], "id int")
    r = {x.id: x.route for x in routing.routes(df, named, "id", "q").collect()}
    assert [r[k] for k in range(11)] == ["general_chat", "identity", "onboarding", "library_books", "library_chapter_lookup", "out_of_scope", "out_of_scope", "graph_strong", "low_similarity_reject", "graph_soft", "out_of_scope"] and 11 in r
    assert routing.routes(df.limit(0), named, "id", "q").count() == 0


def test_library_words(spark):
    assert ask(spark, ["suggest some books on rag", "reading list for llm", "what should i read", "books are heavy"], lambda c: c.rlike(U.BOOKS)) == [True, True, True, False]
    assert ask(spark, ["sections in the book", "table of contents", "what are the chapters", "a chapter"], lambda c: c.rlike(U.CHAPTERS)) == [True, True, True, False]


def test_partial_ratio_equals_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, n))) for n in (9, 30))
        s, t = sorted((a, b), key=len)
        n = len(s)
        want = (100.0 if not t else 0.0) if not s else max(ratio(s, t[max(0, k) : k + n]) for k in range(1 - n, len(t)) if t[max(0, k) : k + n])
        assert abs(partial_ratio(a, b) - want) < 1e-9


def test_ranked_by_shared_words(spark):
    c = spark.createDataFrame([("rag", "Retrieval-Augmented Generation (RAG)", "finds documents", 3), ("cnn", "Convolution", "images", 1)], "id string, name string, summary string, degree int")
    r = ranking.rank_concepts(spark.createDataFrame([(1, "what is rags"), (2, "zzz")], "a int, b string"), c).collect()
    assert [(x.query_id, x.id) for x in r] == [(1, "rag")]


def test_mentions_equal_brute_force(spark):
    rng = random.Random(2)
    names = [("a", "Graph Search"), ("b", "Search"), ("c", "Very long name of a concept with more than six words in it"), ("d", None)]
    texts = [(i, " ".join(rng.choice(["graph", "search", "GRAPH-search", "very long name of a concept with more than six words in it", "research", "x"]) for _ in range(8))) for i in range(60)] + [(99, None), (100, "")]
    got = {tuple(r) for r in relations.mentions(spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame(names, "id string, name string"), ["k"]).collect()}
    al = {(r.id, r.alias) for r in relations.alias_table(spark.createDataFrame(names, "id string, name string")).collect()}
    want = {(k, i) for k, t in texts if t for i, a in al if f" {a} " in " " + " ".join("".join(ch if ch.isalnum() else " " for ch in t.lower()).split()) + " "}
    assert got == want and relations.mentions(spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame([], "id string, name string"), ["k"]).count() == 0


def reach(arcs, v):
    seen, todo = {v}, [v]
    while todo:
        x = todo.pop()
        for a, b in arcs:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_strong_components(spark):
    rng = random.Random(5)
    arcs = list({(f"v{rng.randrange(14):02d}", f"v{rng.randrange(14):02d}") for _ in range(22)})
    arcs = [(a, b) for a, b in arcs if a != b]
    core = [tuple(r) for r in graph.cyclic_core(spark.createDataFrame(arcs, "a string, b string")).collect()]
    got = {r.id: r.scc for r in graph.strong_components(spark.createDataFrame(core, "a string, b string")).collect()}
    vs = {x for a in core for x in a}
    assert set(got) == vs
    for x in vs:
        for y in vs:
            assert (got[x] == got[y]) == (y in reach(core, x) and x in reach(core, y))


def test_broken_cycles_leave_none(spark):
    rng = random.Random(7)
    arcs = [(a, b) for a, b in {(f"n{rng.randrange(12):02d}", f"n{rng.randrange(12):02d}") for _ in range(40)} if a != b]
    lv = spark.createDataFrame([(f"n{i:02d}", rng.choice(["foundational", "expert", None])) for i in range(12)], "id string, difficulty string")
    gone = {tuple(r) for r in graph.break_cycles(spark.createDataFrame(arcs, "a string, b string"), lv).collect()}
    left = [x for x in arcs if x not in gone]
    assert gone and all(a not in reach([x for x in left if x != (a, b)], b) for a, b in left)


def test_quotas_never_rank_a_whole_stratum(spark):
    d = spark.range(3000).select(F.col("id").alias("pair_id"))
    s = F.when(F.col("pair_id") < 2000, "hot").when(F.col("pair_id") < 2005, "few").otherwise("free")
    n = {r.stratum: r["count"] for r in dataset.balanced(d, s, {"hot": 50, "few": 50}).groupBy("stratum").count().collect()}
    assert n == {"hot": 50, "few": 5, "free": 995}
    assert {r.g: r["count"] for r in dataset.first_of_each(d.withColumn("g", F.when(F.col("pair_id") < 2900, "a").otherwise(F.lit(None))), "g", "pair_id", 8).groupBy("g").count().collect()} == {"a": 8, None: 8}


RECORD = "rec_id int, doc_id string, concept_name string, concept_type string, difficulty string, summary string, prerequisites array<string>, unlocks array<string>, related_to array<struct<concept:string,relation:string>>, relation_provenance map<string,string>, chunk_id string, source_passage string"


def record(i, doc, name, pre=(), un=(), passage=None):
    return (i, doc, name, "theory", "advanced", "s", list(pre), list(un), [], {}, f"c{i}", passage)


def test_documents_come_and_go(spark):
    old = spark.createDataFrame([record(1, "a.pdf", "A", ["B"]), record(2, "b.pdf", "B"), record(3, None, "C")], RECORD)
    new = spark.createDataFrame([record(9, "b.pdf", "B2")], RECORD)
    assert sorted(r.rec_id for r in lifecycle.add_document(old, new).collect()) == [1, 3, 9] and lifecycle.add_document(old, new.limit(0)).count() == 3
    kept, n, e = lifecycle.delete_end_to_end(old, "x/b.pdf")
    assert sorted(r.rec_id for r in kept.collect()) == [1, 3] and "A" in {r.name for r in n.collect()}
    kept, n, e = lifecycle.delete_end_to_end(old, "a.pdf")
    assert e.count() == 0 and {r.name for r in n.collect()} == {"B", "C"}
    p = "x" * 201 + ". Deep work requires graph search. It leads to kernel masking. Other text names token pooling."
    r = spark.createDataFrame([record(1, "d", "Deep Work", [], [], p), record(2, "d", "Graph Search"), record(3, "d", "Kernel Masking"), record(4, "d", "Token Pooling")], RECORD)
    assert {(x.rec_id, x.kind, x.target) for x in lifecycle.second_pass(r).collect()} == {(1, "prereq", "Graph Search"), (1, "unlock", "Kernel Masking")}
    g = lifecycle.graft(spark.createDataFrame([record(1, "d", "A"), record(2, "d", "B")], RECORD), spark.createDataFrame([record(7, "e", " a ", ["b", "Z"])], RECORD))
    assert [(x.name, x.kind, x.target) for x in g.collect()] == [("a", "prereq", "b")]


def test_a_bad_snapshot_is_never_published(spark, tmp_path):
    jobs = spark.createDataFrame([("j", "done")], "job_id string, status string")
    good = spark.createDataFrame([record(1, "a", "A", ["B"]), record(2, "a", "B")], RECORD)
    root = "file://" + str(tmp_path)
    assert lifecycle.publish(spark, root, 1, good, jobs).first().accepted and not lifecycle.publish(spark, root, 2, good.limit(0), jobs).first().accepted
    assert files.read_snapshot(spark, root, "concepts").count() == 2


def test_loose_matches_and_upserts(spark):
    m = lifecycle.loose_match(spark.createDataFrame([("graph search",), ("search",), ("graph voting",), ("zzz",), (None,)], "target string"), spark.createDataFrame([("1", "Graph Search"), ("2", "A Search")], "id string, name string"))
    assert {(r.target, r.id, r["rank"]) for r in m.collect()} == {("graph search", "1", 1), ("search", "2", 2), ("graph voting", "1", 3)}
    t = lifecycle.upsert(spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, x string, y int"), spark.createDataFrame([(1, None, 7, 1), (3, "c", 8, 1), (3, "d", None, 2)], "k int, x string, y int, at int"), ["k"], "at")
    assert sorted(map(tuple, t.collect())) == [(1, "a", 7), (2, "b", 6), (3, "d", None)]


def test_provenance_of_documents(spark):
    e = spark.createDataFrame([("a", "b", "T", s) for s in ("p/x.pdf:c1", "x.pdf", "q\\x.pdf/c", "p/xx.pdf:c", "y:1")], "src string, dst string, edge_type string, source string")
    got = lifecycle.document_edges(e.withColumn("src", F.col("source")), spark.createDataFrame([("p/x.pdf",), ("q/x.pdf",), (None,)], "doc_id string"))
    assert {(r.src, r.doc_id) for r in got.collect()} == {("p/x.pdf:c1", "p/x.pdf"), ("x.pdf", "p/x.pdf"), ("x.pdf", "q/x.pdf"), ("q\\x.pdf/c", "q/x.pdf")}


def test_spans_and_topics(spark):
    d = spark.createDataFrame([("abcdef", 1, 3), ("abcdef", 4, 9), ("abcdef", None, 2), (None, 0, 1), ("abcdef", 3, 3)], "t string, a int, b int")
    assert [r.s for r in d.select(answers.span(F.col("t"), F.col("a"), F.col("b")).alias("s")).collect()] == ["bc", "abcdef", "abcdef", "", "abcdef"]
    c = spark.createDataFrame([("rag_system", "Retrieval", ["rags"]), ("x", "Fragments", None)], "id string, label string, aliases array<string>")
    got = answers.related_concepts(spark.createDataFrame([("what are RAGs?",), ("tell me",), (None,)], "q string"), c)
    assert {(r.q, r.id) for r in got.collect()} == {("what are RAGs?", "rag_system"), ("what are RAGs?", "x")}


def test_nested_rows(spark):
    out = '[{"concept_name": ["", "Graph search"], "prerequisites": ["a", "graph search"], "related_to": [{"concept": "B"}, "C", {}]}, {"concept_name": "graph search"}, 5]'
    d = spark.createDataFrame([(1, "TEXT: the graph search needs a", out), (2, "TEXT: x", "no json"), (3, "TEXT: x", "{}"), (4, None, None)], "pair_id int, instruction string, output string")
    s = rows.strict_schema(d).orderBy("pos").collect()
    assert [(r.pair_id, r.pos, r.name, r.concept_type, r.related) for r in s] == [(1, 0, "Graph search", "definition", "B|C"), (1, 1, "graph search", "definition", "")]
    u = rows.distinct_concepts(d, {"graph search": "method"}).collect()
    assert [(r.name, r.concept_type, r.prerequisites) for r in u] == [("Graph search", "method", "a")]
    assert rows.cleaned_rows(d.limit(0)).count() == 0
    t = spark.createDataFrame([("[1] A. 1990\n[2] B. 1991",), ("short",), ("a model is short",), (None,)], "t string").select(rows.forced_empty(F.col("t")).alias("r"))
    assert [r.r for r in t.collect()] == ["bibliography_like", "too_short_non_concept", None, "too_short_non_concept"]


def test_checked_rows_fill_up(spark):
    good = '[{"concept_name": "Graph", "concept_type": "theory", "difficulty": "expert", "summary": "A graph is a set of nodes."}]'
    d = spark.createDataFrame([(i, "TEXT: a Graph", good if i % 3 else "broken") for i in range(300)], "pair_id int, instruction string, output string")
    n = rows.checked_balance(d, 60).collect()
    assert 60 <= len(n) <= 200 and all(r.pair_id % 3 for r in n)
    split = rows.stratified_split(d.unionByName(d.where("pair_id < 3").withColumn("pair_id", F.col("pair_id") + 1000)), F.col("pair_id") % 2 == 0)
    assert split.count() == 303


def docx(paragraphs) -> bytes:
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return b.getvalue()


def pdf(pages) -> bytes:
    out, k = b"%PDF-1.4\n", 10
    for n, text in enumerate(pages):
        s = zlib.compress(b"BT /F1 12 Tf 72 700 Td (" + text.encode() + b") Tj T* [(se) -20 (cond) -300 (line)] TJ ET")
        out += f"{n + 1} 0 obj << /Type /Page /Contents {k + n} 0 R >> endobj\n".encode() + f"{k + n} 0 obj << /Length {len(s)} /Filter /FlateDecode >> stream\n".encode() + s + b"\nendstream endobj\n"
    return out


def test_binary_documents(spark, tmp_path):
    assert office.docx_markdown(docx([("Heading1", "Start"), (None, "Text one."), (None, "# no heading"), (None, " ")])) == "# Start\n\nText one.\n\n\\# no heading"
    assert office.pdf_pages(pdf(["First \\(page\\)", "Other"])) == ["First (page)\nsecond line", "Other\nsecond line"] and office.pdf_pages(b"junk") == []
    (tmp_path / "a.docx").write_bytes(docx([("Heading1", "Start"), (None, "Words of the section. " * 20)]))
    (tmp_path / "b.pdf").write_bytes(pdf(["Words of the page. " * 20]))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_text("Plain words. " * 30)
    f = files.scan(spark, str(tmp_path))
    got = files.chunk_files(f).collect()
    assert {r.doc_id for r in got} == {"a.docx", "b.pdf", "c.txt"} and any(r.section_title == "Start" for r in got) and any(r.section_title == "Page 1" for r in got)
    assert {(r.doc_id, r.error) for r in office.office_pages(f).where("error is not null").collect()} == {("bad.docx", "BadZipFile")}
    (tmp_path / "d.doc").write_bytes(b"old")
    with pytest.raises(Exception, match="can't be read"):
        files.chunk_files(files.scan(spark, str(tmp_path))).collect()
