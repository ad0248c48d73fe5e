"""Operators on small inputs with known results."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import fuzzy, names, queries, text
from loomgraph.operators import chunking, dataset, evidence, filters, graph, ranking, records, relations
from loomgraph.sources import files
from loomgraph.streaming import jobs


def one(spark, expr, **cols):
    schema = ", ".join(f"`{k}` {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in cols.items()) or "x int"
    return spark.createDataFrame([tuple(cols.values()) or (0,)], schema).select(expr.alias("r")).first().r


@pytest.mark.parametrize(
    "body, title, kind",
    [
        ("", "", "empty"), ("   ", "x", "empty"), ("Some text.", "References", "reference"), ("[1] A. One.\n[2] B. Two.\n[3] C. Three.", "", "reference"), ("12 13 14 15 x 16 17", "", "table"),
        ("a@b.com and c@d.org are the authors", "", "frontmatter"), ("= + ∑ ∫ x ^ 2 = / y", "", "math"), ("A plain sentence about learning systems and how they work.", "", "prose"),
    ],
)
def test_chunk_kind(spark, body, title, kind):
    assert one(spark, chunking.chunk_kind(F.col("b"), F.col("t")), b=body, t=title) == kind


@pytest.mark.parametrize("raw, want", [("some_concept_name", "Some Concept Name"), ("concept (abbrev)", "Concept"), ("concept name.", "Concept Name"), ("lora", "Low-Rank Adaptation"), ("multi-head attention", "Multi-Head Attention"), ("GPT", "GPT"), (" BERT ", "BERT"), ("", "")])
def test_canonical_name(spark, raw, want):
    assert one(spark, names.canonical_name(F.col("n")), n=raw) == want


@pytest.mark.parametrize("raw, want", [("Low-Rank Adaptation", "LRA"), ("Low-Rank Adaptation (LoRA)", "LORA"), ("Retrieval-Augmented Generation", "RAG"), ("", "")])
def test_acronym(spark, raw, want):
    assert one(spark, names.acronym(F.col("n")), n=raw) == want


def test_alias_index(spark):
    idx = records.alias_index(spark.createDataFrame([(1, "Low-Rank Adaptation (LoRA)"), (2, "Retrieval-Augmented Generation")], "ord int, name string"))
    got = {r.alias: r.canonical for r in idx.collect()}
    assert got["lora"] == "Low-Rank Adaptation" and got["rag"] == "Retrieval-Augmented Generation" and got["low-rank-adaptation"] == "Low-Rank Adaptation"


@given(st.text("abcd ", max_size=12), st.text("abcd ", max_size=12))
def test_ratio_is_symmetric_and_bounded(a, b):
    assert fuzzy.ratio(a, b) == pytest.approx(fuzzy.ratio(b, a)) and 0 <= fuzzy.ratio(a, b) <= 100


def test_fuzzy_scores():
    assert fuzzy.ratio("abcd", "abce") == 75 and fuzzy.token_set_ratio("deep neural network", "neural network") == 100 and fuzzy.partial_ratio("cat", "the cat sat") == 100


def test_fuzzy_merges_match_brute_force(spark):
    ns = ["Neural Network", "Neural Networks", "Neural Netwrk", "Graph Search", "Graf Search", "Kernel Pooling", "Kernel Polling", "Attention"]
    got = {(r.name, r.like) for r in records.fuzzy_merges(spark.createDataFrame([(n,) for n in ns], "n string"), 90).collect()}
    want = {tuple(sorted((a, b), key=lambda x: (len(x), x))) for a in ns for b in ns if a != b and round(fuzzy.ratio(a.lower(), b.lower())) >= 90}
    assert got == want


def test_pack_paragraphs(spark):
    body = "\n\n".join(["a" * 700, "b" * 700, "c" * 700, "d" * 150])
    got = one(spark, chunking.pack_paragraphs(F.col("t")), t=body)
    assert [len(x) for x in got] == [1402, 852] and one(spark, chunking.pack_paragraphs(F.col("t")), t="short") == []


def test_section_chunks(spark):
    rows = [("d", 1, 1, "1 Basics", True), ("d", 2, 1, "x" * 900, False), ("d", 3, 2, "y" * 900, False), ("d", 4, 3, "2 Tiny", True), ("d", 5, 3, "z" * 50, False)]
    got = chunking.section_chunks(spark.createDataFrame(rows, "doc_id string, ord int, page int, text string, heading boolean")).orderBy("chunk_id").collect()
    assert [(r.section_title, r.page_number, r.page_start, r.page_end) for r in got] == [("1 Basics", 1, 1, 1), ("1 Basics", 2, 2, 3)]


def test_grounding(spark):
    v = lambda n, s, p: one(spark, filters.grounding_verdict(F.col("n"), F.col("s"), F.col("p")), n=n, s=s, p=p)
    assert v("Graph RAG", "about walls", "a text on bricks") == "ungrounded" and v("Masonry", "bricks and walls", "a text on bricks walls") == "rescued"
    assert v("bricks", "", "a text on bricks") == "kept" and v("bricks theory", "", "a text on bricks") == "empty_summary" and v("x", "", "") == "kept"


def test_inverted_prerequisite(spark):
    f = lambda t, p, td, pd: one(spark, filters.inverted_prerequisite(F.col("t"), F.col("p"), F.col("td"), F.col("pd")), t=t, p=p, td=td, pd=pd)
    assert f("Neural Network", "Graph Neural Network", "", "") and f("Algebra", "Topos", "foundational", "expert") and not f("Topos", "Algebra", "expert", "foundational") and f("A", "a", "", "")


SCHEMA = "rec_id bigint, concept_name string, concept_type string, difficulty string, summary string, prerequisites array<string>, unlocks array<string>, related_to array<struct<concept:string,relation:string>>, relation_provenance map<string,string>, doc_id string, chunk_id string, section_title string, page_number bigint"


def recs(spark, rows):
    full = [dict(dict(concept_type=None, difficulty=None, summary="s", prerequisites=[], unlocks=[], related_to=[], relation_provenance=None, doc_id="d", chunk_id="c", section_title=None, page_number=1), rec_id=i + 1, **r) for i, r in enumerate(rows)]
    order = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in order) for r in full], SCHEMA)


def test_merge_duplicates(spark):
    r = recs(spark, [dict(concept_name="A", summary="short", prerequisites=["B"], unlocks=["C"]), dict(concept_name="a", summary="a longer one", prerequisites=["D"], doc_id="e")])
    m = records.merged_concepts(r).first()
    assert (m.summary, m.n_records, m.source_count) == ("a longer one", 2, 2)
    f = {(x.kind, x.target): x.source for x in records.merged_facts(r).collect()}
    assert f == {("prereq", "b"): "d:c", ("prereq", "d"): "e:c", ("unlock", "c"): "d:c"}


def test_graph_and_cycles(spark):
    r = recs(spark, [dict(concept_name="A", difficulty="foundational", unlocks=["B"]), dict(concept_name="B", difficulty="intermediate", unlocks=["A", "Missing"]), dict(concept_name="Alone")])
    n, e = graph.nodes(r), graph.edges(r)
    assert {(x.src, x.dst) for x in e.collect()} == {("a", "b"), ("b", "a")} and [x.id for x in graph.orphans(n, e).collect()] == ["alone"]
    arcs = graph.learn_arcs(e).select("before", "after")
    assert {(x.a, x.b) for x in graph.cyclic_core(arcs).collect()} == {("a", "b"), ("b", "a")}
    assert [(x.a, x.b) for x in graph.break_cycles(arcs, n).collect()] == [("b", "a")]
    assert {x.component for x in graph.connected_components(e).collect()} == {"a"}
    assert {x.target for x in graph.unknown_targets(r).collect()} == {"missing"}


def test_traversal(spark):
    arcs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")], "a string, b string")
    hops = {(r.a, r.b): r.depth for r in graph.k_hops(arcs, 2).collect()}
    assert hops[("a", "d")] == 2 and hops[("a", "c")] == 1 and ("a", "a") not in hops
    assert {r.path for r in graph.chains(arcs, 3).where("start = 'a'").collect()} == {"a>b>c>d", "a>c>d"}


def test_capped_edges_equal_the_greedy_fold(spark):
    import random

    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(14), 2))) for _ in range(60)})
    rows = [(f"v{a:02d}", f"v{b:02d}", rng.randint(1, 5)) for a, b in pairs]
    used, want = {}, set()
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if used.get(a, 0) < 3 and used.get(b, 0) < 3:
            want.add((a, b))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    got = relations.capped_edges(spark.createDataFrame(rows, "a string, b string, score int"), 3)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_mentions_and_triggers(spark):
    c = spark.createDataFrame([("alg", "Linear Algebra"), ("ml", "Machine Learning")], "id string, name string")
    t = spark.createDataFrame([("m", "c1", "Linear algebra enables machine learning in practice."), ("m", "c2", "Machine learning builds on linear algebra."), ("m", "c3", "Nothing here.")], "doc_id string, chunk_id string, text string")
    assert {(r.chunk_id, r.id) for r in relations.mentions(t, c, ["doc_id", "chunk_id"]).collect()} == {("c1", "alg"), ("c1", "ml"), ("c2", "alg"), ("c2", "ml")}
    assert [(r.src, r.dst, r.chunk_id) for r in relations.trigger_unlocks(t, c, ["doc_id", "chunk_id"]).collect()] == [("alg", "ml", "c1")]


def test_directions(spark):
    c = spark.createDataFrame([("a", "alpha", "expert"), ("b", "beta", "foundational"), ("z", "zeta", None)], "id string, name string, difficulty string")
    t = spark.createDataFrame([("d", "1", 1, "alpha before beta"), ("d", "2", 2, "zeta")], "doc_id string, chunk_id string, ord int, text string")
    m = relations.mentions(t, c.select("id", "name"), ["doc_id", "chunk_id"])
    p = spark.createDataFrame([("b", "a"), ("z", "a")], "a string, b string")
    assert {(r.a, r.b): (r.first, r.second) for r in relations.directions(p, t, m, c, ["doc_id", "chunk_id"]).collect()} == {("b", "a"): ("a", "b"), ("z", "a"): ("a", "z")}


def test_evidence(spark):
    assert one(spark, evidence.page_display(F.create_map(F.lit("iv"), F.lit(4)), F.col("p")), p=4) == "p. iv" and one(spark, evidence.page_display(F.lit(None).cast("map<string,int>"), F.col("p")), p=4) == "PDF page 4"
    assert one(spark, evidence.cited_ids(F.col("t")), t="see S10 and S2, S2") == ["S2", "S10"] and one(spark, evidence.offending_ids(F.col("t"), F.array(F.lit("S2"))), t="S2 S3") == ["S3"]


@pytest.mark.parametrize("q, want", [("Hi there, can you explain to me RAGS?", "RAG"), ("please tell me about CNNs", "CNN"), ("What is attention?", "What is attention"), ("hello", "hello")])
def test_normal_question(spark, q, want):
    assert one(spark, queries.normalize(F.col("q")), q=q) == want


def test_question_predicates(spark):
    assert one(spark, queries.is_chitchat(F.col("q")), q="Hello!") and not one(spark, queries.is_chitchat(F.col("q")), q="Explain gradients to me now please") and one(spark, queries.library_intent(F.col("q")), q="Recommend some books on algebra") == "library_books"
    assert one(spark, queries.book_limit(F.col("q")), q="top 50 books on x") == 20 and one(spark, queries.yes_or_no(F.col("q")), q="No, it is not") is False


def test_ranking_puts_the_named_concept_first(spark):
    c = spark.createDataFrame([("rag", "Retrieval-Augmented Generation", "", 3), ("gan", "Generative Adversarial Network", "", 3), ("ret", "Retrieval", "", 1)], "id string, name string, summary string, degree int")
    got = ranking.rank_concepts(spark.createDataFrame([(1, "what is rag")], "i int, q string"), c, 1).collect()
    assert [r.id for r in got] == ["rag"]


def test_dataset_checks(spark):
    good = '[{"concept_name": "Graph Search", "concept_type": "method", "difficulty": "advanced", "summary": "A way to search graphs.", "prerequisites": [], "unlocks": [], "tags": []}]'
    rows = [(1, "TEXT: on graph search", good), (2, "TEXT: x", "{}"), (3, "TEXT: x", "nope"), (4, "no mark", "[]"), (5, "TEXT: walls", good)]
    got = {(r.pair_id, r.reason) for r in dataset.row_failures(spark.createDataFrame(rows, "pair_id int, instruction string, output string")).collect()}
    assert got == {(2, "output_not_list"), (3, "output_not_json"), (4, "instruction_missing_text"), (5, "ungrounded")}


def test_sources_and_snapshots(spark, tmp_path):
    (tmp_path / "papers").mkdir()
    (tmp_path / "papers" / "a.md").write_text("# One\n" + "alpha beta " * 40)
    (tmp_path / "b.txt").write_text("word " * 80)
    (tmp_path / "c.bin").write_bytes(b"x")
    f = files.scan(spark, str(tmp_path))
    assert {r.doc_id for r in f.collect()} == {"papers/a.md", "b.txt"}
    assert {(r.doc_id, r.section_title) for r in files.chunk_files(f).collect()} == {("papers/a.md", "One"), ("b.txt", "Section")}
    files.write_snapshot({"t": spark.range(3)}, str(tmp_path / "s"), 1)
    files.write_snapshot({"t": spark.range(5)}, str(tmp_path / "s"), 2)
    assert files.read_snapshot(spark, str(tmp_path / "s"), "t").count() == 5


def test_download_reject(spark):
    r = lambda b, s: spark.createDataFrame([(bytearray(b), len(b), s)], "c binary, n int, s string").select(files.download_reject(F.col("c"), F.col("n"), F.col("s"), F.lit("")).alias("r")).first().r
    assert r(b"x", "pdf") == "too_small" and r(b"%PDF-1.4" + b"x" * 20_000, "pdf") is None and r(b"<!DOCTYPE html>" + b"x" * 20_000, "pdf") == "html_page" and r(b"abc" * 9_000, "pdf") == "signature"


def test_job_states(spark):
    assert [one(spark, jobs.state(F.col("s")), s=s) for s in ("Completed", "graph-build", " error ")] == ["COMPLETE", "GRAPH_BUILD", "FAILED"]


def test_text_helpers(spark):
    assert one(spark, text.json_payload(F.col("t")), t='ok:\n[{"a": 1}] bye') == '[{"a": 1}]' and one(spark, text.slug(F.col("t")), t="  C++ & more!") == "c_more" and one(spark, text.slug(F.col("t")), t="++") == "concept"
    assert one(spark, text.source_category(F.col("t")), t="Papers\\x.pdf") == "paper"


def test_empty_tables(spark):
    r = recs(spark, [dict(concept_name="A")]).limit(0)
    assert graph.nodes(r).count() == 0 and graph.edges(r).count() == 0 and records.merged_facts(r).count() == 0 and records.canonical_map(r.select("concept_name")).count() == 0


def test_written_tables_are_released(spark):
    from loomgraph import session

    df = session.materialize(spark.range(5), "t")
    assert df.count() == 5
    session.release(spark)
    assert not session._WRITTEN
    with pytest.raises(Exception):
        df.count()


def test_answers_keep_only_supplied_citations_on_topic(spark):
    from loomgraph.operators import extra

    topics = {"S1": "Graph Search", "S2": "Token Pooling"}
    assert extra.cleanse("Graph search is old [S1]. It uses walls [S2] and more [S9].", topics) == "Graph search is old [S1]. It uses walls and more."
    assert extra.cleanse("Nothing cited.", topics).endswith("Sources: [S1] Graph Search, [S2] Token Pooling") and extra.cleanse("Plain.", {}) == "Plain."
    got = spark.createDataFrame([("x (S1) graph.", {"S1": "graph"})], "t string, m map<string,string>").select(extra.cleanse_udf("t", "m").alias("r")).first().r
    assert got == "x [S1] graph."


def test_gold_matches(spark):
    from loomgraph.operators import extra

    mine = spark.createDataFrame([("graph searches",), ("the token pooling layer",), ("Walls",), (None,)], "n string")
    gold = spark.createDataFrame([("Graph Search",), ("Token Pooling",), ("Kernel",)], "g string")
    got = {(r.gold, r.how) for r in extra.gold_matches(mine, gold).collect()}
    assert got == {("Token Pooling", "fuzzy"), ("Graph Search", "fuzzy")}


def test_build_leaves_no_cycle(spark):
    from loomgraph.operators import extra

    r = recs(spark, [dict(concept_name="Alpha", unlocks=["Beta"]), dict(concept_name="Beta", unlocks=["Gamma"]), dict(concept_name="Gamma", unlocks=["Alpha"])]).withColumn("source_passage", F.lit("alpha beta gamma"))
    n, e, dropped = extra.build(r)
    assert n.count() == 3 and dropped.count() == 1 and graph.cyclic_core(graph.learn_arcs(e).select("before", "after")).count() == 0


def _closing(a, b, level):
    after, out = {}, []
    for i, (x, y) in enumerate(zip(a, b)):
        seen, todo = {y}, [y]
        while todo:
            for z in after.get(todo.pop(), ()):
                if z not in seen:
                    seen.add(z)
                    todo.append(z)
        if x in seen:
            out.append(i)
        else:
            after.setdefault(x, set()).add(y)
    return out


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=80, unique=True), st.lists(st.integers(0, 3), min_size=13, max_size=13))
def test_closing_arcs_equal_a_search_per_arc(arcs, level):
    arcs = sorted(((x, y) for x, y in arcs if x != y), key=lambda r: (level[r[0]] - level[r[1]], r))
    a, b = [x for x, _ in arcs], [y for _, y in arcs]
    assert graph.closing_arcs(a, b, level) == _closing(a, b, level)


def test_closing_arcs_of_a_dense_component_take_seconds():
    import random
    import time

    rng = random.Random(3)
    arcs = list({(rng.randrange(1500), rng.randrange(1500)) for _ in range(30_000)})
    arcs = [r for r in arcs if r[0] != r[1]]
    began = time.process_time()
    got = graph.closing_arcs([x for x, _ in arcs], [y for _, y in arcs], [0] * 1500)
    # a search per arc over all that is kept takes some twenty times as long
    assert len(got) > 5_000 and time.process_time() - began < 8


def test_chunk_back_edges(spark):
    from loomgraph.operators import more

    rows = [(1, "d", "c", "A", ["B"]), (2, "d", "c", "B", ["C", "X"]), (3, "d", "c", "C", ["A"]), (4, "d", "e", "A", ["B"])]
    got = more.chunk_back_edges(spark.createDataFrame(rows, "rec_id int, doc_id string, chunk_id string, concept_name string, prerequisites array<string>")).collect()
    assert [tuple(r) for r in got] == [("d", "c", "c", "a")]


def _misspelled(n, seed=5):
    import random

    rng = random.Random(seed)
    base = ["Neural Network", "Graph Search Method", "Kernel Pooling", "Attention Mechanism", "Gradient Descent", "Tensor", "RAG", "RAG Architecture", "Language Models", "Language Model"]
    out = list(base)
    while len(out) < n:
        w = list(rng.choice(out))
        i = rng.randrange(len(w))
        w[i : i + rng.randint(0, 1)] = rng.choice("aeior") if rng.random() < 0.7 else ""
        out.append("".join(w).strip().title())
    out = [n for n in out if n]
    rng.shuffle(out)
    return out


def test_clustered_map_equals_the_fold(spark):
    ns = _misspelled(120)
    df = spark.createDataFrame([(n,) for n in ns], "name string")
    c = names.canonical_name(F.col("name"))
    forms = {r.name: (r.c, r.k) for r in df.distinct().select("name", c.alias("c"), names.merge_key(F.lower(c)).alias("k")).collect()}
    want, kept, keys = {}, {}, {}
    for raw in sorted(forms, key=lambda n: (len(forms[n][0]), forms[n][0], n)):
        canon, key = forms[raw]
        like = [v for k, v in kept.items() if round(fuzzy.ratio(canon.lower(), k)) >= 90]
        if len(canon) > 3 and key in keys:
            want[raw] = keys[key]
        elif len(canon) > 3 and like:
            want[raw] = like[0]
        else:
            want[raw] = kept[canon.lower()] = canon
            keys.setdefault(key, canon)
    got = {r.name: r.canonical for r in records.clustered_map(df).collect()}
    assert got == want and got["RAG Architecture"] == "RAG" and len(set(got.values())) < len({r.canonical for r in records.canonical_map(df).collect()})


def test_first_seen_map_equals_the_fold(spark):
    ns = _misspelled(120, 6)
    want, kept = {}, []
    for n in ns:
        like = [o for low, o in kept if round(fuzzy.ratio(n.lower(), low)) >= 85]
        want[n] = like[0] if like else n
        if not like:
            kept.append((n.lower(), n))
    df = spark.createDataFrame([(i, f" {n} ") for i, n in enumerate(ns)], "rec_id int, concept_name string")
    got = {r.name: r.canonical for r in records.first_seen_map(df).collect()}
    assert got == want and len(set(got.values())) < len(set(ns))


@pytest.mark.parametrize("threshold", [85.0, 87.5, 90.0])
def test_pairs_at_once_equal_the_ratio(threshold):
    import math

    import numpy as np

    ns = [n.lower() for n in _misspelled(150, 7)] + ["", "é ∑ tensor", "é ∑ tensors", "x" * 63, "x" * 64, "x" * 65, "y" * 70 + "x" * 70, "y" * 70 + "x" * 71]
    c = fuzzy.Coded(ns)
    i, j = fuzzy.alike(c, np.arange(len(ns)), np.arange(len(ns)), threshold)
    want = {(a, b) for a, x in enumerate(ns) for b, y in enumerate(ns) if (x or y) and math.floor(fuzzy.ratio(x, y) + 0.5) >= threshold}
    assert set(zip(i.tolist(), j.tolist())) == want and len(want) > len(ns)


def test_clusters_over_many_blocks(spark, monkeypatch):
    # names that are kept meet names of later blocks only in packs; no pair of names is written
    for name, value in (("BLOCK", 30), ("MOST_BLOCK", 60), ("PACK_X", 8), ("PACK_Y", 8)):
        monkeypatch.setattr(records, name, value)
    monkeypatch.setattr(records, "fuzzy_merges", lambda *_: pytest.fail("pairs of names are written"))
    test_clustered_map_equals_the_fold(spark)
    test_first_seen_map_equals_the_fold(spark)
    assert records.clustered_map(spark.createDataFrame([(None,), (" ",)], "name string")).collect() == []


def test_facts_of_misspelled_names_meet(spark):
    r = recs(spark, [dict(concept_name="Neural Network", prerequisites=["Kernel Pooling"]), dict(concept_name="Neural Netwrk", prerequisites=["Kernel Poolng"]), dict(concept_name="Kernel Pooling"), dict(concept_name="Kernel Poolng")])
    f = records.merged_facts(r, last_wins=True, mapping=records.first_seen_map(r)).collect()
    first, last = sorted(x.rec_id for x in r.where("size(prerequisites) > 0").collect())
    assert [(x.name_key, x.kind, x.target, x.rec_id) for x in f] == [("neural network", "prereq", "kernel pooling", first)]
    own = r.where(F.col("rec_id") == last).select(F.concat_ws(":", F.coalesce("doc_id", F.lit("")), F.coalesce("chunk_id", F.lit("")))).first()[0]
    assert f[0].source == (own if own != ":" else None)


def test_registered_chains_have_three_hops(spark, monkeypatch):
    from loomgraph.plans import q_graph

    r = recs(spark, [dict(concept_name=a, prerequisites=[b] if b else []) for a, b in (("Alpha", "Beta"), ("Beta", "Gamma"), ("Gamma", "Delta"), ("Delta", "Kappa"), ("Kappa", None))])
    monkeypatch.setattr(q_graph, "_r", lambda *_: r)
    assert {x.path for x in q_graph.QUERIES["trv2_chains_three_hops"](spark, "").collect()} == {"alpha>beta>gamma>delta", "beta>gamma>delta>kappa", "gamma>delta>kappa", "delta>kappa"}


@pytest.mark.parametrize("n, m, seed", [(7, 9, 1), (8, 20, 2), (12, 60, 3), (12, 130, 4)])
def test_path_sections_need_few_chains(spark, n, m, seed):
    import random

    from loomgraph.operators import answers

    rng = random.Random(seed)
    name = lambda i: ("a", "a b", "a>b", "a-", "ab", "b", "B", "é", "c d", "c", "z", "y")[i]
    arcs = spark.createDataFrame([(name(rng.randrange(n)), name(rng.randrange(n))) for _ in range(m)], "a string, b string")
    few, all_ = graph.first_chains(arcs), graph.chains(arcs)
    assert {tuple(r) for r in answers.path_section(few).collect()} == {tuple(r) for r in answers.path_section(all_).collect()}
    assert few.count() <= all_.count() and (m < 100 or few.count() < all_.count() / 2)


def test_closed_references_have_all_kinds_and_positions(spark):
    rows = [dict(concept_name="A", prerequisites=["v", "w", "x", "y", "z", "B"], unlocks=["B", "G"], related_to=[("C", "uses"), ("x", "uses")])]
    rows += [dict(concept_name=n) for n in "BCDE"] + [dict(concept_name="F", unlocks=["A"]), dict(concept_name="G", unlocks=["A"], chunk_id="e")]
    got = {tuple(r) for r in relations.closed_references(recs(spark, rows)).collect()}
    assert got == {(1, "prereq", 5, "B"), (1, "unlock", 0, "B"), (1, "related", 0, "C")}


def test_oriented_edges(spark):
    c = spark.createDataFrame([("Graph Search", "Graph Search", "expert"), ("Token Pooling", "Token Pooling", "foundational"), ("Kernel Method", "Kernel Method", None)], "id string, name string, difficulty string")
    t = spark.createDataFrame([("d", "1", "d:1", "graph search before token pooling"), ("d", "2", "d:2", "kernel method")], "doc_id string, chunk_id string, ord string, text string")
    m = relations.mentions(t, c.select("id", "name"), ["doc_id", "chunk_id"])
    idx = records.alias_index(spark.createDataFrame([(1, "Graph Search"), (2, "Token Pooling"), (3, "Kernel Method")], "ord int, name string"))
    r = recs(spark, [
        dict(concept_name="graph-search", prerequisites=["Token Pooling", "Kernel Method"], related_to=[("Token Pooling", "extends")]), dict(concept_name="Token Pooling", unlocks=["Graph Search"], related_to=[("graph search", "uses")], chunk_id="z"),
        dict(concept_name="Token Pooling", prerequisites=["Graph Search"], chunk_id="y"),
    ])
    got = {tuple(x) for x in relations.oriented_edges(r, t, m, c, idx, ["doc_id", "chunk_id"]).collect()}
    assert got == {("Token Pooling", "Graph Search", "REQUIRES", "requires", "d:c"), ("Graph Search", "Token Pooling", "UNLOCKS", "enables", "d:z"), ("Graph Search", "Token Pooling", "RELATED", "extends", "d:c")}


def test_clean_pipeline_runs_all_stages(spark):
    from loomgraph.operators import compose

    r = recs(spark, [dict(concept_name="Graph Search", prerequisites=["Graph Serch"]), dict(concept_name="Graph Serch", unlocks=["Tensor"], chunk_id="e"), dict(concept_name="Tensor"), dict(concept_name="Kernel Pooling", chunk_id="e")])
    r = r.withColumn("source_passage", F.when(F.col("rec_id") == 3, "a tensor"))
    c = spark.createDataFrame([("d", "c", "Graph search of nodes."), ("d", "e", "The graph serch is here.")], "doc_id string, chunk_id string, text string")
    concepts, facts = compose.clean_pipeline(r, c, ["graph"])
    assert [(x.name_key, x.concept_name, x.rec_id, x.n_records) for x in concepts.collect()] == [("graph search", "Graph Search", 1, 2)]
    assert {(x.name_key, x.kind, x.target, x.source) for x in facts.collect()} == {("graph search", "prereq", "graph search", "d:c"), ("graph search", "unlock", "tensor", "d:e")}
    assert {x.name_key for x in compose.clean_pipeline(r, c, [])[0].collect()} == {"graph search", "tensor"}


def test_clean_and_canonicalize_runs_all_steps(spark):
    from loomgraph.operators import compose

    text = "neural network, language model, tensor algebra and gradient flow"
    r = recs(spark, [
        dict(concept_name="Neural Network", difficulty="intermediate", prerequisites=["neural network", "12 13", "Tensor Algebra", "Gradient Flow"], related_to=[("Language Models", "extends"), ("Elsewhere Known", "uses")]),
        dict(concept_name="Neural Networks", difficulty="intermediate", summary="the longer summary", unlocks=["Tensor Algebras"]), dict(concept_name="Language Model", difficulty="foundational", summary=""),
        dict(concept_name="Tensor Algebra", difficulty="foundational", section_title="Chapter"), dict(concept_name="Gradient Flow", difficulty="expert"), dict(concept_name="Neural Network", section_title="References", unlocks=["Lost Thing"]),
    ]).withColumn("source_passage", F.lit(text))
    concepts, refs = compose.clean_and_canonicalize(r)
    got = {x.concept_name: (x.rec_id, x.n_records, x.summary) for x in concepts.collect()}
    assert got == {"Neural Network": (1, 2, "the longer summary"), "Language Model": (3, 1, ""), "Tensor Algebra": (4, 1, "s"), "Gradient Flow": (5, 1, "s")}
    # out: the self reference, the number, the unlock that closes a cycle, the prerequisite two levels harder; targets nobody extracted stay
    assert {tuple(x) for x in refs.collect()} == {("Neural Network", "prereq", "requires", "Tensor Algebra", "d:c"), ("Neural Network", "related", "extends", "Language Model", "d:c"), ("Neural Network", "related", "uses", "Elsewhere Known", "d:c")}


def test_concepts_alone_break_no_cycles(spark, monkeypatch):
    from loomgraph.operators import compose

    r = recs(spark, [dict(concept_name="Neural Network", unlocks=["Tensor Algebra"]), dict(concept_name="Tensor Algebra", unlocks=["Neural Networks"])]).withColumn("source_passage", F.lit("neural network and tensor algebra"))
    want = {tuple(x) for x in compose.clean_and_canonicalize(r)[0].collect()}
    monkeypatch.setattr(compose, "break_cycles", lambda *_: pytest.fail("references are cleaned for the concepts"))
    assert {tuple(x) for x in compose.clean_concepts(r).collect()} == want and len(want) == 2


def test_few_pairs_are_measured(monkeypatch):
    # texts of the same letters in another order are told apart by their neighbours, before any subsequence is measured
    import random

    import numpy as np

    rng, ns = random.Random(8), []
    for _ in range(60):
        letters = list("stochastic gradient voting")
        rng.shuffle(letters)
        ns += ["".join(letters), "".join(letters[1:])]
    measured, lcs_of = [], fuzzy._lcs_of
    monkeypatch.setattr(fuzzy, "_lcs_of", lambda c, masks, pattern, a, b: measured.append(len(a)) or lcs_of(c, masks, pattern, a, b))
    i, j = fuzzy.alike(fuzzy.Coded(ns), np.arange(len(ns)), np.arange(len(ns)), 90.0)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, x in enumerate(ns) for b, y in enumerate(ns) if round(fuzzy.ratio(x, y)) >= 90} and sum(measured) < 1000


def test_names_whose_key_is_kept_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(records, "BLOCK", 4)
    met, matches = [], records._matches
    monkeypatch.setattr(records, "_matches", lambda rest, *a: met.extend(r.low for r in rest.collect()) or matches(rest, *a))
    got = {r.name: r.canonical for r in records.clustered_map(spark.createDataFrame([(x,) for x in ("Kernel", "Tensor", "Lattice", "Sampling", "Kernel Methods", "Lattice Search")], "name string")).collect()}
    assert met == [] and got["Kernel Methods"] == "Kernel" and got["Lattice Search"] == "Lattice"


def test_record_names_read_each_record_once(spark):
    df = spark.createDataFrame([(1, "A", ["B", None], None, [("C", "uses")]), (2, None, None, ["B"], None)], "rec_id int, concept_name string, prerequisites array<string>, unlocks array<string>, related_to array<struct<concept string, relation string>>")
    names = records.record_names(df)
    assert sorted(str(r.name) for r in names.collect()) == ["A", "B", "C", "None"] and "Union" not in names._jdf.queryExecution().optimizedPlan().toString()


def test_the_built_graph_judges_each_record_once(spark, tmp_path):
    from pyspark.sql import types as T

    from loomgraph.operators import extra

    path = str(tmp_path / "r")
    text = "Linear algebra studies vectors and matrices and the maps between them."
    rows = [(1, "Linear Algebra", text, ["Matrix Theory"], ["Deep Learning"], text, "d", "c1", "s", 1), (2, "Matrix Theory", "Matrix theory studies matrices.", ["Linear Algebra"], None, "Matrix theory studies matrices.", "d", "c2", "s", 2)]
    df = spark.createDataFrame(rows, "rec_id long, concept_name string, summary string, prerequisites array<string>, unlocks array<string>, source_passage string, doc_id string, chunk_id string, section_title string, page_number long")
    df = df.withColumns({"concept_type": F.lit("definition"), "difficulty": F.lit("intermediate"), "related_to": F.lit(None).cast("array<struct<concept string, relation string>>"), "relation_provenance": F.lit(None).cast(T.MapType(T.StringType(), T.StringType()))})
    df.write.parquet(path)
    n, e, dropped = extra.build(spark.read.parquet(path))
    assert n.count() == 2 and dropped.count() == 1 and e.count() == 1
    assert not any(path in t._jdf.queryExecution().optimizedPlan().toString() or any(path in f for f in t.inputFiles()) for t in (n, e, dropped))


def test_the_fold_of_first_seen_names_measures_few_pairs(monkeypatch):
    import random

    rng, ns = random.Random(9), []
    for _ in range(200):
        letters = list("ternary feature projection")
        rng.shuffle(letters)
        ns.append("".join(letters))
    measured, lcs_of = [], fuzzy._lcs_of
    monkeypatch.setattr(fuzzy, "_lcs_of", lambda c, masks, pattern, a, b: measured.append(len(a)) or lcs_of(c, masks, pattern, a, b))
    every = [True] * len(ns)
    out, kept = fuzzy.kept_first(ns, [None] * len(ns), every, every, 85.0).tolist(), []
    for i, x in enumerate(ns):
        want = next((k for k in kept if round(fuzzy.ratio(x, ns[k])) >= 85), -1)
        assert out[i] == want
        if want < 0:
            kept.append(i)
    assert sum(measured) < 0.6 * len(ns) ** 2


def _shuffled(plan) -> int:
    """Rows written by the shuffles of an executed plan."""
    kind = plan.getClass().getSimpleName()
    if kind == "ShuffleExchangeExec":
        n = plan.metrics().get("shuffleRecordsWritten").get().value()
    else:
        n = 0
    inner = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan() if kind.endswith("QueryStageExec") else None
    below = [inner] if inner is not None else [plan.children().apply(i) for i in range(plan.children().size())]
    return n + sum(_shuffled(x) for x in below)


def test_chains_are_not_shuffled(spark):
    n = 24
    arcs = spark.createDataFrame([(f"{k}{i:02d}", f"{k + 1}{j:02d}") for k in range(3) for i in range(n) for j in range(n)], "a string, b string")
    c = graph.chains(arcs)
    got = c.collect()
    assert len({r.path for r in got}) == len(got) == n**4 + n**3 + n**2 and {r.hops for r in got} == {1, 2, 3}
    assert _shuffled(c._jdf.queryExecution().executedPlan()) < 2 * n**3  # fewer than the paths of two steps


@pytest.mark.parametrize("hops", [1, 2, 3, 4])
def test_chains_equal_brute_force_in_pieces(spark, monkeypatch, hops):
    import random

    monkeypatch.setattr(graph, "PIECE", 2)
    rng = random.Random(hops)
    arcs = [(rng.choice("abcdefg>é"), rng.choice("abcdefg>é")) for _ in range(45)] + [(None, "a"), ("a", None)]
    succ: dict = {}
    for a, b in arcs:
        if a and b and a != b:
            succ.setdefault(a, set()).add(b)

    def paths(p):
        more = [x for x in succ.get(p[-1], ()) if x not in p]
        return [p] if len(p) > hops or len(p) > 1 and not more else [q for x in more for q in paths([*p, x])]

    want = sorted((p[0], ">".join(p), len(p) - 1) for a in succ for p in paths([a]))
    assert sorted(map(tuple, graph.chains(spark.createDataFrame(arcs, "a string, b string"), hops).collect())) == want
