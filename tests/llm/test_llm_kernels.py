"""Kernels against brute force."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import canon_match, language, leaks, overlap, pairs, reading, text_stats
from loomgraph.llm.words import banded_distance, lcs_length, masks, myers_search, normal_words, osa_distance


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


WORDS = st.lists(st.sampled_from("abcd"), max_size=14)


@given(WORDS, WORDS, st.integers(0, 9))
def test_banded_distance(a, b, k):
    d = distance(a, b)
    assert banded_distance(a, b, k) == (d if d <= k else k + 1)


@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=8), st.lists(st.sampled_from("abcd"), max_size=14))
def test_myers_search(p, t):
    want = min(distance(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
    assert myers_search(masks(p), len(p), t)[0] == want


@given(WORDS, WORDS)
def test_lcs(a, b):
    if a:
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert lcs_length(masks(a), len(a), b) == table[-1][-1]


def test_osa_counts_a_swap_once():
    assert osa_distance("graph", "grpah", 2) == 1 and osa_distance("abc", "xyz", 2) == 3


def test_normal_words_fold_formatting():
    assert normal_words("The sort-\ned “Simpliﬁed” non-stationary TEXT_x") == ["the", "sorted", "simplified", "nonstationary", "text", "x"]


@settings(max_examples=150)
@given(st.text("ab .\n\t|&,1-•–wW", max_size=60), st.lists(st.integers(0, 60), max_size=5))
def test_statistics_add_up_over_chunks(text, cuts):
    at = sorted({min(c, len(text)) for c in cuts} | {0, len(text)})
    parts = [text_stats.chunk_stats(text[a:b]) for a, b in zip(at, at[1:])] or [text_stats.chunk_stats("")]
    left = parts[0]
    for p in parts[1:]:
        left = text_stats.merge(left, p)
    right = parts[-1]
    for p in reversed(parts[:-1]):
        right = text_stats.merge(p, right)
    whole, n = text_stats.text_stats(text)
    for s in (text_stats.close(left), text_stats.close(right)):
        assert s.sums == whole and text_stats.distinct(s.bins) == n


@given(st.text("ab \n", max_size=200), st.integers(1, 6))
def test_soft_breaks_are_alike_in_chunks(text, k):
    cell, chunk = 8, 8 * k
    parts = [text_stats.chunk_stats(text[a : a + chunk], None, cell) for a in range(0, max(len(text), 1), chunk)]
    left = parts[0]
    for p in parts[1:]:
        left = text_stats.merge(left, p)
    sums, bins = [0] * len(text_stats.NAMES), [0] * text_stats.BINS
    lines = text_stats.lines_of(text, cell)
    for line in lines:
        text_stats.add_line(sums, bins, line)
    s = text_stats.close(left)
    assert s.sums == sums and s.bins == bins
    assert "".join(text_stats.soft_breaks(text, cell)) == text and all(len(x) <= 2 * cell for x in lines) or len(text) < cell


@given(st.lists(st.integers(1, 9), min_size=1, max_size=40))
def test_coverage_ranks(ranks):
    for share, got in zip(reading.SHARES, reading.coverage_ranks([(r, 1) for r in ranks])):
        assert got == min(r for r in ranks if sum(x <= r for x in ranks) >= share * len(ranks) - 1e-9)


def test_the_sentence_of_the_middle_word():
    assert reading.sentence_length("One two. One two three four five six.") == 6 and reading.sentence_length("") == 0 and reading.sentence_length("Hi. Hi. Ho.") == 1


def test_only_known_prompt_endings_are_cut():
    end = "\n\nAnswer with the JSON array and nothing else:"
    for passage in ("Graphs have nodes.\n\nThe last layer gives the output of the network.", "The model should return an answer:", "x"):
        assert overlap.passage_of("Read it.\nTEXT:\n" + passage + end).strip() == passage == overlap.passage_of("TEXT: " + passage).strip()


@given(st.integers(1, 400))
def test_segments_leave_room_for_the_edits(n):
    k, q = overlap.errors(n), overlap.segment_length(n)
    assert n // q >= min(k + overlap.SPARE, n)


@pytest.mark.parametrize(
    "v, want",
    [
        ("Search, Graph", "graph search"), ("A.P.M.", "apm"), ("W.R.F..", "wrf"), ("the concept of node_propagation", "node propagation"), ("TensorRouting", "tensor routing"), ("Paired Signal Voting (PSV)", "paired signal voting"),
        ("Late. Margin Encoding", "late. margin encoding"), ("“Uniﬁed Context Tuning” – overview", "unified context tuning"), ("", ""), (" ", ""),
    ],
)
def test_normal_value(v, want):
    assert canon_match.normal_value(v) == want


def test_name_cost():
    known = {"masking", "graph", "search", "voting"}
    assert canon_match.name_cost("grahp search", "graph search", known) == 1 and canon_match.name_cost("graph voting", "graph search", known) is None
    assert canon_match.name_cost("abc.", "abc", set()) == 0 and canon_match.name_cost("abd", "abc", set()) is None and canon_match.name_cost("loar", "lora", set()) == 1
    assert canon_match.name_cost("kernel tasting", "kernel masking", set()) is None and canon_match.name_cost("elasticcontext", "elastic context", set()) == 0.05


ITEM = " ".join(f"w{i}" for i in range(60))


def damaged(words, every):
    return [("zz" if i % every == every - 1 else w) for i, w in enumerate(words)]


@pytest.mark.parametrize(
    "text, found",
    [
        (ITEM, True), ("x y " * 50 + ITEM.upper().replace(" ", ",\n") + " end " * 30, True), (" ".join(ITEM.split()[:40]), True), (" ".join(ITEM.split()[:20]), False),
        (" ".join(damaged(ITEM.split(), 9)), True), (" ".join(damaged(ITEM.split(), 4)), True), (" ".join(damaged(ITEM.split(), 2)), False), (" ".join(reversed(ITEM.split())), False), ("", False), ("w1 w2 w3", False), (" ".join(w + " gap" * 30 for w in ITEM.split()), False),
    ],
)
def test_item_index(text, found):
    assert bool(leaks.ItemIndex([(7, ITEM), (8, None), (9, "too short")]).search([leaks.normal_words(text), []])) is found


@settings(max_examples=60)
@given(st.integers(1, 140), st.integers(0, 3), st.randoms(use_true_random=False))
def test_no_copy_within_the_error_budget_is_missed(m, cut, rng):
    """Words lost at the ends and every fourth kept word changed, as far as the budget goes: enough pieces survive."""
    words = [f"w{i}" for i in range(m)]
    k = int(leaks.BUDGET * m)
    a, b = sorted((rng.randint(0, k * cut // 3), rng.randint(0, k * cut // 3)))
    kept = words[a : m - (b - a)] if b > a else words[a:]
    room = k - (m - len(kept))
    copy = [("zz" if i % 4 == 3 and i // 4 < room else w) for i, w in enumerate(kept)]
    q = leaks.piece_length(m)
    pieces = {tuple(words[i : i + q]) for i in range(m - q + 1)}
    assert sum(tuple(copy[i : i + q]) in pieces for i in range(len(copy) - q + 1)) >= max(1, leaks.intact(m, q))


def test_items_of_any_length():
    long = [f"v{i}" for i in range(20_000)]
    index = leaks.ItemIndex([(1, "alpha"), (2, "alpha beta gamma"), (3, " ".join(long)), (4, "")])
    got = lambda t: sorted(i for _, i in index.search([leaks.normal_words(t)]))
    assert got("so alpha, yes") == [1] and got("Alpha Beta-gamma") in ([1], [1, 2]) and got("alpha beta gamma") == [1, 2] and got("nothing here") == []
    assert got("x " * 50 + " ".join(w for i, w in enumerate(long) if not 4_000 <= i < 9_000)) == [3]


def test_distances_are_the_edit_distances():
    import random

    import numpy as np

    rng = random.Random(3)
    items = [(k, " ".join(rng.choice("abcdef") for _ in range(n))) for k, n in enumerate((1, 5, 63, 64, 65, 130))]
    index = leaks.ItemIndex(items)
    text = [rng.choice("abcdefg") for _ in range(150)]
    ids = np.array([index.vocab[w] for w in text])
    it, lo = np.arange(6), np.array([0, 3, 10, 0, 20, 5])
    got = index.distances(it, ids, lo, np.array([150, 60, 140, 150, 149, 150]))
    want = [myers_search(masks(items[k][1].split()), len(items[k][1].split()), text[a:b])[0] for k, a, b in zip(it, lo, (150, 60, 140, 150, 149, 150))]
    assert got.tolist() == want


def model(**texts):
    counts = {}
    for lang, text in texts.items():
        c = counts.setdefault(lang, {})
        for w in text.lower().split():
            for g in language.grams(w):
                c[g] = c.get(g, 0) + 1
    return language.LanguageModel(counts)


LANGUAGES = model(
    en="the graph is a set of nodes and edges that the model reads in order so we can see which of them are not in it when the reader has learned the words",
    de="das modell liest die knoten und die kanten weil sie nicht geordnet sind und der graph neu ist wer die knoten kennt versteht auch das wie man sie nicht sieht",
    fi="malli lukee solmut ja kaaret koska ne eivät ole järjestyksessä ja verkko on uusi joka tuntee solmut ymmärtää myös mallin ja kaaret",
)


def test_language_model():
    assert LANGUAGES.of_text("The nodes are read in the order that the model has") == "en" and LANGUAGES.of_text("Die Kanten sind nicht neu und das Modell kennt sie") == "de"
    assert LANGUAGES.of_text("one two") is None and LANGUAGES.of_words([]) is None and language.LanguageModel({}).of_text("a b c d e f") is None


@pytest.mark.parametrize(
    "prompt, answer, want",
    [
        ("Explain.\nTEXT: The graph is a set of nodes and edges that the model reads in order.", "[]", None), ("TEXT: x", None, "empty"), ("TEXT: x", "```json\n```", "empty"), ("TEXT: x", "<think>\n</think>", "empty"),
        ("TEXT: x", "Sorry, I can't help with this passage.", "refusal"), ("TEXT: x", '{"error": "Regrettably, I am not able to produce these records."}', "refusal"), ("TEXT: x", "[{\"concept_name\": \"A", "truncated"),
        ("TEXT: x", "The model reads the nodes in", "truncated"), ("TEXT: x", "The model reads the nodes in order.", None),
        ("TEXT: The graph is a set of nodes and edges that the model reads in order.", "> the graph is a set of nodes and edges that the model reads in order", "copy"),
        ("TEXT: The graph is a set of nodes and edges that the model reads in order.", "Das Modell liest die Knoten und die Kanten, weil sie nicht geordnet sind und der Graph neu ist.", "language"),
        ("TEXT: Verkko on uusi ja malli lukee solmut ja kaaret järjestyksessä.", "Wer die Knoten kennt, versteht auch das Modell und die Kanten.", "language"),
        ("TEXT: Graphs have nodes.\n\nThe last layer gives the output of the network.", "Graphs have nodes. The last layer gives the output of the network.", "copy"),
        ("TEXT: Nine words make up this whole short passage here.", '[{"concept_name": "A", "summary": "Nine words make up this whole short passage here."}]', "copy"),
        ("TEXT: Two words.", "Two words", "copy"), ("TEXT: x", "The model learns. " * 40 + "I cannot help with that.", "refusal"),
        ("TEXT: x", '[{"concept_name": "A", "summary": "Fine."}, {"concept_name": "B", "summary": "Good."}, {"concept_name": "C", "summary": "I must decline this request."}]', "refusal"),
        ("TEXT: Das Modell liest die Knoten und die Kanten, weil sie nicht geordnet sind.", "Wer die Knoten kennt, versteht auch das Modell und die Kanten.", None),
    ],
)
def test_defects(prompt, answer, want):
    assert pairs.defect(prompt, None, answer, 0, LANGUAGES) == want


def test_a_preview_cut_at_its_limit_is_whole():
    cut = '[{"concept_name": "A", "summary": "' + "x" * 185
    assert pairs.defect(None, "text", cut, len(cut)) is None and pairs.defect(None, "text", cut, len(cut) + 1) == "truncated" and pairs.defect(None, None, None, 220) == "empty"
