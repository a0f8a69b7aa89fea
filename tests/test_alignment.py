import itertools
import math
import random

import numpy as np
import pytest

from utterframe.operators.alignment import EditCosts, align_grams, align_syllables, align_words, beam_search, edit_counts, edit_distances, edit_operations, edit_path, force_align, greedy_ids, lattice, locate_chunks, merge_streams, prefix_distances, with_edit_distance
from utterframe.operators.confusion import Matrix, estimate, graph_components, label_propagation


def slow(a, b, sub=lambda x, y: 1.0, rem=1.0, add=1.0):
    d = {(0, 0): 0.0}
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        if i or j:
            d[i, j] = min(
                d[i - 1, j] + rem if i else math.inf, d[i, j - 1] + add if j else math.inf,
                d[i - 1, j - 1] + (0 if a[i - 1] == b[j - 1] else sub(a[i - 1], b[j - 1])) if i and j else math.inf,
            )
    return d[len(a), len(b)]


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(1)
    return [tuple("".join(rng.choices("abcdé", k=rng.randrange(0, 9))) for _ in range(2)) for _ in range(80)] + [("", ""), ("", "ab"), ("ab", "")]


def test_batch_distances(pairs):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    assert edit_distances(a, b).tolist() == [slow(x, y) for x, y in pairs]
    costs = EditCosts(substitution={("a", "b"): 0.2, ("c", "a"): 0.7}, deletion={"d": 0.4}, insertion={"b": 0.3})
    got = edit_distances(a, b, costs)
    for (x, y), g in zip(pairs, got):
        d = np.full((len(x) + 1, len(y) + 1), np.inf)
        d[0, 0] = 0
        for i, j in itertools.product(range(len(x) + 1), range(len(y) + 1)):
            if i:
                d[i, j] = min(d[i, j], d[i - 1, j] + (0.4 if x[i - 1] == "d" else 1))
            if j:
                d[i, j] = min(d[i, j], d[i, j - 1] + (0.3 if y[j - 1] == "b" else 1))
            if i and j:
                d[i, j] = min(d[i, j], d[i - 1, j - 1] + (0 if x[i - 1] == y[j - 1] else {("a", "b"): 0.2, ("c", "a"): 0.7}.get((x[i - 1], y[j - 1]), 1)))
        assert abs(g - d[-1, -1]) < 1e-9


def test_operations_spell_both_texts(pairs):
    ops = edit_operations([p[0] for p in pairs], [p[1] for p in pairs])
    for k, (a, b) in enumerate(pairs):
        mine = ops[ops.pair == k]
        assert "".join(mine.ref) == a and "".join(mine.hyp) == b
        assert (mine.op != "match").sum() == slow(a, b)
        assert edit_path(a, b) == list(mine[["op", "ref", "hyp"]].itertuples(index=False, name=None))
    kit = edit_operations(["kitten"], ["sitting"])
    assert kit.op.tolist() == ["substitute", "match", "match", "match", "substitute", "match", "insert"]


def test_tables(spark, pairs):
    df = spark.createDataFrame([(i % 2, a, b) for i, (a, b) in enumerate(pairs)] + [(0, None, "x")], "k int, a string, b string")
    got = {(r.a, r.b): r.distance for r in with_edit_distance(df, "a", "b", EditCosts()).collect()}
    assert got == {p: slow(*p) for p in pairs}
    counts = edit_counts(df, ["k"], "a", "b").toPandas()
    assert counts[counts.op != "match"].n.sum() == sum(slow(*p) for p in pairs)
    assert edit_counts(df.limit(0), [], "a", "b").count() == 0


def test_prefixes(pairs):
    table = prefix_distances("abcd", [p[1] for p in pairs])
    for k, (_, b) in enumerate(pairs):
        assert all(table[k, j, i] == slow("abcd"[:i], b[:j]) for j in range(len(b) + 1) for i in range(5))


def test_lattice_prefers_the_first_of_equal_steps():
    cost, path = lattice(1, 1, lambda i, j: [(1, 1, 1.0), (1, 0, 0.5), (0, 1, 0.5)])
    assert cost == 1.0 and [p[2:4] for p in path] == [(1, 1)]
    assert lattice(1, 0, lambda i, j: [(1, 1, 1.0)])[0] == math.inf


def test_words():
    assert [p[:4] for p in align_words(["ab", "cd", "ef"], ["abcd", "ef"])] == [(0, 0, 2, 1), (2, 1, 1, 1)]
    assert [p[2:4] for p in align_words(["ab"], [])] == [(1, 0)] and align_words([], []) == []
    assert [p[2:4] for p in align_words(["a" * 12, "bb"], ["bb"])] == [(1, 0), (1, 1)]


def test_chunks():
    got = locate_chunks(["one two", "three four"], "noise one two junk thr ee four".split())
    assert [g[:2] for g in got] == [(1, 3), (4, 7)] and got[0][2] == 0
    assert locate_chunks(["a", ""], []) == [(0, 0, 1.0), (0, 0, 1.0)]


def test_grams():
    m = Matrix([("a b", "c", 1.0), ("x", "", 0.5)])
    cost, path = align_grams(["a", "b", "x"], ["c"], m.substitute, m.delete, m.insert)
    assert [p[2:4] for p in path] == [(2, 1), (1, 0)] and abs(cost - math.log(2)) < 1e-9


def test_syllables():
    units = [("Ꮳ", "tsa", True), ("Ꮃ", "la", True), (" ", " ", False), ("Ꭹ", "ki", True)]
    spans = align_syllables(units, "tsala gi")
    assert ["tsala gi"[a:b] for a, b in spans] == ["tsa", "la", " ", "gi"]
    assert align_syllables(units, "") == [(0, 0)] * 4
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_streams():
    seg = [("C", "n"), ("V", "a"), ("|", " "), ("V", "e")]
    assert merge_streams(seg, [("C", "n"), ("V", "3"), ("|", " "), ("V", "1")]) == "na3 e1"
    assert merge_streams(seg, [("V", "3"), ("|", " "), ("V", "1")]) == "na3 e1" and merge_streams(seg, []) == "na2 e2"


def probs(rows):
    return np.log(np.array(rows) / np.array(rows).sum(axis=1, keepdims=True))


def test_greedy_rearms_after_a_pad():
    assert greedy_ids(probs([[1, 9, 1], [1, 9, 1], [9, 1, 1], [1, 9, 1], [1, 1, 9]])) == [1, 1, 2] and greedy_ids(np.zeros((0, 3))) == []


def test_beam_sums_over_alignments():
    x = probs(np.random.default_rng(0).random((5, 3)) + 0.05)
    want: dict = {}
    for path in itertools.product(range(3), repeat=5):
        ids = tuple(c for k, c in enumerate(path) if c and (k == 0 or path[k - 1] != c))
        want[ids] = np.logaddexp(want.get(ids, -np.inf), sum(x[t, c] for t, c in enumerate(path)))
    best = sorted(want.items(), key=lambda kv: -kv[1])[:3]
    got = beam_search(x, width=200, top=3, least=1e-9)
    assert [g[0] for g in got] == [b[0] for b in best] and np.allclose([g[1] for g in got], [b[1] for b in best])


def test_forced_alignment():
    x = probs([[9, 1, 1, 1], [1, 9, 1, 1], [1, 1, 9, 1], [9, 1, 1, 1], [1, 1, 1, 9]])
    score, at = force_align(x, [1, 2, 3])
    assert at == [1, 2, 4] and score <= 0
    plain = force_align(x, [1, 2, 3], skippable=[False] * 3, intrusive=[], sites=[True] * 3)
    assert plain == (score, at)
    skipped = probs([[9, 1, 1, 1], [1, 9, 1, 1], [1, 1, 1, 9]])
    assert force_align(skipped, [1, 2, 3], skippable=[False, True, False])[1] == [1, -1, 2]
    assert force_align(skipped, [1, 2, 3], skippable=[False, True, False], penalty=50)[1] == [0, 1, 2]
    intruded = probs([[1, 9, 1, 1], [1, 1, 1, 9], [1, 1, 9, 1]])
    assert force_align(intruded, [1, 2], intrusive=[3], sites=[False, True])[0] > force_align(intruded, [1, 2])[0]
    assert force_align(x[:1], [1, 2])[1] == [-1, -1]


def test_components(spark):
    assert graph_components([("a", "b"), ("b", "c")], list("abcd")) == [("a", 0, 3, 2), ("b", 0, 3, 2), ("c", 0, 3, 2), ("d", 1, 1, 0)]
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("x", "y"), ("y", "x")]
    got = {r.node: r.label for r in label_propagation(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert set(got.values()) == {"n000", "x"} and got["n040"] == "n000" and len(got) == 43


def test_estimation(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcd", k=5)) for _ in range(120)]
    df = spark.createDataFrame([(w, w.replace("a", "x") if i % 3 else w) for i, w in enumerate(words)], "s string, t string")
    rows, deltas = estimate(df, "s", "t")
    p = {(s, t): v for s, t, v in rows}
    assert 0.5 < p["a", "x"] < 0.8 and p["b", "b"] > 0.95 and deltas[-1] < deltas[0]
    for s in "abcd":
        assert abs(sum(v for (x, _), v in p.items() if x == s) - 1) < 1e-6
