"""Sequences, graphs and folds against brute force and known values."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.functions import vectors
from loomwright.operators import graphs, segment, similarity

LABELS = st.lists(st.sampled_from("abcd"), max_size=5)


def needleman(a, b, gap=0.35):
    rows = [[-gap * j for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [-gap * i]
        for j, y in enumerate(b, 1):
            row.append(max(rows[-1][j - 1] + (x == y), rows[-1][j] - gap, row[-1] - gap))
        rows.append(row)
    if not a or not b:
        return float(not a and not b)
    n, m = len(a), len(b)
    low, high = -gap * (n + m), min(n, m)
    return min(1, max(0, (rows[-1][-1] - low) / (high - low) * (0.85 + 0.15 * min(n, m) / max(n, m))))


def test_alignment(spark):
    known = [("abc", "abc", 1), ("abc", "abd", 0.8039), ("abc", "xyz", 0.4118), ("ab", "abcd", 0.7671), ("a", "bcdefg", 0.1775), ("", "", 1), ("", "a", 0), ("abab", "ba", None)]
    rows = spark.createDataFrame([(list(a), list(b)) for a, b, _ in known], "x array<string>, y array<string>")
    got = [r[0] for r in rows.select(similarity.align("x", "y")).collect()]
    for (a, b, value), g in zip(known, got):
        assert g == pytest.approx(needleman(a, b), abs=1e-9)
        assert value is None or g == pytest.approx(value, abs=1e-4)


@settings(max_examples=60, deadline=None)
@given(LABELS, LABELS)
def test_graph_similarity_is_bounded_and_one_for_equal(a, b):
    def chain(labels):
        return {str(i): x for i, x in enumerate(labels)}, {(str(i), str(i + 1)): "NEXT" for i in range(len(labels) - 1)}

    assert similarity.graph_similarity(chain(a), chain(a)) == 1
    assert 0 <= similarity.graph_similarity(chain(a), chain(b)) <= 1
    assert similarity.graph_distance(chain(a), chain(b), 10**6) == similarity.graph_distance(chain(b), chain(a), 10**6)


def test_topological_order(spark):
    nodes = spark.createDataFrame([("w", v, o) for v, o in (("c", 0), ("a", 1), ("b", 2), ("x", 3), ("y", 4))], "workflow_id string, node_id string, ord int")
    edges = spark.createDataFrame([("w", "a", "c"), ("w", "x", "y"), ("w", "y", "x"), ("w", "a", "gone")], "workflow_id string, source string, target string")
    got = {r.node_id: r.position for r in graphs.topological_order(nodes, edges).collect()}
    assert sorted(got, key=got.get) == ["a", "c", "b", "x", "y"]


def test_weak_boundaries(spark):
    marks = [(1, 0.5, True), (2, 0.52, True), (3, 0.9, True), (5, 0.5, True), (9, 0.5, True), (10, 0.1, False)]
    gaps = spark.createDataFrame([("d", i, c, b) for i, c, b in marks], "document_id string, idx int, confidence double, is_boundary boolean")
    assert sorted(r.idx for r in segment.drop_weak(gaps).collect()) == [2, 3, 9]


def test_small_groups(spark):
    groups = spark.createDataFrame([("d", i, n) for i, n in enumerate((1, 3, 1, 4, 1))], "document_id string, group_no long, actions long")
    got = [(r.merged_no, r.host) for r in segment.merge_small(groups).orderBy("group_no").collect()]
    assert got == [(0, 1), (0, 1), (0, 1), (1, 3), (1, 3)]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), max_size=8))
def test_greedy_clusters(spark, vectors):
    rows = spark.createDataFrame([("k", f"v{i}", i, [float(x) for x in v]) for i, v in enumerate(vectors)], "k string, id string, pos int, vec array<double>")
    got = {r.id: r.leader for r in similarity.greedy_clusters(rows, "k", 0.8).collect()}

    def cosine(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    leaders, wanted = [], {}
    for i, v in enumerate(vectors):
        lead = next((j for j in leaders if cosine(vectors[j], v) >= 0.8 - 1e-12), i)
        if lead == i:
            leaders.append(i)
        wanted[f"v{i}"] = f"v{lead}"
    assert got == wanted


def plain_distance(a, b, width):
    """The beam search of one pair, candidate by candidate."""
    (na, ea), (nb, eb) = a, b
    left, right = sorted(na), sorted(nb)

    def edge_cost(x, y):
        return 0.0 if x == y else 0.5 if x is not None and y is not None else 1.0

    states = [(0.0, ())]
    for i, v in enumerate(left):
        grown = []
        for cost, done in states:
            free = [j for j in range(len(right)) if j not in done]
            for j in [*free, -1]:
                total = cost + (1.0 if j < 0 else float(na[v] != nb[right[j]]))
                for p, q in [*enumerate(done), (i, j)]:
                    for s, t in {(p, i), (i, p)}:
                        k, m = (q if s == p else j), (j if t == i else q)
                        total += edge_cost(ea.get((left[s], left[t])), eb.get((right[k], right[m])) if k >= 0 and m >= 0 else None)
                later, held = [na[u] for u in left[i + 1 :]], [nb[right[q]] for q in free if q != j]
                common = sum(min(later.count(x), held.count(x)) for x in {*later})
                grown.append((total + max(len(later), len(held)) - common, (*done, j), total))
        states = [(total, done) for _, done, total in sorted(grown)[:width]]

    def rest(done):
        inside = {right[j] for j in range(len(right)) if j not in done}
        return len(inside) + sum(s in inside or t in inside for s, t in eb)

    return min(cost + rest(done) for cost, done in states)


def drawn_graph(draw, labels, nodes):
    ids = draw.sample(range(100), nodes)
    edges = {(s, t): draw.choice(("NEXT", "THEN", "IF")) for s, t in zip(ids, ids[1:])} | {(draw.choice(ids), draw.choice(ids)): "NEXT" for _ in range(3) if ids}
    return {v: draw.choice(labels) for v in ids}, edges


def test_graph_distances_of_many_pairs_are_those_of_each():
    draw = random.Random(3)
    for width in (1, 5, 24):
        pairs = [tuple(drawn_graph(draw, "abcdefghijkl"[:kinds], draw.randint(0, 7)) for _ in "ab") for kinds in (1, 3, 12) for _ in range(25)]
        lefts, rights = zip(*(similarity._numbered(*p) for p in pairs))
        wanted = [plain_distance(a, b, width) for a, b in pairs]
        assert similarity.graph_distances(lefts, rights, width).tolist() == wanted
        assert similarity.graph_distances(lefts, rights, width, cells=1).tolist() == wanted


def test_large_graphs_are_compared_by_distance_too():
    def chain(labels):
        return dict(enumerate(labels)), {(i, i + 1): "NEXT" for i in range(len(labels) - 1)}

    for n in (25, 26, 60):
        one, other = chain([f"a{i}" for i in range(n)]), chain([f"b{i}" for i in range(n)])
        assert similarity.graph_similarity(one, one) == 1
        assert similarity.graph_similarity(one, other) == pytest.approx(1 - plain_distance(one, other, 24) / (4 * n - 2))


def test_many_pairs_of_graphs_take_little_time():
    draw = random.Random(4)
    graphs_ = similarity._numbered(*(drawn_graph(draw, [f"step {i}" for i in range(300)], 14) for _ in range(4000)))
    began = time.process_time()
    similarity.graph_similarities(graphs_[:2000], graphs_[2000:])
    assert time.process_time() - began < 10


def test_structural_takes_the_last_relation_and_keeps_columns(spark):
    names = {"w1": "abc", "w2": "abc", "w3": "a" * 30}
    nodes = spark.createDataFrame([(w, f"{w}-{i:02d}", x) for w, own in names.items() for i, x in enumerate(own)], "workflow_id string, node_id string, normal string")
    links = [("w1", 0, "w1-00", "w1-01", "NEXT"), ("w1", 1, "w1-00", "w1-01", "THEN"), ("w1", 2, "w1-00", "gone", "NEXT"), ("w2", 0, "w2-00", "w2-01", "THEN")]
    edges = spark.createDataFrame(links, "workflow_id string, seq int, source string, target string, relation string")
    pairs = spark.createDataFrame([("w1", "w2", 7), ("w1", "w3", 8)], "left_id string, right_id string, mark int")
    rows = similarity.structural(pairs, nodes, edges)
    assert rows.columns == [*pairs.columns, "structural"]
    got = {r.mark: r.structural for r in rows.collect()}
    assert got == {7: 1.0, 8: round(1 - 30 / 34, 4)}


def test_alignments_of_many_pairs_are_those_of_each(spark):
    draw = random.Random(5)
    rows = [(i, *([draw.choice(["a", "b", "c", "d", None]) for _ in range(draw.randint(0, 9))] for _ in "xy")) for i in range(120)]
    pairs = spark.createDataFrame(rows, "id int, x array<string>, y array<string>")
    wanted = {r.id: r.v for r in pairs.select("id", similarity.align("x", "y").alias("v")).collect()}
    assert {r.id: r.v for r in similarity.alignments(pairs, "x", "y", "v").collect()} == {i: pytest.approx(v, abs=1e-12) for i, v in wanted.items()}


def test_bucket_cosines_of_many_pairs_are_those_of_each(spark):
    draw = random.Random(6)
    rows = [(i, *([draw.randrange(64) for _ in range(draw.randint(0, 30))] for _ in "xy")) for i in range(600)]
    pairs = spark.createDataFrame(rows, "id int, x array<int>, y array<int>")
    wanted = {r.id: r.v for r in pairs.select("id", vectors.bucket_cosine(F.col("x"), F.col("y")).alias("v")).collect()}
    assert {r.id: r.v for r in similarity.scored(pairs, ["x", "y"], "v", vectors.bucket_cosines).collect()} == {i: pytest.approx(v, abs=1e-12) for i, v in wanted.items()}
