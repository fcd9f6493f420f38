"""Tiles against exact products; the search's recall against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm import vectors


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(1, 60), st.integers(1, 6), st.booleans(), st.integers(0, 9))
def test_tile_is_exact(n, m, k, same, seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, 8)).astype(np.float32)
    b = a if same else rng.normal(size=(m, 8)).astype(np.float32)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    i, j, c = vectors.tile_best(a, b, k, same)
    exact = a.astype(float) @ b.astype(float).T
    if same:
        np.fill_diagonal(exact, -9)
    for row in range(n):
        wanted = np.sort(exact[row])[::-1][: min(k, len(b) - same)]
        assert np.allclose(np.sort(c[i == row])[::-1], wanted, atol=1e-5)


def test_search(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(300, 64))
    x = np.repeat(centres, 7, axis=0) + rng.normal(size=(2100, 64)) * 0.2
    x[50:60] = x[50]  # equal vectors
    rows = [(int(i), [float(v) for v in e]) for i, e in enumerate(x)]
    rows += [rows[7], (9001, None), (9002, [0.0] * 64), (9003, [1.0] * 32), (9004, [float("nan")] * 64), (None, [1.0] * 64)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vector_id long, embedding array<float>, id int")
    got = {}
    for r in vectors.nearest_vectors(df).collect():
        got.setdefault(r.vector_id, []).append(r.near_id)
    assert sorted(got) == list(range(2100)) and all(len(v) == 5 == len(set(v)) and k not in v for k, v in got.items())
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    bar = np.sort(s, axis=1)[:, -5]
    hits = sum(s[i, j] >= bar[i] - 1e-6 for i, js in got.items() for j in js)
    assert hits >= 0.97 * 5 * 2100


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few(spark, n):
    df = spark.createDataFrame([(i, [float(i + 1)] + [1.0] * 63) for i in range(n)], "vector_id long, embedding array<float>")
    assert vectors.nearest_vectors(df).count() == n * (n - 1)


def test_alone_in_their_cells(spark, monkeypatch):
    """Vectors whose cells hold no others still get their five, and the right ones."""
    monkeypatch.setattr(vectors, "CELL", 10)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.repeat(rng.normal(size=(6, 64)), 30, axis=0) + rng.normal(size=(180, 64)) * 0.01, rng.normal(size=(8, 64)) * 9])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vector_id long, embedding array<float>")
    got = {}
    for r in vectors.nearest_vectors(rows).collect():
        got.setdefault(r.vector_id, set()).add(r.near_id)
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert len(got) == 188 and all(len(v) == 5 for v in got.values())
    alone = [i for i in range(180, 188) if got[i] == set(np.argsort(-s[i])[:5].tolist())]
    assert len(alone) >= 4


@pytest.mark.parametrize("flat", [10**6, 4])
def test_cells_of_many_vectors(monkeypatch, flat):
    """Recall of the cells, as a flat list and as a list of lists, against brute force."""
    monkeypatch.setattr(vectors, "FLAT", flat)
    monkeypatch.setattr(vectors, "CELL", 100)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(2_000, 64)), 6, axis=0) + rng.normal(size=(12_000, 64)) * 0.25
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    cells = vectors.Cells(x[::3], len(x))
    assert (cells.heads is None) == (flat > 1000) and len(cells.centres) > 60 and abs(cells.share.sum() - 1) < 1e-6
    near = cells.nearest(x, vectors.PROBES)
    assert all(len(set(r)) == vectors.PROBES for r in near[:500].tolist())
    asked = np.arange(0, len(x), 20)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -9
    true = np.argsort(-s, axis=1)[:, :5]
    held = [set(r) for r in near.tolist()]
    hits = sum(bool(held[i] & held[j]) for i, js in zip(asked, true) for j in js)
    assert hits >= 0.9 * true.size
