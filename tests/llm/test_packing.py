"""Packing places every token once, never over the capacity."""

import os
from collections import defaultdict

import numpy as np
import pytest

from loomwright.llm import packing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json")), reason="no vocabulary files here")


def test_packing(spark):
    texts = [(i, "grind the valve " * (1 + i % 7)) for i in range(60)] + [(100, "x y z " * 200), (101, None), (102, ""), (103, "same"), (103, "same"), (None, "no id")]
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    count = tokens.Encoder(tokens.TokenAutomaton.load(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json")))
    sizes = {(i, t): len(count(t)) for i, t in texts}
    got = packing.pack_texts(rows, capacity=64, shard=300).collect()
    room, placed = defaultdict(int), defaultdict(list)
    for r in got:
        room[r.container] += r.tokens
        placed[r.doc_id].append((r.start_at, r.tokens))
    assert max(room.values()) <= 64
    for doc in range(60):
        assert placed[doc] == [(0, sizes[doc, texts[doc][1]])]
    long = sorted(placed[100])
    assert [s for s, _ in long] == list(range(0, sizes[100, texts[60][1]], 64)) and sum(n for _, n in long) == sizes[100, texts[60][1]]
    assert 101 not in placed and 102 not in placed and len(placed[103]) == 2 and len(placed[None]) == 1
    assert len(room) <= 1.25 * sum(room.values()) / 64 + 2
    assert packing.pack_texts(rows.where("false"), capacity=64).collect() == []


def test_partitioning_changes_nothing(spark):
    texts = [(i, " ".join(f"part{(i * k) % 23}" for k in range(1, 5 + i % 9))) for i in range(80)] + [(5, "same again")] * 3
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    found = [sorted(map(tuple, packing.pack_texts(rows.repartition(k), capacity=64, shard=700).collect())) for k in (1, 5)]
    assert found[0] == found[1] and len(found[0]) == len(texts)


def test_scores_use_every_term():
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, 60, rng.integers(1, 40)) for _ in range(50)]
    rarity = rng.random(60)
    index = packing.Bm25(ids, rarity)
    mean = np.mean([len(x) for x in ids])
    for seed in range(50):
        got = index.scores(seed, [seed, *range(5)])
        for i, item in enumerate(ids):
            norm = packing.K1 * (1 - packing.B + packing.B * len(item) / mean)
            want = sum((c := (item == t).sum()) * (packing.K1 + 1) / (c + norm) * rarity[t] for t in set(ids[seed].tolist()))
            # A term that one item alone holds adds to that item's own score only.
            assert i == seed or abs(got[i] - want) < 1e-4
