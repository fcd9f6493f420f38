"""Operators do the whole job: every row asks, nothing is left out."""

import os

import numpy as np
import pytest

from loomwright import config
from loomwright.operators import markers, retrieval, similarity, workflows
from loomwright.plans import catalog

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def leaders(pairs, ids):
    before, out = {}, {}
    for a, b in pairs:
        before.setdefault(b, []).append(a)
    for v in sorted(ids):
        out[v] = min((a for a in before.get(v, ()) if out[a] == a), default=v)
    return out


@tables
def test_leader_dedup_compares_all_rows(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in zip(*np.nonzero(x @ x.T >= 0.3)) if i < j]
    assert any(a % 20 and b % 20 for a, b in pairs)
    got = {r.id: r.leader for r in catalog.queries()["leader_dedup"](spark, DATA).collect()}
    assert got == leaders(pairs, ids)


def test_pairs_and_leaders_do_not_depend_on_blocks_and_rounds(spark):
    x = np.random.default_rng(3).normal(size=(60, 4))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    wanted = {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.8}
    pairs = similarity.similar_pairs(vectors, 0.8, block=16)
    got = [(r.a, r.b) for r in pairs.collect()]
    assert len(got) == len(wanted) and set(got) == wanted
    for few in (0, 10**6):
        assert {r.id: r.leader for r in similarity.leader_dedup(vectors, pairs, few).collect()} == leaders(wanted, range(60))


KIND = """workflow_id string, summary string, title_hint string, sections array<string>,
nodes array<struct<node_id:string,actor:string,action:string,object:string,ord:int,page:int,section:string,sentence:string,action_id:string>>,
evidence_sources array<struct<document:string,page:int,section:string,sentence:string,chunk_id:string,action_id:string>>"""


def flow(name, summary, title, steps, said=()):
    return (name, summary, title, [], [(f"{name}{i}", None, a, o, i, 1, None, s, None) for i, (a, o, s) in enumerate(steps)], [("d", 1, None, s, None, None) for s in said])


FLOWS = [
    flow("wf_a", "Crew performs: polish mirror", "Polish", [("polish", "mirror", "Polish the mirror with felt.")], ["Wipe felt dry.", "Polish the mirror with felt."]),
    flow("wf_b", None, None, [("torque", "gearbox flange", "Torque the gearbox flange to value.")]),
    flow("wf_c", "Crew performs: polish lens", "Lens", [("polish", "lens", None), ("rinse", "lens", None)]),
]


def test_search_reads_steps_and_sentences(spark):
    w = spark.createDataFrame(FLOWS, KIND)
    q = spark.createDataFrame([("q1", "torque gearbox flange"), ("q2", "polish the mirror")], "question_id string, question string")
    hits = retrieval.search(q, workflows.index_entries(w), 2).collect()
    assert {(h.question_id, h.workflow_id, h.score) for h in hits if h.rank == 1} == {("q1", "wf_b", 1.0), ("q2", "wf_a", 0.816497)}
    assert len({(h.question_id, h.workflow_id) for h in hits}) == len(hits)


def test_answers_rank_candidates_and_score_all_without_hits(spark):
    w = spark.createDataFrame(FLOWS, KIND)
    q = spark.createDataFrame([("q1", "torque gearbox flange"), ("q2", "polish the mirror")], "question_id string, question string")
    # The first hit of q2 has the lower blended score; q1 has no hit that reaches the least score.
    hits = spark.createDataFrame([("q2", "wf_c", "", 0.9, 1), ("q2", "wf_a", "", 0.8, 2), ("q1", "wf_c", "", 0.1, 1)], "question_id string, workflow_id string, vector_id string, score double, rank int")
    got = {r.question_id: r for r in retrieval.answers(q, hits, w).collect()}
    assert {k: r.workflow_id for k, r in got.items()} == {"q1": "wf_b", "q2": "wf_a"}
    assert got["q1"].confidence == 100
    assert got["q2"].explanation.endswith("Polish the mirror with felt. / Wipe felt dry.")


def test_query_weights_are_read(spark):
    w = spark.createDataFrame(FLOWS, KIND)
    q = spark.createDataFrame([("q2", "polish the mirror")], "question_id string, question string")
    hits = spark.createDataFrame([("q2", "wf_a", "", 0.8, 1)], "question_id string, workflow_id string, vector_id string, score double, rank int")
    settings = config.load(values={"similarity": {"query_weights": [0.0, 0.0]}})
    assert [r.confidence for r in retrieval.answers(q, hits, w, settings).collect()] == [0]


def test_missing_sides_are_filled(spark):
    said = ["Then install the valve.", "Clean the seat then close it; open the cover before draining.", "Then", "Torque the bolt, then", "Then wipe, dry it"]
    sentences = spark.createDataFrame([("c" if i else "d", i, s) for i, s in enumerate(said)], "chunk_id string, sent_index int, sentence string")
    actions = spark.createDataFrame([("c", 0, "lift lid"), ("c", 1, "seal lid")], "chunk_id string, ord bigint, label string")
    got = {(r.sent_index, r.clause): (r.source, r.target) for r in markers.filled_edges(sentences, actions).collect()}
    # The fill of the first gives equal sides, which is no edge; the last has the comma form.
    assert got == {(1, 0): ("Clean the seat", "close it"), (1, 1): ("draining", "open the cover"), (2, 0): ("lift lid", "seal lid"), (3, 0): ("Torque the bolt", "seal lid")}
    more = spark.createDataFrame([("d", 0, "lift lid")], "chunk_id string, ord bigint, label string")
    first = markers.filled_edges(sentences.where("sent_index = 0"), more).collect()
    assert [(r.source, r.target) for r in first] == [("lift lid", "install the valve")]
