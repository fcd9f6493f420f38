"""Duplicates, merging, sanitising and the vector table on small collections."""

import math

import pytest

from loomwright import config
from loomwright.operators import dedup, retrieval
from loomwright.sources.store import Store, VectorStore

KIND = """workflow_id string, document string, document_id string, pages array<int>, sections array<string>,
nodes array<struct<node_id:string,actor:string,action:string,object:string,ord:int,page:int,section:string,sentence:string,action_id:string>>,
edges array<struct<source:string,target:string,relation:string,weight:double,evidence:string>>,
evidence_sources array<struct<document:string,page:int,section:string,sentence:string,chunk_id:string,action_id:string>>,
summary string, title_hint string, merged_from array<string>, metadata map<string,string>"""


def flow(i, summary, pages=(1,), sections=("s",), said=(), steps=(("grind", "valve", None),), merged=(), paper="d", edges=()):
    nodes = [(f"n{k}", None, a, o, k, 1, None, s, None) for k, (a, o, s) in enumerate(steps)]
    return (i, paper, "doc", list(pages), list(sections), nodes, list(edges), [(paper, 1, None, s, None, None) for s in said], summary, None, list(merged), {"k": "v"})


@pytest.fixture(scope="module")
def flows(spark):
    rows = [
        flow("w1", "grind the valve and weld the cover now", (3, 1), ("a", "b"), ("x", "y"), paper="one"),
        flow("w2", "grind the valve and weld the cover now", (2,), ("b", "c"), ("y", "z"), merged=("w0",), paper="two"),
        flow("w2", "grind the valve and weld the cover now", (2,), ("b", "c"), ("y", "z"), merged=("w0",), paper="two"),
        flow("w3", "grind the valve and weld the cover later", (9,)),
        flow("w4", "polish a lens"),
        flow("w5", None),
    ]
    return spark.createDataFrame(rows, KIND)


def test_find_duplicates(flows):
    got = {r.workflow_id: (r.duplicate_of, r.cosine) for r in dedup.find_duplicates(flows, config.Settings(duplicate_cosine=0.8)).collect()}
    near = round(11 / math.sqrt(12 * 12), 4)  # two of the words share a bucket
    assert got["w1"] == ("w2", 1.0) and got["w2"] == ("w1", 1.0) and set(got) == {"w1", "w2", "w3"}
    assert got["w3"][0] == "w1" and got["w3"][1] == near
    assert {r.workflow_id for r in dedup.find_duplicates(flows).collect()} >= {"w1", "w2"}
    assert dedup.find_duplicates(flows.where("false")).collect() == []


def test_leaders_and_merge(flows):
    led = dedup.leaders(flows, config.Settings(duplicate_cosine=0.8))
    assert {r.workflow_id: r.leader for r in led.collect()} == {"w1": "w1", "w2": "w1", "w3": "w1", "w4": "w4", "w5": "w5"}
    got = {r.workflow_id: r for r in dedup.merge_workflows(flows, led).collect()}
    w = got["w1"]
    assert sorted(got) == ["w1", "w4", "w5"] and w.pages == [1, 2, 3, 9] and w.sections == ["a", "b", "c", "s"]
    assert [e.sentence for e in w.evidence_sources] == ["x", "y", "z"] and w.merged_from == ["w0", "w2", "w3"]
    assert w.metadata == {"k": "v", "merged_documents": "d, one, two"} and w.summary.endswith("now") and got["w4"].metadata == {"k": "v"}


def test_sanitise(spark):
    steps = [("grind", "valve", "Grind the valve."), ("perform", "7", "7."), ("weld", "cover", None)]
    rows = spark.createDataFrame([flow("w", "old", steps=steps, said=("Grind the valve.", "7.", "This procedure tells."), edges=[("n0", "n1", "NEXT", 1.0, None), ("n0", "n2", "NEXT", 1.0, None)]), flow("v", "Operator performs: grind valve", said=("7.",))], KIND)
    got = {r.workflow_id: r for r in dedup.sanitize_workflows(rows).collect()}
    w, v = got["w"], got["v"]
    assert [(n.node_id, n.ord) for n in w.nodes] == [("n0", 0), ("n2", 1)] and [e.target for e in w.edges] == ["n2"] and [e.sentence for e in w.evidence_sources] == ["Grind the valve."]
    assert w.summary == "Operator performs: grind valve → weld cover" and w.changed
    assert not v.changed and [e.sentence for e in v.evidence_sources] == ["7."]


def test_store_merges_and_sanitises(spark, flows, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.sanitize() == 0 and store.merge_duplicates() == 0
    store.save(flows)
    assert store.load().count() == 5
    assert store.merge_duplicates() == 2 and store.load().count() == 3
    assert store.sanitize() == 3 and store.sanitize() == 0


def test_vector_table(spark, flows, tmp_path):
    index = VectorStore(spark, str(tmp_path / "v"))
    assert index.rebuild(flows.where("workflow_id in ('w1', 'w2')")) == 4
    assert index.add(flows.where("workflow_id in ('w2', 'w4')")) == 6
    rows = index.load().collect()
    assert {r.kind for r in rows} == {"summary", "node"} and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in rows)


def test_title_overlap(spark):
    rows = spark.createDataFrame([("Where is the weld repair?", "4.1 Weld Repair of it"), ("Where is the weld repair?", "repair by weld"), ("12?", "x"), ("Where?", "")], "q string, h string")
    assert [r[0] for r in rows.select(retrieval.title_overlap(rows.q, rows.h)).collect()] == [1.0, 0.75, 0.0, 0.0]


def test_best_matches_and_flags(spark, flows):
    scored = spark.createDataFrame([("w1", "w2", 0.5), ("w1", "w4", 0.7), ("w1", "w3", 0.5)], "left_id string, right_id string, blended double")
    assert [(r.right_id, r.rank) for r in dedup.best_matches(scored, 2).orderBy("rank").collect()] == [("w4", 1), ("w2", 2)]
    assert {r.right_id: r.is_duplicate for r in dedup.compare_pairs(scored, flows).collect()} == {"w2": True, "w4": False, "w3": dedup.compare_pairs(scored, flows).where("right_id = 'w3'").first().summary_cosine >= 0.9}
