"""From texts to workflows on small documents with known results."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.operators import build, graphs, units

TWO = """4.3 Panel Crack Repair Procedure
Note that the panel must be dry.
1. Inspect the crack.
2. Remove damaged material.
3. Grind the surface.
If testing shows a defect, repeat steps 2-3.
4.4 Bolt Torque Check
1. Clean the bolt threads.
2. Apply torque.
3. Mark the bolt head."""


@pytest.fixture(scope="module")
def built(spark):
    docs = spark.createDataFrame([("two", TWO), ("list", "Role → Context → Objective → Input"), ("short", "A → B → C"), ("none", None)], "document_id string, text string")
    names = spark.createDataFrame([("two", "two_sections.txt")], "document_id string, source_name string")
    return build.build_workflows(units.chunk_units(units.text_units(docs, "document_id")), names)


def test_units(spark):
    docs = spark.createDataFrame([("two", TWO)], "document_id string, text string")
    rows = units.text_units(docs, "document_id").orderBy("unit_no").collect()
    assert [r.unit_type for r in rows] == ["heading", "paragraph", "step", "step", "step", "paragraph", "heading", "step", "step", "step"]
    assert [r.paragraph for r in rows] == [None, 1, 2, 3, 4, 5, None, 6, 7, 8]
    assert {(r.page, r.page_count) for r in rows} == {(1, 2)}


def test_actions_and_discourse(built):
    labels = {d: [r.label for r in built.actions.where(f"document_id = '{d}'").orderBy("ord").collect()] for d in ("two", "list")}
    assert labels["two"] == ["inspect the crack", "remove damaged material", "grind the surface", "clean the bolt threads", "apply torque", "mark the bolt head"]
    assert labels["list"] == ["role", "context", "objective", "input"]
    edges = built.discourse.where("document_id = 'two'").collect()
    assert sorted(e.relation for e in edges) == ["IF"] + ["THEN"] * 4
    assert [(e.source_action_id, e.target_action_id) for e in edges if e.relation == "IF"] == [(None, None)]


def test_workflows(built):
    got = {(r.document_id, r.title_hint): r for r in built.workflows.collect()}
    first, second, chain = got["two", "4.3 Panel Crack Repair Procedure"], got["two", "4.4 Bolt Torque Check"], got["list", None]
    assert first.summary == "4.3 Panel Crack Repair Procedure: Operator performs: inspect the crack → remove damaged material → grind the surface"
    assert chain.summary == "Operator performs: role → context → objective → input"
    for w in (first, second):
        assert sorted((e.relation, e.weight, e.evidence) for e in w.edges) == [("NEXT", 1.0, "numbered_step")] * 2 + [("THEN", 1.0, "numbered_step")] * 2
        assert len(w.evidence_sources) == 3 and {e.document for e in w.evidence_sources} == {"two_sections.txt"} and w.context_notes == [] and w.pages == [1]
    assert [(b.condition, b.action, b.target_steps) for b in first.conditional_branches] == [("testing shows a defect", "repeat", [2, 3])] and second.conditional_branches == []
    assert first.metadata["boundary_confidence"] == "1.0" and second.metadata["boundary_confidence"] == "0.49"


def test_unnumbered_repeats_of_steps_go_and_order_is_that_of_numbers(spark):
    rows = [("w", "a1", 5, 1, None, "remove the cover carefully"), ("w", "a2", 1, 1, 2, "remove the cover"), ("w", "a3", 2, 1, 1, "lift lid"), ("w", "a4", 3, 1, None, "wipe"), ("w", "a5", 4, 1, None, "wipe the seat"), ("w", "a6", 6, 1, None, "this procedure tells all")]
    actions = spark.createDataFrame([(w, a, o, p, n, label, label) for w, a, o, p, n, label in rows], "workflow_id string, action_id string, ord bigint, page int, step_number int, label string, sentence string")
    got = graphs.pick_nodes(actions).orderBy("ord").collect()
    assert [(r.action_id, r.ord) for r in got] == [("a3", 0), ("a2", 1), ("a5", 2)]


LABELS = st.lists(st.lists(st.sampled_from(["lift", "lid", "wipe", "seat"]), max_size=3).map(" ".join), max_size=6)


@settings(max_examples=200, deadline=None)
@given(LABELS)
def test_kept_labels_hold_no_other(labels):
    kept = [labels[k] for k in graphs._kept(labels)]
    assert len(set(kept)) == len(kept)
    assert not any(graphs.subsumes(a, b) for a in kept for b in kept)


def test_phrases_find_nodes_and_edges_join_groups(spark):
    text = "1. Open the valve.\n2. Drain the tank.\nAfter you open the valve, drain the tank."
    docs = spark.createDataFrame([("d", text)], "document_id string, text string")
    b = build.build_workflows(units.chunk_units(units.text_units(docs, "document_id")))
    (w,) = b.workflows.collect()
    names = {n.node_id: n.action for n in w.nodes}
    after = [(names[e.source], names[e.target]) for e in w.edges if e.relation == "AFTER"]
    assert after == [("open", "drain")] and w.document is None


def test_no_chunks(spark):
    docs = spark.createDataFrame([], "document_id string, text string")
    b = build.build_workflows(units.chunk_units(units.text_units(docs, "document_id")))
    assert b.workflows.collect() == [] and b.edges.collect() == []
