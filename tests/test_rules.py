"""Line, sentence and label rules against spelt-out cases."""

import pytest
from pyspark.sql import functions as F

from loomwright.functions import text as X
from loomwright.operators import actions, coref, markers

CLASSES = [
    ("Inspect the crack", "heading"),
    ("Inspect the crack.", "paragraph"),
    ("7.2 Weld Repair", "heading"),
    ("1. Inspect the crack", "step"),
    ("Step 3: Grind", "step"),
    ("- clean bolt", "list_item"),
    ("* clean bolt", "paragraph"),
    ("(a) clean bolt", "list_item"),
    ("Part of the assembly is hot.", "heading"),
    ("Grin", "paragraph"),
    ("# Heading", "paragraph"),
    ("A. Intro text", "step"),
]


def col(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select(f(F.col("v")).alias("x"), "i").orderBy("i").collect()]


def test_unit_classes(spark):
    assert col(spark, [c[0] for c in CLASSES], X.unit_class) == [c[1] for c in CLASSES]


def test_step_numbers(spark):
    given = ["1. Inspect", "Step 3: go", "4.5 Engine", "12 bolts are", "3) x", "7"]
    assert col(spark, given, X.step_number) == [1, 3, 4, 12, 3, None]


def test_conditions(spark):
    given = ["If UT indicates incomplete fusion, repeat steps 5–7.", "If x, stop.", "Unless dry, wait.", "3. If crack, redo step 2"]
    assert col(spark, given, X.is_conditional) == [True, False, True, False]
    rows = actions.conditions(spark.createDataFrame([(g,) for g in given], "sentence string")).collect()
    assert rows[0].target_steps == [5, 6, 7] and rows[0].rework == "repeat"


def test_list_separators(spark):
    got = col(spark, ["A → B → C", "A → B → C → D", "a --> b --> c --> d"], X.list_parts)
    assert [len(x) for x in got] == [1, 4, 4]


def test_markers(spark):
    rows = spark.createDataFrame([("Before welding, preheat the plate.",), ("Grind it after cooling.",), ("Nothing here.",), (None,)], "sentence string")
    comma = markers.comma_edges(rows).collect()
    assert [(r.relation, r.source, r.target) for r in comma] == [("BEFORE", "preheat the plate", "welding")]
    infix = markers.infix_edges(rows).collect()
    assert [(r.relation, r.source, r.target) for r in infix] == [("AFTER", "Grind it", "cooling")]


COREFERENCE = [
    (None, None), ("", ""), ("Clean it.", "Clean it."), ("Open the valve. it drains fast.", "Open the valve. the valve drains fast."), ("Remove the cover. Clean it.", "Remove the cover. Clean Clean."),
    ("The pump is hot. Let it cool. Check its seal.", "The pump is hot. Let Let cool. Check Check's seal."), ("Lift the lid. that and this and it go.", "Lift the lid. the lid and the lid and it go."),
]


def test_coreference(spark):
    assert col(spark, [g for g, _ in COREFERENCE], coref.resolve) == [w for _, w in COREFERENCE]


def test_coreference_of_sentences_before(spark):
    assert col(spark, ["Remove the cover. Clean it."], lambda c: coref.resolve(c, previous_only=True)) == ["Remove the cover. Clean the cover."]


def test_coreference_of_chunks(spark):
    rows = spark.createDataFrame([("heading", "Lift the lid. Clean it."), ("paragraph", "Do it."), ("paragraph", "Lift the lid. it is hot.")], "unit_type string, text string")
    assert [r.resolved for r in coref.resolve_chunks(rows).collect()] == ["Lift the lid. Clean it.", "Do it.", "Lift the lid. the lid is hot."]


EXTRACTED = [
    ("The technician shall drain the upper sensor.", "agent", "technician", "drain", "the upper sensor"),
    ("2. The operator closes the valve.", "agent", "operator", "close", "the valve"),
    ("Allow the joint to cool for 10 minutes.", "causative", None, "cool", "joint"),
    ("After inspection, remove the cover.", "imperative", None, "remove", "the cover"),
    ("3) Grind the surface.", "imperative", None, "grind", "the surface"),
    ("12 V test", "imperative", None, "v", "test"),
]


def test_extraction(spark):
    chunks = spark.createDataFrame([(str(i), "d", i, "step", None, 1, 1, x[0]) for i, x in enumerate(EXTRACTED)], "chunk_id string, document_id string, order_index int, unit_type string, section string, page int, paragraph int, text string")
    got = {r.chunk_id: r for r in actions.extract(chunks).collect()}
    for i, (_, rule, actor, action, obj) in enumerate(EXTRACTED):
        r = got[str(i)]
        assert (r.extraction, r.actor, r.action, r.object) == (rule, actor, action, obj)
    assert got["2"].duration == "10 minutes" and got["4"].step_number == 3 and got["4"].sentence == "3) Grind the surface."


SPURIOUS = [
    ("perform", "7", None, "7", None), ("weld", "x", None, "Where is the weld?", None), ("follow", "steps", None, "Follow the steps.", 1), ("do", "inspection", None, "After that do inspection", 1),
    ("use", "the process for welding", None, "Use the process for welding.", 1), ("go", "x" * 90, None, "Go " + "x" * 90, None), ("apply", "glue", None, "Glue differs from tape, apply it.", 1), ("do", "it", "This Section", "Do it.", 1),
]


def test_spurious_actions(spark):
    rows = spark.createDataFrame([*SPURIOUS, ("grind", "the edge", None, "Grind the edge.", None), ("go", "x" * 90, None, "Go " + "x" * 90, 4)], "a string, o string, w string, s string, n int")
    flags = [r[0] for r in rows.select(X.is_spurious_action(*[F.col(c) for c in "aowsn"])).collect()]
    assert flags == [True] * len(SPURIOUS) + [False, False]


def test_spurious_nodes_by_sentence(spark):
    rows = spark.createDataFrame([("weld", "x", "6."), ("weld", "x", "THIS IS A LONG TITLE (PART 2)"), ("weld", "x", "This procedure tells all."), ("weld", "x", "Weld x."), ("perform", "12", None), ("weld", "x", None)], "a string, o string, s string")
    assert [r[0] for r in rows.select(X.is_spurious_node(F.col("a"), F.col("o"), F.col("s"))).collect()] == [True, True, True, False, True, False]


def test_all_domain_phrases(spark):
    got = col(spark, ["Where are the weld repair and the  Field  Repair, the weld repair?", "How do I torque bolts", "Bolts?"], X.query_phrases)
    assert got == [["weld repair", "field repair"], ["i torque bolts"], []]
