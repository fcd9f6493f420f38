"""Ways to type a thing, and things that are not on the list."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm import canonical
from loomwright.llm.canonical import canonical_values, map_fields, map_values

TERMS = [
    (1, "object", "cargo gearbox", ["cargo transmission"]),
    (2, "object", "main sensor", ["main probe"]),
    (3, "object", "cabin hose", []),
    (4, "object", "main valve", None),
    (5, "action", "grind", []),
    (6, "action", "tag", ["put a tag on"]),
    (7, "action", "replace", ["swap out"]),
    (5, "action", "grind", []),
]
MEANT = {
    "object": {"Cargo  Gearbox - worn": 1, "gearbox (cargo)": 1, "cagro gearbx": 1, "cargo_transmission": 1, "cаrgo gеarbox": 1, "crg grbx": 1, "carg. gearbox": 1, "cargogearbox": 1, "main probe no. 5": 2, "sensor / main": 2,
               "main hose": 0, "main gearbox": 0, "stapler": 0, "6": 0, "cargo": 0, "the main valves": 4},
    "action": {"ground": 5, "grinding": 5, "please grind": 5, "Put a tag on": 6, "tagged": 6, "rplc": 7, "replacing": 7, "swap out": 7, "sketch": 0, "??": 0},
}


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame([(*t, "x") for t in TERMS], "term_id int, kind string, name string, aliases array<string>, value string")


def test_values(spark, terms):
    rows = [(k, v) for k, vs in MEANT.items() for v in vs] + [("object", None), ("object", " \xa0"), ("object", "x" * 20000), ("object", "main valve")] * 2
    got = {(r.kind, r.value): r.term_id for r in map_values(spark.createDataFrame(rows, "kind string, value string"), terms).collect()}
    for kind, values in MEANT.items():
        for value, term in values.items():
            assert got[kind, value] == term, value
    assert got["object", "x" * 20000] == 0 and ("object", None) not in got and ("object", " \xa0") not in got


def test_fields(spark, terms):
    rows = spark.createDataFrame([("n1", "grind", "cagro gearbox", 1), ("n1", "grind", "cagro gearbox", 1), ("n2", None, "", 2), ("n3", "grinds", None, 3)], "node_id string, action string, object string, term_id int")
    assert {tuple(r) for r in map_fields(rows, terms).collect()} == {("n1", "object", 1), ("n3", "action", 5)}
    assert map_fields(rows.where("false"), terms).collect() == []
    assert {r.term_id for r in map_fields(rows, terms.where("false")).collect()} == {0}


def test_one_spelling(spark, terms):
    rows = [("action", v) for v in ("sketch", "sketches", "Sketching.", "skеtch")] + [("object", v) for v in ("main hose", "hose, main", "the main hoses")]
    got = {(r.kind, r.canon) for r in canonical_values(spark.createDataFrame(rows, "kind string, value string"), terms).collect()}
    assert len(got) == 2


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("abc ", min_size=3, max_size=9), min_size=1, max_size=6), st.lists(st.text("abc ", min_size=3, max_size=9), min_size=1, max_size=6))
def test_the_join_finds_all_within_two_edits(spark, typed, names):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    q = spark.createDataFrame([("k", x) for x in set(typed)], "kind string, q string")
    r = spark.createDataFrame([("k", x) for x in set(names)], "kind string, form string")
    got = {(x.q, x.form) for x in canonical.close_strings(q, r).collect()}
    assert got == {(a, b) for a in typed for b in names if edits(a, b) <= canonical.K}


def test_strings_before_words(spark):
    terms = spark.createDataFrame([(1, "object", "relief valve", ["prv"]), (2, "object", "relief valve seat", None), (3, "object", "brake", [])], "term_id int, kind string, name string, aliases array<string>")
    typed = spark.createDataFrame([("object", v) for v in ("Relief  Valve", "releif valve", "relief valves", "PRV", "relief valve seet", "old relief valve", "brakes and relief valve", "xyz")], "kind string, value string")
    got = {r.value: (r.term_id, r.cost) for r in canonical.match_strings(typed, terms).collect()}
    assert got == {"Relief  Valve": (1, 0.0), "releif valve": (1, 1.0), "relief valves": (1, 1.0), "PRV": (1, 0.0), "relief valve seet": (2, 1.0)}
    assert {r.value: r.term_id for r in canonical.map_values(typed, terms).collect()} == {v: t for v, (t, _) in got.items()} | {"old relief valve": 1, "brakes and relief valve": 1, "xyz": 0}
