"""Which value survives, and the alignment beneath."""

from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm import consensus

T = st.lists(st.sampled_from("abcd"), max_size=7)


@settings(max_examples=200, deadline=None)
@given(T, T)
def test_alignment_is_a_longest_common_subsequence(a, b):
    columns = consensus.align(a, b)
    assert [i for i, _ in columns if i >= 0] == list(range(len(a))) and [j for _, j in columns if j >= 0] == list(range(len(b)))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    assert sum(i >= 0 and j >= 0 and a[i] == b[j] for i, j in columns) == best[-1][-1]


def test_votes():
    good = "Repair the valve seat now".split()
    assert consensus.votes("Rep¤ir the valve seat now".split(), [(good, 0.5), (good, 0.25)]) == {0: (0.75, 0.0)}
    assert consensus.votes("Repair the va?ve seat".split(), [(good, 1.0), ("Repair the va?ve".split(), 3.0)]) == {2: (1.0, 3.0)}
    assert consensus.votes("Is the valve dry? Repair it.".split(), [(good, 1.0)]) == {}
    assert not consensus.damaged_form("Rep¤¤¤¤ir", "Repair") and not consensus.damaged_form("Repaid", "Repair") and consensus.damaged_form("Re¤ir", "Repair")


def run(spark, rows, part=None):
    kind = "record_id long, workflow_id string, trust int, recorded_at string, pages array<int>, sections array<string>, evidence_sources array<struct<document:string,page:int,section:string,sentence:string,chunk_id:string,action_id:string>>, summary string, value string"
    df = spark.createDataFrame([(*r, "x") for r in rows], kind)
    df = df.withColumn("recorded_at", df.recorded_at.cast("timestamp_ntz"))
    before = consensus.PART
    consensus.PART = part or before
    try:
        return {(r.workflow_id, r.field): r.record_id for r in consensus.survivors(df).collect()}
    finally:
        consensus.PART = before


def e(*sentences):
    return [("d", 1, "s", x, None, None) for x in sentences]


FULL = "4.1 Repair: Operator performs: grind valve → weld cover"
ROWS = [
    (1, "w", 2, "2031-01-01", [3, 4], ["4.1 Repair"], e("a", "b"), FULL),
    (2, "w", 1, "2031-01-02", [4], ["TBD"], e("a"), "Operator performs: grind valve → weld cover"),
    (3, "w", 1, "2031-01-03", [0], [], e("?", "n/a"), "4.1 Repair: Operator performs: grind va…"),
    (4, "w", 1, None, [5, 6], ["4.1 Former Repair"], None, "4.1 Rep�ir: Operator performs: grind valve → weld cover"),
    (5, "w", 3, "2031-01-04", None, None, [], "summary pending"),
    (6, "w", 1, "2031-01-01", [4, 3], ["4.1 Repair"], e("b", "a"), None),
    (6, "w", 1, "2031-01-01", [4, 3], ["4.1 Repair"], e("b", "a"), None),
    (7, "v", None, None, [], [""], None, " "),
    (8, None, 1, "2031-01-01", [1], ["x y"], e("a"), FULL),
]


def test_survivors(spark):
    wanted = {("w", "pages"): 6, ("w", "sections"): 6, ("w", "evidence_sources"): 6, ("w", "summary"): 1}
    assert run(spark, ROWS) == wanted
    assert run(spark, ROWS, part=2) == wanted  # split groups
    assert run(spark, []) == {}


def test_a_spoilt_value_is_a_witness_whatever_the_parts(spark):
    rows = [(1, "w", 1, "2031-01-01", [1, 2], None, None, None), (2, "w", 1, "2031-01-02", [0, 1, 2], None, None, None), (3, "v", 1, "2031-01-01", [1], None, None, None), (4, "v", 1, "2031-01-02", [1, 2, 0], None, None, None), (5, "v", 1, "2030-01-01", [7], None, None, None)]
    for part in (256, 2, 1):
        assert run(spark, rows, part) == {("v", "pages"): 5}


def test_the_vote_decides(spark):
    """The newest summary is garbled in a way no list names; the others outvote it, and where they do not, it stays."""
    texts = ["Operator performs: grind valve", "Operator performs: grind valve → weld cover", "Operator performs: grind va¤ve → weld cover → tag hose"]
    rows = [(i, "w", 1, f"2031-01-0{i + 1}", None, None, None, t) for i, t in enumerate(texts)]
    alone = [(9, "u", 1, "2031-01-01", None, None, None, texts[2])]
    split = [(20 + i, "x", 1, f"2031-01-0{i + 1}", None, None, None, t) for i, t in enumerate([texts[1], texts[2], texts[2].replace("tag", "lock"), texts[2].replace("tag", "clean") + "s"])]
    for part in (256, 1):
        assert run(spark, rows + alone + split, part) == {("w", "summary"): 1, ("u", "summary"): 9, ("x", "summary"): 23}


def test_large_groups(spark):
    rows = [(i, "w", 1, "2031-01-01", list(range(1, 2 + i)), None, None, f"Operator performs: step {i} of many") for i in range(40)]
    assert run(spark, rows, 3) == run(spark, rows) == {("w", "pages"): 39, ("w", "summary"): 0}
    hidden = [(100 + i, "w", 1, "2032-01-01", None, None, None, f"Operator performs: no. {i}") for i in range(9)] + [(200 + i, "w", 1, "2030-01-01", None, None, None, f"Operator performs: no. {i} and more") for i in range(9)]
    assert run(spark, rows + hidden, 3)["w", "summary"] == run(spark, rows + hidden)["w", "summary"] == 0
