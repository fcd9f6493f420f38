"""Hooking against union-find, on chains, hubs and random links."""

import random

import pytest

from loomwright.llm.components import connected_components, merge_groups


def brute(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            up[find(a)] = find(b)
    groups = {}
    for x in list(up):
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


CASES = {
    "chain": [(i, i + 1) for i in range(40)],
    "hub": [(0, i) for i in range(1, 60)] + [(100, 101)],
    "random": [(random.Random(i).randrange(60), random.Random(i + 999).randrange(60)) for i in range(45)],
    "odd": [(1, 1), (2, None), (None, None), (3, 4), (4, 3), (3, 4)],
    "none": [],
}


@pytest.mark.parametrize("case", CASES)
def test_components(spark, case):
    rows = spark.createDataFrame([(a, b, "x") for a, b in CASES[case]], "src long, dst long, root string")
    groups = {}
    for r in connected_components(rows).collect():
        groups.setdefault(r.root, set()).add(r.id)
    assert {frozenset(g) for g in groups.values()} == brute(CASES[case])
    assert all(root in g for root, g in groups.items())


def test_merge_groups(spark):
    w = [f"wf_{i:012x}" for i in range(9)]
    rows = [
        (w[3], [w[1].upper(), None, "n/a"]),
        (w[1], []),
        (w[2], [" wf_00000000ffff "]),
        (w[4], ["WF_00000000FFFF", w[4]]),
        (w[5], None),
        (w[6], ["wf_0000"]),
        (w[7], ["wf_eeeeeeeeeeee"]),
        (w[3], [w[1].upper(), None, "n/a"]),
        (None, [w[8]]),
    ]
    got = {(r.workflow_id, r.group_id) for r in merge_groups(spark.createDataFrame([(*r, 1) for r in rows], "workflow_id string, merged_from array<string>, src int")).collect()}
    assert got == {(w[1], w[1]), (w[3], w[1]), (w[2], w[2]), (w[4], w[2])}
    assert merge_groups(spark.createDataFrame([], "workflow_id string, merged_from array<string>")).collect() == []
