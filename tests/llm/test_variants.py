"""Pairs by signatures against all pairs."""

import random

from pyspark.sql import functions as F

from loomwright.llm import variants


def test_all_pairs_are_found(spark):
    rng = random.Random(5)
    sets = []
    for _ in range(60):
        base = rng.sample(range(400), rng.randint(1, 15))
        sets.append(base)
        for _ in range(rng.randint(0, 3)):
            copy = set(base)
            for _ in range(rng.randint(0, 4)):
                copy ^= {rng.randrange(400)}
            sets.append(list(copy))
    sets += [[1, 2, i] for i in range(500, 530)]  # many that share a segment
    sets = {frozenset(s) for s in sets if s}
    rows = spark.createDataFrame([(f"w{i:04}", sorted(s)) for i, s in enumerate(sorted(sets, key=sorted))], "id string, steps array<long>")
    rows = rows.withColumn("steps", F.array_sort(F.transform("steps", lambda x: F.xxhash64(x))))
    held = {r.id: frozenset(r.steps) for r in rows.collect()}
    wanted = {(a, b) for a in held for b in held if a < b and len(held[a] & held[b]) >= 0.6 * len(held[a] | held[b]) - 1e-9}
    before = variants.HOT
    for hot in (before, 3):  # with hot segments given up, the exact way for the rest finds them
        variants.HOT = hot
        assert {tuple(r) for r in variants.near_pairs(rows).collect()} == wanted
    variants.HOT = before


def test_records(spark):
    node = "struct<action:string,object:string>"
    terms = spark.createDataFrame([(1, "action", "grind", []), (2, "object", "main valve", [])], "term_id int, kind string, name string, aliases array<string>")
    steps = [("grind", "main valve"), ("weld", "cover"), ("tag", "hose")]
    rows = [("b", [("tag", "hose"), ("GRINDING", "valve, main"), ("weld", "cover")]), ("a", steps), ("a", steps), ("c", steps[:2]), ("d", [("cut", "wire")]), ("e", None), ("f", [(None, None)]), (None, steps)]
    df = spark.createDataFrame([(*r, 1) for r in rows], f"workflow_id string, nodes array<{node}>, id int")
    assert {tuple(r) for r in variants.near_duplicates(df, terms).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    got = {r.workflow_id: (r.class_id, r.group_id, r.links) for r in variants.near_groups(df, terms).collect()}
    assert got == {"a": ("a", "a", 1), "b": ("a", "a", 1), "c": ("c", "a", 1), "d": ("d", "d", 0)}
    assert variants.near_duplicates(df.where("false"), terms).collect() == []
