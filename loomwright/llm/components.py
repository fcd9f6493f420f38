"""Consolidation of pairwise links into groups by deterministic Boruvka hooking.

Every component picks its smallest outgoing edge under one total order of the
edges, so the picks form trees with exactly one two-edge loop each. The loop's
smaller end becomes the root, pointer doubling flattens the trees, the edges are
relabelled and deduplicated, and the rounds go on until no edge is left. The
number of components at least halves a round.

Edges and labels stay distributed; only "is anything left" comes to the driver.
Picks are minima with map-side combining, so a hub with very many links costs the
task that picks for it no more than its share. Where edges meet labels the hub's
rows share a join key; the labels have one row a component, so the adaptive skew
join can split the hub's edges over tasks, which it is relied on to do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import cut


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, root) for every id that has a link with another id.

    ``root`` is one id of the component, the same for all its members. Nulls on
    either side and links of an id with itself link nothing; repeated links and
    either direction count once; other columns are ignored. No links: no rows.
    """
    a, b = F.col(src), F.col(dst)
    edges = (
        links.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .distinct()
        .withColumn("w", F.xxhash64("a", "b"))
    )
    edges = cut(edges)
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        labels = _collapse(_hook(edges))
        rounds.append(labels)
        edges = cut(_relabel(edges, labels))
    if not rounds:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))

    def compose(left: DataFrame, right: DataFrame) -> DataFrame:
        upper = right.select(F.col("v").alias("root"), F.col("p").alias("up"))
        joined = left.join(upper, "root", "left")
        return joined.select("id", F.coalesce("up", "root").alias("root"))

    first = rounds[0].select(F.col("v").alias("id"), F.col("p").alias("root"))
    return reduce(compose, rounds[1:], first)


def _hook(edges: DataFrame) -> DataFrame:
    """(v, p): the other end of each component's smallest edge; the smaller end of a loop is its own."""
    picked = F.min(F.struct("w", "a", "b")).alias("m")
    ends = F.explode(F.array("a", "b")).alias("v")
    best = edges.select(ends, "w", "a", "b").groupBy("v").agg(picked)
    best = best.select("v", F.when(F.col("v") == F.col("m.a"), F.col("m.b")).otherwise(F.col("m.a")).alias("o"))
    best = cut(best)
    other = best.select(F.col("v").alias("o"), F.col("o").alias("oo"))
    loop = F.col("oo") == F.col("v")
    return best.join(other, "o").select("v", F.when(loop, F.least("v", "o")).otherwise(F.col("oo")).alias("p"))


def _collapse(pointers: DataFrame) -> DataFrame:
    """Pointer doubling until every pointer is a root."""
    now = cut(pointers)
    while True:
        up = now.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        then = cut(now.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
        if then.where("moved").isEmpty():
            return then.select("v", "p")
        now = then.select("v", "p")


def _relabel(edges: DataFrame, labels: DataFrame) -> DataFrame:
    left = labels.select(F.col("v").alias("a"), F.col("p").alias("ra"))
    right = labels.select(F.col("v").alias("b"), F.col("p").alias("rb"))
    moved = edges.join(left, "a").join(right, "b").where("ra <> rb")
    return moved.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("w").alias("w"))


def merge_groups(workflows: DataFrame) -> DataFrame:
    """(workflow_id, group_id) of every workflow linked with another one of the table.

    A link is an entry of merged_from that is ``wf_`` and 12 hex digits, letter
    case and outer blanks aside; it may name a row that no longer exists and then
    still links through. group_id is the smallest workflow_id of the table in the
    group. Null lists, null or stray entries, links to itself and repeated rows
    link nothing more. No table rows: no result rows.
    """
    clean = F.lower(F.regexp_replace(F.col("raw"), r"^[\s 　]+|[\s 　]+$", ""))

    def number(c):
        return F.conv(F.substring(c, 4, 12), 16, 10).cast("long")

    shape = r"^wf_[0-9a-f]{12}$"
    rows = workflows.select("workflow_id", "merged_from", F.col("workflow_id").alias("raw")).withColumn("key", clean)
    rows = rows.where(F.col("key").rlike(shape)).withColumn("src", number(F.col("key")))
    links = rows.select("src", F.explode("merged_from").alias("raw")).withColumn("key", clean)
    links = links.where(F.col("key").rlike(shape)).select("src", number(F.col("key")).alias("dst"))
    roots = connected_components(links)
    known = rows.select("workflow_id", "src").distinct()
    named = known.join(roots, known.src == roots.id).select("workflow_id", "src", "root")
    sizes = named.groupBy("root").agg(F.min(F.struct("src", "workflow_id")).alias("first"), F.max("src").alias("last"))
    sizes = sizes.where("first.src <> last").select("root", F.col("first.workflow_id").alias("group_id"))
    return named.join(sizes, "root").select("workflow_id", "group_id").distinct()
