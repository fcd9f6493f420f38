"""Step graphs: nodes, edges, order."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import rules as R
from loomwright.functions import text as X


def node_rows(nodes: DataFrame) -> DataFrame:
    """Nodes once each with label and normal label."""
    one = nodes.select("workflow_id", "node_id", "ord", "action", "object", "actor", "page", "section").distinct()
    one = one.where("node_id is not null and workflow_id is not null")
    named = one.withColumn("label", X.label(F.col("action"), F.col("object")))
    return named.withColumn("normal", X.normal_label(F.col("label")))


def workflow_nodes(workflows: DataFrame) -> DataFrame:
    """The nodes in the workflows' lists, once each, with their sentences, label and normal label."""
    one = workflows.where("workflow_id is not null").select("workflow_id", F.explode("nodes").alias("n")).select("workflow_id", "n.*").where("node_id is not null").distinct()
    named = one.withColumn("label", X.label(F.col("action"), F.col("object")))
    return named.withColumn("normal", X.normal_label(F.col("label")))


def edge_rows(workflows: DataFrame) -> DataFrame:
    """(workflow_id, seq, source, target, relation, weight, evidence) of the workflows' edge lists."""
    one = workflows.select("workflow_id", "edges").where("edges is not null").distinct()
    return one.select("workflow_id", F.posexplode("edges").alias("seq", "e")).select("workflow_id", "seq", "e.*")


def first_labels(nodes: DataFrame) -> DataFrame:
    """Of nodes with one normal label the first of each workflow."""
    order = Window.partitionBy("workflow_id", "normal").orderBy("ord", "node_id")
    return nodes.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def subsumes(a: str, b: str) -> bool:
    """Whether label a holds all words of label b, or b as a part of it; they differ, and their lengths by less than 24."""
    return bool(b) and a != b and abs(len(a) - len(b)) < 24 and (b in a or set(b.split()) <= set(a.split()))


def overlaps(a: str, b: str) -> bool:
    """Whether one label's words are all among the other's, or one is part of the other."""
    if not a or not b:
        return False
    x, y = set(a.split()), set(b.split())
    return a in b or b in a or x <= y or y <= x


def _kept(labels: list[str]) -> list[int]:
    """Positions kept when, in order, a label goes that an equal or wider one precedes, and takes narrower ones with it."""
    kept: list[int] = []
    for i, label in enumerate(labels):
        if not any(label == labels[k] or subsumes(labels[k], label) for k in kept):
            kept = [k for k in kept if not subsumes(label, labels[k])] + [i]
    return kept


def drop_subsumed(nodes: DataFrame) -> DataFrame:
    """(workflow_id, node_id) kept when, in order, a node is dropped that an earlier one subsumes and drops the earlier ones it subsumes."""
    lists = nodes.groupBy("workflow_id").agg(F.array_sort(F.collect_list(F.struct("ord", "node_id", "normal"))).alias("n"))

    def run(batches):
        for batch in batches:
            found = [(w, n[k]["node_id"]) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k in _kept([x["normal"] or "" for x in n])]
            cols = list(zip(*found)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["workflow_id", "node_id"])

    return lists.mapInArrow(run, "workflow_id string, node_id string")


def pick_nodes(actions: DataFrame) -> DataFrame:
    """(workflow_id, action_id, ord): the actions of each workflow that become its nodes, in order.

    Numbered steps go first, by page and number. Descriptions go, and unnumbered
    actions that say what a numbered one does; of the rest, equal and subsumed
    labels as of ``drop_subsumed``. The order is by number, then by place.
    """
    plain = ~(X.looks_descriptive(F.col("label")) | ((X.strip(F.coalesce("sentence", F.lit(""))) != "") & F.coalesce(F.col("sentence").rlike(R.LIGHT_DESC), F.lit(False))))
    step = F.col("step_number")
    first = F.struct(step.isNull().alias("bare"), F.coalesce("page", F.lit(0)).alias("page"), F.coalesce(step.cast("bigint"), F.col("ord")).alias("by"), "ord", "action_id", X.normal_label(F.col("label")).alias("normal"), "step_number", plain.alias("plain"))
    lists = actions.groupBy("workflow_id").agg(F.array_sort(F.collect_list(first)).alias("a"))

    def nodes_of(own: list[dict]) -> list[str]:
        numbered = [x["normal"] for x in own if not x["bare"]]
        open_ = [x for x in own if x["plain"] and x["normal"] and not (x["bare"] and any(overlaps(x["normal"], n) for n in numbered))]
        kept = [open_[k] for k in _kept([x["normal"] for x in open_])]
        place = {x["action_id"]: i for i, x in enumerate(kept)}
        by_number = sorted(kept, key=lambda x: (x["bare"], place[x["action_id"]] if x["bare"] else x["step_number"], x["page"]))
        return [x["action_id"] for x in by_number]

    def run(batches):
        for batch in batches:
            found = [(w, a, i) for w, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, a in enumerate(nodes_of(own))]
            cols = list(zip(*found)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32()))], names=["workflow_id", "action_id", "ord"])

    return lists.mapInArrow(run, "workflow_id string, action_id string, ord int")


def document_edges(nodes: DataFrame) -> DataFrame:
    """(workflow_id, source, target): each node leads to the next."""
    order = Window.partitionBy("workflow_id").orderBy("ord", "node_id")
    return nodes.withColumn("target", F.lead("node_id").over(order)).where("target is not null").select("workflow_id", F.col("node_id").alias("source"), "target")


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One edge per source, target and relation: the heaviest, the first on ties."""
    order = Window.partitionBy("workflow_id", "source", "target", "relation").orderBy(F.desc("weight"), "seq")
    return edges.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def adjacency(edges: DataFrame) -> DataFrame:
    """(workflow_id, source, target, relation): one edge per pair, the last one's relation."""
    return edges.groupBy("workflow_id", "source", "target").agg(F.max(F.struct("seq", "relation"))["relation"].alias("relation"))


def degrees(edges: DataFrame) -> DataFrame:
    """(workflow_id, node_id, degree) over undirected distinct pairs."""
    pairs = edges.select("workflow_id", "source", "target").where("source <> target").distinct()
    return pairs.select("workflow_id", F.explode(F.array("source", "target")).alias("node_id")).groupBy("workflow_id", "node_id").agg(F.count("*").alias("degree"))


def topological_order(nodes: DataFrame, edges: DataFrame, *keys: str) -> DataFrame:
    """(workflow_id, node_id, position): Kahn's order with the smallest by ``keys`` (ord) and node_id first; what a cycle holds follows in that order.

    A graph travels as one row of two lists, so that Python sees batches of graphs.
    """
    n = nodes.groupBy("workflow_id").agg(F.array_sort(F.collect_set(F.struct(*(keys or ("ord",)), "node_id"))).alias("n"))
    e = edges.groupBy("workflow_id").agg(F.collect_set(F.struct("source", "target")).alias("e"))

    def walk(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple[str, str, int]] = []
        for workflow, own, links in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rank = {x["node_id"]: i for i, x in enumerate(own)}
            names = list(rank)
            after: list[set[int]] = [set() for _ in names]
            for x in links or ():
                s, t = rank.get(x["source"]), rank.get(x["target"])
                if s is not None and t is not None and s != t:
                    after[s].add(t)
            waits = [0] * len(names)
            for ts in after:
                for t in ts:
                    waits[t] += 1
            ready = [i for i, w in enumerate(waits) if not w]
            order = []
            while ready:
                i = heapq.heappop(ready)
                order.append(i)
                for t in after[i]:
                    waits[t] -= 1
                    if not waits[t]:
                        heapq.heappush(ready, t)
            order += sorted(set(range(len(names))) - set(order))
            rows += [(workflow, names[i], k) for k, i in enumerate(order)]
        cols = list(zip(*rows)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], names=["workflow_id", "node_id", "position"])

    both = n.join(e, "workflow_id", "left").select("workflow_id", "n", "e")
    return both.mapInArrow(lambda batches: map(walk, batches), "workflow_id string, node_id string, position int")


def to_html(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(workflow_id, html): each graph as a page of its own, steps in order with the edges that leave them; no script, nothing to load."""

    def safe(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")

    named = nodes.select("workflow_id", "node_id", "ord", "label", "page")
    to = named.select("workflow_id", F.col("node_id").alias("target"), F.col("label").alias("to"))
    out = edges.join(to, ["workflow_id", "target"]).select("workflow_id", F.col("source").alias("node_id"), F.struct("seq", F.concat(F.lit("<li>"), safe(F.col("relation")), F.lit(": "), safe(F.col("to")), F.lit("</li>")).alias("line")).alias("x"))
    links = out.groupBy("workflow_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "").alias("links"))
    title = F.concat(F.lit('page='), F.coalesce(F.col("page").cast("string"), F.lit("n/a")), F.lit(" order="), F.col("ord").cast("string"))
    item = F.concat(F.lit('<li id="'), safe(F.col("node_id")), F.lit('" title="'), title, F.lit('">'), safe(F.col("label")), F.coalesce(F.concat(F.lit("<ul>"), "links", F.lit("</ul>")), F.lit("")), F.lit("</li>"))
    rows = named.join(links, ["workflow_id", "node_id"], "left").select("workflow_id", F.struct("ord", "node_id", item.alias("line")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    return rows.groupBy("workflow_id").agg(F.concat(F.lit("<!doctype html><meta charset=utf-8><ol>\n"), body, F.lit("\n</ol>")).alias("html"))


def to_dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(workflow_id, dot): each graph as a text for a drawing program."""
    quoted = F.concat(F.lit('  "'), F.col("node_id"), F.lit('" [label="'), F.regexp_replace("label", '"', "'"), F.lit('"];'))
    lines = nodes.select("workflow_id", F.struct(F.lit(0).alias("k"), F.col("ord").cast("bigint").alias("o"), quoted.alias("line")).alias("x"))
    arrow = F.concat(F.lit('  "'), F.col("source"), F.lit('" -> "'), F.col("target"), F.lit('" [label="'), F.col("relation"), F.lit('"];'))
    links = edges.select("workflow_id", F.struct(F.lit(1).alias("k"), F.col("seq").cast("bigint").alias("o"), arrow.alias("line")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    return lines.unionByName(links).groupBy("workflow_id").agg(F.concat(F.lit("digraph {\n"), body, F.lit("\n}")).alias("dot"))
