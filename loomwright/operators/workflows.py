"""Workflow records: summaries, sanitising, merging, statistics, index payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import text as X


def modal_actor(nodes: DataFrame) -> DataFrame:
    """(workflow_id, actor): the most frequent actor that is not empty, the first seen on ties, "Operator" if there is none."""
    named = nodes.where("trim(coalesce(actor, '')) <> ''").groupBy("workflow_id", "actor").agg(F.count("*").alias("n"), F.min(F.struct("ord", "node_id")).alias("first"))
    order = Window.partitionBy("workflow_id").orderBy(F.desc("n"), "first")
    best = named.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("workflow_id", "actor")
    return nodes.select("workflow_id").distinct().join(best, "workflow_id", "left").withColumn("actor", F.coalesce("actor", F.lit("Operator")))


def summaries(nodes: DataFrame, titles: DataFrame) -> DataFrame:
    """(workflow_id, summary) of all workflows in ``titles`` (workflow_id, title_hint): "Title: Actor performs: step → step".

    Without a title the part before the actor is missing; without nodes it reads "Workflow: Title".
    """
    steps = nodes.groupBy("workflow_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id", "label"))), lambda s: s["label"]), " → ").alias("steps"))
    told = steps.join(modal_actor(nodes), "workflow_id").select("workflow_id", F.concat("actor", F.lit(" performs: "), "steps").alias("told"))
    title = F.when(F.col("title_hint") != "", F.col("title_hint"))
    both = titles.select("workflow_id", title.alias("title")).join(told, "workflow_id", "left")
    text = F.coalesce(F.concat("title", F.lit(": "), "told"), F.col("told"), F.concat(F.lit("Workflow: "), F.coalesce("title", F.lit("Untitled workflow"))))
    return both.select("workflow_id", text.alias("summary"))


def sane_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that name a step, numbered anew."""
    kept = nodes.where(~F.coalesce(X.is_spurious_node(F.col("action"), F.col("object"), F.col("sentence")), F.lit(True)))
    order = Window.partitionBy("workflow_id").orderBy("ord", "node_id")
    return kept.withColumn("position", F.row_number().over(order) - 1)


def sane_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both ends of which are kept; two semi joins."""
    s = nodes.select("workflow_id", F.col("node_id").alias("source"))
    t = nodes.select("workflow_id", F.col("node_id").alias("target"))
    return edges.join(s, ["workflow_id", "source"], "left_semi").join(t, ["workflow_id", "target"], "left_semi")


def merged_pages(workflows: DataFrame, group_col: str) -> DataFrame:
    """(group, pages): the sorted distinct pages of a group's workflows."""
    return workflows.select(group_col, F.explode("pages").alias("p")).where("p is not null").groupBy(group_col).agg(F.array_sort(F.collect_set("p")).alias("pages"))


def merged_evidence(workflows: DataFrame, group_col: str) -> DataFrame:
    """(group, sentence, workflow_id, pos): a group's evidence, the first of each sentence."""
    rows = workflows.select(group_col, "workflow_id", F.posexplode("evidence_sources").alias("pos", "e")).select(group_col, "workflow_id", "pos", "e.sentence")
    order = Window.partitionBy(group_col, "sentence").orderBy("workflow_id", "pos")
    return rows.where("trim(coalesce(sentence, '')) <> ''").distinct().withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def corpus_stats(workflows: DataFrame) -> DataFrame:
    one = workflows.select("workflow_id", "document_id", F.coalesce(F.size("nodes"), F.lit(0)).alias("n"), F.col("metadata")["boundary_confidence"].cast("double").alias("c")).distinct()
    return one.agg(
        F.countDistinct("document_id").alias("documents_processed"),
        F.count("*").alias("workflows_found"),
        F.sum(F.greatest("n", F.lit(0))).alias("actions_extracted"),
        F.round(F.avg("c"), 4).alias("avg_confidence"),
    )


def meta_index(workflows: DataFrame) -> DataFrame:
    """One row a workflow: counts and the page range as text."""
    pages = F.array_sort(F.array_distinct(F.filter(F.coalesce("pages", F.array().cast("array<int>")), lambda p: p.isNotNull())))
    one = workflows.select("workflow_id", "document_id", "title_hint", pages.alias("p"), F.greatest(F.coalesce(F.size("nodes"), F.lit(0)), F.lit(0)).alias("node_count"), F.greatest(F.coalesce(F.size("edges"), F.lit(0)), F.lit(0)).alias("edge_count")).distinct()
    span = F.when(F.size("p") == 0, "").when(F.size("p") == 1, F.element_at("p", 1).cast("string")).otherwise(F.concat_ws("–", F.element_at("p", 1).cast("string"), F.element_at("p", -1).cast("string")))
    return one.withColumn("page_range", span).drop("p")


def index_payload(workflows: DataFrame) -> DataFrame:
    """(workflow_id, kind, node_id, text): of each workflow its summary (or id), of each node its label and sentence."""
    one = workflows.select("workflow_id", "summary", "nodes").distinct()
    head = one.select("workflow_id", F.lit("summary").alias("kind"), F.lit(None).cast("string").alias("node_id"), F.when(F.trim(F.coalesce("summary", F.lit(""))) == "", F.col("workflow_id")).otherwise(F.col("summary")).alias("text"))
    n = one.select("workflow_id", F.explode("nodes").alias("n")).select("workflow_id", "n.*")
    node = n.select("workflow_id", F.lit("node").alias("kind"), "node_id", X.label(F.col("action"), F.col("object")).alias("text"))
    said = n.where("coalesce(sentence, '') <> ''").select("workflow_id", F.lit("action").alias("kind"), "node_id", F.col("sentence").alias("text"))
    return head.unionByName(node).unionByName(said)


def index_entries(workflows: DataFrame) -> DataFrame:
    """(workflow_id, vector_id, text): the rows of the index with an id each, from workflow, node and kind."""
    rows = index_payload(workflows).where("workflow_id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select("workflow_id", F.concat_ws("/", "workflow_id", F.coalesce("node_id", F.lit("")), "kind", F.hex(F.xxhash64("text"))).alias("vector_id"), "text").distinct()
