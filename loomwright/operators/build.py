"""From chunks to workflows: actions, discourse edges, groups, nodes, edges, evidence, records."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright import config
from loomwright.functions import text as X
from loomwright.operators import actions as A
from loomwright.operators import graphs, markers, segment, workflows
from loomwright.session import written


@dataclass
class Build:
    """Tables of one build; ``grouped`` has the actions with group and workflow id, ``groups`` a row a workflow."""

    actions: DataFrame
    discourse: DataFrame
    branches: DataFrame
    grouped: DataFrame
    groups: DataFrame
    nodes: DataFrame
    edges: DataFrame
    workflows: DataFrame


def _id(prefix: str, *parts: str):
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("/", *[F.col(p).cast("string") for p in parts]), 256), 1, 12))


def group_actions(actions: DataFrame, discourse: DataFrame, settings: config.Segmentation = config.Segmentation()) -> tuple[DataFrame, DataFrame]:
    """Actions with group_id and workflow_id; groups with title, pages and boundary confidence."""
    most = discourse.groupBy("document_id", "chunk_id").agg(F.count("*").alias("n"))
    top = most.groupBy("document_id").agg(F.max("n").alias("most"))
    dense = most.join(top, "document_id").select("document_id", "chunk_id", (F.col("n") / F.col("most")).alias("density"))
    rows = actions.join(dense, ["document_id", "chunk_id"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))
    gaps = segment.gap_scores(rows.withColumn("order_index", F.col("ord")), last="action_id", settings=settings)
    gaps = written(gaps.drop("order_index"))
    kept = segment.drop_weak(gaps, settings=settings).select("document_id", "idx", F.lit(True).alias("kept"))
    marked = gaps.join(kept, ["document_id", "idx"], "left").withColumn("is_boundary", F.coalesce("kept", F.lit(False)))
    assigned = segment.assign_groups(marked)
    named = segment.group_rows(assigned)
    merged = segment.merge_small(named, least=settings.least_actions)
    assigned = assigned.join(merged, ["document_id", "group_no"])
    own = assigned.groupBy("document_id", "merged_no", "host").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.count("*").alias("actions"))
    host = named.select("document_id", F.col("group_no").alias("host"), "title_hint", "boundary_confidence")
    # A host without a title takes the first one that its followers have.
    later = named.join(merged, ["document_id", "group_no"]).where("title_hint is not null and group_no > host").groupBy("document_id", "merged_no").agg(F.min_by("title_hint", "group_no").alias("later"))
    groups = own.join(host, ["document_id", "host"]).join(later, ["document_id", "merged_no"], "left")
    groups = groups.withColumns({"title_hint": F.coalesce("title_hint", "later"), "group_id": _id("group_", "document_id", "merged_no"), "workflow_id": _id("wf_", "document_id", "merged_no")}).drop("later")
    ids = ["document_id", "merged_no", "group_id", "workflow_id"]
    keep = [c for c in actions.columns if c != "document_id"]
    return assigned.select("document_id", "merged_no", "group_no", "host", *keep).join(groups.select(*ids), ["document_id", "merged_no"]), groups


def group_edges(discourse: DataFrame, grouped: DataFrame) -> DataFrame:
    """Discourse edges of each workflow: those that name one of its actions, or stand in a chunk of it. Three equality joins, no OR join."""
    by_action = grouped.select("workflow_id", "action_id")
    sides = [discourse.join(by_action.withColumnRenamed("action_id", f"{s}_action_id"), f"{s}_action_id") for s in ("source", "target")]
    near = discourse.join(grouped.select("workflow_id", "document_id", "chunk_id").distinct(), ["document_id", "chunk_id"])
    columns = ["workflow_id", *discourse.columns]
    return near.select(*columns).unionByName(sides[0].select(*columns)).unionByName(sides[1].select(*columns)).distinct()


def node_table(grouped: DataFrame) -> DataFrame:
    """Nodes of each workflow with their place in the source; ``ord`` is their order by number and place."""
    picked = graphs.pick_nodes(grouped)
    rows = picked.join(grouped.withColumnRenamed("ord", "at"), ["workflow_id", "action_id"])
    node = F.concat(F.lit("n_"), "action_id").alias("node_id")
    return rows.select("workflow_id", node, "actor", "action", "object", "ord", "page", "section", "sentence", "action_id", "label", "step_number", "at", F.coalesce("page", F.lit(0)).alias("p"), F.coalesce("paragraph", F.lit(0)).alias("q"))


def numbered_edges(nodes: DataFrame) -> DataFrame:
    """Each numbered step's node leads to the next one's."""
    order = Window.partitionBy("workflow_id").orderBy("step_number", "at")
    rows = nodes.where("step_number is not null").withColumn("target", F.lead("node_id").over(order)).where("target is not null")
    return rows.select("workflow_id", F.col("node_id").alias("source"), "target", F.lit("NEXT").alias("relation"), F.lit(1.0).alias("weight"), F.lit("numbered_step").alias("evidence"), F.struct(F.lit(1).alias("kind"), "at").alias("seq"))


def discourse_graph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Discourse edges between nodes: by the actions they name, else by the phrase, which must match a node with 3 points."""
    sides = edges.select("workflow_id", F.explode(F.array("source", "target")).alias("phrase"))
    fuzzy = markers.match_phrases(sides, nodes, "workflow_id", least=3)
    known = nodes.select("workflow_id", "node_id", "action_id")
    rows = edges
    for side in ("source", "target"):
        by_id = known.select("workflow_id", F.col("action_id").alias(f"{side}_action_id"), F.col("node_id").alias(f"{side}_node"))
        by_phrase = fuzzy.select("workflow_id", F.col("phrase").alias(side), F.col("node_id").alias(f"{side}_near"))
        rows = rows.join(by_id, ["workflow_id", f"{side}_action_id"], "left").join(by_phrase, ["workflow_id", side], "left")
    ends = rows.select("workflow_id", F.coalesce("source_node", "source_near").alias("source"), F.coalesce("target_node", "target_near").alias("target"), "relation", F.lit(1.0).alias("weight"), F.col("marker").alias("evidence"), F.struct(F.lit(2).alias("kind"), F.xxhash64("chunk_id", "sent_index", "clause", "marker").alias("at")).alias("seq"))
    return ends.where("source is not null and target is not null and source <> target")


def build_workflows(chunks: DataFrame, names: DataFrame | None = None, settings: config.Settings = config.Settings()) -> Build:
    """Workflows of chunk rows (as of ``units.chunk_rows``); ``names`` has document_id and source_name.

    One workflow a group of actions; its nodes, edges of document order, numbered
    steps and discourse, evidence of every action, notes of its chunks and branches
    of its chunks or its section. Every step is a join or a window within a
    document or a workflow; what the later steps read more than once is written to
    the shared folder.
    """
    extracted = written(A.extract(chunks))
    actions = written(A.action_rows(extracted))
    said = chunks.select("chunk_id", "document_id", "page", "section", F.posexplode(X.sentences(F.col("text"))).alias("sent_index", "sentence"))
    discourse = written(markers.discourse_edges(said, actions))
    grouped, groups = group_actions(actions, discourse, settings.segmentation)
    grouped, groups = written(grouped), written(groups)

    nodes = written(node_table(grouped))
    order = graphs.document_edges(nodes).select("workflow_id", "source", "target", F.lit("NEXT").alias("relation"), F.lit(0.5).alias("weight"), F.lit("document_order").alias("evidence"), F.struct(F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("at")).alias("seq"))
    numbered = numbered_edges(nodes)
    g = settings.graph
    sources = [(g.document_order, order), (g.numbered_steps, numbered), (g.discourse, discourse_graph_edges(group_edges(discourse, grouped), nodes))]
    edges = reduce(DataFrame.unionByName, [e for on, e in sources if on], order.limit(0))
    edges = written(graphs.dedupe_edges(edges))

    places = graphs.topological_order(nodes, numbered if g.numbered_steps else numbered.limit(0), "p", "q", "at")
    nodes = nodes.drop("ord").join(places, ["workflow_id", "node_id"]).withColumnRenamed("position", "ord")

    host = grouped.where("group_no = host").select("workflow_id", "document_id", "chunk_id").distinct()
    notes = extracted.where("kind = 'DESCRIPTION'").join(host, ["document_id", "chunk_id"])
    place = F.struct("order_index", "unit_index", "sent_index")
    notes = notes.groupBy("workflow_id", "sentence").agg(F.min(place).alias("at")).groupBy("workflow_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "sentence"))), lambda x: x["sentence"]).alias("context_notes"))

    branches = A.conditions(extracted.where("kind = 'CONDITIONAL'"))
    branches = branches.select("document_id", "chunk_id", "page", "section", "paragraph", "sentence", "condition", F.col("rework").alias("action"), "target_steps", place.alias("at"))
    by_chunk = branches.join(host, ["document_id", "chunk_id"]).select("workflow_id", *branches.columns)
    titled = groups.where("title_hint is not null").select("workflow_id", "document_id", F.col("title_hint").alias("section"))
    by_section = branches.join(titled, ["document_id", "section"]).select("workflow_id", *branches.columns)
    held = by_chunk.withColumn("k", F.lit(0)).unionByName(by_section.withColumn("k", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("workflow_id", "sentence").orderBy("k", "at"))
    held = held.withColumn("r", first).where("r = 1")
    fields = ("sentence", "condition", "action", "target_steps", "page", "section", "paragraph", "chunk_id")
    branch_lists = held.groupBy("workflow_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "at", F.struct(*fields).alias("b")))), lambda x: x["b"]).alias("conditional_branches"))

    source = names.select("document_id", "source_name").groupBy("document_id").agg(F.min("source_name").alias("document")) if names is not None else groups.select("document_id", F.lit(None).cast("string").alias("document")).distinct()
    sentence_rows = grouped.join(source, "document_id", "left")
    evidence = sentence_rows.groupBy("workflow_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("page", F.lit(0)).alias("p"), "ord", F.struct("document", "page", "section", "sentence", "chunk_id", "action_id").alias("e")))), lambda x: x["e"]).alias("evidence_sources"))
    node_fields = ("node_id", "actor", "action", "object", "ord", "page", "section", "sentence", "action_id")
    node_lists = nodes.groupBy("workflow_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*node_fields).alias("n")))).alias("s"))
    node_lists = node_lists.select("workflow_id", F.transform("s", lambda x: x["n"]).alias("nodes"))
    sections = F.array_distinct(F.filter(F.transform("nodes", lambda n: n["section"]), lambda s: s != ""))
    edge_fields = ("source", "target", "relation", "weight", "evidence")
    edge_lists = edges.groupBy("workflow_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(*edge_fields).alias("e")))), lambda x: x["e"]).alias("edges"))
    told = workflows.summaries(nodes, groups)

    rows = groups.withColumnRenamed("pages", "group_pages").join(source, "document_id", "left")
    for part in (node_lists, edge_lists, evidence, notes, branch_lists, told):
        rows = rows.join(part, "workflow_id", "left")

    def or_empty(name: str):
        return F.coalesce(name, F.array().cast(rows.schema[name].dataType)).alias(name)

    own_pages = F.array_sort(F.array_distinct(F.filter(F.transform("nodes", lambda n: n["page"]), lambda p: p.isNotNull())))
    pages = F.when(F.size(own_pages) > 0, own_pages).otherwise(F.col("group_pages"))
    confidence = F.create_map(F.lit("boundary_confidence"), F.round("boundary_confidence", 6).cast("string"), F.lit("action_count"), F.col("actions").cast("string"))
    out = rows.select(
        "workflow_id", "document", "document_id", pages.alias("pages"), F.coalesce(sections, F.array().cast("array<string>")).alias("sections"),
        *[or_empty(c) for c in ("nodes", "edges", "evidence_sources", "context_notes", "conditional_branches")],
        "summary", "title_hint", "group_id", F.array().cast("array<string>").alias("merged_from"), confidence.alias("metadata"),
    )
    return Build(actions, discourse, branches, grouped, groups, nodes, edges, out)
