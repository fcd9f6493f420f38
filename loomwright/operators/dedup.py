"""Duplicates among workflows: comparison of pairs, best matches, leaders, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright import config
from loomwright.functions import text as X
from loomwright.functions import vectors as V
from loomwright.operators import graphs, similarity, workflows
from loomwright.session import written


def summary_texts(rows: DataFrame) -> DataFrame:
    """(workflow_id, text): each workflow's summary, its id where it has none; of rows of one id the smallest."""
    text = F.when(F.trim(F.coalesce("summary", F.lit(""))) == "", F.col("workflow_id")).otherwise(F.col("summary"))
    return rows.where("workflow_id is not null").select("workflow_id", text.alias("text")).groupBy("workflow_id").agg(F.min("text").alias("text"))


def summary_pairs(texts: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Classes (workflow_id, rep) of equal texts, and pairs (a, b, cosine) of representatives, a < b, from ``least`` on.

    Equal texts are one class, named by its smallest id, so copies are not compared.
    """
    reps = texts.groupBy("text").agg(F.min("workflow_id").alias("rep"))
    classes = texts.join(reps, "text").select("workflow_id", "rep")
    vectors = written(reps.select(F.col("rep").alias("id"), V.dense_buckets(V.buckets(F.col("text"))).alias("vec")))
    return classes, similarity.similar_pairs(vectors, least)


def find_duplicates(rows: DataFrame, settings: config.Settings = config.Settings()) -> DataFrame:
    """(workflow_id, duplicate_of, cosine): of each workflow with one, the other of the closest summary from the threshold on, the smaller id on ties."""
    classes, pairs = summary_pairs(summary_texts(rows), settings.duplicate_cosine)
    classes, pairs = written(classes), written(pairs.withColumn("cosine", F.round("cosine", 4)))
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other"), "cosine").unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other"), "cosine"))
    near = both.groupBy("rep").agg(F.min(F.struct((-F.col("cosine")).alias("far"), "other")).alias("near"))
    # The two smallest ids of a class: one of them is another member's, whoever asks.
    first = classes.groupBy("rep").agg(F.count("*").alias("n"), F.max_by("workflow_id", F.when(F.col("workflow_id") == F.col("rep"), 0).otherwise(1)).alias("_"), F.min(F.when(F.col("workflow_id") != F.col("rep"), F.col("workflow_id"))).alias("second")).drop("_")
    asked = classes.join(first, "rep").join(near, "rep", "left")
    twin = F.when(F.col("n") > 1, F.struct(F.lit(-1.0).alias("far"), F.when(F.col("workflow_id") == F.col("rep"), F.col("second")).otherwise(F.col("rep")).alias("other")))
    best = F.array_min(F.filter(F.array(twin, F.col("near")), lambda x: x.isNotNull()))
    found = asked.withColumn("best", best).where("best is not null")
    return found.select("workflow_id", F.col("best.other").alias("duplicate_of"), (-F.col("best.far")).alias("cosine"))


def leaders(rows: DataFrame, settings: config.Settings = config.Settings()) -> DataFrame:
    """(workflow_id, leader): in order of id, each workflow joins its smallest-id leader whose summary is close enough, or leads."""
    classes, pairs = summary_pairs(summary_texts(rows), settings.duplicate_cosine)
    classes = written(classes)
    led = similarity.leader_dedup(classes.where("workflow_id = rep").select(F.col("rep").alias("id")), pairs)
    return classes.join(led.withColumnRenamed("id", "rep"), "rep").select("workflow_id", "leader")


def merge_workflows(rows: DataFrame, led: DataFrame) -> DataFrame:
    """One row a leader: its own record, with the pages, sections, evidence and ids of those it absorbs.

    Evidence is appended where its sentence is new, pages are united, sections
    follow in order of first sight, merged_from has all absorbed ids, metadata the
    documents merged. The summary stays the leader's. Leaders and members come
    from ``leaders``; every union is of distinct values, found before they are
    collected, so a row is as large as what it holds.
    """
    one = rows.where("workflow_id is not null").dropDuplicates(["workflow_id"]).join(led, "workflow_id")
    one = written(one.withColumn("own", (F.col("workflow_id") != F.col("leader")).cast("int")))

    def gather(name: str, key: Column, *drop: str) -> DataFrame:
        """(leader, name): the distinct elements of a list column, the leader's first, then by id and place."""
        flat = one.select("leader", "own", "workflow_id", F.posexplode(name).alias("at", "x")).withColumn("key", key).where("key is not null")
        first = flat.groupBy("leader", "key").agg(F.min_by("x", F.struct("own", "workflow_id", "at")).alias("x"), F.min(F.struct("own", "workflow_id", "at")).alias("place"))
        return first.groupBy("leader").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda e: e["x"]).alias(name))

    pages = gather("pages", F.col("x")).select("leader", F.array_sort("pages").alias("pages"))
    sections = gather("sections", F.col("x"))
    evidence = gather("evidence_sources", F.col("x.sentence"))
    ids = one.select("leader", F.explode(F.concat(F.coalesce("merged_from", F.array().cast("array<string>")), F.when(F.col("own") == 1, F.array("workflow_id")).otherwise(F.array().cast("array<string>")))).alias("id"))
    ids = ids.where("id is not null").groupBy("leader").agg(F.array_sort(F.collect_set("id")).alias("merged_from"))
    papers = one.where("document is not null").groupBy("leader").agg(F.array_join(F.array_sort(F.collect_set("document")), ", ").alias("papers"), F.count("*").alias("members"))
    changed = ("pages", "sections", "evidence_sources", "merged_from")
    out = one.where("own = 0").drop(*changed, "own", "workflow_id")
    for part in (pages, sections, evidence, ids, papers):
        out = out.join(part, "leader", "left")
    absorbed = led.where("workflow_id <> leader").groupBy("leader").agg(F.lit(True).alias("merged"))
    out = out.join(absorbed, "leader", "left")
    known = F.coalesce("metadata", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    extra = F.create_map(F.lit("merged_documents"), F.coalesce("papers", F.lit("")))
    metadata = F.when(F.col("merged"), F.map_concat(F.map_filter(known, lambda k, v: k != "merged_documents"), extra)).otherwise(F.col("metadata"))
    return out.withColumnRenamed("leader", "workflow_id").withColumn("metadata", metadata).select(*[c for c in rows.columns])


def compare_pairs(pairs: DataFrame, rows: DataFrame, settings: config.Settings = config.Settings()) -> DataFrame:
    """Adds summary_cosine and is_duplicate to pairs (left_id, right_id, …)."""
    text = summary_texts(rows).select("workflow_id", V.buckets(F.col("text")).alias("b"))
    both = pairs.join(text.select(F.col("workflow_id").alias("left_id"), F.col("b").alias("_x")), "left_id").join(text.select(F.col("workflow_id").alias("right_id"), F.col("b").alias("_y")), "right_id")
    both = similarity.scored(both, ["_x", "_y"], "summary_cosine", V.bucket_cosines)
    return both.withColumn("summary_cosine", F.round("summary_cosine", 4)).withColumn("is_duplicate", F.col("summary_cosine") >= settings.duplicate_cosine)


def best_matches(scored: DataFrame, k: int) -> DataFrame:
    """(left_id, right_id, blended, rank): of each left workflow the ``k`` highest blended scores."""
    order = Window.partitionBy("left_id").orderBy(F.desc("blended"), "right_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("left_id", "right_id", "blended", "rank")


def sanitize_workflows(rows: DataFrame) -> DataFrame:
    """All workflows with their spurious nodes, those nodes' edges and worthless evidence gone, a new summary, and ``changed``.

    Rows of which no node is spurious keep their lists. Everything stays within a
    row, so there is no shuffle but that of repeated rows.
    """
    one = rows.where("workflow_id is not null").dropDuplicates(["workflow_id"])
    nodes = F.array_sort(F.transform(F.coalesce("nodes", F.array().cast(rows.schema["nodes"].dataType)), lambda n: F.struct(n["ord"].alias("o"), n["node_id"].alias("i"), n.alias("n"))))
    fields = [f.name for f in rows.schema["nodes"].dataType.elementType.fields]
    kept = F.filter(nodes, lambda x: ~F.coalesce(X.is_spurious_node(x["n"]["action"], x["n"]["object"], x["n"]["sentence"]), F.lit(True)))
    one = one.withColumn("kept", F.transform(kept, lambda x, i: F.struct(*[(i if f == "ord" else x["n"][f]).alias(f) for f in fields])))
    fewer = F.size("kept") < F.size(F.coalesce("nodes", F.array().cast(rows.schema["nodes"].dataType)))
    names = F.transform("kept", lambda n: n["node_id"])
    edges = F.filter("edges", lambda e: F.array_contains(names, e["source"]) & F.array_contains(names, e["target"]))
    said = F.filter("evidence_sources", lambda e: ~X.looks_descriptive(e["sentence"]) & ~X.strip(e["sentence"]).rlike(r"^\d+\.$") & ~X.strip(e["sentence"]).rlike(r"(?i)^perform \d+$"))
    one = one.withColumns({"new_edges": F.when(fewer, edges).otherwise(F.col("edges")), "new_evidence": F.when(fewer, said).otherwise(F.col("evidence_sources")), "fewer": fewer})
    one = written(one)
    steps = graphs.workflow_nodes(one.select("workflow_id", F.col("kept").alias("nodes")))
    told = workflows.summaries(steps, one.select("workflow_id", "title_hint")).withColumnRenamed("summary", "told")
    out = one.drop("nodes", "edges", "evidence_sources").join(told, "workflow_id")
    changed = F.col("fewer") | ~F.col("told").eqNullSafe(F.col("summary"))
    out = out.withColumn("changed", changed).drop("summary").withColumnsRenamed({"kept": "nodes", "new_edges": "edges", "new_evidence": "evidence_sources", "told": "summary"})
    return out.select(*rows.columns, "changed")
