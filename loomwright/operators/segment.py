"""Segmentation of a document's actions into procedures by scored gaps."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright import config
from loomwright.functions import rules as R


def gap_scores(actions: DataFrame, id_col: str = "document_id", last: str = "chunk_id", settings: config.Segmentation = config.Segmentation()) -> DataFrame:
    """Adds idx, structural, lexical, continuity, confidence, is_boundary to actions (id, order_index, section, page, sentence, step_number, density).

    Structural: 1 where the section changes, 0.6 at a jump of two pages. Lexical: 1
    for a heading pattern in the sentence; at a new section with a title 1 for one in
    it, else 0.35. Continuity: 0 in titled sections with numbered steps, else 1 less
    the mean marker density around the gap. The first action of a document is no
    gap; a section without a title is as one that is missing.
    """
    order = Window.partitionBy(id_col).orderBy(F.coalesce("page", F.lit(0)), "order_index", last)
    x = actions.withColumns({"idx": F.row_number().over(order) - 1, "s0": F.lag(_title()).over(order), "p0": F.lag("page").over(order)})
    first = F.col("idx") == 0
    changed = ~first & (_title() != F.col("s0"))
    jump = F.coalesce(F.abs(F.col("page") - F.col("p0")) >= 2, F.lit(False))
    hit = F.greatest(*[F.col("sentence").rlike(p).cast("int") for p in R.LEXICAL])
    title = F.greatest(*[F.coalesce(F.col("section"), F.lit("")).rlike(p).cast("int") for p in R.LEXICAL])
    near = Window.partitionBy(id_col).orderBy("idx").rowsBetween(-5, 4)
    numbered = F.max(F.col("step_number").isNotNull().cast("int")).over(Window.partitionBy(id_col, "section"))
    mean = F.avg("density").over(near)
    a, b, c = settings.weights
    x = x.withColumns(
        {
            "structural": F.when(first, 0.0).when(changed, 1.0).when(jump, 0.6).otherwise(0.0),
            "lexical": F.when(hit == 1, 1.0).when(changed & (_title() != ""), F.when(title == 1, 1.0).otherwise(0.35)).otherwise(0.0),
            "continuity": F.when((numbered == 1) & (_title() != ""), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mean))),
        }
    )
    x = x.withColumn("confidence", F.when(first, 1.0).otherwise(a * F.col("structural") + b * F.col("lexical") + c * F.col("continuity")))
    return x.withColumn("is_boundary", ~first & (F.col("confidence") >= settings.threshold)).drop("s0", "p0")


def _title():
    return F.coalesce(F.col("section"), F.lit(""))


def marker_density(chunks: DataFrame, edges: DataFrame, id_col: str = "document_id") -> DataFrame:
    """(id, chunk_id, density): edges of each chunk by the most a chunk of its document has."""
    n = edges.groupBy("chunk_id").agg(F.count("*").alias("n"))
    counted = chunks.select(id_col, "chunk_id").distinct().join(n, "chunk_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    most = F.max("n").over(Window.partitionBy(id_col))
    return counted.withColumn("density", F.when(most > 0, F.col("n") / most).otherwise(0.0)).select(id_col, "chunk_id", "density")


def _per_document(rows: DataFrame, id_col: str, fold: Callable[[list[dict]], Iterable[tuple]], columns: str) -> DataFrame:
    """``fold`` over each document's sorted rows; a document is one row of a list, so Python sees batches of documents."""
    lists = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c != id_col]))).alias("rows"))
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    names = [c.split() for c in columns.split(", ")]

    def run(batches):
        for batch in batches:
            ids, found = [], []
            for i, own in enumerate(batch.column(1).to_pylist()):
                for row in fold(own):
                    ids.append(i)
                    found.append(row)
            cols = list(zip(*found)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *[pa.array(c, kinds[k]) for c, (_, k) in zip(cols, names)]], names=[id_col, *[n for n, _ in names]])

    return lists.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, {columns}")


def drop_weak(gaps: DataFrame, id_col: str = "document_id", settings: config.Segmentation = config.Segmentation()) -> DataFrame:
    """(id, idx, confidence) of the boundaries kept: of two weak ones close together the stronger, none that is weak close behind a kept one."""

    def fold(marks):
        held = None
        for m in marks:
            i, c = m["idx"], m["confidence"]
            if held and i - held[0] <= settings.weak_gap and c <= settings.weak:
                if held[1] <= settings.weak and c > held[1]:
                    held = (i, c)
                continue
            if held:
                yield held
            held = (i, c)
        if held:
            yield held

    return _per_document(gaps.where("is_boundary").select(id_col, "idx", "confidence"), id_col, fold, "idx int, confidence double")


def assign_groups(gaps: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Adds group_no: the running count of boundaries."""
    order = Window.partitionBy(id_col).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return gaps.withColumn("group_no", F.sum(F.col("is_boundary").cast("int")).over(order))


def group_rows(assigned: DataFrame, id_col: str = "document_id") -> DataFrame:
    """One row a group: actions, pages, title (first section that is not empty), confidence at its start."""
    named = F.when(F.coalesce(F.col("section"), F.lit("")) != "", F.struct("idx", "section"))
    return assigned.groupBy(id_col, "group_no").agg(
        F.count("*").alias("actions"),
        F.min("page").alias("page_start"),
        F.max("page").alias("page_end"),
        F.min(named)["section"].alias("title_hint"),
        F.min(F.struct("idx", "confidence"))["confidence"].alias("boundary_confidence"),
    )


def merge_small(groups: DataFrame, id_col: str = "document_id", least: int = 2) -> DataFrame:
    """(id, group_no, merged_no, host): groups of fewer than ``least`` actions go to the one before, a small first one to the next.

    ``host`` is the group_no whose title, notes and confidence the merged group keeps.
    """

    def fold(rows):
        held, size = [], 0  # groups of the merged one so far, and their actions
        host, number = 0, 0
        for row in rows:
            no, n = row["group_no"], row["actions"]
            if held and n >= least and size >= least:
                yield from ((g, number, host) for g in held)
                held, size, number = [], 0, number + 1
            if not held or (n >= least and size < least):
                host = no
            held.append(no)
            size += n
        yield from ((g, number, host) for g in held)

    return _per_document(groups.select(id_col, "group_no", "actions"), id_col, fold, "group_no bigint, merged_no bigint, host bigint")
