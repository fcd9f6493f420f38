"""The workflow store: parquet tables with keyed upsert, delete, clear and statistics."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import vectors as V
from loomwright.operators.dedup import leaders, merge_workflows, sanitize_workflows
from loomwright.operators.workflows import corpus_stats, index_payload, meta_index
from loomwright.session import written


class Store:
    """One folder of versions; a pointer file names the current one, so that a reader never sees half a write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _pointer(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, "current"))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _current(self) -> str | None:
        fs, path = self._pointer()
        if not fs.exists(path):
            return None
        return self.spark.read.text(path.toString()).first()[0]

    def load(self) -> DataFrame | None:
        """All workflows; None while there are none."""
        name = self._current()
        return self.spark.read.parquet(os.path.join(self.root, name)) if name else None

    def get(self, workflow_id: str) -> DataFrame | None:
        rows = self.load()
        return None if rows is None else rows.where(F.col("workflow_id") == workflow_id)

    def _write(self, rows: DataFrame) -> None:
        """Writes a version, then swaps the pointer to it in one rename; the version before the last one goes."""
        name = f"v_{uuid.uuid4().hex[:12]}"
        rows.write.parquet(os.path.join(self.root, name))
        fs, path = self._pointer()
        jvm = self.spark.sparkContext._jvm
        before = self._current()
        new = jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, f".current-{name}"))
        out = fs.create(new, True)
        out.write(bytearray(name.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(context.makeQualified(new), context.makeQualified(path), options)
        for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.root)):
            old = status.getPath().getName()
            if old.startswith("v_") and old not in (name, before):
                fs.delete(status.getPath(), True)

    def save(self, rows: DataFrame) -> None:
        """Upsert by workflow_id: rows given replace those on file; of several given with one id one stays."""
        rows = rows.dropDuplicates(["workflow_id"])
        old = self.load()
        if old is not None:
            kept = old.join(rows.select("workflow_id").distinct(), "workflow_id", "left_anti")
            rows = kept.unionByName(rows, allowMissingColumns=True)
        self._write(rows)

    def delete(self, ids: DataFrame) -> None:
        old = self.load()
        if old is not None:
            self._write(old.join(ids.select("workflow_id").distinct(), "workflow_id", "left_anti"))

    def clear(self) -> int:
        """Empties the store; how many workflows it had."""
        old = self.load()
        if old is None:
            return 0
        n = old.count()
        self._write(old.where("false"))
        return n

    def stats(self) -> DataFrame | None:
        rows = self.load()
        return None if rows is None else corpus_stats(rows)

    def meta(self) -> DataFrame | None:
        rows = self.load()
        return None if rows is None else meta_index(rows)

    def sanitize(self) -> int:
        """Sanitises all workflows; how many changed."""
        rows = self.load()
        if rows is None:
            return 0
        clean = written(sanitize_workflows(rows))
        self._write(clean.drop("changed"))
        return clean.where("changed").count()

    def merge_duplicates(self) -> int:
        """Merges duplicates into their leaders; how many were absorbed."""
        rows = self.load()
        if rows is None:
            return 0
        led = written(leaders(rows))
        self._write(merge_workflows(rows, led))
        return led.where("workflow_id <> leader").count()

    def export_json(self, path: str) -> None:
        rows = self.load()
        if rows is not None:
            rows.write.mode("overwrite").json(path)


class VectorStore(Store):
    """The vector index as a table: (workflow_id, vector_id, kind, node_id, text, embedding), rebuilt, added to, read whole."""

    @staticmethod
    def entries(workflows: DataFrame) -> DataFrame:
        """The index rows of workflows: summary (or id), labels and sentences, each with its embedding."""
        rows = index_payload(workflows).where("workflow_id is not null").withColumn("text", F.coalesce("text", F.lit(""))).distinct()
        place = F.concat_ws("/", "workflow_id", F.coalesce("node_id", F.lit("")), "kind", F.hex(F.xxhash64("text")))
        return rows.select("workflow_id", place.alias("vector_id"), "kind", "node_id", "text", V.dense_buckets(V.buckets(F.col("text"))).cast("array<float>").alias("embedding"))

    def rebuild(self, workflows: DataFrame) -> int:
        """Indexes these workflows and no others; how many vectors."""
        self._write(self.entries(workflows))
        return self.load().count()

    def add(self, workflows: DataFrame) -> int:
        """Adds workflows; the vectors of those that are there are replaced. How many vectors there are."""
        new, old = self.entries(workflows), self.load()
        if old is not None:
            new = old.join(workflows.select("workflow_id").distinct(), "workflow_id", "left_anti").unionByName(new)
        self._write(new)
        return self.load().count()
