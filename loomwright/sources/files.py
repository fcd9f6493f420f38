"""File sources: plain text, DOCX, PDF text through a backend, workflow JSON, and a router by suffix."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.functions import text as X
from loomwright.operators.units import text_units

UNITS = "document_id string, unit_no int, text string, unit_type string, section string, paragraph int, page int"
WORKFLOW = """workflow_id string, document string, document_id string, pages array<int>, sections array<string>,
 nodes array<struct<node_id:string,actor:string,action:string,object:string,`order`:int,page:int,section:string,sentence:string,action_id:string>>,
 edges array<struct<source:string,target:string,relation:string,weight:double,evidence:string>>,
 evidence_sources array<struct<document:string,page:int,section:string,sentence:string,chunk_id:string,action_id:string>>,
 context_notes array<string>,
 conditional_branches array<struct<sentence:string,condition:string,action:string,target_steps:array<int>,page:int,section:string,paragraph:int,chunk_id:string>>,
 summary string, title_hint string, group_id string, merged_from array<string>, metadata map<string,string>"""
SUFFIXES = {"text": ("txt", "md", "text"), "docx": ("docx",), "pdf": ("pdf",)}


def _id(path) -> F.Column:
    return F.concat(F.lit("doc_"), F.substring(F.md5(path), 1, 12))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Units of .txt, .md and .text files."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{txt,md,text}")
    return text_units(raw.select(_id(F.col("_metadata.file_path")).alias("document_id"), F.col("value").alias("text")), "document_id")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(content: bytes) -> Iterator[tuple[str, str, str]]:
    """(text, style, kind) of a file's paragraphs and tables in body order; rows joined by line ends, cells by " | "."""

    def said(e) -> str:
        return "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            if said(e):
                yield said(e), "" if style is None else style.get(f"{_W}val", ""), "paragraph"
        elif e.tag == f"{_W}tbl":
            rows = [[said(c) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]
            if any(any(r) for r in rows):
                yield "\n".join(" | ".join(r) for r in rows if any(r)), "", "table"


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Units of .docx files: headings by style or shape, page marks read and dropped, tables as one unit each. Broken files have none."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path)

    def parse(frames):
        for pdf in frames:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(p, i, *b) for i, b in enumerate(docx_blocks(content))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "unit_no", "text", "style", "kind"])

    blocks = raw.select("path", "content").mapInPandas(parse, "path string, unit_no int, text string, style string, kind string")
    t = F.col("text")
    mark = F.regexp_extract(t, r"(?i)^\s*(?:page\s+)?(\d+)\s*$", 1).try_cast("int")
    head = F.col("style").contains("Heading") | X.is_heading(t)
    kind = F.when(F.col("kind") == "table", "table").when(head, "heading").otherwise(X.line_class(t))
    seen = Window.partitionBy("path").orderBy("unit_no").rowsBetween(Window.unboundedPreceding, 0)
    x = blocks.withColumns({"mark": F.when(F.col("kind") == "paragraph", mark), "unit_type": kind})
    majors = F.sum(F.when((F.col("unit_type") == "heading") & X.is_major(t), 1).otherwise(0)).over(seen)
    x = x.withColumns(
        {
            "page": F.greatest(F.coalesce(F.max("mark").over(seen), F.lit(1)), majors, F.lit(1)).cast("int"),
            "section": F.last(F.when(F.col("unit_type") == "heading", t), ignorenulls=True).over(seen),
            "paragraph": F.sum(F.when((F.col("unit_type") != "heading") & (F.col("kind") == "paragraph") & F.col("mark").isNull(), 1).otherwise(0)).over(seen).cast("int"),
        }
    )
    return x.where("mark is null").select(_id(F.col("path")).alias("document_id"), "unit_no", "text", "unit_type", "section", "paragraph", "page")


def pdf_units(spans: DataFrame, delta: float = 2.0, least: int = 3) -> DataFrame:
    """Units of spans (document_id, page, block, text, size): headings by type size over the median, or by shape; a page's headings come first."""
    head_pages = spans.where("page <= 20")
    median = head_pages.groupBy("document_id").agg(F.expr("percentile_disc(0.5) within group (order by size)").alias("median"))
    blocks = spans.groupBy("document_id", "page", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), " ").alias("text"), F.max("size").alias("size"))
    x = blocks.join(median, "document_id", "left").withColumn("text", X.strip(F.col("text"))).where("text <> ''")
    n, t = F.char_length("text"), F.col("text")
    head = ((F.col("size") >= F.coalesce("median", F.lit(11.0)) + delta) | X.is_heading(t)) & (n >= least) & (n < 200)
    x = x.withColumn("unit_type", F.when(head, "heading").otherwise(X.line_class(t)))
    order = Window.partitionBy("document_id").orderBy("page", F.when(F.col("unit_type") == "heading", 0).otherwise(1), "block")
    seen = order.rowsBetween(Window.unboundedPreceding, 0)
    return x.select(
        "document_id",
        (F.row_number().over(order) - 1).alias("unit_no"),
        "text",
        "unit_type",
        F.last(F.when(F.col("unit_type") == "heading", t), ignorenulls=True).over(seen).alias("section"),
        F.sum(F.when(F.col("unit_type") == "heading", 0).otherwise(1)).over(seen).cast("int").alias("paragraph"),
        "page",
    )


def read_pdf(spark: SparkSession, path: str, backend: Callable[[bytes], Iterator[tuple[int, int, int, str, float]]]) -> DataFrame:
    """Units of .pdf files; ``backend`` turns a file into (page, block, line, text, size) spans, as no PDF library is part of this package."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)

    def parse(frames):
        for pdf in frames:
            rows = [(p, *s) for p, content in zip(pdf["path"], pdf["content"]) for s in backend(content)]
            yield pd.DataFrame(rows, columns=["path", "page", "block", "line", "text", "size"])

    spans = raw.select("path", "content").mapInPandas(parse, "path string, page int, block int, line int, text string, size double")
    return pdf_units(spans.withColumn("document_id", _id(F.col("path"))).drop("path"))


def read_any(spark: SparkSession, path: str, backend=None) -> DataFrame:
    """Units of one file by its suffix; a missing file or an unknown suffix is an error."""
    import os

    local = re.sub(r"^file:(//)?", "", path)
    if "://" not in local and not os.path.exists(local):
        raise FileNotFoundError(path)
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in SUFFIXES["text"]:
        return read_text(spark, path)
    if suffix in SUFFIXES["docx"]:
        return read_docx(spark, path)
    if suffix in SUFFIXES["pdf"] and backend:
        return read_pdf(spark, path, backend)
    raise ValueError(f"no reader for .{suffix}")


def read_workflows(spark: SparkSession, path: str) -> DataFrame:
    """Workflow JSON files (wf_*.json); unreadable ones are left out, missing fields are null."""
    raw = spark.read.schema(WORKFLOW).option("multiLine", "true").option("pathGlobFilter", "wf_*.json").json(path)
    return raw.where("workflow_id is not null")
