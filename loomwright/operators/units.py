"""From texts to units and chunks: line scan, section fill, counters, splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import text as X


def scan_lines(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, unit_no, text): the non-blank lines of each text in order."""
    lines = texts.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text_col, r"\r\n|\n|\r")).alias("unit_no", "line"))
    return lines.withColumn("text", X.strip(F.col("line"))).where("text <> ''").select(id_col, "unit_no", "text")


def text_units(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Units with class, running section (the last heading), paragraph number, page and the text's page count.

    A heading names the section of what follows, itself included; the paragraph
    number counts units that are no headings, which have none. A plain text has one
    page; its page count grows with every major section but the first. One shuffle
    by text.
    """
    whole = Window.partitionBy(id_col)
    order = whole.orderBy("unit_no").rowsBetween(Window.unboundedPreceding, 0)
    units = scan_lines(texts, id_col, text_col).withColumn("unit_type", X.unit_class(F.col("text")))
    head = F.col("unit_type") == "heading"
    return units.withColumns(
        {
            "section": F.last(F.when(head, F.col("text")), ignorenulls=True).over(order),
            "paragraph": F.when(~head, F.sum(F.when(head, 0).otherwise(1)).over(order)).cast("int"),
            "page": F.lit(1),
            "page_count": F.greatest(F.sum(X.is_major(F.col("text")).cast("int")).over(whole), F.lit(1)).cast("int"),
        }
    )


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Chunks once each, types spelled alike, texts stripped."""
    one = chunks.select("chunk_id", "document_id", "order_index", "text", "page", "section", "paragraph", "unit_type").distinct()
    return one.where("text is not null").withColumns({"unit_type": X.kind_name(F.col("unit_type")), "text": X.strip(F.col("text"))}).where("text <> ''")


def split_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, piece_no, piece, piece_type): chunks cut at their steps or blank lines; headings and tables stay whole."""
    t, kind = F.col("text"), F.col("unit_type")
    parts = F.when(kind.isin("heading", "table"), F.array(t)).otherwise(X.split_at_steps(t, kind))
    out = chunks.select("chunk_id", "unit_type", F.posexplode(parts).alias("piece_no", "piece"))
    return out.select("chunk_id", "piece_no", "piece", F.when(kind.isin("heading", "table"), kind).otherwise(X.line_class(F.col("piece"))).alias("piece_type"))


def chunk_units(units: DataFrame, preserve_tables: bool = True) -> DataFrame:
    """(chunk_id, document_id, order_index, text, page, section, paragraph, unit_type) of units: split, section filled, numbered through.

    Headings stay whole and name the section of what follows; tables stay whole
    unless ``preserve_tables`` is off. chunk_id comes from document and place.
    """
    seen = Window.partitionBy("document_id").orderBy("unit_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = units.withColumn("current", F.last(F.when(F.col("unit_type") == "heading", F.col("text")), ignorenulls=True).over(seen))
    whole = F.col("unit_type").isin("heading", "table") if preserve_tables else F.col("unit_type") == "heading"
    parts = F.when(whole, F.array("text")).otherwise(X.split_at_steps(F.col("text"), F.col("unit_type")))
    paragraph = F.col("paragraph") if "paragraph" in units.columns else F.lit(None).cast("int").alias("paragraph")
    out = filled.select("document_id", "unit_no", "page", paragraph, "unit_type", F.coalesce("current", "section").alias("section"), F.posexplode(parts).alias("piece_no", "text"))
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("unit_no", "piece_no")) - 1
    place = F.concat_ws("/", F.col("document_id").cast("string"), F.col("unit_no").cast("string"), F.col("piece_no").cast("string"))
    out = out.withColumns({"order_index": number, "chunk_id": F.concat(F.lit("chunk_"), F.substring(F.sha2(place, 256), 1, 12))})
    return out.select("chunk_id", "document_id", "order_index", "text", "page", "section", "paragraph", "unit_type")


def doc_units(docs: DataFrame) -> DataFrame:
    """(document_id, unit_no, text, page, section, paragraph, unit_type) of the documents' unit lists."""
    one = docs.select("document_id", "units").where("units is not null").distinct()
    flat = one.select("document_id", F.posexplode("units").alias("unit_no", "u")).select("document_id", "unit_no", "u.*")
    return flat.where("text is not null").withColumns({"unit_type": X.kind_name(F.col("unit_type")), "text": X.strip(F.col("text"))}).where("text <> ''")
