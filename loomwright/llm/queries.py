"""Queries over the whole tables, one module function per problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwright.llm.canonical import map_fields
from loomwright.llm.components import merge_groups
from loomwright.llm.consensus import survivors
from loomwright.llm.packing import pack_texts
from loomwright.llm.sentences import split_sentences
from loomwright.llm.splitting import all_texts, long_items, split_items
from loomwright.llm.tokens import encode_texts
from loomwright.llm.variants import near_duplicates, near_groups
from loomwright.llm.vectors import nearest_vectors
from loomwright.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(table(spark, sf_dir, "wf_versions"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_fields(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "terms"))


def _p3(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks, docs = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "docs")
    return split_items(long_items(chunks, docs), all_texts(chunks, docs))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p3(spark, sf_dir)[0].select("item_id", "cut_at").distinct()


def p3_valleys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p3(spark, sf_dir)[1].distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p3(spark, sf_dir)[2].distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "workflows"), table(spark, sf_dir, "terms"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "workflows"), table(spark, sf_dir, "terms"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "faiss_meta"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_groups(table(spark, sf_dir, "workflows"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_valleys": p3_valleys, "p3_pieces": p3_pieces, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p6_found": p6_found, "p7_ids": p7_ids, "p8_containers": p8_containers, "p9_found": p9_found}


def oracle_sql() -> dict[str, str]:
    return {}
