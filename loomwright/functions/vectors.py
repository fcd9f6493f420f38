"""Vector and text embeddings as Column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import rules as R
from loomwright.functions import text as X


def dot(a: Column, b: Column) -> Column:
    """In double precision; null if either is."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is all zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def buckets(text: Column, dim: int = R.EMBED_DIM) -> Column:
    """The buckets of a text's words, one a word: what ``hash_embedding`` counts, as an array."""
    return F.transform(X.tokens(text), lambda t: (F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("bigint") % dim).cast("int"))


def dense_buckets(held: Column, dim: int = R.EMBED_DIM) -> Column:
    """The embedding of a text's buckets as an array of length 1; all zero without words."""

    def counted(h: Column) -> Column:
        counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.size(F.filter(h, lambda x: x == b)).cast("double"))
        return F.transform(F.array(counts), lambda c: F.struct(c.alias("c"), norm(c).alias("n")))[0]

    # Each step is bound by a lambda of its own, so that nothing is computed once a bucket.
    scaled = F.transform(F.transform(F.array(held), counted), lambda s: F.transform(s["c"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(0.0)))
    return scaled[0]


def bucket_cosine(a: Column, b: Column) -> Column:
    """Cosine of two texts' embeddings, from their buckets; 0 if either has no words."""

    def common(x: Column, y: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda n, i: n + F.size(F.filter(y, lambda j: i == j)))

    n = F.sqrt(common(a, a).cast("double") * common(b, b))
    return F.when(n > 0, common(a, b) / n).otherwise(0.0)


def bucket_cosines(columns: list, dim: int = R.EMBED_DIM, rows: int = 256) -> np.ndarray:
    """``bucket_cosine`` of many pairs: of either side all buckets, and each pair's first place in them."""
    (x, at_x), (y, at_y) = columns
    out = np.zeros(len(at_x) - 1)
    for k in range(0, len(out), rows):
        counts = []
        for v, at in ((x, at_x[k : k + rows + 1]), (y, at_y[k : k + rows + 1])):
            pair = np.repeat(np.arange(len(at) - 1), np.diff(at))
            counts.append(np.bincount(pair * dim + v[at[0] : at[-1]], minlength=(len(at) - 1) * dim).reshape(-1, dim))
        a, b = counts
        n = np.sqrt((a * a).sum(1).astype(np.float64) * (b * b).sum(1))
        out[k : k + rows] = np.where(n > 0, (a * b).sum(1) / np.maximum(n, 1), 0.0)
    return out


def hash_embedding(texts: DataFrame, id_col: str, text_col: str = "text", dim: int = R.EMBED_DIM) -> DataFrame:
    """(id, bucket, weight): the words of each text, hashed to ``dim`` buckets, counted, of length 1. Sparse rows, joined by bucket."""
    words = texts.select(id_col, F.explode(X.tokens(F.col(text_col))).alias("w"))
    bucket = F.conv(F.substring(F.md5("w"), 1, 7), 16, 10).cast("bigint") % dim
    counts = words.select(id_col, bucket.alias("bucket")).groupBy(id_col, "bucket").agg(F.count("*").alias("n"))
    total = counts.groupBy(id_col).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("len"))
    return counts.join(total, id_col).select(id_col, "bucket", (F.col("n") / F.col("len")).alias("weight"))
