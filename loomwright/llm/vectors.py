"""The most similar vectors of every vector, by a block matrix join over cells.

Every vector belongs to its PROBES nearest cells of a partition of the sphere, whose
centres are fitted on a bounded sample; all vectors are indexed and all are
queries. The centres grow with the vectors, one for CELL of them: a flat list up to
FLAT, beyond it a list of lists, searched by its WIDE nearest heads. A cell is a
block of its own up to TILE rows, sent once; one the sample says is larger is a
grid of tiles. A vector that has too few others in its cells is compared with all.
A tile first multiplies int8 codes: with the codes' scales and the exact norm of
what the codes leave out, the product bounds the cosine from both sides. Pairs
whose upper bound is under the k-th best lower bound cannot be among the k best;
the others are computed again in floating point, and the tiles' best are merged.

Equal vectors are one point of the index, so that a vector a third of all rows
share makes no cell hot; its first k + 1 ids stand for its copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import written

#: Rows of the sample the centres are fitted on at least, and at most; sample rows a centre.
SAMPLE, MOST_SAMPLED, SHARE = 16_384, 262_144, 4
#: Centres of a flat list at most; heads of a list of lists that are searched.
FLAT, WIDE = 4_096, 8
#: Rows a cell should have, cells a vector belongs to, rows of a tile at most, products a tile holds at once.
CELL, PROBES, TILE, PRODUCTS = 400, 2, 32_768, 2_000_000


def k_means(sample: np.ndarray, k: int, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """About k centres by spherical k-means, and the centre of each row of the sample."""
    centres = sample[np.random.default_rng(7).permutation(len(sample))[:k]].copy()
    for last in range(rounds + 1):
        nearest = np.concatenate([np.argmax(sample[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(sample), 4096)])
        counts = np.bincount(nearest, minlength=len(centres))
        if last == rounds:
            break
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        kept = counts >= max(2, len(sample) / len(centres) / 16)  # smaller cells go to their neighbours
        kept = kept if kept.any() else counts > 0
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)[kept].astype(np.float32)
    return centres, nearest


class Cells:
    """Centres of all cells, each one's share of the sample and, where they are many, the heads they hang under."""

    def __init__(self, sample: np.ndarray, n: int):
        sample = np.unique(sample, axis=0)
        k = int(min(max(1, n // CELL), max(1, len(sample) // SHARE)))
        self.heads: np.ndarray | None = None
        if k <= FLAT:
            self.centres, nearest = k_means(sample, k)
        else:
            self.heads, own = k_means(sample, int(np.sqrt(k)))
            parts, self.begin = [], [0]
            for h in range(len(self.heads)):
                rows = sample[own == h]
                parts.append(k_means(rows, max(1, round(k * len(rows) / len(sample))))[0] if len(rows) else self.heads[h : h + 1])
                self.begin.append(self.begin[-1] + len(parts[-1]))
            self.centres = np.concatenate(parts)
            nearest = np.concatenate([self.nearest(sample[i : i + 4096], 1)[:, 0] for i in range(0, len(sample), 4096)])
        self.share = np.bincount(nearest, minlength=len(self.centres)) / len(sample)

    def nearest(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """The nearest ``probes`` cells of each row; in a list of lists among those of its WIDE nearest heads."""
        if self.heads is None:
            return np.argpartition(-(unit @ self.centres.T), probes - 1, axis=1)[:, :probes]
        wide = min(WIDE, len(self.heads))
        near = np.argpartition(-(unit @ self.heads.T), wide - 1, axis=1)[:, :wide]
        best, score = np.zeros((len(unit), probes), np.int64), np.full((len(unit), probes), -9.0, np.float32)
        for h in np.unique(near):
            rows = np.nonzero((near == h).any(axis=1))[0]
            lo, hi = self.begin[h], self.begin[h + 1]
            both = np.concatenate([score[rows], unit[rows] @ self.centres[lo:hi].T], axis=1)
            ids = np.concatenate([best[rows], np.broadcast_to(np.arange(lo, hi), (len(rows), hi - lo))], axis=1)
            top = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
            score[rows], best[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(ids, top, 1)
        return best


def tile_best(a: np.ndarray, b: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit rows a: (row of a, row of b, cosine) of each one's k best in b; with ``same``, a is b and no row meets itself."""

    def code(x: np.ndarray):
        scale = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-12) / 127
        q = np.rint(x / scale).astype(np.int8)
        back = q * scale
        return q.astype(np.float32), scale[:, 0], np.linalg.norm(x - back, axis=1), np.linalg.norm(back, axis=1)

    qa, sa, ea, na = code(a)
    qb, sb, eb, nb = code(b)
    out = []
    step = max(16, PRODUCTS // max(1, len(b)))
    for lo in range(0, len(a), step):
        hi = min(lo + step, len(a))
        # Products of int8 codes are whole numbers under 2**24, so single precision holds them exactly.
        product = (qa[lo:hi] @ qb.T) * (sa[lo:hi, None] * sb[None, :])
        slack = ea[lo:hi, None] * nb[None, :] + na[lo:hi, None] * eb[None, :] + ea[lo:hi, None] * eb[None, :] + 2e-6
        if same:
            product[np.arange(hi - lo), np.arange(lo, hi)] = -9
        low = product - slack
        width = low.shape[1]
        bar = np.partition(low, width - k, axis=1)[:, width - k] if width > k else np.full(hi - lo, -8, np.float32)
        i, j = np.nonzero((product + slack >= bar[:, None]) & (product > -5))
        exact = np.einsum("ij,ij->i", a[lo + i].astype(np.float64), b[j].astype(np.float64))
        order = np.lexsort((j, -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, np.arange(hi - lo))
        keep = np.arange(len(i)) - first[i] < k
        out.append((lo + i[keep], j[keep], exact[keep]))
    parts = list(zip(*out)) or [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    return tuple(np.concatenate(p) for p in parts)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.values if isinstance(column, pa.ListArray) else column.flatten()
    x = np.asarray(column.flatten() if len(flat) != dim * len(column) else flat, dtype=np.float32).reshape(-1, dim).astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def nearest_vectors(vectors: DataFrame, k: int = 5, dim: int = 64, id_col: str = "vector_id", vector_col: str = "embedding") -> DataFrame:
    """(id, near_id): for each id with a proper vector the k other ids of highest cosine.

    Proper are vectors of ``dim`` numbers, none null or NaN, not all zero; others
    neither ask nor answer. Repeated rows count once; at the same cosine the
    smaller id comes first, and equal vectors are neighbours at cosine 1. With
    fewer than k others, all of them. Other columns are ignored; an empty table
    gives an empty result. The search is approximate: pairs that share none of
    their PROBES nearest cells are missed (recall is measured in the tests), but
    every id has its k rows: one whose cells hold too few others asks all vectors.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col)
    proper = (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)) & F.exists(x, lambda v: v != 0)
    good = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & proper).select(F.col(id_col).alias("id"), x.cast("array<float>").alias("x"))
    good = good.withColumn("point", F.xxhash64("x"))

    n = vectors.count()  # of all rows: only the size of the partition depends on it
    sampled = int(min(MOST_SAMPLED, max(SAMPLE, SHARE * n // CELL)))
    sample = good.orderBy(F.xxhash64("id"), "id").limit(sampled).select("x").toArrow().column("x").combine_chunks()
    if len(sample) == 0:
        return good.select(F.col("id").alias(id_col), F.col("id").alias("near_id"))
    cells = Cells(_unit(sample, dim), n)
    tiles = np.maximum(1, np.ceil(cells.share * n * min(PROBES, len(cells.centres)) / TILE)).astype(np.int64)
    index = spark.sparkContext.broadcast((cells, tiles))  # MOST_SAMPLED / SHARE centres at most

    def assign(batches):
        cells, tiles = index.value
        probes = min(PROBES, len(cells.centres))
        for batch in batches:
            if not batch.num_rows:
                continue
            points = np.asarray(batch.column(0))
            unit = _unit(batch.column(1), dim)
            rows, own_cells = np.repeat(np.arange(len(points)), probes), cells.nearest(unit, probes).ravel()
            t = tiles[own_cells]
            own = (points[rows].view(np.uint64) % t.astype(np.uint64)).astype(np.int64)
            # A row meets every tile of its cell: it goes to each pair of tiles that holds its own.
            rep = np.repeat(np.arange(len(rows)), t)
            other = np.arange(len(rep)) - np.repeat(np.cumsum(t) - t, t)
            i, j = np.minimum(own[rep], other), np.maximum(own[rep], other)
            raw = unit[rows[rep]].tobytes()
            offsets = pa.py_buffer((np.arange(len(rep) + 1, dtype=np.int32) * (4 * dim)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(own_cells[rep].astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(own[rep].astype(np.int32)), pa.array(points[rows[rep]]), pa.Array.from_buffers(pa.binary(), len(rep), [None, offsets, pa.py_buffer(raw)])],
                names=["cell", "i", "j", "own", "point", "unit"],
            )

    need = k + 1

    def tile(table: pa.Table) -> pa.Table:
        points = table.column("point").to_numpy()
        unit = np.frombuffer(b"".join(table.column("unit").to_pylist()), dtype=np.float32).reshape(-1, dim)
        own = table.column("own").to_numpy()
        i = table.column("i")[0].as_py()
        left = own == i
        if left.all():
            a, b, c = tile_best(unit, unit, need, True)
            found = [(points[a], points[b], c)]
        else:
            pl, pr, ul, ur = points[left], points[~left], unit[left], unit[~left]
            a, b, c = tile_best(ul, ur, need, False)
            d, e, f = tile_best(ur, ul, need, False)
            found = [(pl[a], pr[b], c), (pr[d], pl[e], f)]
        p, q, cos = (np.concatenate(z) for z in zip(*found))
        return pa.table({"point": p, "near": q, "cos": cos.astype(np.float64)})

    points = good.select("point", "x").dropDuplicates(["point"])
    blocks = points.mapInArrow(assign, "cell int, i int, j int, own int, point bigint, unit binary")
    pairs = blocks.groupBy("cell", "i", "j").applyInArrow(tile, "point bigint, near bigint, cos double")
    # One shuffle by point serves both the pairs met in two cells and each point's best.
    pairs = pairs.repartition("point").groupBy("point", "near").agg(F.max("cos").alias("cos"))
    best_points = F.row_number().over(_window("point", F.desc("cos"), "near"))
    pairs = written(pairs.withColumn("rank", best_points).where(F.col("rank") <= need).drop("rank"))
    ids = written(good.select("point", "id").distinct())
    few = ids.withColumn("rank", F.row_number().over(_window("point", "id"))).where(F.col("rank") <= need).drop("rank")
    more = _exhaustive(points, pairs, few, need, dim)
    close = pairs if more is None else pairs.unionByName(more)
    answers = close.join(few.select(F.col("point").alias("near"), F.col("id").alias("near_id")), "near").select("point", "near_id", "cos")
    answers = answers.unionByName(few.select("point", F.col("id").alias("near_id"), F.lit(2.0).alias("cos")))
    ranked = answers.withColumn("rank", F.row_number().over(_window("point", F.desc("cos"), "near_id"))).where(F.col("rank") <= need)
    lists = ranked.groupBy("point").agg(F.sort_array(F.collect_list(F.struct("rank", "near_id"))).alias("near"))
    others = F.slice(F.filter("near", lambda s: s["near_id"] != F.col("id")), 1, k)
    return ids.join(lists, "point").select(F.col("id").alias(id_col), F.explode(others).alias("s")).select(id_col, F.col("s.near_id").alias("near_id"))


def _exhaustive(points: DataFrame, pairs: DataFrame, few: DataFrame, need: int, dim: int) -> DataFrame | None:
    """(point, near, cos) of the points that may have met fewer than ``need`` ids, their own included, with their best of all points, exact; None if there are none."""
    own = few.groupBy("point").agg(F.count("*").alias("n"))
    met = pairs.groupBy("point").agg(F.count("*").alias("met"))
    alone = own.join(met, "point", "left").where(F.col("n") + F.coalesce("met", F.lit(0)) < need).select("point")
    alone = written(points.join(alone, "point", "left_semi"))
    short = alone.count()
    if not short:
        return None
    # A stated query set, the few, against all rows, in blocks: a row goes to each block of the other side.
    rows, columns = max(1, -(-short // 4_096)), max(1, -(-points.count() // TILE))
    ask = alone.select("point", "x", F.pmod(F.col("point"), F.lit(rows)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j"))
    all_ = points.select("point", "x", F.pmod(F.xxhash64("point"), F.lit(columns)).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("i"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"point": pa.array([], pa.int64()), "near": pa.array([], pa.int64()), "cos": pa.array([], pa.float64())})
        p, q = left.column("point").to_numpy(), right.column("point").to_numpy()
        a, b, cos = tile_best(_unit(left.column("x").combine_chunks(), dim), _unit(right.column("x").combine_chunks(), dim), need + 1, False)
        other = p[a] != q[b]
        return pa.table({"point": p[a][other], "near": q[b][other], "cos": cos[other].astype(np.float64)})

    met = ask.groupBy("i", "j").cogroup(all_.groupBy("i", "j")).applyInArrow(best, "point bigint, near bigint, cos double")
    known = pairs.select("point", "near")
    return met.join(known, ["point", "near"], "left_anti")


def _window(partition: str, *order):
    from pyspark.sql import Window

    return Window.partitionBy(partition).orderBy(*order)
