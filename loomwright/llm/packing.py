"""Filling of fixed-capacity containers with texts, related ones together.

A text is measured in tokens; one over the capacity is cut into full containers
and a rest, all others stay whole. Every text is encoded once; its items, with
their ids, are a table in the shared folder, and the counts of the texts that hold
each token come out of the same pass. The items are dealt, by hash, to shards of
about SHARD tokens, whatever the input's size or partitions. A shard holds a BM25
inverted index of its items; how rare a term is comes from the counts over all
texts. The longest unused item is a container's seed; its best neighbours in the
index, by all of its terms, that are unused and fit are put beside it, best first.
What room is left takes the largest unused item that fits, and so on until none
does. Containers that stay emptier than FULL are dissolved and their items packed
again by size, in shards of their own.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.tokens import TOKENIZERS, share_automaton, worker_encoder
from loomwright.session import cut, written

CAPACITY = 2_048
#: Tokens of a shard, and of one of the second round.
SHARD = 2_000_000
#: Share of a container that must be filled, else its items are packed again.
FULL = 0.98
#: BM25's saturation and length parameters.
K1, B = 1.2, 0.75
#: Terms that more than one in COMMON of a shard's items hold are scored as a matrix, seeds in blocks; the others from their postings.
COMMON, SEEDS = 8, 32


class SizePool:
    """Unused items by size; the largest that fits is found by bisection."""

    def __init__(self, sizes: list[int]):
        self.by_size: dict[int, list[int]] = defaultdict(list)
        for i in sorted(range(len(sizes)), reverse=True):
            self.by_size[sizes[i]].append(i)
        self.sizes, self.keys = sizes, sorted(self.by_size)
        self.used = np.zeros(len(sizes), bool)

    def take(self, i: int) -> None:
        self.used[i] = True

    def largest(self, room: int) -> int:
        """An unused item of the largest size up to ``room``, taken out; -1 if none."""
        at = bisect_right(self.keys, room) - 1
        while at >= 0:
            held = self.by_size[self.keys[at]]
            while held:
                i = held.pop()
                if not self.used[i]:
                    self.used[i] = True
                    return i
            del self.keys[at]
            at -= 1
        return -1


class Bm25:
    """Inverted index of one shard over the items' token ids, in arrays.

    An item's score for a seed is the sum over all distinct terms of the seed.
    Terms of more than n / COMMON of the n items are columns of a matrix, which has
    at most COMMON times as many cells as the index has postings; a block of seeds
    is one product with it. Postings of the others are short.
    """

    def __init__(self, ids: list[np.ndarray], rarity: np.ndarray):
        n = len(ids)
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        owner = np.repeat(np.arange(n, dtype=np.int64), lengths)
        keys, times = np.unique((owner << 20) | np.concatenate(ids) if n else np.zeros(0, np.int64), return_counts=True)
        doc, term = keys >> 20, keys & 0xFFFFF
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean() if n else 1.0))
        impact = (times * (K1 + 1) / (times + norm[doc]) * rarity[term]).astype(np.float32)
        held = np.bincount(term, minlength=len(rarity))
        column = np.cumsum(held > n / COMMON) - 1
        often = held[term] > n / COMMON
        self.matrix = np.zeros((n, int((held > n / COMMON).sum())), np.float32)
        self.matrix[doc[often], column[term[often]]] = impact[often]
        seldom = ~often & (held[term] > 1)
        by_term = np.argsort(term[seldom], kind="stable")
        self.posted, self.impact = doc[seldom][by_term], impact[seldom][by_term]
        post_at = np.searchsorted(term[seldom][by_term], np.arange(len(rarity) + 1))
        self.begin, self.length = post_at[:-1], np.diff(post_at)
        self.terms, self.doc_at = term[seldom], np.searchsorted(doc[seldom], np.arange(n + 1))
        self.block: dict[int, np.ndarray] = {}

    def scores(self, i: int, order: list[int]) -> np.ndarray:
        """Every item's score for the seed i; ``order`` has the seeds that are asked next, i the first."""
        if i not in self.block:
            self.block = dict(zip(order, (self.matrix @ (self.matrix[order] > 0).T.astype(np.float32)).T))
        out = self.block[i].astype(np.float64)
        terms = self.terms[self.doc_at[i] : self.doc_at[i + 1]]
        length = self.length[terms]
        if len(terms):
            at = np.repeat(self.begin[terms] - np.cumsum(length) + length, length) + np.arange(length.sum())
            out += np.bincount(self.posted[at], weights=self.impact[at], minlength=len(out))
        return out


def pack(sizes: list[int], index: Bm25 | None, capacity: int) -> list[list[int]]:
    """Items of each container. Without an index by size only."""
    pool, out = SizePool(sizes), []
    size = np.array(sizes, dtype=np.int64)
    by_size = np.argsort(-size, kind="stable")
    while True:
        seed = pool.largest(capacity)
        if seed < 0:
            return out
        held, room = [seed], capacity - sizes[seed]
        smallest = pool.keys[0] if pool.keys else room + 1
        if index is not None and room >= smallest:
            if seed not in index.block:
                by_size = by_size[~pool.used[by_size]]
            scores = index.scores(seed, [seed, *by_size[: SEEDS - 1].tolist()])
            fit = np.nonzero((size <= room) & ~pool.used & (scores > 0))[0]
            for i in fit[np.argsort(-scores[fit], kind="stable")].tolist():
                if room < smallest:
                    break
                if sizes[i] <= room:
                    pool.take(i)
                    held.append(i)
                    room -= sizes[i]
        while room:
            i = pool.largest(room)
            if i < 0:
                break
            held.append(i)
            room -= sizes[i]
        out.append(held)


PLACED = "container string, place int, doc_id bigint, start_at int, tokens int"
ROW = pa.schema([("doc_id", pa.int64()), ("start_at", pa.int32()), ("tokens", pa.int32()), ("ids", pa.binary()), ("t", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])


def _items(texts: DataFrame, automaton, capacity: int) -> DataFrame:
    """A row an item (doc_id, start_at, tokens, ids as bytes), and one a task (t, n) with the texts that hold each token; token -1 counts all texts, -2 all tokens."""

    def run(batches):
        encode = worker_encoder(automaton)
        size = max(automaton.value.label) + 1
        wide = "I" if size > 1 << 16 else "H"
        counts, texts_, total = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            doc, start, tokens, raw = [], [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py())
                counts[list(set(ids))] += 1
                texts_, total = texts_ + 1, total + len(ids)
                for at in range(0, len(ids), capacity):
                    own = ids[at : at + capacity]
                    doc.append(name), start.append(at), tokens.append(len(own)), raw.append(array(wide, own).tobytes())
            none = [None] * len(doc)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((doc, start, tokens, raw, none, none), ROW.types)], schema=ROW)
        held = np.nonzero(counts)[0]
        row = {"doc_id": [None], "start_at": [None], "tokens": [None], "ids": [None], "t": [[*held.tolist(), -1, -2]], "n": [[*counts[held].tolist(), texts_, total]]}
        yield pa.RecordBatch.from_pydict(row, schema=ROW)

    return texts.mapInArrow(run, "doc_id bigint, start_at int, tokens int, ids binary, t array<int>, n array<bigint>")


def pack_texts(texts: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, shard: int = SHARD) -> DataFrame:
    """(container, place, doc_id, start_at, tokens): which tokens of which text stand where.

    ``start_at`` is 0 and ``tokens`` the text's length in tokens, but for texts over
    the capacity, which are cut. Every token of every row is placed once, so
    repeated rows, and equal texts under several ids, are packed each; empty and
    null texts have no row, as they take no room. Other columns are ignored; an
    empty table gives an empty result. How the input is partitioned changes nothing.
    """
    spark = texts.sparkSession
    automaton = share_automaton(spark, "byte_bpe_50k", folder)
    rows = texts.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("length(text) > 0")
    both = written(_items(rows, automaton, capacity))
    # One row a token of the vocabulary at most.
    counted = both.where("t is not null").select(F.explode(F.arrays_zip("t", "n")).alias("c")).groupBy("c.t").agg(F.sum("c.n").alias("n"))
    counted = dict(counted.toPandas().itertuples(index=False))
    n, total = counted.pop(-1, 0), counted.pop(-2, 0)
    rarity = np.zeros(max(automaton.value.label) + 1)
    for t, c in counted.items():
        rarity[t] = math.log(1 + (n - c + 0.5) / (c + 0.5))
    shared = spark.sparkContext.broadcast(rarity)
    wide = np.uint32 if len(rarity) > 1 << 16 else np.uint16

    # Repeated rows are numbered, so that each goes its own way; usually there are none, and only short keys move.
    items = both.where("t is null").select("doc_id", "start_at", "tokens", "ids", F.xxhash64("ids").alias("h"))
    key = ["doc_id", "start_at", "h"]
    again = items.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")
    if again.isEmpty():
        items = items.withColumn("copy", F.lit(0))
    else:
        again = again.select(*[F.col(c).alias(f"again_{c}") for c in key], "copies")
        match = F.expr(" and ".join(f"{c} <=> again_{c}" for c in key))
        once = items.join(again, match, "left_anti").withColumn("copy", F.lit(0))
        first = items.join(again, match).groupBy(*key).agg(*[F.first(c).alias(c) for c in ("tokens", "ids", "copies")])
        first = first.select("doc_id", "start_at", "tokens", "ids", "h", F.explode(F.expr("sequence(0, cast(copies as int) - 1)")).alias("copy"))
        items = once.unionByName(first)

    def placed_rows(name: str, groups: list[list[int]], doc, start, copy, sizes: list[int]) -> pa.Table:
        rows = [(f"{name}-{k}", p, doc[i], start[i], sizes[i], copy[i], sum(sizes[x] for x in held) >= FULL * capacity) for k, held in enumerate(groups) for p, i in enumerate(held)]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], names=["container", "place", "doc_id", "start_at", "tokens", "copy", "full"])

    def columns(table: pa.Table):
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "start_at", "h", "copy") if c in table.column_names])
        return table, *[table.column(c).to_pylist() for c in ("doc_id", "start_at", "copy", "tokens")]

    def fill(table: pa.Table) -> pa.Table:
        table, doc, start, copy, sizes = columns(table)
        index = Bm25([np.frombuffer(b, wide).astype(np.int64) for b in table.column("ids").to_pylist()], shared.value)
        return placed_rows(f"a{table.column('shard')[0].as_py()}", pack(sizes, index, capacity), doc, start, copy, sizes)

    def refill(table: pa.Table) -> pa.Table:
        table, doc, start, copy, sizes = columns(table)
        return placed_rows(f"b{table.column('shard')[0].as_py()}", pack(sizes, None, capacity), doc, start, copy, sizes)

    def dealt(of: DataFrame, tokens: int, *keys: str) -> DataFrame:
        return of.withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(max(1, math.ceil(tokens / shard))))).groupBy("shard")

    kind = PLACED + ", copy int, full boolean"
    first = cut(dealt(items, total, "doc_id", "start_at", "h", "copy").applyInArrow(fill, kind))
    left = first.where("not full").agg(F.sum("tokens")).first()[0] or 0
    rest = dealt(first.where("not full").select("doc_id", "start_at", "tokens", "copy"), left, "doc_id", "start_at", "copy").applyInArrow(refill, kind)
    return first.where("full").unionByName(rest).drop("copy", "full")
