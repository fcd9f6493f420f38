"""Encoding of texts by a public byte-pair tokenizer, through a token automaton.

The merges are compiled, in order, into a deterministic automaton over tokens
that accepts exactly the sequences byte-pair encoding produces. It starts as one
state that every byte leads back to. The gadget of merge (x, y) -> z, done once
per merge:

* the state after x loses its transition by y: x has a new state from then on;
* wherever x could be read, z can be read now, and leads to where y led.

So a token's state is fixed by its lineage: z starts with the state y had when z
was made. The gadgets leave two tables, the cuts (x, y) -> rank and the lineages
with the ranks between which they held; a transition is looked up in them on
first use and kept in the transition table. Reading a pre-split word, exactly one
token can end at each byte that a token ends at; decoding emits the arcs' labels.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pre-split pattern of the byte_bpe_50k tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries a task keeps of words it has met; only memory depends on it.
KEEP_WORDS = 300_000
KEEP_ARCS = 2_000_000
LONGEST_KEPT = 48
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter by which the vocabulary file writes each byte: printable ones as they are, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        letters = byte_letters()
        names = {w: i for w, i in vocab.items() if all(c in letters for c in w)}
        self.label = {i: bytes(letters[c] for c in w) for w, i in names.items()}
        single = [i for w, i in names.items() if len(w) == 1]
        # Lineages, newest first: (token, last rank it holds to). Right ends for the state, left ends for the arc.
        self.right: dict[int, tuple] = {i: ((i, NEVER),) for i in single}
        self.left: dict[int, tuple] = {i: ((i, NEVER),) for i in single}
        self.cuts: dict[int, int] = {}
        for rank, (x, y) in enumerate(merges):
            a, b = names[x], names[y]
            z = names[x + y]
            self.cuts.setdefault((a << 20) | b, rank)
            if z not in self.right:
                self.right[z] = ((z, NEVER), (b, rank), *self.right[b][1:])
                self.left[z] = ((z, NEVER), (a, rank), *self.left[a][1:])
        self.children: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for token in self.right:
            node = 0
            for byte in self.label[token]:
                key = (node << 8) | byte
                node = self.children.get(key) or self._grow(key)
            self.ends[node] = token
        self.arcs: dict[int, bool] = {}

    def _grow(self, key: int) -> int:
        self.ends.append(-1)
        self.children[key] = len(self.ends) - 1
        return len(self.ends) - 1

    @classmethod
    def load(cls, path: str) -> TokenAutomaton:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges)

    def follows(self, before: int, token: int) -> bool:
        """Whether the state after one token has a transition by another."""
        key = (before << 20) | token
        known = self.arcs.get(key)
        if known is None:
            known = self._follows(before, token)
            if len(self.arcs) > KEEP_ARCS:
                self.arcs.clear()
            self.arcs[key] = known
        return known

    def _follows(self, before: int, token: int) -> bool:
        cuts = self.cuts
        for x, until_x in self.right[before]:
            for y, until_y in self.left[token]:
                rank = cuts.get((x << 20) | y)
                if rank is not None and rank < until_x and rank <= until_y:
                    return False
        return True

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        n = len(word)
        token_at, from_at = [-1] * (n + 1), [-1] * (n + 1)
        from_at[0] = 0
        children, ends = self.children, self.ends
        for i in range(n):
            if from_at[i] < 0:
                continue
            before, node = token_at[i], 0
            for j in range(i, n):
                node = children.get((node << 8) | word[j])
                if node is None:
                    break
                token = ends[node]
                if token >= 0 and (before < 0 or self.follows(before, token)):
                    token_at[j + 1], from_at[j + 1] = token, i
        out, at = [], n
        while at:
            out.append(token_at[at])
            at = from_at[at]
        return tuple(reversed(out))

    def decode(self, ids) -> bytes:
        return b"".join(self.label[i] for i in ids)


class _Words(dict):
    def __init__(self, automaton: TokenAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.automaton.encode_word(word.encode("utf-8", "surrogatepass"))
        if len(self) > KEEP_WORDS:
            self.clear()
        self[word] = ids
        return ids


class _Runs(dict):
    """Ids of runs between single blanks, each pre-split into words when first met."""

    def __init__(self, words: _Words):
        super().__init__()
        self.words, self.split = words, regex.compile(SPLIT).findall

    def __missing__(self, run: str) -> tuple[int, ...]:
        ids = tuple(chain.from_iterable(map(self.words.__getitem__, self.split(run))))
        if len(run) <= LONGEST_KEPT:
            if len(self) > KEEP_WORDS:
                self.clear()
            self[run] = ids
        return ids


class Encoder:
    """Text to ids; one per Python worker.

    No word of the pre-split goes on behind a blank that follows something else,
    so a text is cut there first; most runs have been met before.
    """

    def __init__(self, automaton: TokenAutomaton):
        self.runs = _Runs(_Words(automaton))
        self.cut, self.odd = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall, re.compile("[\x1c-\x1f]").search

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.odd(text):  # blanks here, but not in the pre-split
            return list(chain.from_iterable(map(self.runs.words.__getitem__, self.runs.split(text))))
        return list(chain.from_iterable(map(self.runs.__getitem__, self.cut(text))))


def worker_encoder(shared) -> Encoder:
    """The worker's encoder for a broadcast automaton, made once and kept with it."""
    automaton = shared.value
    if getattr(automaton, "encoder", None) is None:
        automaton.encoder = Encoder(automaton)
    return automaton.encoder


def share_automaton(spark, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """The compiled automaton as a broadcast; its size is that of the vocabulary file, whatever the input."""
    return spark.sparkContext.broadcast(TokenAutomaton.load(os.path.join(folder, f"{tokenizer}.json")))


def encode_texts(
    texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS
) -> DataFrame:
    """(id, ids array<int>) for every row; an empty list for empty and null texts.

    Special tokens' strings are ordinary text. Rows are independent: equal rows
    give equal rows, columns beside the two are ignored, an empty table gives an
    empty table, and a text of any length is encoded whole. No shuffle.
    """
    shared = share_automaton(texts.sparkSession, tokenizer, folder)

    def run(batches):
        encode = worker_encoder(shared)
        for batch in batches:
            values, offsets = array("i"), np.zeros(batch.num_rows + 1, dtype=np.int32)
            for i, text in enumerate(batch.column(1)):
                values.extend(encode(text.as_py()))
                offsets[i + 1] = len(values)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(values, dtype=np.int32) if len(values) else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, text): the labels along each row's arcs; null ids give null, none the empty text."""
    shared = share_automaton(encoded.sparkSession, tokenizer, folder)

    def run(batches):
        for batch in batches:
            texts = [None if ids is None else shared.value.decode(ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col), F.col("ids")).mapInArrow(run, f"`{id_col}` {kind}, text string")
