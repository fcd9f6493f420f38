"""Splitting of oversized texts at natural boundaries, where the vocabulary changes.

A long text's natural units are its rows (tables), items (lists) or sentences
(everything else; boundaries as learned in ``sentences``). Blocks of units on
either side of each boundary are compared by the cosine of their word counts; how
far the cosine lies under the peaks to its left and right is the boundary's depth,
and deep valleys are topic changes. A piece is then cut at the deepest boundary
within the window its size allows; each later piece starts with an overlap, taken
from the end of its predecessor at a word's beginning.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm import sentences as S
from loomwright.session import written

LIMIT, OVERLAP = 800, 80
#: Units of a block on either side of a boundary.
BLOCK = 3
#: Share of a window, from its end, in which a piece may be cut at a natural boundary.
WINDOW = 0.6
ITEM = re.compile(r"\s*(?:[-–—•▪‣◦*·]|\(?(?:\d{1,4}|[a-z]{1,2})[.)、]|\(\d+\)|#{1,6})\s*", re.I)
LINK = re.compile(r"\s+(?:→|->|=>|-->|⇒|➔|➜|\+)\s+")
INLINE, SEMICOLON = re.compile(r"\s+(?=[•▪‣◦]\s)"), re.compile(r";\s+(?=\S)")
WORDS = re.compile(r"\w+")


def kind_of(unit_type: str | None) -> str:
    """table, list or text, whatever the spelling; unknown and missing types are text."""
    bare = re.sub(r"[^a-z]", "", (unit_type or "").lower())
    return "table" if bare.startswith("table") else "list" if bare.startswith(("listitem", "list", "bullet")) else "text"


LETTER_STEP = re.compile(r"\s*[a-z]\.")
LINE_END = re.compile(r"\r\n|\r|\n")
WANTS_NUMBER, CLOSED = re.compile(r"(?:\b[A-Z]?[a-z]{1,4}\.|[,(])$"), re.compile(r"(?:etc|p\.m|a\.m|usw)\.$")


def unit_starts(text: str, kind: str) -> tuple[list[int], list[tuple]]:
    """Offsets at which a natural unit other than the first begins, and the places (as in ``sentences``) that still need a verdict."""
    lines = [(m.start() + len(m.group()) - len(m.group().lstrip()), m.end()) for m in S.LINE.finditer(text) if not m.group().isspace()]
    if not lines:
        return [], []
    if kind == "table":
        return [s for s, _ in lines[1:]], []
    if kind == "list":
        starts, marked = [], False
        for i, (s, e) in enumerate(lines):
            item = bool(ITEM.match(text, s, e))
            if i and (item or not marked):
                starts.append(s)
            marked = marked or item
            for divider in (LINK, INLINE, SEMICOLON):
                inside = [m.end() for m in divider.finditer(text, s, e)]
                if len(inside) >= 2:
                    starts += inside
                    break
        return starts, []
    starts, places, begin, dense = [], [], lines[0][0], bool(S.DENSE.search(text))

    def within(end: int) -> None:
        step = S.STEP.match(text, begin, end)
        for mark, word, at, key in S.candidates(text, step.end() if step and step.end() < end else begin, end, dense):
            places.append((mark, word, key, at, begin))

    for i, (s, e) in enumerate(lines[1:], 1):
        before = lines[i - 1][1]
        marked = S.STEP.match(text, s, e) or S.BULLET.match(text, s, e)
        if marked and LETTER_STEP.match(text, s, e) and text[before - 1] not in ".!?":
            marked = None  # an abbreviation behind a line end
        if len(LINE_END.findall(text, before, s)) > 1 or (marked and _closed(text, before)):
            within(before)
            starts.append(s)
            begin = s
    within(lines[-1][1])
    return starts, places


def _closed(text: str, end: int) -> bool:
    """Whether the line before ends a sentence, or at least not with a word that wants a number."""
    while end and text[end - 1].isspace():
        end -= 1
    tail = text[max(0, end - 12) : end]
    return not WANTS_NUMBER.search(tail) or bool(CLOSED.search(tail))


def depths(text: str, starts: list[int]) -> list[float]:
    """How deep the cohesion valley at each boundary is."""
    edges = [0, *starts, len(text)]
    bags = [Counter(w.lower() for w in WORDS.findall(text[a:b])) for a, b in zip(edges, edges[1:])]
    cohesion = []
    for i in range(1, len(bags)):
        left, right = sum(bags[max(0, i - BLOCK) : i], Counter()), sum(bags[i : i + BLOCK], Counter())
        norm = math.sqrt(sum(v * v for v in left.values()) * sum(v * v for v in right.values()))
        cohesion.append(sum(v * right[w] for w, v in left.items() if w in right) / norm if norm else 0.0)
    # A peak is where cohesion stops rising on the way from the boundary.
    left = _peaks(cohesion)
    right = _peaks(cohesion[::-1])[::-1]
    return [a + b - 2 * c for a, b, c in zip(left, right, cohesion)]


def _peaks(cohesion: list[float]) -> list[float]:
    pairs = accumulate(cohesion, lambda held, c: (c, held[1] if held[0] >= c else c), initial=(-1.0, -1.0))
    return [peak for _, peak in pairs][1:]


def pieces(text: str, starts: list[int], valley: list[float], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, float | None]]:
    """(start, end, characters repeated from the piece before, depth of the boundary at the end), each of at most ``limit`` characters, together the text."""
    out, at, repeated = [], 0, 0
    where, deep = np.asarray(starts, dtype=np.int64), np.asarray(valley)
    while len(text) - (at - repeated) > limit:
        room = at - repeated + limit
        lo, hi = np.searchsorted(where, at + max(1, int((room - at) * (1 - WINDOW)))), np.searchsorted(where, room, side="right")
        if lo >= hi:
            lo = np.searchsorted(where, at, side="right")  # an earlier one rather than none
            lo = max(lo, hi - 1)
        if lo < hi:
            best = hi - 1 - int(np.argmax(deep[lo:hi][::-1]))
            cut, depth = int(where[best]), float(deep[best])
        else:
            space = max(text.rfind(" ", at + (room - at) // 2, room), text.rfind("\n", at + (room - at) // 2, room))
            cut, depth = space + 1 if space > 0 else room, None
        out.append((at - repeated, cut, repeated, depth))
        low = max(at, cut - overlap)
        word = re.compile(r"(?<=\s)\S").search(text, low, cut)
        repeated = cut - word.start() if word else min(overlap, cut - at)
        at = cut
    out.append((at - repeated, len(text), repeated, None))
    return out


def long_items(chunks: DataFrame, docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(item_id, text, unit_type) of the chunks and document units over the limit, repeated rows once."""
    long = F.char_length("text") > limit
    own = chunks.where(F.col("chunk_id").isNotNull() & long).select(F.col("chunk_id").alias("item_id"), "text", "unit_type")
    units = docs.where(F.col("document_id").isNotNull() & F.exists("units", lambda u: F.char_length(u["text"]) > limit))
    units = units.select("document_id", F.posexplode("units").alias("i", "u")).select(F.concat_ws("#", "document_id", F.col("i").cast("string")).alias("item_id"), "u.text", "u.unit_type")
    return own.unionByName(units.where(long)).distinct()


def all_texts(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(text) of all chunks and all units, what the boundaries are learned from."""
    return chunks.select("text").unionByName(docs.select(F.explode("units.text").alias("text"))).where("text is not null")


def split_items(items: DataFrame, corpus: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boundaries (item_id, cut_at), valleys (item_id, cut_at, depth) and pieces of items over ``limit``.

    Pieces are (item_id, piece, start_at, end_at, overlap, depth, text). ``items`` has
    item_id, text, unit_type, a row an item; ``corpus`` has the texts that sentence
    boundaries are learned from. Offsets are in characters, ends exclusive. A piece
    ends at the deepest boundary of its window, at an earlier boundary if the
    window has none, else behind a blank, else at the limit; depth is that of the
    boundary at its end, null where there is none. Items without boundaries are cut
    all the same; null texts and items within the limit have no row; missing and
    unknown types are read as text; repeated rows give repeated rows; other columns
    are ignored; empty tables give empty results.
    """
    _, learned = S.learned_cases(S.scan(corpus, None, "text", None))

    def mark(batches):
        for batch in batches:
            rows, texts, langs, starts, places, at, of = [], [], [], [], [], [0], [0]
            for i, (text, unit_type) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if text is not None and len(text) > limit:
                    found, open_places = unit_starts(text, kind_of(unit_type))
                    starts += found
                    places += open_places
                    rows.append(i), texts.append(text), langs.append(S.language(None, text)), at.append(len(starts)), of.append(len(places))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(starts, pa.int32())), pa.ListArray.from_arrays(pa.array(of, pa.int32()), S.place_columns(*(zip(*places) if places else ())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())).cast(pa.string()), pa.array(texts, pa.string()), pa.array(langs, pa.string()), *lists], names=["item_id", "text", "lang", "starts", "places"])

    marked = items.select("item_id", "text", "unit_type").mapInArrow(mark, f"item_id string, text string, lang string, starts array<int>, places array<{S.PLACE}>")
    marked = written(marked.withColumn("uid", F.monotonically_increasing_id()))
    places = marked.select("uid", "item_id", "lang", F.explode("places").alias("p")).select("uid", "item_id", "lang", "p.*")
    good = S.verdicts(places.select(*S.CASE).distinct(), learned).where("boundary")
    cuts = S.true_places(places, good).select("uid", "item_id", F.col("start_at").alias("cut_at"))
    cuts = written(cuts.unionByName(marked.select("uid", "item_id", F.explode("starts").alias("cut_at"))).where("cut_at > 0").distinct())
    held = cuts.groupBy("uid").agg(F.sort_array(F.collect_list("cut_at")).alias("cuts"))
    whole = marked.select("uid", "item_id", "text").join(held, "uid", "left").select("item_id", "text", F.coalesce("cuts", F.array().cast("array<int>")).alias("cuts"))

    def each(batch):
        for item, text, starts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            yield item, text, [s for s in starts if s < len(text)]

    def deep(batches):
        for batch in batches:
            found = [(item, s, d) for item, text, starts in each(batch) for s, d in zip(starts, depths(text, starts))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found)) or [[]] * 3, VALLEYS.types)], schema=VALLEYS)

    def parts(batches):
        for batch in batches:
            found = []
            for item, text, starts in each(batch):
                found += [(item, n, a, b, r, d, text[a:b]) for n, (a, b, r, d) in enumerate(pieces(text, starts, depths(text, starts), limit, overlap))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found)) or [[]] * 7, PIECES.types)], schema=PIECES)

    valleys = whole.mapInArrow(deep, "item_id string, cut_at int, depth double")
    return cuts.select("item_id", "cut_at"), valleys, whole.mapInArrow(parts, "item_id string, piece int, start_at int, end_at int, overlap int, depth double, text string")


VALLEYS = pa.schema([("item_id", pa.string()), ("cut_at", pa.int32()), ("depth", pa.float64())])
PIECES = pa.schema([("item_id", pa.string()), ("piece", pa.int32()), ("start_at", pa.int32()), ("end_at", pa.int32()), ("overlap", pa.int32()), ("depth", pa.float64()), ("text", pa.string())])
