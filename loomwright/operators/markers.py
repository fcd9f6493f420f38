"""Discourse markers: sentences to ordered edges between phrases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import rules as R
from loomwright.functions import text as X


def _relation(marker: Column) -> Column:
    table = F.create_map(*[F.lit(v) for m, r in R.all_markers() for v in (m, r)])
    return table[marker]


def _spaced(m: str) -> str:
    return m.replace(" ", r"\s+")


ANY = "|".join(_spaced(m) for m, _ in R.all_markers())
COMMA = rf"(?i)^\s*({ANY})\s+(.+?),\s*(.+)$"
INFIX = rf"(?i)([^.。;]*?)\b({ANY})\b([^.。;]*)"


def comma_edges(sentences: DataFrame, col: str = "sentence") -> DataFrame:
    """Edges of "Marker A, B": after and then lead from A to B, before from B to A. One edge a sentence, the longest marker's."""
    s = F.col(col)
    found = sentences.withColumn("marker", F.regexp_replace(F.lower(F.regexp_extract(s, COMMA, 1)), r"\s+", " ")).where("marker <> ''")
    a, b = X.clean_phrase(F.regexp_extract(s, COMMA, 2)), X.clean_phrase(F.regexp_extract(s, COMMA, 3))
    rel = _relation(F.col("marker"))
    found = found.withColumns({"relation": rel, "a": a, "b": b})
    found = found.withColumns({"source": F.when(F.col("relation") == "BEFORE", F.col("b")).otherwise(F.col("a")), "target": F.when(F.col("relation") == "BEFORE", F.col("a")).otherwise(F.col("b"))})
    return found.where("source <> '' and target <> '' and lower(source) <> lower(target)").drop("a", "b")


def clauses(sentences: DataFrame, col: str = "sentence") -> DataFrame:
    """The clauses (clause, c) of sentences without the comma form that hold a marker."""
    s = F.col(col)
    rows = sentences.where(~s.rlike(COMMA) & s.rlike(rf"(?i)\b({ANY})\b")).select("*", F.posexplode(F.split(s, "[.。;]")).alias("clause", "c"))
    return rows.where(F.col("c").rlike(rf"(?i)\b({ANY})\b"))


def _first_edge(rows: DataFrame, ends: Callable[[Column], tuple[Column, Column]]) -> DataFrame:
    """Of each clause the edge of its longest marker that makes one; ``ends`` gives source and target of a struct (marker, relation, p, left, right).

    All within the row: both sides there, and different.
    """
    marks = F.array(*[F.struct(F.lit(m).alias("marker"), F.lit(r).alias("relation"), F.lit(_spaced(m)).alias("p")) for m, r in R.all_markers()])

    def pattern(m: Column) -> Column:
        return F.concat(F.lit(r"(?is)^(.*?)\b"), m["p"], F.lit(r"\b(.*)$"))

    def split(m: Column) -> Column:
        left, right = (F.nullif(X.clean_phrase(F.call_function("regexp_extract", F.col("c"), pattern(m), F.lit(k))), F.lit("")) for k in (1, 2))
        return F.struct(m["marker"].alias("marker"), m["relation"].alias("relation"), m["p"].alias("p"), left.alias("left"), right.alias("right"))

    def edge(x: Column) -> Column:
        source, target = ends(x)
        return F.struct(x["marker"].alias("marker"), x["relation"].alias("relation"), source.alias("source"), target.alias("target"))

    met = F.transform(F.filter(marks, lambda m: F.regexp_like(F.col("c"), pattern(m))), split)
    made = F.filter(F.transform(met, edge), lambda x: F.coalesce((x["source"] != "") & (x["target"] != "") & (F.lower(x["source"]) != F.lower(x["target"])), F.lit(False)))
    # A generator keeps the optimiser from copying the search into each use of its result.
    return rows.select("*", F.explode(F.slice(made, 1, 1)).alias("e")).select(*rows.columns, "e.*").drop("c")


def infix_edges(sentences: DataFrame, col: str = "sentence") -> DataFrame:
    """Edges of "left marker right", one a clause: before leads right to left, the others left to right. No shuffle."""

    def ends(x: Column) -> tuple[Column, Column]:
        back = x["relation"] == "BEFORE"
        return F.when(back, x["right"]).otherwise(x["left"]), F.when(back, x["left"]).otherwise(x["right"])

    return _first_edge(clauses(sentences, col), ends)


def filled_edges(sentences: DataFrame, actions: DataFrame, col: str = "sentence") -> DataFrame:
    """Edges as of ``infix_edges``, a missing side filled.

    ``sentences`` have chunk_id and sent_index, ``actions`` chunk_id, ord, label. A
    missing right side is the chunk's last action, or the sentence without its
    marker if the chunk has none; a missing left side too, unless the right one
    splits at a comma; where both are missing they are the chunk's first and last
    action.
    """
    known = actions.where("label <> ''").groupBy("chunk_id").agg(F.min_by("label", "ord").alias("first"), F.max_by("label", "ord").alias("last"), F.count("*").alias("n"))
    rows = clauses(sentences, col).join(known, "chunk_id", "left")

    def ends(x: Column) -> tuple[Column, Column]:
        left, right = x["left"], x["right"]
        back = (x["relation"] == "BEFORE") & right.isNotNull()
        s0, t0 = F.when(back, right).otherwise(left), F.when(back, left).when(x["relation"] != "BEFORE", right)
        bare = X.clean_phrase(F.regexp_replace(F.col(col), F.concat(F.lit(r"(?i)^\s*"), x["p"], F.lit(r"\b[,:]?\s*")), F.lit("")))
        main, none, several, comma = F.coalesce("last", bare), s0.isNull() & t0.isNull(), F.col("n") >= 2, t0.contains(",")
        source = F.when(none, F.when(several, F.col("first"))).when(s0.isNull(), F.when(comma, F.trim(F.regexp_extract(t0, r"^([^,]*),", 1))).otherwise(main)).otherwise(s0)
        target = F.when(none, F.when(several, F.col("last"))).when(t0.isNull(), main).when(s0.isNull() & comma, F.trim(F.regexp_extract(t0, r"(?s)^[^,]*,(.*)$", 1))).otherwise(t0)
        return source, target

    return _first_edge(rows, ends).drop("first", "last", "n")


def match_score(phrase: Column, action: Column, obj: Column, label: Column) -> Column:
    """+2 if the action stands in the phrase, +2 for the object, +3 if label or phrase holds the other."""
    p, a, o, n = (F.lower(F.coalesce(c, F.lit(""))) for c in (phrase, action, obj, label))

    def held(x: Column, points: int) -> Column:
        return F.when((x != "") & (F.instr(p, x) > 0), points).otherwise(0)

    both = F.when((n != "") & (p != "") & ((F.instr(p, n) > 0) | (F.instr(n, p) > 0)), 3).otherwise(0)
    return held(a, 2) + held(o, 2) + both


def match_phrases(phrases: DataFrame, actions: DataFrame, key: str, least: int = 1) -> DataFrame:
    """(…phrase row, node_id, score): the best action of the same ``key`` for each phrase, earliest on ties; joins within the key only."""
    best = Window.partitionBy(key, "phrase").orderBy(F.desc("score"), "ord", "node_id")
    pairs = phrases.select(key, "phrase").distinct().join(actions.select(key, "node_id", "ord", "action", "object", "label"), key)
    pairs = pairs.withColumn("score", match_score(F.col("phrase"), F.col("action"), F.col("object"), F.col("label"))).where(F.col("score") >= least)
    return pairs.withColumn("rank", F.row_number().over(best)).where("rank = 1").select(key, "phrase", "node_id", "score")


def numbered_edges(steps: DataFrame, id_col: str = "document_id", name: str = "chunk_id", order: str = "order_index") -> DataFrame:
    """(id, source, target, section, n0, step_number): consecutive numbered steps of a section whose numbers rise; ``name`` says what is linked."""
    by = Window.partitionBy(id_col).orderBy(F.coalesce("page", F.lit(0)), F.coalesce("section", F.lit("")), "step_number", order, name)
    before = steps.where("step_number is not null").withColumns({"source": F.lag(name).over(by), "s0": F.lag("section").over(by), "n0": F.lag("step_number").over(by)})
    kept = before.where(F.col("source").isNotNull() & F.col("s0").eqNullSafe(F.col("section")) & (F.col("step_number") > F.col("n0")))
    return kept.withColumn("target", F.col(name))


def discourse_edges(sentences: DataFrame, actions: DataFrame) -> DataFrame:
    """All edges of a document's chunks, with the actions they name: of sentences, by markers, and of numbered steps.

    ``sentences`` have chunk_id, document_id, page, section, sent_index, sentence;
    ``actions`` come from ``action_rows``. A phrase names the action of its chunk
    that it matches best, the first on ties, or none.
    """
    own = ("document_id", "chunk_id", "section", "sent_index", "sentence")
    said = [*own, "marker", "relation", "source", "target"]
    clause = F.lit(0).alias("clause")
    phrases = comma_edges(sentences).select(*said, clause).unionByName(filled_edges(sentences, actions).select(*said, "clause"))
    sides = phrases.select("chunk_id", F.explode(F.array("source", "target")).alias("phrase"))
    named = match_phrases(sides, actions.select("chunk_id", F.col("action_id").alias("node_id"), "ord", "action", "object", "label"), "chunk_id")
    for side in ("source", "target"):
        held = named.select("chunk_id", F.col("phrase").alias(side), F.col("node_id").alias(f"{side}_action_id"))
        phrases = phrases.join(held, ["chunk_id", side], "left")
    steps = numbered_edges(actions, name="action_id", order="ord")
    numbered = steps.select("document_id", "chunk_id", "section", F.lit(None).cast("int").alias("sent_index"), "sentence", F.lit("numbered_step").alias("marker"), F.lit("THEN").alias("relation"), F.col("source").alias("source_action_id"), F.col("label").alias("target"), F.col("target").alias("target_action_id"), F.lit(0).alias("clause"))
    numbered = numbered.join(actions.select(F.col("action_id").alias("source_action_id"), F.col("label").alias("source")), "source_action_id")
    return phrases.unionByName(numbered.select(*phrases.columns))
