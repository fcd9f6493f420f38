"""Pronoun resolution by the last noun phrase: one fold over a text's sentences, in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.functions import rules as R
from loomwright.functions import text as X

#: Pronouns of a sentence that are replaced at most, first ones first.
MOST = 2
_PRONOUN_FIRST = rf"(?is)^(.*?){R.COREF_PRON.removeprefix('(?i)')}(.*)$"


def _antecedent(sentence: Column) -> Column:
    """The last definite noun phrase of a sentence, else its last one, else null."""
    phrases = F.regexp_extract_all(sentence, F.lit(R.COREF_NOUN), 1)
    definite = F.filter(phrases, lambda p: p.rlike(r"(?i)^the\b"))
    return F.try_element_at(F.when(F.size(definite) > 0, definite).otherwise(phrases), F.lit(-1))


def _replaced(sentence: Column, phrase: Column, times: int = MOST) -> Column:
    """The sentence with its first pronouns replaced; possessives get 's."""
    if not times:
        return sentence
    before, pronoun, after = (F.regexp_extract(sentence, _PRONOUN_FIRST, k) for k in (1, 2, 3))
    owner = F.when(F.lower(pronoun).isin("its", "their"), "'s").otherwise("")
    return F.when(pronoun == "", sentence).otherwise(F.concat(before, phrase, owner, _replaced(after, phrase, times - 1)))


def resolve(text: Column, previous_only: bool = False) -> Column:
    """Texts of one sentence stay; in others up to two pronouns a sentence become the last definite noun phrase, or the last one.

    By default the sentence's own phrases count already; with ``previous_only``
    those of the sentences before. Null stays null.
    """
    parts = F.transform(F.split(X.strip(text), r"(?<=[.!?])\s+"), lambda s: F.struct(s.alias("s"), _antecedent(s).alias("own")))

    def step(done: Column, part: Column) -> Column:
        known = F.coalesce(part["own"], done["last"])
        used = done["last"] if previous_only else known
        said = F.when(used.isNull(), part["s"]).otherwise(_replaced(part["s"], used))
        return F.struct(known.alias("last"), F.concat(done["out"], F.array(said)).alias("out"))

    start = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(parts, start, step, lambda done: F.array_join(done["out"], " "))
    return F.when(F.size(parts) < 2, text).otherwise(whole)


def resolve_chunks(chunks, col: str = "text"):
    """Adds ``resolved`` to chunks: headings and texts of fewer than three words pass as they are."""
    short = F.size(F.filter(F.split(X.strip(F.col(col)), r"\s+"), lambda w: w != "")) < 3
    return chunks.withColumn("resolved", F.when((F.col("unit_type") == "heading") | short, F.col(col)).otherwise(resolve(F.col(col))))


def working_text(resolved: Column, text: Column) -> Column:
    return F.coalesce(F.when(resolved != "", resolved), text)
