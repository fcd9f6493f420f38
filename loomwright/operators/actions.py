"""Action extraction by rules: sentences to (actor, action, object)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import rules as R
from loomwright.functions import text as X


def sentence_rows(chunks: DataFrame) -> DataFrame:
    """Sentences of chunks that are no headings or noise, by atomic unit, each with its step number.

    A unit is a line, or an item of a chain. Its number is the one it starts with;
    else, where the chunk has several units, its place among them. The number stays
    with the unit's first sentence.
    """
    body = chunks.where((F.col("unit_type") != "heading") & ~X.is_noise(F.col("text")))
    lines = F.filter(F.transform(F.split("text", r"[\r\n]+"), X.strip), lambda s: s != "")
    body = body.withColumn("units", F.flatten(F.transform(lines, lambda line: X.list_parts(line))))
    kept = [c for c in ("chunk_id", "document_id", "order_index", "section", "page", "paragraph") if c in chunks.columns]
    units = body.select(*kept, F.size("units").alias("unit_count"), F.posexplode("units").alias("unit_index", "unit")).where(~X.is_noise(F.col("unit")))
    number = F.coalesce(X.step_number(F.col("unit")), F.when(F.col("unit_count") > 1, F.col("unit_index") + 1))
    mark = F.regexp_extract("unit", R.STEP_NUM, 0)
    said = F.transform(X.sentences(F.regexp_replace("unit", R.STEP_NUM, "")), lambda s, i: F.when(i == 0, F.concat(X.strip(mark), F.when(X.strip(mark) != "", F.lit(" ")).otherwise(F.lit("")), s)).otherwise(s))
    rows = units.withColumn("step_number", number).select("*", F.posexplode(said).alias("sent_index", "sentence"))
    return rows.drop("unit", "unit_count")


def imperative(sentence: Column) -> Column:
    """struct(action, object): the first word and the rest; of "Marker X, Y" only Y is read."""
    head = "|".join(m.replace(" ", r"\s+") for m, _ in R.all_markers())
    x = F.regexp_replace(F.regexp_replace(sentence, R.STEP_NUM, ""), rf"(?i)^\s*(?:{head})\s+[^,]+,\s*", "")
    x = F.regexp_replace(X.strip(x), r"[.!?;:]+$", "")
    first, rest = F.regexp_extract(x, r"^(\S+)", 1), X.strip(F.regexp_replace(x, r"^\S+\s*", ""))
    word = first.rlike(r"^[A-Za-z]+$") & ~F.lower(first).isin(*R.STOP_VERBS)
    few = F.size(F.split(x, r"\s+")) <= 6
    return (
        F.when(word, F.struct(F.lower(first).alias("action"), F.when(rest != "", rest).alias("object")))
        .when(few & (x != ""), F.struct(F.lit("perform").alias("action"), x.alias("object")))
    )


def causative(sentence: Column) -> Column:
    """struct(action, object, duration) of "allow the X to Y for N unit"."""
    obj, act = F.regexp_extract(sentence, R.CAUSATIVE, 2), F.regexp_extract(sentence, R.CAUSATIVE, 3)
    held = F.regexp_extract(sentence, R.DURATION, 1)
    return F.when(act != "", F.struct(F.lower(act).alias("action"), obj.alias("object"), F.when(held != "", held).alias("duration")))


def agent(sentence: Column) -> Column:
    """struct(actor, action, object) of "The technician shall drain the sensor" and "The operator closes the valve"."""
    who, modal, verb, rest = (F.regexp_extract(sentence, R.ACTOR, k) for k in (1, 2, 3, 4))
    stem = F.lower(F.when(modal != "", verb).otherwise(F.regexp_replace(verb, r"(?<=[^s])s$", "")))
    obj = F.regexp_replace(X.strip(rest), r"[.!?;:]+$", "")
    held = F.struct(F.lower(who).alias("actor"), stem.alias("action"), F.when(obj != "", obj).alias("object"))
    return F.when((who != "") & ~stem.isin(*R.STOP_VERBS), held)


def list_item(sentence: Column) -> Column:
    """struct(action) of a short item of a chain: the whole phrase."""
    x = F.lower(F.regexp_replace(sentence, r"^[ .,;:]+|[ .,;:]+$", ""))
    return F.when((x != "") & (F.char_length(x) <= 80) & (F.size(F.split(x, r"\s+")) <= 6), F.struct(x.alias("action")))


def extract(chunks: DataFrame) -> DataFrame:
    """Sentences with kind and, for instructions, actor, action, object, label, duration and the rule that found them.

    Causatives first, then sentences with an agent, then imperatives, then items of
    chains. Descriptions and conditions keep their kind only; instructions that
    name no action, or none to do, are left out.
    """
    s = F.col("sentence")
    # A generator keeps the optimiser from copying an extraction into each later use of its result.
    rows = sentence_rows(chunks).where(~X.is_noise(s)).withColumn("kind", F.explode(F.array(X.sentence_class(s))))
    none = F.lit(None).cast("string")

    def found(x: Column, rule: str, **named: Column) -> Column:
        parts = {"actor": none, "action": x["action"], "object": none, "duration": none, **named}
        return F.when(x.isNotNull(), F.struct(*[v.alias(k) for k, v in parts.items()], F.lit(rule).alias("extraction")))

    c, g, i, t = causative(s), agent(s), imperative(s), list_item(s)
    best = F.coalesce(
        found(c, "causative", object=c["object"], duration=c["duration"]),
        found(g, "agent", actor=g["actor"], object=g["object"]),
        found(i, "imperative", object=i["object"]),
        found(t, "list_item"),
    )
    rows = rows.withColumn("a", F.explode(F.array(F.when(F.col("kind") == "INSTRUCTION", best))))
    out = rows.select("*", *[F.col(f"a.{c}").alias(c) for c in ("actor", "action", "object", "duration", "extraction")]).drop("a")
    spurious = X.is_spurious_action(F.col("action"), F.col("object"), F.col("actor"), s, F.col("step_number"))
    return out.where((F.col("kind") != "INSTRUCTION") | (F.col("action").isNotNull() & ~F.coalesce(spurious, F.lit(False)))).withColumn("label", X.label(F.col("action"), F.col("object")))


def action_rows(extracted: DataFrame) -> DataFrame:
    """Instructions as actions: action_id from their place, ``ord`` in reading order within the document."""
    place = F.concat_ws("/", "document_id", "chunk_id", F.col("unit_index").cast("string"), F.col("sent_index").cast("string"))
    ord_ = F.col("order_index").cast("bigint") * 1_000_000_000 + F.col("unit_index") * 10_000 + F.col("sent_index")
    rows = extracted.where("kind = 'INSTRUCTION'").withColumns({"action_id": F.concat(F.lit("act_"), F.substring(F.sha2(place, 256), 1, 12)), "ord": ord_})
    return rows.drop("kind", "unit_index", "sent_index", "order_index")


def conditions(sentences: DataFrame, col: str = "sentence") -> DataFrame:
    """Adds condition, rework verb and target steps of conditional sentences."""
    s = F.col(col)
    lo, hi = F.regexp_extract(s, R.TARGET_RANGE, 1).try_cast("int"), F.regexp_extract(s, R.TARGET_RANGE, 2).try_cast("int")
    each = F.transform(F.regexp_extract_all(s, F.lit(R.TARGET_ONE), 1), lambda x: x.try_cast("int"))
    targets = F.when(lo.isNotNull() & hi.isNotNull() & (lo <= hi) & (hi - lo < 1000), F.sequence(lo, hi)).otherwise(each)
    return sentences.where(X.is_conditional(s)).withColumns(
        {
            "condition": X.strip(F.regexp_replace(F.regexp_extract(s, r"^([^,]*)", 1), r"(?i)^\s*(?:if|unless)\s+", "")),
            "rework": F.lower(F.regexp_extract(s, R.CONDITIONAL, 1)),
            "target_steps": targets,
        }
    )
