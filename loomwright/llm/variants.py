"""Near-duplicate records by deletion-variant signatures.

A record is the set of its distinct steps. Two sets of s and t steps whose Jaccard
similarity reaches J differ in at most k = (s + t)(1 - J) / (1 + J) steps. The steps
are dealt, by hash, to m = k // 2 + 1 segments, fewer than k + 1, so that in one
segment the two differ by one step at most: they agree on it, or one has what the
other has with one step taken out. So a segment is indexed as it is and with each
step left out in turn, looked up as it is, and candidates are verified exactly.

A segment of fewer than MIN_STEPS steps, or one very many records share, tells
little; it is not looked up, and its records are dealt again under other hashes.
What could still be missed can only be a pair of two records that have such a
segment under every hash. Those records, and only those, are joined on pairs of
steps of their prefixes, rarest first (two sets that are similar enough share two
steps of their prefixes), which loses nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.canonical import canonical_values
from loomwright.llm.components import connected_components
from loomwright.session import cut

J = 0.6
SEEDS, MIN_STEPS = 2, 2
#: Records that share a segment, beyond which it is not looked up.
HOT = 500


def step_sets(records: DataFrame, terms: DataFrame, id_col: str = "workflow_id") -> DataFrame:
    """(id, steps array<bigint>): sorted hashes of each record's distinct canonical steps; records without any have no row."""
    nodes = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode("nodes").alias("n"))
    steps = cut(nodes.select("id", F.col("n.action").alias("action"), F.col("n.object").alias("object")).distinct())
    values = steps.select(F.explode(F.array(*[F.struct(F.lit(f).alias("kind"), F.col(f).alias("value")) for f in ("action", "object")])).alias("x"))
    canon = cut(canonical_values(values.select("x.kind", "x.value"), terms))
    for f in ("action", "object"):
        steps = steps.join(canon.where(F.col("kind") == f).select(F.col("value").alias(f), F.col("canon").alias(f"c_{f}")), f, "left")
    steps = steps.where("c_action is not null or c_object is not null")
    step = F.xxhash64(F.coalesce("c_action", F.lit("")), F.coalesce("c_object", F.lit("")))
    return steps.select("id", step.alias("step")).groupBy("id").agg(F.array_sort(F.collect_set("step")).alias("steps"))


def _segments(sets: DataFrame) -> DataFrame:
    """(id, seed, m, seg, part): every segment of every set, under each hash and each number of segments a partner may call for."""
    s = "size(steps)"
    most = f"cast(floor({s} / {J} + 1e-9) as int)"
    least = f"cast(ceil({s} * {J} - 1e-9) as int)"
    ms = f"array_distinct(transform(sequence({least}, {most}), t -> cast(floor(({s} + t) * {(1 - J) / (1 + J)} + 1e-9) as int) div 2 + 1))"
    dealt = sets.select("id", "steps", F.explode(F.expr(ms)).alias("m"))
    dealt = dealt.select("id", "steps", "m", F.explode(F.expr(f"sequence(1, {SEEDS})")).alias("seed"))
    dealt = dealt.select("id", "steps", "m", "seed", F.explode(F.expr("sequence(0, m - 1)")).alias("seg"))
    return dealt.select("id", "seed", "m", "seg", F.expr("filter(steps, x -> pmod(xxhash64(x, seed), m) = seg)").alias("part"))


def candidate_pairs(sets: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of different sets that may reach J, and few others."""
    segments = _segments(sets)
    place = ["seed", "m", "seg"]
    whole = segments.where(F.size("part") >= MIN_STEPS).select("id", *place, F.xxhash64(*place, "part").alias("key"))
    fewer = segments.where(F.size("part") > MIN_STEPS).select("id", *place, F.explode(F.expr("transform(part, x -> filter(part, y -> y <> x))")).alias("part"))
    fewer = fewer.select("id", F.xxhash64(*place, "part").alias("key"))
    index = whole.select("id", "key", F.lit(True).alias("asked")).unionByName(fewer.withColumn("asked", F.lit(False)))
    same = Window.partitionBy("key")  # one shuffle; a hot key's rows are counted as they stream by
    useful = index.withColumns({"n": F.count("*").over(same), "any": F.max("asked").over(same)}).where("n > 1 and any")
    useful = cut(useful.select("id", "key", "asked", (F.col("n") > HOT).alias("hot")))
    asked = useful.where("asked and not hot").select("key", F.col("id").alias("x"))
    held = useful.where("not hot").select("key", F.col("id").alias("y"))
    found = asked.join(held, "key").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    # A pair is missed under a hash only if, in both records, a segment is small or hot.
    hot = useful.where("hot").select("id").distinct()
    small = segments.groupBy("id", "seed").agg(F.min(F.size("part")).alias("least")).where(f"least <= {MIN_STEPS}")
    small = small.groupBy("id").agg(F.count("*").alias("n")).where(f"n = {SEEDS}").select("id")
    rest = cut(sets.join(small.unionByName(hot).distinct(), "id", "left_semi"))
    return found.unionByName(_prefix_pairs(rest)).distinct()


def _prefix_pairs(sets: DataFrame) -> DataFrame:
    """(a, b) of sets that share two steps of their prefixes, rarest steps first; sets of one step have no other partner."""
    steps = sets.select("id", F.size("steps").alias("s"), F.explode("steps").alias("step"))
    often = steps.groupBy("step").agg(F.count("*").alias("n"))
    order = Window.partitionBy("id").orderBy("n", "step")
    kept = steps.join(often, "step").withColumn("rank", F.row_number().over(order))
    kept = kept.where(F.expr(f"rank <= s - cast(ceil(s * {J} - 1e-9) as int) + 2"))
    prefix = kept.groupBy("id").agg(F.array_sort(F.collect_list("step")).alias("p"))
    two = F.expr("flatten(transform(p, (x, i) -> transform(slice(p, i + 2, size(p)), y -> xxhash64(x, y))))")
    keys = prefix.where("size(p) >= 2").select("id", F.explode(two).alias("key"))
    a, b = keys.select("key", F.col("id").alias("a")), keys.select("key", F.col("id").alias("b"))
    return a.join(b, "key").where("a < b").select("a", "b").distinct()


def near_pairs(sets: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of ids of different sets with a Jaccard similarity of J or more."""
    numbered = sets.withColumn("number", F.xxhash64("id"))  # shorter than ids on the way
    left = numbered.select(F.col("number").alias("a"), F.col("id").alias("ia"), F.col("steps").alias("sa"))
    right = numbered.select(F.col("number").alias("b"), F.col("id").alias("ib"), F.col("steps").alias("sb"))
    pairs = candidate_pairs(numbered.select(F.col("number").alias("id"), "steps"))
    held = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    held = held.where(f"both >= {J} * (size(sa) + size(sb) - both) - 1e-9")
    return held.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))


def classes(sets: DataFrame) -> DataFrame:
    """(id, rep, steps): equal sets are one class, named by its smallest id."""
    names = sets.groupBy("steps").agg(F.min("id").alias("rep"))
    return sets.join(names, "steps").select("id", "rep", "steps")


def near_duplicates(records: DataFrame, terms: DataFrame, id_col: str = "workflow_id") -> DataFrame:
    """(left_id, right_id), smaller first: records of which J of the distinct steps taken together occur in both.

    A step is an action with its object, whatever the spelling; either may be null,
    a step without both is none. Records without steps, null lists and null ids
    have no row. Repeated rows of an id count as one record with all their steps.
    Equal sets are joined once, as a class, and their ids multiplied out at the
    end. Other columns are ignored; an empty table gives an empty result.
    """
    named = cut(classes(step_sets(records, terms, id_col)))
    reps = cut(named.where("id = rep").select("id", "steps"))
    pairs = near_pairs(reps)
    same = reps.select(F.col("id").alias("a"), F.col("id").alias("b"))
    left = named.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    right = named.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    out = pairs.unionByName(same).join(left, "a").join(right, "b").where("x <> y")
    return out.select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id")).distinct()


def near_groups(records: DataFrame, terms: DataFrame, id_col: str = "workflow_id") -> DataFrame:
    """(id, class_id, group_id, links): of every record its class of equal sets, its group over all links, and its class's links to others."""
    named = cut(classes(step_sets(records, terms, id_col)))
    pairs = cut(near_pairs(cut(named.where("id = rep").select("id", "steps"))))
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    groups = connected_components(pairs, "a", "b").withColumnRenamed("id", "rep")
    first = groups.groupBy("root").agg(F.min("rep").alias("group_id"))
    groups = groups.join(first, "root").select("rep", "group_id")
    out = named.select("id", "rep").join(links, "rep", "left").join(groups, "rep", "left")
    return out.select(F.col("id").alias(id_col), F.col("rep").alias("class_id"), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
