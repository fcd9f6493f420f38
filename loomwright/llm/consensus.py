"""Best representative of each group of records, field by field, by token consensus.

The distinct values of a field on file are turned into tokens. Which of the values
are sound is settled first: rules find what is missing, a stand-in, cut off or
wrongly decoded; a value that is part of another goes; and the values of a group
vote, token by token. A candidate is aligned with every other value, and where one
of its tokens holds a character that may be damage, each value that is sound puts
its weight (its records, the more trusted the more) to the token it has in that
column: to the same one, or to the one the candidate's would be without the
damage. A value with an outvoted token is garbled, though no list names how. Of
the values that are left, the order of the records decides, newest first.

Values are pre-aggregated to the distinct ones. The newest PART sound values of a
group are candidates; they meet the values of their group in parts of about PART
each, wherever the parts are, and votes of the parts are added up. If none of them
is left, the next PART are candidates. So no task holds a group, whatever its size,
and the size changes no result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.session import written

#: Distinct values of one group and field that meet in one part, and candidates of a round.
PART = 256
FIELDS = ("pages", "sections", "evidence_sources", "summary")
# Stand-ins for a value, lower case, without what is no letter or digit.
STAND_INS = (
    "na", "none", "null", "nil", "nan", "unknown", "unspecified", "untitled", "tbd", "tba", "todo", "pending", "missing", "empty", "notitle",
    "summarypending", "summarytbd", "nosummary", "workflowuntitled", "titlepending", "sectionpending", "placeholder",
    "notavailable", "notapplicable", "seeabove", "seebelow", "xxx", "x", "default", "undefined",
)
#: What a wrong decoding leaves behind, what a cut leaves at the end, what an omission does.
GARBLED = "[\ufffd\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]|Ã[\x80-¿]|â€|Â[\x80-¿]|ï»¿|Ð[\x80-¿]|Ñ[\x80-¿]"
CUT = r"(?i)(?:\.\.\.|…|\[(?:truncated|cut|more|continued)\]|\((?:truncated|cut|continued)\)|→|->|=>|[,;:(\[&/]|\b(?:and|or))\s*$"
OMITTED = r"(?:…|\.\.\.|\])\s*$"
#: A character that may be damage: no letter, digit, blank or common sign, or a question mark within a word.
DAMAGE = re.compile(r"[^\w\s!-~→–—°µ±×÷≤≥…•’‘“”„«»§·Ω]|(?<=\w)\?(?=\w)")
#: Letters that damage may have taken, at most.
TAKEN = 3


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"(?U)[\W_]+", "")


def spoilt_text(c: Column) -> Column:
    """Missing, void, a stand-in, garbled or visibly cut off."""
    bare = _bare(c)
    return F.coalesce((bare == "") | bare.isin(*STAND_INS) | c.rlike(GARBLED) | c.rlike(CUT), F.lit(True))


def _spoilt(field: str, value: Column) -> Column:
    if field == "summary":
        return spoilt_text(value)
    if field == "pages":
        broken = F.exists(value, lambda p: F.coalesce(p <= 0, F.lit(True)))
    elif field == "sections":
        broken = F.exists(value, spoilt_text)
    else:

        def bad(e: Column) -> Column:
            # A sentence of a source may end in a comma or an arrow of its own; a mark of omission may not.
            s = e["sentence"]
            bare = _bare(s)
            open_end = ~((bare == "") | bare.isin(*STAND_INS) | s.rlike(GARBLED) | s.rlike(OMITTED))
            kept = [F.coalesce(e[k].rlike(GARBLED), F.lit(False)) for k in ("document", "section")]
            return F.coalesce(spoilt_text(s) & ~F.coalesce(open_end, F.lit(False)), F.lit(True)) | F.coalesce(e["page"] <= 0, F.lit(False)) | kept[0] | kept[1] | e.isNull()

        broken = F.exists(value, bad)
    return F.coalesce((F.size(value) == 0) | broken, F.lit(True))


def _tokens(field: str, value: Column) -> Column:
    if field == "summary":
        return F.array(value)  # cut into words where they are aligned
    if field == "evidence_sources":
        return F.transform(value, lambda e: F.coalesce(F.to_json(e), F.lit("")))
    return F.transform(value, lambda x: F.coalesce(x.cast("string"), F.lit("")))


def part_of(field: str, own, other) -> bool:
    """Whether a value is strictly part of another one: as prepared by ``prepared``."""
    if field != "summary":
        return own[1] < other[1]
    text, tail = own[1]
    o = other[1][0]
    if len(o) > len(text) and text in o:
        return True
    if len(tail) >= 8 and o != text:  # under another title the text goes on
        at = o.find(tail)
        return at >= 0 and at + len(tail) < len(o)
    return False


def prepared(field: str, tokens: list[str]) -> tuple:
    """(tokens to align, what part_of compares)."""
    if field != "summary":
        return tokens, frozenset(tokens)
    text = tokens[0].strip()
    return text.split(), (text, text.partition(": ")[2])


def align(profile: list[str], tokens: list[str]) -> list[tuple[int, int]]:
    """Columns (index in profile or -1, index in tokens or -1) of a longest common subsequence."""
    lo, n, m = 0, len(profile), len(tokens)
    while lo < min(n, m) and profile[lo] == tokens[lo]:
        lo += 1
    hi = 0
    while hi < min(n, m) - lo and profile[n - 1 - hi] == tokens[m - 1 - hi]:
        hi += 1
    a, b = profile[lo : n - hi], tokens[lo : m - hi]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    middle, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            middle.append((lo + i, lo + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j + 1] == best[i][j] and len(a) - i == len(b) - j:
            middle.append((lo + i, lo + j))  # one token in place of another
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            middle.append((lo + i, -1))
            i += 1
        else:
            middle.append((-1, lo + j))
            j += 1
    middle += [(lo + x, -1) for x in range(i, len(a))] + [(-1, lo + x) for x in range(j, len(b))]
    return [(x, x) for x in range(lo)] + middle + [(n - hi + x, m - hi + x) for x in range(hi)]


def damaged_form(token: str, other: str) -> bool:
    """Whether ``token`` is ``other`` with some of its letters turned to damage: outside of it, both are the same."""
    lo, n, m = 0, len(token), len(other)
    while lo < min(n, m) and token[lo] == other[lo]:
        lo += 1
    hi = 0
    while hi < min(n, m) - lo and token[n - 1 - hi] == other[m - 1 - hi]:
        hi += 1
    x, y = token[lo : n - hi], other[lo : m - hi]
    return bool(y) and len(x) <= TAKEN and len(y) <= TAKEN and not DAMAGE.sub("", x.replace("?", "")) and DAMAGE.search(token) is not None and not DAMAGE.search(y)


def votes(candidate: list[str], values: list[tuple[list[str], float]]) -> dict[int, tuple[float, float]]:
    """Per token of the candidate that may be damaged: weight against it and for it, of values (tokens, weight)."""
    open_tokens = {i for i, t in enumerate(candidate) if DAMAGE.search(t)}
    if not open_tokens:
        return {}
    out = {i: [0.0, 0.0] for i in open_tokens}
    for tokens, weight in values:
        own, other = [], []  # a stretch without a common token
        for i, j in [*align(candidate, tokens), (None, None)]:
            if i is not None and not (i >= 0 and j >= 0 and candidate[i] == tokens[j]):
                own += [i] if i in out else []
                other += [tokens[j]] if j >= 0 else []
                continue
            for x in own:
                if any(damaged_form(candidate[x], t) for t in other):
                    out[x][0] += weight
            own, other = [], []
            if i in out:
                out[i][1] += weight
    return {i: (a, b) for i, (a, b) in out.items()}


JUDGED = "group_key string, field string, record_id bigint, rank int, held boolean, token int, against double, agreed double"
_NAMES = ("group_key", "field", "part", "value_no", "tokens", "spoilt", "weight", "rank", "record_id", "asks")


def _judge(batches):
    """What the values of each part say of the candidates sent to it. Rows come sorted by group, field and part."""
    key, rows = None, []
    names = [x.split()[0] for x in JUDGED.split(", ")]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.float64(), pa.float64())

    def said(key, rows):
        field = key[1]
        seen = [(prepared(field, r[4]), r) for r in rows]
        values = [(p, r) for p, r in seen if not r[9]]
        sound = [(p, r) for p, r in values if not r[5]]
        for p, r in seen:
            if not r[9]:
                continue
            held = any(part_of(field, p, q) for q, v in values if v[4] != r[4])
            found = {} if held else votes(p[0], [(q[0], v[6]) for q, v in sound if v[4] != r[4]])
            if not found:
                yield key[0], field, r[8], r[7], held, None, 0.0, 0.0
            for token, (against, agreed) in found.items():
                yield key[0], field, r[8], r[7], held, token, against, agreed

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 8, kinds)], names=names)

    for batch in batches:
        out = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(len(_NAMES)))):
            if row[:3] != key:
                if rows:
                    out += said(key, rows)
                key, rows = row[:3], []
            rows.append(row)
        yield table(out)
    if rows:
        yield table(list(said(key, rows)))


def survivors(records: DataFrame, group_col: str = "workflow_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(group, field, record_id): the record whose value of the field survives in its group.

    ``records`` has group_col, record_id bigint, trust int, recorded_at timestamp
    and the fields. No value survives that is missing, void, a stand-in,
    impossible (pages below 1), garbled, cut off, or strictly part of another
    value of the group (lists compared as sets); of the rest the latest does, at
    the same instant the more trusted, then the smaller record_id. A group and
    field without such a value has no row; nor has a null group. Equal values
    count once, with their best record; null recorded_at is earliest, null trust
    least trusted. Repeated rows change nothing and other columns are ignored. An
    empty table gives an empty result.
    """
    micros = F.coalesce(F.unix_micros(F.col("recorded_at").cast("timestamp")), F.lit(-(2**62)))
    base = records.where(F.col(group_col).isNotNull() & F.col("record_id").isNotNull()).select(
        F.col(group_col).alias("group_key"), "record_id", micros.alias("at"), F.coalesce("trust", F.lit(2**31 - 1)).cast("bigint").alias("trust"), *fields
    )
    # One row a record and field, then one a distinct value, with its best record and the records' weight.
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), _tokens(f, F.col(f)).alias("tokens"), _spoilt(f, F.col(f)).alias("spoilt")) for f in fields])).alias("v")
    values = base.distinct().select("group_key", "record_id", "at", "trust", long).select("group_key", "v.*", "record_id", "at", "trust").where("size(tokens) > 0 and tokens[0] is not null")
    best = F.max(F.struct("at", (-F.col("trust")).alias("trusted"), (-F.col("record_id")).alias("id"))).alias("best")
    weight = F.sum(1 / (1 + F.greatest(F.col("trust"), F.lit(0))))
    values = values.groupBy("group_key", "field", "tokens", "spoilt").agg(best, weight.alias("weight"))
    values = written(values.withColumn("record_id", -F.col("best.id")))

    big = values.groupBy("group_key", "field").agg(F.count("*").alias("n")).where(f"n > {PART}")
    some = not big.isEmpty()
    parts = F.expr(f"cast(ceil(coalesce(n, 1) / {PART}) as int)")
    if some:
        values = values.join(big, ["group_key", "field"], "left").withColumn("parts", parts).drop("n")
    else:
        values = values.withColumn("parts", F.lit(1))
    held = values.withColumn("part", F.pmod(F.xxhash64("record_id"), F.col("parts")).cast("int"))

    newest = Window.partitionBy("group_key", "field").orderBy(F.desc("best.at"), F.desc("best.trusted"), F.desc("best.id"))
    rest, found = values.where("not spoilt"), None
    while True:
        ranked = rest.withColumn("rank", F.row_number().over(newest)).where(f"rank <= {PART}")
        asked = ranked.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        shape = [F.lit(0).alias("value_no"), "tokens", "spoilt", "weight"]
        rows = held.select("group_key", "field", "part", *shape, F.lit(0).alias("rank"), "record_id", F.lit(False).alias("asks"))
        if found is not None:
            rows = rows.join(asked.select("group_key", "field").distinct(), ["group_key", "field"], "left_semi").select(*_NAMES)
        rows = rows.unionByName(asked.select("group_key", "field", "part", *shape, "rank", "record_id", F.lit(True).alias("asks")))
        rows = rows.repartition("group_key", "field", "part").sortWithinPartitions("group_key", "field", "part", "asks", "rank", "record_id")
        judged = rows.select(*_NAMES).mapInArrow(_judge, JUDGED)
        one = judged.groupBy("group_key", "field", "record_id", "rank", "token").agg(F.max("held").alias("held"), (F.sum("against") > F.sum("agreed")).alias("outvoted"))
        left = one.groupBy("group_key", "field", "record_id", "rank").agg(F.max("held").alias("held"), F.max("outvoted").alias("outvoted")).where("not held and not outvoted")
        winners = left.groupBy("group_key", "field").agg(F.min(F.struct("rank", "record_id"))["record_id"].alias("record_id"))
        if not some:
            return winners.withColumnRenamed("group_key", group_col)
        winners = written(winners)
        found = winners if found is None else found.unionByName(winners)
        seen = ranked.select("group_key", "field", "record_id")
        rest = rest.join(big, ["group_key", "field"], "left_semi").join(winners, ["group_key", "field"], "left_anti").join(seen, ["group_key", "field", "record_id"], "left_anti")
        rest = written(rest)
        if rest.isEmpty():
            return found.withColumnRenamed("group_key", group_col)
