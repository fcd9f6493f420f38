"""Mapping of freely typed values to the entries of a reference list.

Only built-in expressions and equality joins. A value is folded (letters of other
scripts that look alike, case, blanks, punctuation). First whole strings meet by the
pigeonhole join: a reference string is cut into k + 1 segments; a typed string
within k edits holds one of them unchanged, moved by at most k; substrings at those
places meet the segments in an equality join, and ``levenshtein`` verifies. What is
within one edit of a name or alias is that entry's. An anti-join leaves the rest,
which is cut into words; each distinct word is matched once with the words of the
reference list:

* equal to a form of a reference word: the word, its inflections, its consonant
  skeleton, a dotted beginning, two words written as one;
* else by the same pigeonhole join.

Of a word's matches only the nearest stay. A reference entry is meant if each
word of its name, or of an alias, is matched by another word of the value; what
is left of the value (articles, counts, remarks) says nothing. Values no entry is
meant by are those an anti-join leaves, and get id 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.session import cut

# Letters that look alike, and what they are read as.
LOOKALIKES = "аеорсухіѕјԁһкмтвноαορνικτ"
READ_AS = "aeopcyxisjdhkmtbhoaopviKt".lower()
# Irregular past forms of English verbs, as form:verb.
IRREGULAR = (
    "ground:grind took:take taken:take wrote:write written:write broke:break broken:break "
    "wound:wind bound:bind held:hold left:leave found:find cut:cut put:put set:set shut:shut "
    "drew:draw drawn:draw bent:bend sent:send built:build hung:hang swung:swing spun:spin "
    "drove:drive driven:drive blew:blow blown:blow fed:feed led:lead bled:bleed read:read"
)
#: Edits at most in words of under LONG letters, and in longer ones; a swap of neighbours counts one.
EDITS, LONG, EDITS_LONG = 1, 9, 2
K = 2
#: Shortest word that may be matched by edits.
LEAST = 3


def fold(c: Column) -> Column:
    """Lower case, Latin look-alikes, single blanks; dots kept behind letters only."""
    x = F.translate(F.lower(c), LOOKALIKES, READ_AS)
    x = F.regexp_replace(x, r"[^\p{L}\p{N}.]+", " ")
    x = F.regexp_replace(x, r"(?<!\p{L})\.", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def words(c: Column) -> Column:
    """The words of a value, without such as hold a digit."""
    return F.filter(F.split(fold(c), " "), lambda w: (w != "") & ~w.rlike(r"\p{N}"))


def reference_words(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, term_id, phrase, word, size) of all names and aliases; (kind, form, word, cost) of all words."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    phrases = terms.where("name is not null and term_id is not null").select("kind", "term_id", F.explode(F.array_distinct(names)).alias("phrase"))
    split = F.array_distinct(F.transform(words(F.col("phrase")), lambda w: F.regexp_replace(w, r"\.", "")))
    phrases = phrases.withColumn("ws", split).where("size(ws) > 0")
    parts = phrases.select("kind", "term_id", "phrase", F.size("ws").alias("size"), F.explode("ws").alias("word")).distinct()
    single = parts.select("kind", "word").distinct()
    table = "map(" + ",".join("'{}','{}'".format(*p.split(":")) for p in IRREGULAR.split()) + ")"
    forms = F.expr(
        f"""
        filter(flatten(array(
          array(named_struct('form', word, 'cost', 0.0d)),
          transform(array(
            word || 's', word || 'es', word || 'ed', word || 'ing', word || 'er',
            if(word like '%e', word || 'd', null),
            if(word like '%e', left(word, length(word) - 1) || 'ing', null),
            if(word rlike '[^aeiou]y$', left(word, length(word) - 1) || 'ies', null),
            if(word rlike '[^aeiou]y$', left(word, length(word) - 1) || 'ied', null),
            if(word rlike '[aeiou][bdgklmnprt]$', word || right(word, 1) || 'ed', null),
            if(word rlike '[aeiou][bdgklmnprt]$', word || right(word, 1) || 'ing', null)
          ), f -> named_struct('form', f, 'cost', 0.1d)),
          transform(map_keys(map_filter({table}, (k, v) -> v = word)), f -> named_struct('form', f, 'cost', 0.1d)),
          transform(array(
            left(word, 1) || regexp_replace(substring(word, 2), '[aeiou]', ''),
            left(word, 2) || regexp_replace(substring(word, 3), '[aeiou]', '')
          ), f -> named_struct('form', if(length(f) < length(word) and length(f) > 1, f, null), 'cost', 0.5d)),
          transform(if(length(word) > 4, sequence(3, least(length(word) - 1, 6)), array()),
                    n -> named_struct('form', left(word, n) || '.', 'cost', 0.6d))
        )), f -> f.form is not null)"""
    )
    variants = single.select("kind", "word", F.explode(forms).alias("f")).select("kind", "word", "f.form", "f.cost")
    return parts, variants.groupBy("kind", "form", "word").agg(F.min("cost").alias("cost"))


def _nearest(matches: DataFrame) -> DataFrame:
    """Of each word's matches the nearest, ties all."""
    least = matches.groupBy("kind", "q").agg(F.min("cost").alias("least"))
    return matches.join(least, ["kind", "q"]).where("cost = least").select("kind", "q", "word", "cost").distinct()


def close_strings(typed: DataFrame, reference: DataFrame, k: int = K) -> DataFrame:
    """The pigeonhole join: (kind, q, form, …, cost) of typed (kind, q) and reference strings (kind, form, …) within k edits.

    A reference string is cut into k + 1 segments; one of them stands unchanged in
    any string within k edits, moved by at most k. Substrings of the typed string at
    those places meet the segments by equality, ``levenshtein`` verifies. A swap of
    neighbours counts one.
    """
    segments = reference.where(f"length(form) >= {LEAST}").select(
        "*", F.length("form").alias("n"),
        F.explode(F.expr(f"transform(sequence(0, {k}), i -> struct(i as seg, cast(floor(i * length(form) / {k + 1}) as int) as at, cast(floor((i + 1) * length(form) / {k + 1}) as int) as till))")).alias("s"),
    ).select(*reference.columns, "n", "s.seg", F.expr("substring(form, s.at + 1, s.till - s.at)").alias("piece"))
    probes = typed.where(f"length(q) >= {LEAST}").select("kind", "q", F.explode(F.expr(f"sequence(greatest({LEAST}, length(q) - {k}), length(q) + {k})")).alias("n"))
    probes = probes.select("kind", "q", "n", F.explode(F.expr(f"sequence(0, {k})")).alias("seg"))
    probes = probes.withColumns({"at": F.expr(f"cast(floor(seg * n / {k + 1}) as int)"), "till": F.expr(f"cast(floor((seg + 1) * n / {k + 1}) as int)")})
    probes = probes.select("kind", "q", "n", "seg", F.explode(F.expr(f"transform(sequence(greatest(0, at - {k}), greatest(0, least(at + {k}, length(q) - (till - at)))), p -> substring(q, p + 1, till - at))")).alias("piece")).distinct()
    pairs = probes.join(segments, ["kind", "n", "seg", "piece"]).select("kind", "q", *[c for c in reference.columns if c != "kind"]).distinct()
    pairs = pairs.withColumn("lev", F.expr(f"levenshtein(q, form, {k})")).where("lev >= 0")
    swapped = "lev = 2 and length(q) = length(form) and array_sort(split(q, '')) = array_sort(split(form, ''))"
    return pairs.withColumn("cost", F.expr(f"cast(if({swapped}, 1, lev) as double)")).drop("lev")


def match_strings(typed: DataFrame, terms: DataFrame) -> DataFrame:
    """(kind, value, term_id, cost) of values that are, folded, a name or alias, or one edit from it; the nearest, then the smaller id."""
    folded = F.array_join(F.transform(words(F.col("value")), lambda w: F.regexp_replace(w, r"\.", "")), " ")
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    reference = terms.where("name is not null and term_id is not null").select("kind", "term_id", F.explode(names).alias("value"))
    reference = reference.select("kind", "term_id", folded.alias("form")).where("form <> ''").distinct()
    asked = typed.select("kind", "value", folded.alias("q")).where("q <> ''")
    equal = asked.join(reference.withColumnRenamed("form", "q"), ["kind", "q"]).select("kind", "value", "term_id", F.lit(0.0).alias("cost"))
    near = close_strings(asked.select("kind", "q").distinct(), reference).where(f"cost <= {EDITS}")
    near = asked.join(near, ["kind", "q"]).select("kind", "value", "term_id", "cost")
    best = equal.unionByName(near).groupBy("kind", "value").agg(F.min(F.struct("cost", "term_id")).alias("best"))
    return best.select("kind", "value", F.col("best.term_id").alias("term_id"), F.col("best.cost").alias("cost"))


def match_words(typed: DataFrame, forms: DataFrame) -> DataFrame:
    """(kind, q, word, cost) for each distinct typed word (kind, q) that means reference words."""
    bare = F.regexp_replace("q", r"\.", "")
    equal = typed.join(forms.withColumnRenamed("form", "q"), ["kind", "q"])
    undotted = typed.where("q like '%.'").withColumn("form", bare).join(forms, ["kind", "form"]).select("kind", "q", "word", "cost")
    exact = _nearest(equal.select("kind", "q", "word", "cost").unionByName(undotted))
    exact = cut(exact)
    rest = typed.join(exact.select("kind", "q").distinct(), ["kind", "q"], "left_anti")

    near = _nearest(close_strings(rest, forms.where("cost < 0.5").select("kind", "form", "word")).where(f"cost <= if(length(form) < {LONG}, {EDITS}, {EDITS_LONG})"))
    near = cut(near)
    left = rest.join(near.select("kind", "q").distinct(), ["kind", "q"], "left_anti")
    return exact.unionByName(near).unionByName(_joined(left, forms))


def _joined(left: DataFrame, forms: DataFrame) -> DataFrame:
    """Words written as one, cut where both parts are forms of reference words; both parts' words match."""
    whole = forms.where("cost < 0.5")
    cuts = left.where("length(q) >= 6").select("kind", "q", F.explode(F.expr("sequence(3, length(q) - 3)")).alias("at"))
    cuts = cuts.select("kind", "q", F.expr("left(q, at)").alias("a"), F.expr("substring(q, at + 1)").alias("b"))
    a = whole.select("kind", F.col("form").alias("a"), F.col("word").alias("wa"))
    b = whole.select("kind", F.col("form").alias("b"), F.col("word").alias("wb"))
    both = cuts.join(a, ["kind", "a"]).join(b, ["kind", "b"])
    return both.select("kind", "q", F.explode(F.array("wa", "wb")).alias("word"), F.lit(1.0).alias("cost")).distinct()


def _meanings(values: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """typed (kind, value); placed (…, pos, q); matched (…, pos, q, word, cost); meant (kind, value, term_id)."""
    typed = values.select("kind", "value").where("value is not null").distinct()
    typed = typed.where(F.regexp_replace("value", r"[\s\u00a0\u3000]+", "") != "")
    parts, forms = reference_words(terms.select("term_id", "kind", "name", "aliases"))
    typed, parts, forms = cut(typed), cut(parts), cut(forms)  # each is read many times below
    whole = cut(match_strings(typed, terms))
    rest = typed.join(whole, ["kind", "value"], "left_anti")
    placed = rest.select("kind", "value", F.posexplode(words(F.col("value"))).alias("pos", "q"))
    matched = cut(placed.join(match_words(cut(placed.select("kind", "q").distinct()), forms), ["kind", "q"]))
    hits = matched.join(parts, ["kind", "word"])
    hits = hits.groupBy("kind", "value", "term_id", "phrase", "size", "word").agg(F.min(F.struct("cost", "pos")).alias("best"))
    full = hits.groupBy("kind", "value", "term_id", "phrase", "size").agg(F.count("*").alias("n"), F.sum("best.cost").alias("cost"))
    full = full.where("n = size")
    meant = full.groupBy("kind", "value").agg(F.min(F.struct((-F.col("size")).alias("less"), "cost", "term_id")).alias("best"))
    return typed, placed, matched, whole.select("kind", "value", "term_id").unionByName(meant.select("kind", "value", F.col("best.term_id").alias("term_id")))


def map_values(values: DataFrame, terms: DataFrame) -> DataFrame:
    """(kind, value, term_id) for each distinct (kind, value); term_id 0 where the list has none that is meant.

    Null and blank values have no row. Of several entries that are meant the one
    with more words, then fewer edits, then the smaller id counts. An empty list
    gives 0 for every value; repeated entries count once; other columns of either
    table are ignored. Texts of any length are read whole.
    """
    typed, _, _, meant = _meanings(values, terms)
    none = typed.join(meant, ["kind", "value"], "left_anti").withColumn("term_id", F.lit(0))
    return meant.unionByName(none.select("kind", "value", F.col("term_id").cast(meant.schema["term_id"].dataType)))


def canonical_values(values: DataFrame, terms: DataFrame) -> DataFrame:
    """(kind, value, canon): one spelling for all ways to type a thing, on the list or not.

    Of an entry that is meant, its id. Else the reference words the value holds, if
    there are two; else the consonants of its own words, without endings. Null and
    blank values have no row.
    """
    typed, placed, matched, meant = _meanings(values, terms)
    one = matched.groupBy("kind", "value", "pos").agg(F.min(F.struct("cost", "word")).alias("m"))
    known = one.groupBy("kind", "value").agg(F.array_sort(F.collect_set("m.word")).alias("ws")).where("size(ws) >= 2")
    # Words that say nothing of what is done, or to what.
    bare = "filter(transform(words, w -> regexp_replace(w, '[.]', '')), w -> not array_contains(array('the','a','an','each','please','and','then','to','assy','old','worn','no'), w))"
    endings = f"transform({bare}, w -> regexp_replace(w, '(?<=..)(?:ing|ed|es|s|e)$', ''))"
    skeleton = f"array_join(transform({endings}, w -> left(w, 1) || regexp_replace(regexp_replace(substring(w, 2), '[aeiou]', ''), '(.)\\\\1+', '$1')), ' ')"
    own = typed.withColumn("words", words(F.col("value"))).select("kind", "value", F.expr(skeleton).alias("own"))
    named = own.join(meant, ["kind", "value"], "left").join(known, ["kind", "value"], "left")
    canon = F.coalesce(F.concat(F.lit("#"), F.col("term_id").cast("string")), F.concat(F.lit("="), F.array_join("ws", " ")), F.concat(F.lit("~"), F.col("own")))
    return named.select("kind", "value", canon.alias("canon"))


def map_fields(rows: DataFrame, terms: DataFrame, id_col: str = "node_id", fields: tuple[str, ...] = ("action", "object")) -> DataFrame:
    """(id, field, term_id) for each row's field whose value is neither null nor blank nor a name of the list.

    Values are gathered before they are matched, so that a value typed in a third
    of all rows is matched once. Repeated rows count once; see ``map_values``.
    """
    long = rows.select(id_col, F.explode(F.array(*[F.struct(F.lit(f).alias("kind"), F.col(f).alias("value")) for f in fields])).alias("x"))
    long = long.select(id_col, "x.kind", "x.value").where("value is not null")
    names = terms.select("kind", F.col("name").alias("value")).distinct()
    values = long.select("kind", "value").distinct().join(names, ["kind", "value"], "left_anti")
    mapped = map_values(values, terms)
    return long.join(mapped, ["kind", "value"]).select(id_col, F.col("kind").alias("field"), "term_id").distinct()
