"""Line, sentence and label rules as Column expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.functions import rules as R


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_heading(c: Column) -> Column:
    n = F.char_length(c)
    return n.between(3, 180) & (~c.rlike(R.STEP_LINE) | c.rlike(r"^\d+\.\d+")) & c.rlike(R.HEADING)


def line_class(c: Column) -> Column:
    bullet = c.rlike(r"^\s*[-•▪]")
    return F.when(c.rlike(R.STEP_LINE), F.when(bullet, "list_item").otherwise("step")).when(c.rlike(R.LIST_PAREN), "list_item").otherwise("paragraph")


def unit_class(c: Column) -> Column:
    return F.when(is_heading(c), "heading").otherwise(line_class(c))


def is_major(c: Column) -> Column:
    return c.rlike(R.MAJOR_SECTION)


def is_noise(c: Column) -> Column:
    n, low = F.char_length(c), F.lower(c)
    return (
        (n < 2)
        | c.rlike(R.BARE_NUMBER)
        | (c.rlike(R.ALLCAPS) & (n > 20))
        | (c.contains("—") & ~c.rlike(R.CLS_NUMBERED) & (n > 40))
        | low.rlike(R.NOISE_LOWER)
        | (low.contains("regression tests") & (n < 120))
    )


def is_conditional(c: Column) -> Column:
    return c.rlike(R.CONDITIONAL) | c.rlike(R.UNLESS)


def first_word(c: Column) -> Column:
    return F.regexp_extract(F.lower(c), r"^\W*(\w+)", 1)


def is_imperative(c: Column) -> Column:
    return first_word(c).isin(*R.IMPERATIVES) & ~F.lower(c).rlike(r"^\s*record all\b")


def sentence_class(c: Column) -> Column:
    """Ordered rules; the first that holds decides."""
    return (
        F.when(strip(c) == "", "DESCRIPTION")
        .when(is_conditional(c), "CONDITIONAL")
        .when(c.rlike(R.CLS_NUMBERED), "INSTRUCTION")
        .when(c.rlike(R.CLS_DESC_PREFIX), "DESCRIPTION")
        .when(c.rlike(R.CLS_COMPARISON), "DESCRIPTION")
        .when(is_imperative(c), "INSTRUCTION")
        .when(F.char_length(c) > 120, "DESCRIPTION")
        .otherwise("INSTRUCTION")
    )


def step_number(c: Column) -> Column:
    return F.regexp_extract(c, R.STEP_NUM, 1).try_cast("int")


def looks_descriptive(c: Column) -> Column:
    return (strip(F.coalesce(c, F.lit(""))) == "") | c.rlike(R.LIGHT_DESC)


def label(action: Column, obj: Column) -> Column:
    return F.trim(F.concat_ws(" ", action, F.when(obj != "", obj)))


def is_spurious_node(action: Column, obj: Column, sentence: Column) -> Column:
    """Nodes that name no step: bare numbers, descriptions, shouting headings and leftovers."""
    a, o = F.lower(F.trim(F.coalesce(action, F.lit("")))), F.lower(F.trim(F.coalesce(obj, F.lit(""))))
    name, said = label(action, obj), strip(F.coalesce(sentence, F.lit("")))
    shown = F.when(said != "", said).otherwise(name)
    return (
        name.rlike(R.PERFORM_NUMBER)
        | said.rlike(R.BARE_NUMBER)
        | looks_descriptive(shown)
        | (said.rlike(R.ALLCAPS) & (F.char_length(said) > 20))
        | ((a == "perform") & (o.rlike(r"^\d+$") | (o == "testing passes")))
        | (a == "aircraft")
        | ((a == "complete") & F.lower(name).contains("procedure below"))
    )


def is_spurious_action(action: Column, obj: Column, actor: Column, sentence: Column, step: Column) -> Column:
    """Extracted actions that name nothing to do: descriptions, questions, headings, talk about the procedure itself."""
    a, o = F.lower(action), F.lower(F.trim(F.coalesce(obj, F.lit(""))))
    said, name = strip(F.coalesce(sentence, F.lit(""))), F.lower(label(action, obj))
    low = F.lower(said)
    applies = low.startswith("this procedure applies") | low.contains("hairline cracks found") | name.contains("during borescope inspection")
    return (
        (sentence_class(said) == "DESCRIPTION")
        | said.rlike(R.BARE_NUMBER)
        | ((a == "perform") & (o.rlike(r"^\d+$") | (o == "testing passes")))
        | said.rlike(R.ASKS)
        | (said.rlike(R.ALLCAPS) & (F.char_length(said) > 20))
        | low.startswith("the procedure below")
        | (o.isin(*R.NOISE_OBJECTS) & said.rlike(R.LEADS))
        | name.contains("process for")
        | a.isin("follow", "follows", "differ")
        | ((a == "apply") & (applies | low.contains("differs from")))
        | F.lower(F.coalesce(actor, F.lit(""))).isin("this procedure", "this section", "this document")
        | ((F.char_length(name) > 80) & step.isNull())
    )


def normal_label(c: Column) -> Column:
    """Lower case, no articles, letters and digits only, single blanks."""
    x = F.regexp_replace(F.lower(c), r"\b(the|a|an)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9]+", " "), r" +", " "))


def clean_phrase(c: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[ ,;:.\-]+|[ ,;:.\-]+$", "")
    return F.regexp_replace(x, r"(?i)^(?:and|or|but)\s+", "")


def sentences(c: Column) -> Column:
    """Behind a full stop, question or exclamation mark and a blank, and at line ends; no empty ones."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+|\n+"), strip), lambda s: s != "")


def list_parts(c: Column, least: int = 3) -> Column:
    """The items of a chain of at least ``least`` separators, else the text."""
    n = F.size(F.split(c, R.LIST_SEP)) - 1
    parts = F.transform(F.split(c, R.LIST_SEP), lambda s: F.regexp_replace(s, r"^[ \t.,;:]+|[ \t.,;:]+$", ""))
    return F.when(n >= least, F.filter(parts, lambda s: s != "")).otherwise(F.array(c))


def split_at_steps(text: Column, unit_type: Column) -> Column:
    """Pieces of a chunk: at numbered steps, else at blank lines; steps and list items stay whole."""
    marked = F.split(F.regexp_replace(text, R.CHUNK_STEP, "\u0001$0"), "\u0001")
    n = F.size(marked) - 1
    at_steps = F.slice(marked, 2, F.greatest(n, F.lit(1)))
    blocks = F.split(text, r"\n\s*\n")
    raw = (
        F.when(unit_type.isin("step", "list_item"), F.array(text))
        .when((n <= 1) & ~text.contains("\n"), F.array(text))
        .when((n > 1) | ((n == 1) & (F.element_at(marked, 1) == "")), at_steps)
        .otherwise(blocks)
    )
    return F.filter(F.transform(raw, strip), lambda s: s != "")


def is_lookup(question: Column) -> Column:
    q = F.lower(F.trim(question))
    return q.rlike(R.LOOKUP) | (q.contains("where is") & q.contains("procedure"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z]+)"), 1)


def query_phrases(question: Column) -> Column:
    """All domain phrases, each once; without any the first three telling words as one phrase, if there are two."""
    domain = F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(R.DOMAIN_PHRASE), 0), lambda p: F.regexp_replace(F.lower(p), r"\s+", " ")))
    rest = F.slice(F.filter(tokens(question), lambda t: ~t.isin(*R.QUERY_STOPS)), 1, 3)
    return F.when(F.size(domain) > 0, domain).when(F.size(rest) >= 2, F.array(F.array_join(rest, " "))).otherwise(F.array().cast("array<string>"))


def query_hints(question: Column) -> Column:
    return F.filter(F.array_distinct(tokens(question)), lambda t: t.isin(*R.HINTS))


def query_keywords(question: Column) -> Column:
    return F.slice(F.filter(tokens(question), lambda t: ~t.isin(*R.QUERY_STOPS, "major")), 1, 12)


def kind_name(unit_type: Column) -> Column:
    """Unit types spelled alike: lower case, underscores; missing is paragraph."""
    x = F.regexp_replace(F.lower(F.trim(unit_type)), r"[\s\-]+", "_")
    return F.coalesce(F.when(x != "", x), F.lit("paragraph"))
