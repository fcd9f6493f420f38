"""Registered queries of the core operators, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright import config
from loomwright.functions import rules as R
from loomwright.functions import text as X
from loomwright.functions import vectors as V
from loomwright.operators import actions as A
from loomwright.operators import build, coref, dedup, graphs, markers, retrieval, segment, similarity, units, workflows
from loomwright.session import table, written
from loomwright.streaming.ingest import event_windows

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if SQL can say it."""

    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


# --- SQL shared by the counterparts -------------------------------------------------

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return STRIP.format(x)


def _class(x: str) -> str:
    return f"""case when regexp_matches({x}, '{R.STEP_LINE}') then case when regexp_matches({x}, '^\\s*[-•▪]') then 'list_item' else 'step' end
      when regexp_matches({x}, '{R.LIST_PAREN}') then 'list_item' else 'paragraph' end"""


def _heading(x: str) -> str:
    return rf"(length({x}) between 3 and 180 and (not regexp_matches({x}, '{R.STEP_LINE}') or regexp_matches({x}, '^\d+\.\d+')) and regexp_matches({x}, '{R.HEADING}'))"


def _noise(x: str) -> str:
    return rf"""(length({x}) < 2 or regexp_matches({x}, '{R.BARE_NUMBER}') or (regexp_matches({x}, '{R.ALLCAPS}') and length({x}) > 20)
      or (contains({x}, '—') and not regexp_matches({x}, '{R.CLS_NUMBERED}') and length({x}) > 40)
      or regexp_matches(lower({x}), '{R.NOISE_LOWER}')
      or (contains(lower({x}), 'regression tests') and length({x}) < 120))"""


def _listed(words) -> str:
    return "(" + ",".join(f"'{w}'" for w in words) + ")"


def _kind(x: str) -> str:
    return rf"""case when {_strip(x)} = '' then 'DESCRIPTION' when regexp_matches({x}, '{R.CONDITIONAL}') or regexp_matches({x}, '{R.UNLESS}') then 'CONDITIONAL'
      when regexp_matches({x}, '{R.CLS_NUMBERED}') then 'INSTRUCTION' when regexp_matches({x}, '{R.CLS_DESC_PREFIX}') or regexp_matches({x}, '{R.CLS_COMPARISON}') then 'DESCRIPTION'
      when regexp_extract(lower({x}), '^\W*(\w+)', 1) in {_listed(R.IMPERATIVES)} and not regexp_matches(lower({x}), '^\s*record all\b') then 'INSTRUCTION'
      when length({x}) > 120 then 'DESCRIPTION' else 'INSTRUCTION' end"""


CHUNKS = rf"""chunk_rows as (select chunk_id, document_id, order_index, {_strip('text')} as text, page, section, paragraph,
  coalesce(nullif(regexp_replace(lower(trim(unit_type)), '[\s\-]+', '_', 'g'), ''), 'paragraph') as unit_type
  from (select distinct chunk_id, document_id, order_index, text, page, section, paragraph, unit_type from chunks where text is not null) where {_strip('text')} <> '')"""
SENTENCES = rf"""sentence_rows as (select chunk_id, document_id, order_index, page, section, unit_type, s.s as sentence, s.i as sent_index from chunk_rows,
  lateral (select unnest(x) as s, generate_subscripts(x, 1) - 1 as i from (select list_filter(list_transform(string_split(
    regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda p: {_strip('p')}), lambda p: p <> '') as x)) s)"""
NODES = r"""node_rows as (select *, trim(regexp_replace(regexp_replace(regexp_replace(lower(label), '\b(the|a|an)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) as normal
  from (select distinct workflow_id, node_id, ord, action, object, actor, page, section, trim(concat_ws(' ', action, nullif(object, ''))) as label from nodes where node_id is not null and workflow_id is not null))"""
EDGES = """edge_rows as (select workflow_id, i as seq, e.source as source, e.target as target, e.relation as relation, e.weight as weight, e.evidence as evidence
  from (select workflow_id, unnest(edges) as e, generate_subscripts(edges, 1) - 1 as i from (select distinct workflow_id, edges from workflows where edges is not null)))"""


def _descriptive(x: str) -> str:
    return f"({_strip(f'''coalesce({x}, '')''')} = '' or regexp_matches({x}, '{R.LIGHT_DESC}'))"


WNODES = r"""step_rows as (select *, trim(concat_ws(' ', action, nullif(object, ''))) as label, coalesce(regexp_replace(sentence, '^\s+|\s+$', '', 'g'), '') as said
  from (select distinct workflow_id, n.node_id as node_id, n.ord as ord, n.action as action, n.object as object, n.actor as actor, n.sentence as sentence from (select workflow_id, unnest(nodes) as n from workflows where workflow_id is not null)) where node_id is not null)"""
SPURIOUS = rf"""coalesce(regexp_matches(label, '{R.PERFORM_NUMBER}') or regexp_matches(said, '{R.BARE_NUMBER}') or {_descriptive("coalesce(nullif(said, ''), label)")}
  or (regexp_matches(said, '{R.ALLCAPS}') and length(said) > 20)
  or (lower(trim(coalesce(action, ''))) = 'perform' and (regexp_matches(trim(coalesce(object, '')), '^\d+$') or lower(trim(coalesce(object, ''))) = 'testing passes'))
  or lower(trim(coalesce(action, ''))) = 'aircraft' or (lower(trim(coalesce(action, ''))) = 'complete' and contains(lower(label), 'procedure below')), true)"""


def _chunks(spark, d) -> DataFrame:
    return units.chunk_rows(table(spark, d, "chunks"))


def _sentences(spark, d) -> DataFrame:
    rows = _chunks(spark, d).select("*", F.posexplode(X.sentences(F.col("text"))).alias("sent_index", "sentence"))
    return rows.drop("text")


def _nodes(spark, d) -> DataFrame:
    return graphs.node_rows(table(spark, d, "nodes"))


def _steps(spark, d) -> DataFrame:
    return graphs.workflow_nodes(table(spark, d, "workflows"))


def _edges(spark, d) -> DataFrame:
    return graphs.edge_rows(table(spark, d, "workflows"))


# --- scans, units, chunks -----------------------------------------------------------

LINES = rf"""line_rows as (select doc_id, unit_no, text, case when {_heading('text')} then 'heading' else {_class('text')} end as unit_type
  from (select doc_id, unit_no, {_strip('line')} as text from (select doc_id, unnest(l) as line, generate_subscripts(l, 1) - 1 as unit_no
    from (select doc_id, string_split_regex(text, '\r\n|\n|\r') as l from documents where text is not null))) where text <> '')"""


@query(
    rf"""with {LINES} select doc_id, unit_no, text, unit_type,
  last_value(case when unit_type = 'heading' then text end ignore nulls) over w as section,
  case when unit_type <> 'heading' then sum(case when unit_type = 'heading' then 0 else 1 end) over w end as paragraph, 1 as page,
  greatest(sum(case when regexp_matches(text, '{R.MAJOR_SECTION}') then 1 else 0 end) over (partition by doc_id), 1)::int as page_count
  from line_rows window w as (partition by doc_id order by unit_no rows between unbounded preceding and current row)"""
)
def unit_scan(spark, d):
    return units.text_units(table(spark, d, "documents"), "doc_id")


@query(f"with {LINES} select unit_type, count(*) as n, count(distinct doc_id) as docs from line_rows group by unit_type")
def line_classify(spark, d):
    u = units.scan_lines(table(spark, d, "documents"), "doc_id").withColumn("unit_type", X.unit_class(F.col("text")))
    return u.groupBy("unit_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(
    rf"""with {CHUNKS}, marked as (select *, string_split(regexp_replace(text, '{R.CHUNK_STEP}', chr(1) || '\0', 'g'), chr(1)) as m from chunk_rows),
  parts as (select *, case when unit_type in ('heading', 'table', 'step', 'list_item') then [text] when len(m) <= 2 and not contains(text, chr(10)) then [text]
    when len(m) > 2 or (len(m) = 2 and m[1] = '') then m[2:] else string_split_regex(text, '\n\s*\n') end as p from marked),
  flat as (select chunk_id, unit_type, q as p from (select chunk_id, unit_type, case when unit_type in ('heading', 'table') then p else list_filter(list_transform(p, lambda x: {_strip('x')}), lambda x: x <> '') end as q from parts))
  select chunk_id, piece_no, piece, case when unit_type in ('heading', 'table') then unit_type else {_class('piece')} end as piece_type
  from (select chunk_id, unit_type, unnest(p) as piece, generate_subscripts(p, 1) - 1 as piece_no from flat)"""
)
def chunk_split(spark, d):
    return units.split_chunks(_chunks(spark, d))


@query(
    rf"""with raw as (select document_id, unnest(units) as u, generate_subscripts(units, 1) - 1 as unit_no from (select distinct document_id, units from docs where units is not null)),
  unit_rows as (select document_id, unit_no, {_strip('u.text')} as text, u.page as page, u.section as section, u.paragraph as paragraph,
    coalesce(nullif(regexp_replace(lower(trim(u.unit_type)), '[\s\-]+', '_', 'g'), ''), 'paragraph') as unit_type from raw where u.text is not null),
  filled as (select *, last_value(case when unit_type = 'heading' then text end ignore nulls) over (partition by document_id order by unit_no rows between unbounded preceding and current row) as current from unit_rows where text <> ''),
  marked as (select *, string_split(regexp_replace(text, '{R.CHUNK_STEP}', chr(1) || '\0', 'g'), chr(1)) as m from filled),
  parts as (select *, case when unit_type in ('heading', 'table', 'step', 'list_item') then [text] when len(m) <= 2 and not contains(text, chr(10)) then [text]
    when len(m) > 2 or (len(m) = 2 and m[1] = '') then m[2:] else string_split_regex(text, '\n\s*\n') end as p from marked),
  flat as (select *, case when unit_type in ('heading', 'table') then p else list_filter(list_transform(p, lambda x: {_strip('x')}), lambda x: x <> '') end as q from parts),
  pieces as (select document_id, unit_no, page, coalesce(current, section) as section, paragraph, unit_type, unnest(q) as text, generate_subscripts(q, 1) - 1 as piece_no from flat)
  select 'chunk_' || substr(sha256(concat_ws('/', document_id, unit_no::varchar, piece_no::varchar)), 1, 12) as chunk_id, document_id,
    row_number() over (partition by document_id order by unit_no, piece_no) - 1 as order_index, text, page, section, paragraph, unit_type from pieces"""
)
def unit_chunks(spark, d):
    return units.chunk_units(units.doc_units(table(spark, d, "docs")))


@query(f"with {CHUNKS}, {SENTENCES} select chunk_id, sent_index, sentence from sentence_rows")
def sentence_split(spark, d):
    return _sentences(spark, d).select("chunk_id", "sent_index", "sentence")


@query(
    rf"""with {CHUNKS}, cut as (select chunk_id, text, string_split_regex(text, '{R.LIST_SEP}') as p from chunk_rows),
  parts as (select chunk_id, case when len(p) > 3 then list_filter(list_transform(p, lambda s: regexp_replace(s, '^[ \t.,;:]+|[ \t.,;:]+$', '', 'g')), lambda s: s <> '') else [text] end as p from cut)
  select chunk_id, unnest(p) as item, generate_subscripts(p, 1) - 1 as item_no from parts"""
)
def list_separator_split(spark, d):
    return _chunks(spark, d).select("chunk_id", F.posexplode(X.list_parts(F.col("text"))).alias("item_no", "item"))


# --- sentence and label rules -------------------------------------------------------


@query(f"with {CHUNKS}, {SENTENCES} select chunk_id, sent_index, {_noise('sentence')} as noise, {_kind('sentence')} as kind from sentence_rows")
def sentence_classify(spark, d):
    s = F.col("sentence")
    return _sentences(spark, d).select("chunk_id", "sent_index", X.is_noise(s).alias("noise"), X.sentence_class(s).alias("kind"))


@query(
    rf"""with {CHUNKS}, {SENTENCES}, c as (select chunk_id, sent_index, sentence, try_cast(regexp_extract(sentence, '{R.TARGET_RANGE}', 1) as int) as lo, try_cast(regexp_extract(sentence, '{R.TARGET_RANGE}', 2) as int) as hi
    from sentence_rows where regexp_matches(sentence, '{R.CONDITIONAL}') or regexp_matches(sentence, '{R.UNLESS}'))
  select chunk_id, sent_index, {_strip(r"regexp_replace(regexp_extract(sentence, '^([^,]*)', 1), '(?i)^\s*(?:if|unless)\s+', '', 'g')")} as condition,
  lower(regexp_extract(sentence, '{R.CONDITIONAL}', 1)) as rework,
  array_to_string(case when lo is not null and hi is not null and lo <= hi and hi - lo < 1000 then range(lo, hi + 1)
    else list_transform(regexp_extract_all(sentence, '{R.TARGET_ONE}', 1), lambda x: try_cast(x as bigint)) end, ',') as targets from c"""
)
def conditional_parse(spark, d):
    rows = A.conditions(_sentences(spark, d))
    return rows.select("chunk_id", "sent_index", "condition", "rework", F.array_join(F.transform("target_steps", lambda x: x.cast("string")), ",").alias("targets"))


@query(f"with {CHUNKS} select chunk_id, try_cast(regexp_extract(text, '{R.STEP_NUM}', 1) as int) as step_number from chunk_rows where try_cast(regexp_extract(text, '{R.STEP_NUM}', 1) as int) is not null")
def step_number(spark, d):
    return _chunks(spark, d).withColumn("step_number", X.step_number(F.col("text"))).where("step_number is not null").select("chunk_id", "step_number")


_HEAD = "|".join(m.replace(" ", r"\s+") for m, _ in R.all_markers())
_BARE = rf"regexp_replace({_strip(rf'''regexp_replace(regexp_replace(sentence, '{R.STEP_NUM}', '', 'g'), '(?i)^\s*(?:{_HEAD})\s+[^,]+,\s*', '', 'g')''')}, '[.!?;:]+$', '', 'g')"


@query(
    rf"""with {CHUNKS}, {SENTENCES}, x as (select chunk_id, sent_index, {_BARE} as x from sentence_rows where {_kind('sentence')} = 'INSTRUCTION'),
  y as (select *, regexp_extract(x, '^(\S+)', 1) as first, {_strip(r"regexp_replace(x, '^\S+\s*', '', 'g')")} as rest from x),
  z as (select *, regexp_matches(first, '^[A-Za-z]+$') and lower(first) not in {_listed(R.STOP_VERBS)} as word from y)
  select chunk_id, sent_index, case when word then lower(first) else 'perform' end as action, case when word then nullif(rest, '') else x end as object
  from z where word or (x <> '' and len(string_split_regex(x, '\s+')) <= 6)"""
)
def imperative_extract(spark, d):
    s = F.col("sentence")
    rows = _sentences(spark, d).where(X.sentence_class(s) == "INSTRUCTION").withColumn("a", A.imperative(s)).where("a is not null")
    return rows.select("chunk_id", "sent_index", F.col("a.action").alias("action"), F.col("a.object").alias("object"))


@query(
    rf"""with {CHUNKS}, {SENTENCES} select chunk_id, sent_index, lower(regexp_extract(sentence, '{R.CAUSATIVE}', 3)) as action, regexp_extract(sentence, '{R.CAUSATIVE}', 2) as object,
  nullif(regexp_extract(sentence, '{R.DURATION}', 1), '') as duration from sentence_rows where regexp_extract(sentence, '{R.CAUSATIVE}', 3) <> ''"""
)
def causative_extract(spark, d):
    rows = _sentences(spark, d).withColumn("a", A.causative(F.col("sentence"))).where("a is not null")
    return rows.select("chunk_id", "sent_index", "a.action", "a.object", "a.duration")


def _units_sql() -> str:
    """The sentences of atomic units with their step numbers, and what each rule finds in them."""
    clean = r"regexp_replace({}, '^[ \t.,;:]+|[ \t.,;:]+$', '', 'g')"
    bare = f"regexp_replace(unit, '{R.STEP_NUM}', '')"
    agent = {k: f"regexp_extract(sentence, '{R.ACTOR}', {k})" for k in (1, 2, 3, 4)}
    stem = f"lower(case when {agent[2]} <> '' then {agent[3]} else regexp_replace({agent[3]}, '([^s])s$', '\\1') end)"
    item = r"lower(regexp_replace(sentence, '^[ .,;:]+|[ .,;:]+$', '', 'g'))"
    return rf"""line_parts as (select c.*, case when len(string_split_regex(l.l, '{R.LIST_SEP}')) > 3
      then list_filter(list_transform(string_split_regex(l.l, '{R.LIST_SEP}'), lambda s: {clean.format('s')}), lambda s: s <> '') else [l.l] end as p, l.i as line_no
    from chunk_rows c, lateral (select unnest(x) as l, generate_subscripts(x, 1) as i from (select list_filter(list_transform(string_split_regex(c.text, '[\r\n]+'), lambda s: {_strip('s')}), lambda s: s <> '') as x)) l
    where unit_type <> 'heading' and not {_noise('text')}),
  unit_lists as (select chunk_id, flatten(list(p order by line_no)) as units from line_parts group by chunk_id),
  unit_rows as (select chunk_id, len(units) as unit_count, unnest(units) as unit, generate_subscripts(units, 1) - 1 as unit_index from unit_lists),
  unit_sents as (select u.chunk_id, unit_index, coalesce(try_cast(regexp_extract(unit, '{R.STEP_NUM}', 1) as int), case when unit_count > 1 then unit_index + 1 end) as step_number, s.i as sent_index,
      case when s.i = 0 and regexp_extract(unit, '{R.STEP_NUM}', 0) <> '' then {_strip(f"regexp_extract(unit, '{R.STEP_NUM}', 0)")} || ' ' || s.s else s.s end as sentence
    from unit_rows u, lateral (select unnest(x) as s, generate_subscripts(x, 1) - 1 as i from (select list_filter(list_transform(string_split(
      regexp_replace(regexp_replace({bare}, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda p: {_strip('p')}), lambda p: p <> '') as x)) s where not {_noise('unit')}),
  kinds as (select *, {_kind('sentence')} as kind, {_BARE} as x from unit_sents where not {_noise('sentence')}),
  firsts as (select *, regexp_extract(x, '^(\S+)', 1) as first, {_strip(r"regexp_replace(x, '^\S+\s*', '', 'g')")} as rest from kinds),
  rules as (select *, lower(regexp_extract(sentence, '{R.CAUSATIVE}', 3)) as c_action, regexp_extract(sentence, '{R.CAUSATIVE}', 2) as c_object,
      {agent[1]} <> '' and {stem} not in {_listed(R.STOP_VERBS)} as g_found, lower({agent[1]}) as g_actor, {stem} as g_action, nullif(regexp_replace({_strip(agent[4])}, '[.!?;:]+$', '', 'g'), '') as g_object,
      regexp_matches(first, '^[A-Za-z]+$') and lower(first) not in {_listed(R.STOP_VERBS)} as word, x <> '' and len(string_split_regex(x, '\s+')) <= 6 as few, {item} as item from firsts),
  found as (select chunk_id, unit_index, sent_index, kind, step_number, sentence,
      case when kind <> 'INSTRUCTION' then null when c_action <> '' then 'causative' when g_found then 'agent' when word or few then 'imperative' when item <> '' and length(item) <= 80 and len(string_split_regex(item, '\s+')) <= 6 then 'list_item' end as extraction,
      case when g_found and c_action = '' and kind = 'INSTRUCTION' then g_actor end as actor,
      case when kind <> 'INSTRUCTION' then null when c_action <> '' then c_action when g_found then g_action when word then lower(first) when few then 'perform' when item <> '' and length(item) <= 80 and len(string_split_regex(item, '\s+')) <= 6 then item end as action,
      case when kind <> 'INSTRUCTION' then null when c_action <> '' then c_object when g_found then g_object when word then nullif(rest, '') when few then x end as object from rules),
  named as (select *, regexp_replace(concat_ws(' ', action, nullif(object, '')), '^ +| +$', '', 'g') as label, lower(trim(coalesce(object, ''))) as o from found)"""


_DOUBTFUL = rf"""({_kind('sentence')} = 'DESCRIPTION' or regexp_matches(sentence, '{R.BARE_NUMBER}') or (lower(action) = 'perform' and (regexp_matches(o, '^\d+$') or o = 'testing passes')) or regexp_matches(sentence, '{R.ASKS}')
  or (regexp_matches(sentence, '{R.ALLCAPS}') and length(sentence) > 20) or starts_with(lower(sentence), 'the procedure below') or (o in {_listed(R.NOISE_OBJECTS)} and regexp_matches(sentence, '{R.LEADS}'))
  or contains(lower(label), 'process for') or lower(action) in ('follow', 'follows', 'differ')
  or (lower(action) = 'apply' and (starts_with(lower(sentence), 'this procedure applies') or contains(lower(sentence), 'hairline cracks found') or contains(lower(label), 'during borescope inspection') or contains(lower(sentence), 'differs from')))
  or lower(coalesce(actor, '')) in ('this procedure', 'this section', 'this document') or (length(label) > 80 and step_number is null))"""


@query(
    f"""with {CHUNKS}, {_units_sql()} select chunk_id, unit_index, sent_index, kind, actor, action, object, label, step_number, extraction from named
  where kind <> 'INSTRUCTION' or (action is not null and not coalesce({_DOUBTFUL}, false))"""
)
def action_extraction(spark, d):
    rows = A.extract(_chunks(spark, d))
    return rows.select("chunk_id", "unit_index", "sent_index", "kind", "actor", "action", "object", "label", "step_number", "extraction")


@query(f"with {CHUNKS}, {SENTENCES} select chunk_id, sent_index from sentence_rows where {_descriptive('sentence')}")
def description_filter(spark, d):
    return _sentences(spark, d).where(X.looks_descriptive(F.col("sentence"))).select("chunk_id", "sent_index")


@query(f"with {WNODES} select workflow_id, node_id, {SPURIOUS} as spurious from step_rows")
def spurious_filter(spark, d):
    s = F.coalesce(X.is_spurious_node(F.col("action"), F.col("object"), F.col("sentence")), F.lit(True))
    return _steps(spark, d).select("workflow_id", "node_id", s.alias("spurious"))


@query()
def coreference(spark, d):
    return coref.resolve_chunks(_chunks(spark, d)).select("chunk_id", "resolved")


# --- discourse markers --------------------------------------------------------------

_REL = "case " + " ".join(f"when marker in {_listed(ms)} then '{r}'" for r, ms in R.MARKERS.items()) + " end"


def _phrase(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '^[ ,;:.\-]+|[ ,;:.\-]+$', '', 'g'), '(?i)^(?:and|or|but)\s+', '', 'g')"


def _edge_sql(pattern: str, places: tuple[int, int, int], where: str) -> str:
    a, m, b = places
    return rf"""with {CHUNKS}, {SENTENCES}, x as (select chunk_id, sent_index, regexp_replace(lower(regexp_extract(sentence, '{pattern}', {m})), '\s+', ' ', 'g') as marker,
    {_phrase(f"regexp_extract(sentence, '{pattern}', {a})")} as a, {_phrase(f"regexp_extract(sentence, '{pattern}', {b})")} as b from sentence_rows where {where}),
  y as (select chunk_id, sent_index, marker, {_REL} as relation, a, b from x where marker <> '')
  select chunk_id, sent_index, marker, relation, case when relation = 'BEFORE' then b else a end as source, case when relation = 'BEFORE' then a else b end as target
  from y where a <> '' and b <> '' and lower(a) <> lower(b)"""


@query(_edge_sql(markers.COMMA, (2, 1, 3), "true"))
def marker_comma_edges(spark, d):
    return markers.comma_edges(_sentences(spark, d)).select("chunk_id", "sent_index", "marker", "relation", "source", "target")


_MARKS = "(values " + ",".join(f"({k}, '{m}', '{r}', '{m.replace(' ', r'\\s+')}')" for k, (m, r) in enumerate(R.all_markers())) + ") as m(place, marker, relation, p)"


@query(
    rf"""with {CHUNKS}, {SENTENCES}, cut as (select chunk_id, sent_index, string_split_regex(sentence, '[.。;]') as l from sentence_rows where not regexp_matches(sentence, '{markers.COMMA}')),
  parts as (select chunk_id, sent_index, unnest(l) as c, generate_subscripts(l, 1) - 1 as clause from cut),
  met as (select chunk_id, sent_index, clause, place, marker, relation, {_phrase(r"regexp_extract(c, '(?is)^(.*?)\b' || p || '\b(.*)$', 1)")} as l, {_phrase(r"regexp_extract(c, '(?is)^(.*?)\b' || p || '\b(.*)$', 2)")} as r
    from parts, {_MARKS} where regexp_matches(c, '(?is)^(.*?)\b' || p || '\b(.*)$')),
  made as (select *, case when relation = 'BEFORE' then r else l end as source, case when relation = 'BEFORE' then l else r end as target from met where l <> '' and r <> '' and lower(l) <> lower(r))
  select chunk_id, sent_index, clause, marker, relation, source, target from (select *, row_number() over (partition by chunk_id, sent_index, clause order by place) as n from made) where n = 1"""
)
def marker_infix_edges(spark, d):
    return markers.infix_edges(_sentences(spark, d)).select("chunk_id", "sent_index", "clause", "marker", "relation", "source", "target")


@query()
def marker_filled_edges(spark, d):
    found = A.action_rows(A.extract(_chunks(spark, d)))
    return markers.filled_edges(_sentences(spark, d), found).select("chunk_id", "sent_index", "clause", "marker", "relation", "source", "target")


@query(
    rf"""with {NODES}, p as (select distinct workflow_id, {_phrase('e.sentence')} as phrase from (select workflow_id, unnest(evidence_sources) as e from workflows)),
  s as (select p.workflow_id, phrase, node_id, ord,
    case when coalesce(action, '') <> '' and contains(lower(phrase), lower(action)) then 2 else 0 end + case when coalesce(object, '') <> '' and contains(lower(phrase), lower(object)) then 2 else 0 end
    + case when label <> '' and phrase <> '' and (contains(lower(phrase), lower(label)) or contains(lower(label), lower(phrase))) then 3 else 0 end as score
    from p join node_rows n on p.workflow_id = n.workflow_id where phrase is not null)
  select workflow_id, phrase, node_id, score from (select *, row_number() over (partition by workflow_id, phrase order by score desc, ord, node_id) as r from s where score >= 1) where r = 1"""
)
def phrase_action_match(spark, d):
    e = table(spark, d, "workflows").select("workflow_id", F.explode("evidence_sources").alias("e")).select("workflow_id", X.clean_phrase(F.col("e.sentence")).alias("phrase"))
    return markers.match_phrases(e.where("phrase is not null"), _nodes(spark, d), "workflow_id")


STEPS = f"""steps as (select *, try_cast(regexp_extract(text, '{R.STEP_NUM}', 1) as int) as step_number from chunk_rows)"""


@query(
    f"""with {CHUNKS}, {STEPS}, o as (select document_id, chunk_id as target, section, step_number, lag(chunk_id) over w as source, lag(section) over w as s0, lag(step_number) over w as n0 from steps where step_number is not null
    window w as (partition by document_id order by coalesce(page, 0), coalesce(section, ''), step_number, order_index, chunk_id))
  select document_id, source, target, n0, step_number from o where source is not null and s0 is not distinct from section and step_number > n0"""
)
def numbered_step_edges(spark, d):
    rows = _chunks(spark, d).withColumn("step_number", X.step_number(F.col("text")))
    return markers.numbered_edges(rows).select("document_id", "source", "target", "n0", "step_number")


# --- segmentation -------------------------------------------------------------------

DENSITY = rf"""marks as (select chunk_id, count(*) as n from sentence_rows where regexp_matches(sentence, '{markers.COMMA}') group by chunk_id),
  density as (select document_id, chunk_id, case when max(n) over (partition by document_id) > 0 then n / max(n) over (partition by document_id) else 0 end as density
    from (select distinct c.document_id, c.chunk_id, coalesce(m.n, 0)::double as n from chunk_rows c left join marks m using (chunk_id)))"""
_HIT = "({})".format(" or ".join(f"regexp_matches(text, '{p}')" for p in R.LEXICAL))
_TITLE = "({})".format(" or ".join(f"regexp_matches(coalesce(section, ''), '{p}')" for p in R.LEXICAL))
GAPS = rf"""acts as (select c.*, density, try_cast(regexp_extract(text, '{R.STEP_NUM}', 1) as int) as step_number from chunk_rows c join density using (chunk_id, document_id) where unit_type <> 'heading'),
  ordered as (select *, row_number() over w - 1 as idx, lag(coalesce(section, '')) over w as s0, lag(page) over w as p0 from acts window w as (partition by document_id order by coalesce(page, 0), order_index, chunk_id)),
  scored as (select *, idx > 0 and coalesce(section, '') <> s0 as changed, max((step_number is not null)::int) over (partition by document_id, section) as numbered,
    avg(density) over (partition by document_id order by idx rows between 5 preceding and 4 following) as mean from ordered),
  parts as (select *, case when idx = 0 then 0.0 when changed then 1.0 when coalesce(abs(page - p0) >= 2, false) then 0.6 else 0.0 end as structural,
    case when {_HIT} then 1.0 when changed and coalesce(section, '') <> '' then case when {_TITLE} then 1.0 else 0.35 end else 0.0 end as lexical,
    case when numbered = 1 and coalesce(section, '') <> '' then 0.0 else greatest(0.0, least(1.0, 1 - mean)) end as continuity from scored),
  gaps as (select *, case when idx = 0 then 1.0 else 0.35 * structural + 0.40 * lexical + 0.25 * continuity end as confidence from parts)"""


def _gaps(spark, d) -> DataFrame:
    rows = _chunks(spark, d)
    s = _sentences(spark, d)
    density = segment.marker_density(rows, s.where(F.col("sentence").rlike(markers.COMMA)))
    acts = rows.where(F.col("unit_type") != "heading").join(density, ["document_id", "chunk_id"]).withColumn("step_number", X.step_number(F.col("text")))
    return segment.gap_scores(acts.withColumnRenamed("text", "sentence"))


@query(f"with {CHUNKS}, {SENTENCES}, {DENSITY} select document_id, chunk_id, round(density, 6) as density from density")
def marker_density(spark, d):
    s = _sentences(spark, d)
    out = segment.marker_density(_chunks(spark, d), s.where(F.col("sentence").rlike(markers.COMMA)))
    return out.withColumn("density", F.round("density", 6))


@query(f"with {CHUNKS}, {SENTENCES}, {DENSITY}, {GAPS} select document_id, chunk_id, idx, round(structural::double, 6) as structural, round(lexical::double, 6) as lexical, round(continuity::double, 6) as continuity, round(confidence::double, 6) as confidence, idx > 0 and confidence >= 0.45 as is_boundary from gaps")
def boundary_scores(spark, d):
    r = {c: F.round(c, 6) for c in ("structural", "lexical", "continuity", "confidence")}
    return _gaps(spark, d).withColumns(r).select("document_id", "chunk_id", "idx", *r, "is_boundary")


@query(
    f"""with {CHUNKS}, {SENTENCES}, {DENSITY}, {GAPS}, numbered as (select *, sum((idx > 0 and confidence >= 0.45)::int) over (partition by document_id order by idx rows between unbounded preceding and current row) as group_no from gaps)
  select document_id, group_no, count(*) as actions, min(page) as page_start, max(page) as page_end, arg_min(section, idx) filter (coalesce(section, '') <> '') as title_hint,
  round(arg_min(confidence, idx)::double, 6) as boundary_confidence from numbered group by document_id, group_no"""
)
def boundary_segments(spark, d):
    return segment.group_rows(segment.assign_groups(_gaps(spark, d))).withColumn("boundary_confidence", F.round("boundary_confidence", 6))


@query()
def weak_boundary_filter(spark, d):
    return segment.drop_weak(_gaps(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query()
def small_group_merge(spark, d):
    return segment.merge_small(segment.group_rows(segment.assign_groups(_gaps(spark, d))))


# --- graphs -------------------------------------------------------------------------


@query(f"with {NODES} select workflow_id, node_id, label, normal from (select *, row_number() over (partition by workflow_id, normal order by ord, node_id) as r from node_rows) where r = 1")
def node_dedupe(spark, d):
    return graphs.first_labels(_nodes(spark, d)).select("workflow_id", "node_id", "label", "normal")


@query()
def node_subsumption(spark, d):
    return graphs.drop_subsumed(_nodes(spark, d))


@query(f"with {NODES} select workflow_id, source, target from (select workflow_id, node_id as source, lead(node_id) over (partition by workflow_id order by ord, node_id) as target from node_rows) where target is not null")
def document_order_edges(spark, d):
    return graphs.document_edges(_nodes(spark, d))


@query(f"with {EDGES} select workflow_id, source, target, relation, weight from (select *, row_number() over (partition by workflow_id, source, target, relation order by weight desc nulls last, seq) as r from edge_rows) where r = 1")
def edge_dedupe(spark, d):
    return graphs.dedupe_edges(_edges(spark, d)).select("workflow_id", "source", "target", "relation", "weight")


@query(f"with {EDGES} select workflow_id, source, target, arg_max(relation, seq) as relation from edge_rows group by workflow_id, source, target")
def adjacency(spark, d):
    return graphs.adjacency(_edges(spark, d))


DEGREES = """degrees as (select workflow_id, node_id, count(*) as degree from (select workflow_id, unnest([source, target]) as node_id from (select distinct workflow_id, source, target from edge_rows where source <> target)) group by workflow_id, node_id)"""


@query(f"with {EDGES}, {DEGREES} select workflow_id, degree, count(*) / sum(count(*)) over (partition by workflow_id) as share from degrees group by workflow_id, degree")
def degree_histogram(spark, d):
    return similarity.degree_histograms(graphs.degrees(_edges(spark, d)))


@query()
def stable_toposort(spark, d):
    return graphs.topological_order(_nodes(spark, d), _edges(spark, d))


@query()
def graph_html(spark, d):
    return graphs.to_html(_nodes(spark, d), _edges(spark, d))


@query()
def graph_dot(spark, d):
    return graphs.to_dot(_nodes(spark, d), _edges(spark, d))


# --- workflows ----------------------------------------------------------------------

ACTORS = """actors as (select workflow_id, actor from (select workflow_id, actor, row_number() over (partition by workflow_id order by count(*) desc, min(ord), min(node_id)) as r from node_rows where trim(coalesce(actor, '')) <> '' group by workflow_id, actor) where r = 1)"""


@query(f"with {NODES}, {ACTORS} select n.workflow_id, coalesce(a.actor, 'Operator') as actor from (select distinct workflow_id from node_rows) n left join actors a using (workflow_id)")
def modal_actor(spark, d):
    return workflows.modal_actor(_nodes(spark, d))


TITLES = "titles as (select workflow_id, nullif(min(title_hint), '') as title from workflows group by workflow_id)"


@query(
    f"""with {NODES}, {ACTORS}, {TITLES}, told as (select n.workflow_id, coalesce(max(a.actor), 'Operator') || ' performs: ' || string_agg(label, ' → ' order by ord, node_id) as told from node_rows n left join actors a using (workflow_id) group by n.workflow_id)
  select t.workflow_id, coalesce(title || ': ' || told, told, 'Workflow: ' || coalesce(title, 'Untitled workflow')) as summary from titles t left join told using (workflow_id)"""
)
def workflow_summary(spark, d):
    titles = table(spark, d, "workflows").groupBy("workflow_id").agg(F.min("title_hint").alias("title_hint"))
    return workflows.summaries(_nodes(spark, d), titles)


@query(f"with {WNODES}, sane as (select * from step_rows where not {SPURIOUS}) select workflow_id, node_id, row_number() over (partition by workflow_id order by ord, node_id) - 1 as position from sane")
def sanitize_nodes(spark, d):
    return workflows.sane_nodes(_steps(spark, d)).select("workflow_id", "node_id", "position")


@query(
    f"""with {WNODES}, {EDGES}, sane as (select workflow_id, node_id from step_rows where not {SPURIOUS})
  select workflow_id, seq, source, target from edge_rows where (workflow_id, source) in (select (workflow_id, node_id) from sane) and (workflow_id, target) in (select (workflow_id, node_id) from sane)"""
)
def sanitize_edges(spark, d):
    return workflows.sane_edges(_edges(spark, d), workflows.sane_nodes(_steps(spark, d))).select("workflow_id", "seq", "source", "target")


@query("select document_id, array_to_string(list_sort(list(distinct p)), ',') as pages from (select document_id, unnest(pages) as p from workflows where document_id is not null) where p is not null group by document_id")
def merge_pages(spark, d):
    out = workflows.merged_pages(table(spark, d, "workflows").where("document_id is not null"), "document_id")
    return out.withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ","))


@query(
    """with rows as (select distinct document_id, workflow_id, i - 1 as pos, e.sentence as sentence from (select document_id, workflow_id, unnest(evidence_sources) as e, generate_subscripts(evidence_sources, 1) as i from workflows where document_id is not null))
  select document_id, sentence, workflow_id, pos from (select *, row_number() over (partition by document_id, sentence order by workflow_id, pos) as r from rows where trim(coalesce(sentence, '')) <> '') where r = 1"""
)
def merge_evidence(spark, d):
    return workflows.merged_evidence(table(spark, d, "workflows").where("document_id is not null"), "document_id")


@query(
    """with one as (select distinct workflow_id, document_id, coalesce(len(nodes), 0) as n, try_cast(metadata['boundary_confidence'] as double) as c from workflows)
  select count(distinct document_id) as documents_processed, count(*) as workflows_found, sum(n)::bigint as actions_extracted, round(avg(c), 4) as avg_confidence from one"""
)
def corpus_stats(spark, d):
    return workflows.corpus_stats(table(spark, d, "workflows"))


@query(
    """with one as (select distinct workflow_id, document_id, title_hint, list_sort(list_distinct(coalesce(pages, []))) as p, coalesce(len(nodes), 0) as node_count, coalesce(len(edges), 0) as edge_count from workflows)
  select workflow_id, document_id, title_hint, node_count, edge_count, case len(p) when 0 then '' when 1 then p[1]::varchar else p[1]::varchar || '–' || p[-1]::varchar end as page_range from one"""
)
def meta_index(spark, d):
    return workflows.meta_index(table(spark, d, "workflows"))


@query(
    """with one as (select distinct workflow_id, summary, nodes from workflows), n as (select workflow_id, unnest(nodes) as n from one)
  select workflow_id, 'summary' as kind, null::varchar as node_id, case when trim(coalesce(summary, '')) = '' then workflow_id else summary end as text from one
  union all select workflow_id, 'node', n.node_id, trim(concat_ws(' ', n.action, nullif(n.object, ''))) from n
  union all select workflow_id, 'action', n.node_id, n.sentence from n where coalesce(n.sentence, '') <> ''"""
)
def index_payload(spark, d):
    return workflows.index_payload(table(spark, d, "workflows"))


# --- embeddings and search ----------------------------------------------------------


def _embed_sql(source: str, key: str, text: str) -> str:
    return rf"""(with w as (select {key}, unnest(regexp_extract_all(lower({text}), '([a-z]+)', 1)) as w from {source}),
    c as (select {key}, ('0x' || substr(md5(w), 1, 7))::bigint % {R.EMBED_DIM} as bucket, count(*) as n from w group by 1, 2)
    select {key}, bucket, n / sqrt(sum(n * n) over (partition by {key})) as weight from c)"""


_SUMMARIES = "(select workflow_id, min(summary) as summary from workflows where trim(coalesce(summary, '')) <> '' group by workflow_id)"


def _summaries(spark, d) -> DataFrame:
    return table(spark, d, "workflows").where("trim(coalesce(summary, '')) <> ''").groupBy("workflow_id").agg(F.min("summary").alias("summary"))


@query(f"select workflow_id, bucket, round(weight, 6) as weight from {_embed_sql(_SUMMARIES, 'workflow_id', 'summary')}")
def hash_embed(spark, d):
    return V.hash_embedding(_summaries(spark, d), "workflow_id", "summary").withColumn("weight", F.round("weight", 6))


QUESTIONS = "(select workflow_id as question_id, 'Where is the ' || min(title_hint) || ' procedure?' as question from workflows where title_hint is not null group by workflow_id)"


def _questions(spark, d) -> DataFrame:
    q = table(spark, d, "workflows").where("title_hint is not null").groupBy(F.col("workflow_id").alias("question_id")).agg(F.min("title_hint").alias("t"))
    return q.select("question_id", F.concat(F.lit("Where is the "), "t", F.lit(" procedure?")).alias("question"))


def _asked(spark, d) -> DataFrame:
    """The stated query set of searches: ids whose number is divisible by 20."""
    return _questions(spark, d).where(F.conv(F.substring("question_id", 4, 12), 16, 10).cast("bigint") % 20 == 0)


def _hits(spark, d) -> DataFrame:
    return retrieval.search(_asked(spark, d), workflows.index_entries(table(spark, d, "workflows")), 5)


@query()
def vector_topk_per_workflow(spark, d):
    return _hits(spark, d).select("question_id", "workflow_id", "score", "rank")


_Q = "(select vec_id as query_id, embedding as q from embeddings where vec_id % 20 = 0)"


@query(
    f"""select query_id, vec_id, score, rank from (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank
  from (select query_id, vec_id, round(list_dot_product(embedding::double[], q::double[]), 4) as score from embeddings, {_Q} where vec_id <> query_id)) where rank <= 5"""
)
def vector_topk(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query_vec"))
    return retrieval.nearest_entries(q, e, 5)


@query(
    """select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 4) as cosine from embeddings a join embeddings b on a.label = b.label and a.vec_id % 20 = 0 and (b.vec_id % 20 <> 0 or a.vec_id < b.vec_id) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.3"""
)
def near_duplicate_pairs(spark, d):
    e = table(spark, d, "embeddings")
    a, b = (e.select(F.col("vec_id").alias(x), "label", F.col("embedding").alias(f"v{x}")) for x in "ab")
    pairs = a.where("a % 20 = 0").join(b, "label").where("a <> b and (b % 20 <> 0 or a < b)").withColumn("cosine", V.cosine(F.col("va"), F.col("vb")))
    return pairs.where("cosine >= 0.3").select("a", "b", F.round("cosine", 4).alias("cosine"))


@query()
def greedy_cluster(spark, d):
    n = _nodes(spark, d).select("workflow_id", F.col("node_id").alias("id"), F.col("ord").alias("pos"), V.dense_buckets(V.buckets(F.col("label"))).alias("vec"))
    return similarity.greedy_clusters(n, "workflow_id", 0.7)


@query(
    """select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 4) as cosine from embeddings a join embeddings b on a.vec_id < b.vec_id
  where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.3"""
)
def near_duplicates(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return similarity.similar_pairs(e, 0.3).select("a", "b", F.round("cosine", 4).alias("cosine"))


@query()
def leader_dedup(spark, d):
    return similarity.leader_dedup(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), near_duplicates(spark, d))


#: Hashed words are less alike than a model's vectors, so duplicates are looked for from 0.8 on here.
LOOSE = config.Settings(duplicate_cosine=0.8)
_TEXTS = """texts as (select workflow_id, min(case when trim(coalesce(summary, '')) = '' then workflow_id else summary end) as text from workflows where workflow_id is not null group by workflow_id)"""


@query(
    rf"""with {_TEXTS}, e as {_embed_sql('texts', 'workflow_id', 'text')}, d as (select a.workflow_id as workflow_id, b.workflow_id as duplicate_of, round(sum(a.weight * b.weight), 4) as cosine
    from e a join e b on a.bucket = b.bucket and a.workflow_id <> b.workflow_id group by 1, 2 having sum(a.weight * b.weight) >= 0.8)
  select workflow_id, duplicate_of, cosine from (select *, row_number() over (partition by workflow_id order by cosine desc, duplicate_of) as r from d) where r = 1"""
)
def find_duplicates(spark, d):
    return dedup.find_duplicates(table(spark, d, "workflows"), LOOSE)


@query()
def dedup_workflows(spark, d):
    rows = table(spark, d, "workflows")
    merged = dedup.merge_workflows(rows, written(dedup.leaders(rows, LOOSE)))
    sizes = [F.size(c).alias(f"{c}_count") for c in ("sections", "evidence_sources", "merged_from")]
    return merged.select("workflow_id", "summary", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), *sizes, F.col("metadata")["merged_documents"].alias("merged_documents"))


@query(
    f"""with {WNODES}, sane as (select workflow_id, node_id from step_rows where not {SPURIOUS}), all_steps as (select workflow_id, count(*) as n from step_rows group by workflow_id), kept as (select workflow_id, count(*) as n from sane group by workflow_id)
  select w.workflow_id, coalesce(k.n, 0) as nodes, coalesce(k.n, 0) < coalesce(a.n, 0) as fewer from (select distinct workflow_id from workflows where workflow_id is not null) w left join all_steps a using (workflow_id) left join kept k using (workflow_id)"""
)
def sanitize_workflows(spark, d):
    rows = table(spark, d, "workflows")
    before = rows.dropDuplicates(["workflow_id"]).select("workflow_id", F.coalesce(F.size("nodes"), F.lit(0)).alias("n"))
    out = dedup.sanitize_workflows(rows).select("workflow_id", F.size("nodes").alias("nodes"))
    return out.join(before, "workflow_id").select("workflow_id", "nodes", (F.col("nodes") < F.col("n")).alias("fewer"))


@query()
def title_overlap(spark, d):
    w = table(spark, d, "workflows").groupBy("workflow_id").agg(F.min(F.concat_ws(" ", "title_hint", "summary", F.array_join("sections", " "))).alias("haystack"))
    q = _asked(spark, d)
    return q.join(w, q.question_id == w.workflow_id).select("question_id", F.round(retrieval.title_overlap(F.col("question"), F.col("haystack")), 6).alias("overlap"))


# --- sets, sequences, graphs of workflow pairs --------------------------------------

PAIRS = """seqs as (select workflow_id, list(normal order by ord, node_id) as s from node_rows group by workflow_id),
  words as (select distinct workflow_id, normal from node_rows),
  meets as (select distinct a.workflow_id as left_id, b.workflow_id as right_id from words a join words b on a.normal = b.normal and a.workflow_id <> b.workflow_id where ('0x' || substr(a.workflow_id, 4, 12))::bigint % 20 = 0),
  pairs as (select left_id, right_id, a.s as x, b.s as y from meets join seqs a on a.workflow_id = left_id join seqs b on b.workflow_id = right_id)"""


def _pairs(spark, d) -> DataFrame:
    """The stated query set of searches (ids divisible by 20) against all workflows: each with every other that shares a step with it, found by an equality join; all others have no overlap."""
    nodes = _nodes(spark, d)
    s = nodes.groupBy("workflow_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id", "normal"))), lambda x: x["normal"]).alias("s"))
    words = nodes.select("workflow_id", "normal").distinct()
    asked = words.where(F.conv(F.substring("workflow_id", 4, 12), 16, 10).cast("bigint") % 20 == 0).withColumnRenamed("workflow_id", "left_id")
    pairs = asked.join(words.withColumnRenamed("workflow_id", "right_id"), "normal").where("left_id <> right_id").select("left_id", "right_id").distinct()
    pairs = pairs.join(s.select(F.col("workflow_id").alias("left_id"), F.col("s").alias("x")), "left_id")
    return pairs.join(s.select(F.col("workflow_id").alias("right_id"), F.col("s").alias("y")), "right_id")


@query(
    f"""with {NODES}, {PAIRS} select left_id, right_id, round(len(list_intersect(list_distinct(x), list_distinct(y))) / len(list_distinct(list_concat(x, y))), 6) as jaccard,
  round(len(list_intersect(list_distinct(x), list_distinct(y))) / len(list_distinct(x)), 6) as soft from pairs"""
)
def jaccard_actions(spark, d):
    x, y = F.col("x"), F.col("y")
    return _pairs(spark, d).select("left_id", "right_id", F.round(similarity.jaccard(x, y), 6).alias("jaccard"), F.round(similarity.containment(x, y), 6).alias("soft"))


@query()
def needleman_wunsch(spark, d):
    return _pairs(spark, d).select("left_id", "right_id", F.round(similarity.align("x", "y"), 6).alias("alignment"))


@query(
    f"""with {NODES}, {EDGES}, {DEGREES}, {PAIRS}, h as (select workflow_id, degree, count(*) / sum(count(*)) over (partition by workflow_id) as share from degrees group by workflow_id, degree),
  d as (select left_id, right_id, degree, sum(v) as v from (select left_id, right_id, degree, share as v from pairs join h on workflow_id = left_id union all select left_id, right_id, degree, -share from pairs join h on workflow_id = right_id) group by 1, 2, 3)
  select left_id, right_id, round(1 - 0.5 * sum(abs(v)), 6) as similarity from d group by 1, 2"""
)
def degree_histogram_similarity(spark, d):
    h = similarity.degree_histograms(graphs.degrees(_edges(spark, d)))
    return similarity.histogram_similarity(h, _pairs(spark, d).select("left_id", "right_id"))


@query()
def graph_edit_distance(spark, d):
    return similarity.structural(_pairs(spark, d).select("left_id", "right_id"), _nodes(spark, d), _edges(spark, d))


def _blended(spark, d) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    # Columns of their own: the blend names each more than once.
    pairs = _pairs(spark, d).withColumns({"hard": similarity.jaccard(x, y), "soft": similarity.containment(x, y)})
    pairs = pairs.select("left_id", "right_id", similarity.set_overlap(F.col("hard"), F.col("soft")).alias("set_overlap"), "x", "y")
    scored = similarity.alignments(pairs, "x", "y", "sequence_alignment")
    return similarity.blend_pairs(similarity.structural(scored, _nodes(spark, d), _edges(spark, d)))


@query()
def blended_w2w(spark, d):
    scores = _blended(spark, d).select("left_id", "right_id", "set_overlap", "sequence_alignment", "structural", "blended")
    return dedup.compare_pairs(scores, table(spark, d, "workflows"))


@query()
def best_matches(spark, d):
    return dedup.best_matches(_blended(spark, d), 5)


# --- questions ----------------------------------------------------------------------

_TOKENS = "regexp_extract_all(lower(question), '([a-z]+)', 1)"
_REST = f"list_filter({_TOKENS}, lambda t: t not in {_listed(R.QUERY_STOPS)})"


@query(
    rf"""select question_id, regexp_matches(lower(trim(question)), '{R.LOOKUP}') or (contains(lower(trim(question)), 'where is') and contains(lower(trim(question)), 'procedure')) as lookup,
  case when regexp_matches(question, '{R.DOMAIN_PHRASE}') then array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(question, '{R.DOMAIN_PHRASE}', 0), lambda p: regexp_replace(lower(p), '\s+', ' ', 'g')))), '|') when len({_REST}[1:3]) >= 2 then array_to_string({_REST}[1:3], ' ') else '' end as phrases,
  len(list_filter(list_distinct({_TOKENS}), lambda t: t in {_listed(R.HINTS)})) as hints, array_to_string(list_filter({_TOKENS}, lambda t: t not in {_listed([*R.QUERY_STOPS, "major"])})[1:12], ' ') as keywords from {QUESTIONS}"""
)
def question_nodes(spark, d):
    q = retrieval.question_nodes(_questions(spark, d))
    return q.select("question_id", "lookup", F.array_join(F.array_sort("phrases"), "|").alias("phrases"), F.size("hints").alias("hints"), F.array_join("keywords", " ").alias("keywords"))


PROOFS = rf"""proofs as (select workflow_id, sentence, pos from (select workflow_id, sentence, row_number() over (partition by workflow_id order by min(i), sentence) as pos
  from (select workflow_id, i, {_strip('e.sentence')} as sentence from (select workflow_id, unnest(evidence_sources) as e, generate_subscripts(evidence_sources, 1) as i from workflows)) where sentence is not null and not {_descriptive('sentence')} group by workflow_id, sentence) where pos <= 8)"""


@query(f"with {PROOFS} select workflow_id, pos, sentence from proofs")
def evidence_topn(spark, d):
    return retrieval.evidence(table(spark, d, "workflows"))


@query()
def answer_explain(spark, d):
    return retrieval.answers(_asked(spark, d), _hits(spark, d), table(spark, d, "workflows"))


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def event_counts(spark, d):
    return event_windows(table(spark, d, "events"), "ts")


# --- from chunks to workflows -------------------------------------------------------


def _build(spark, d) -> build.Build:
    names = table(spark, d, "docs").select("document_id", "source_name").where("document_id is not null")
    return build.build_workflows(_chunks(spark, d).where("document_id is not null"), names)


@query()
def workflow_build(spark, d):
    w = _build(spark, d).workflows
    counts = [F.size(c).alias(f"{c}_count") for c in ("nodes", "edges", "evidence_sources", "context_notes", "conditional_branches")]
    return w.select("workflow_id", "document_id", "document", "group_id", "title_hint", "summary", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), F.array_join("sections", " | ").alias("sections"), *counts, F.col("metadata")["boundary_confidence"].alias("boundary_confidence"))


@query()
def workflow_build_nodes(spark, d):
    return _build(spark, d).nodes.select("workflow_id", "node_id", "ord", "actor", "action", "object", "label", "page", "section", "sentence", "action_id")


@query()
def workflow_build_edges(spark, d):
    return _build(spark, d).edges.select("workflow_id", "source", "target", "relation", "weight", "evidence")


@query()
def discourse_edges(spark, d):
    chunks = _chunks(spark, d)
    return markers.discourse_edges(_sentences(spark, d), A.action_rows(A.extract(chunks)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions answered from the workflow corpus, with proofs."""
    return answer_explain(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
