"""Queries of compiled workflows and of progress over stages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedimark.functions import text as T
from sedimark.operators import products as P
from sedimark.operators import workflows as W

from . import catalogue as K
from . import oracles as O
from .literals import Rows, sql_value
from .oracles import quoted

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Units whose first line, description or kind is an edge: line ends of several kinds, exact lengths, blanks, a source without steps, kinds out of order.
EDGES = Rows("source_id string, unit_id string, kind string, content string, ord bigint, review_status string", (
    ("e1", "u1", "principle", "last of all", 1, "candidate"), ("e1", "u2", "framework", "\n  first line \nsecond\n\n third", 9, "approved"), ("e1", "u3", "decision_rule", "x" * 80, 2, "reviewed"), ("e1", "u4", "checklist", "y" * 81, 3, "candidate"),
    ("e1", "u5", "technique", "a\rb" + " " + "c", 4, "candidate"), ("e1", "u6", "technique", "gone", 5, "rejected"), ("e1", "u7", "technique", "w " * 130, 6, "candidate"), ("e1", "u8", "technique", "", 7, "candidate"), ("e1", "u9", "technique", "z" * 240, 8, "candidate"),
    ("e2", "v1", "term", "no steps here", 1, "candidate"), ("e2", "v2", "anti_pattern", "nor here", 2, "candidate"), ("e3", "w1", "technique", "superseded alone", 1, "superseded"), ("e4", "t1", "decision_rule", "  　 trimmed  ", 1, "candidate")))


def _turns(spark, d):
    """Turns of conversations as units with several lines, and fixed ones; every fifth turn is rejected."""
    c = K.table(spark, d, "conversations")
    source = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    rows = c.select(source.alias("source_id"), F.concat_ws("-", source, F.col("turn").cast("string")).alias("unit_id"), T.kind(F.col("text")).alias("kind"), F.col("text").alias("content"), F.col("turn").cast("bigint").alias("ord"), F.when(F.col("turn") % 5 == 4, "rejected").otherwise("candidate").alias("review_status"))
    return P.usable(rows.unionByName(EDGES.df(spark)))


def _sql(x: str) -> str:
    """A class of characters in the other engine's spelling."""
    return x.replace("\\x{A0}", "\\x{00A0}").replace("\\x{85}", "\\x{0085}")


_TURNS = f"""turns AS (SELECT * FROM (SELECT 'c' || conv_id AS source_id, 'c' || conv_id || '-' || turn AS unit_id, {O._kind('text')} AS kind, text AS content, turn::BIGINT AS ord, CASE WHEN turn % 5 = 4 THEN 'rejected' ELSE 'candidate' END AS review_status FROM conversations UNION ALL {EDGES.sql()}) WHERE review_status NOT IN ('rejected', 'superseded'))"""
_STRIP = lambda t: f"regexp_replace({t}, {quoted(f'^[{_sql(W.BLANK)}]+|[{_sql(W.BLANK)}]+$')}, '', 'g')"
_LINE = f"regexp_extract({_STRIP('content')}, {quoted(f'^[^{_sql(W.LINE_END)}]*')})"
_ONE = f"array_to_string(list_filter(list_transform(regexp_split_to_array(content, {quoted(f'[{_sql(W.LINE_END)}]')}), lambda x: {_STRIP('x')}), lambda x: x <> ''), ' ')"
_TITLE = "array_to_string(list_transform(string_split(kind, '_'), lambda w: upper(w[1]) || w[2:]), ' ')"
_FILES = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN list_contains(list(DISTINCT kind), '{k}') THEN '{f}' END" for k, f in W.REFERENCES) + "], lambda x: x IS NOT NULL), ',')"


def _steps(units: str) -> str:
    """SQL of the steps of the table or CTE named."""
    return f"""st AS (SELECT source_id, list_position({sql_value(W.STEP_KINDS)}, kind) AS rank, ord, unit_id, {_TITLE} AS title, {_LINE} AS line, {_ONE} AS text FROM {units} WHERE kind IN {W.STEP_KINDS}),
 f AS (SELECT source_id, count(*) FILTER (WHERE kind IN {W.STEP_KINDS}) > 0 AS has, {_FILES} AS files FROM {units} GROUP BY 1),
 x AS (SELECT source_id, rank, ord, unit_id, CASE WHEN line = '' THEN title WHEN length(line) > 80 THEN title || ': ' || left(line, 77) || '...' ELSE title || ': ' || line END AS step, CASE WHEN length(text) > 240 THEN regexp_replace(left(text, 237), {quoted(f'[{_sql(W.BLANK)}]+$')}, '') || '...' ELSE text END AS description, unit_id AS refs FROM st
  UNION ALL SELECT source_id, 99, 0, '', CASE WHEN has THEN {sql_value(W.ROUTING[0])} ELSE {sql_value(W.ALONE[0])} END, CASE WHEN has THEN {sql_value(W.ROUTING[1])} ELSE {sql_value(W.ALONE[1])} END, files FROM f)
 SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY rank, ord, unit_id) AS place, step, description, refs FROM x"""


@query(f"WITH {O._UNITS}, u AS (SELECT source_id, unit_id, kind, content, block_ord AS ord FROM units), {_steps('u')}")
def workflow_steps(spark, d):
    """The steps of each source's workflow, from its lines."""
    return W.workflow(K._units(spark, d).withColumnRenamed("ord", "source_ord").withColumnRenamed("block_ord", "ord"))


@query(f"WITH {_TURNS}, {_steps('turns')}")
def conversation_workflows(spark, d):
    """The steps of each conversation's workflow, from turns of several lines."""
    return W.workflow(_turns(spark, d))


@query(f"WITH {_TURNS}, it AS (SELECT source_id, ord, unit_id, unnest(string_split(content, ',')) AS item, generate_subscripts(string_split(content, ','), 1) AS pos FROM turns WHERE kind IN ('principle', 'technique', 'term')), t AS (SELECT * REPLACE ({_STRIP('item')} AS item) FROM it), o AS (SELECT source_id, item, min(struct_pack(a := ord, b := unit_id, c := pos)) AS first FROM t WHERE item <> '' GROUP BY 1, 2) SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY first) AS place, item FROM o")
def contract_conditions(spark, d):
    """The clauses of each conversation as conditions of its contract: once each, in the order in which they are first seen."""
    rows = _turns(spark, d).where("kind in ('principle', 'technique', 'term')").withColumn("conditions", F.split("content", ","))
    return W.contract_items(rows, "conditions")


@query(f"WITH {_TURNS}, c AS (SELECT * FROM turns WHERE kind = 'case' UNION ALL SELECT source_id, unit_id || '-x', 'case', content, ord, review_status FROM turns WHERE length(content) < 60) SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY ord, unit_id) AS place, unit_id, content AS scenario FROM c")
def workflow_examples(spark, d):
    """Cases as examples; short turns stand for cases too."""
    turns = _turns(spark, d)
    short = turns.where("length(content) < 60").withColumn("unit_id", F.concat("unit_id", F.lit("-x"))).withColumn("kind", F.lit("case"))
    return W.examples(turns.unionByName(short))


@query(f"WITH {_TURNS} SELECT unit_id, CASE WHEN {_LINE} = '' THEN {_TITLE} WHEN length({_LINE}) > 80 THEN {_TITLE} || ': ' || left({_LINE}, 77) || '...' ELSE {_TITLE} || ': ' || {_LINE} END AS label, length({_LINE}) > 80 AS was_cut FROM turns")
def step_labels(spark, d):
    """What a step of each unit is called."""
    turns = _turns(spark, d)
    return turns.select("unit_id", W.step_label(F.col("kind"), F.col("content")).alias("label"), (F.length(W.first_line(F.col("content"))) > 80).alias("was_cut"))


# Stages in their order with their weights; the types of events stand for them.
STAGES = {"view": 0.05, "click": 0.45, "signup": 0.05, "purchase": 0.30, "error": 0.10}
_TOTAL = sum(STAGES.values())


def _share(i: int) -> str:
    later = " OR ".join(f"at{k} IS NOT NULL AND (at{i} IS NULL OR at{k} < at{i})" for k in range(i + 1, len(STAGES))) or "false"
    return f"{list(STAGES.values())[i] / _TOTAL!r}::DOUBLE * CASE WHEN {later} THEN 1.0 ELSE coalesce(f{i}, 0.0) END"


@query("WITH b AS (SELECT user_id, " + ", ".join(f"min(struct_pack(a := ts, b := event_id)) FILTER (WHERE event_type = '{n}') AS at{i}, max(greatest(0.0, least(1.0, value / 200)))::DOUBLE FILTER (WHERE event_type = '{n}') AS f{i}".replace("::DOUBLE FILTER (WHERE event_type = '" + n + "')", f" FILTER (WHERE event_type = '{n}')") for i, n in enumerate(STAGES)) + f" FROM events GROUP BY 1) SELECT user_id, round(100 * ({' + '.join(_share(i) for i in range(len(STAGES)))}), 6) AS percent FROM b")
def weighted_progress(spark, d):
    """How far each user has come over all stages; stages that were passed over count fully."""
    return W.furthest_progress(K.table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", F.col("value") / 200, STAGES)


_TRIMMED = _STRIP(_LINE)
_NAME = f"CASE WHEN {_TRIMMED} = '' THEN unit_id ELSE {_TRIMMED} END"
_NL = "chr(10)"
_QUOTED = f"array_to_string(list_transform(regexp_split_to_array({_STRIP('content')}, {quoted(chr(92) + 'r' + chr(92) + 'n|[' + _sql(W.LINE_END) + ']')})[1:3], lambda x: '> ' || x), {_NL})"
_PARTS = f"""w AS MATERIALIZED (SELECT source_id, unit_id, kind, ord, content, {_TRIMMED} AS line, {_NAME} AS name, {_TITLE} AS title, {_QUOTED} AS three FROM turns),
 fr AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ord, unit_id) AS n FROM w WHERE kind = 'framework'), la AS (SELECT w.source_id, count(*) FILTER (WHERE kind = 'framework') + 1 AS n FROM w GROUP BY 1),
 x AS (SELECT DISTINCT source_id, 'wiki/chapters.md' AS file, 0 AS section, '' AS o1, 0::BIGINT AS o2, '' AS o3, '# Chapters — ' || source_id || {_NL} AS text FROM w WHERE kind IN ('framework', 'principle')
  UNION ALL SELECT source_id, 'wiki/chapters.md', 1, lpad(n::VARCHAR, 20, '0'), ord, unit_id, '## ' || n || '. ' || CASE WHEN line = '' THEN 'Framework ' || n ELSE line END || {_NL} || {_NL} || content || {_NL} FROM fr
  UNION ALL SELECT DISTINCT source_id, 'wiki/chapters.md', 2, '', 0, '', '## ' || n || '. Principles' || {_NL} FROM w JOIN la USING (source_id) WHERE kind = 'principle'
  UNION ALL SELECT source_id, 'wiki/chapters.md', 3, '', ord, unit_id, '### ' || name || {_NL} || {_NL} || content || {_NL} FROM w WHERE kind = 'principle'
  UNION ALL SELECT DISTINCT source_id, 'wiki/glossary.md', 0, '', 0, '', '# Glossary' || {_NL} FROM w WHERE kind = 'term'
  UNION ALL SELECT source_id, 'wiki/glossary.md', 1, lower(line), ord, unit_id, '**' || name || '**' || {_NL} || {_NL} || content || {_NL} FROM w WHERE kind = 'term'
  UNION ALL SELECT DISTINCT source_id, 'wiki/patterns.md', 0, '', 0, '', '# Patterns & Anti-Patterns' || {_NL} FROM w WHERE kind IN ('principle', 'anti_pattern')
  UNION ALL SELECT DISTINCT source_id, 'wiki/patterns.md', CASE kind WHEN 'principle' THEN 1 ELSE 4 END, '', 0, '', CASE kind WHEN 'principle' THEN '## Patterns' ELSE '## Anti-Patterns' END || {_NL} FROM w WHERE kind IN ('principle', 'anti_pattern')
  UNION ALL SELECT source_id, 'wiki/patterns.md', CASE kind WHEN 'principle' THEN 2 ELSE 5 END, '', ord, unit_id, '- ' || name FROM w WHERE kind IN ('principle', 'anti_pattern')
  UNION ALL SELECT DISTINCT source_id, 'wiki/patterns.md', CASE kind WHEN 'principle' THEN 3 ELSE 6 END, '', 0, '', '' FROM w WHERE kind IN ('principle', 'anti_pattern')
  UNION ALL SELECT DISTINCT source_id, 'wiki/cheatsheet.md', 0, '', 0, '', '# Cheatsheet — ' || source_id || {_NL} FROM w WHERE kind IN ('technique', 'checklist', 'decision_rule')
  UNION ALL SELECT source_id, 'wiki/cheatsheet.md', 1, '', ord, unit_id, '## ' || title || ': ' || name || {_NL} || {_NL} || CASE WHEN line = '' THEN '' ELSE three || {_NL} END FROM w WHERE kind IN ('technique', 'checklist', 'decision_rule')),
 part AS (SELECT source_id, file, row_number() OVER (PARTITION BY source_id, file ORDER BY section, o1, o2, o3) - 1 AS place, text FROM x)"""


@query(f"WITH {_TURNS}, {_PARTS} SELECT source_id, file, place, text FROM part")
def wiki_parts(spark, d):
    """The pages of each conversation's wiki, in parts."""
    return W.wiki_parts(_turns(spark, d))


@query(f"WITH {_TURNS}, {_PARTS} SELECT source_id, file, count(*) AS parts, sha256(string_agg(text, {_NL} ORDER BY place) || {_NL}) AS sha256 FROM part GROUP BY 1, 2")
def wiki_pages(spark, d):
    """How many parts each page of a wiki has, and its digest."""
    return W.wiki_pages(_turns(spark, d))


# Products with too few prompts of their own, and with more than three.
PRODUCTS = Rows("name string, use_when array<string>, do_not_use_when array<string>, refs array<string>", (("none", None, [], None), ("some", [" one ", "", "　"], ["Reproduce the source document verbatim."], ["b", "a"]), ("many", ["a", "b", "c", "d"], ["e", "f", "g", "h"], ["z"])))


def _products(spark, d):
    """Conversations as products: the first three short user turns are what they are used for, the first three short answers what not; and fixed ones."""
    c = K.table(spark, d, "conversations").where((F.length("text") < 80) & F.col("role").isin("user", "assistant"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    short = c.withColumn("nth", nth).where("nth <= 3").groupBy("conv_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("turn", "text")))).alias(r) for r in ("user", "assistant")])
    every = K.table(spark, d, "conversations").select("conv_id").distinct().join(short, "conv_id", "left")
    texts = lambda r: F.transform(r, lambda x: x.text)
    refs = F.transform("user", lambda x: F.concat(F.lit("t"), x.turn.cast("string")))
    return PRODUCTS.df(spark).unionByName(every.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("name"), texts("user").alias("use_when"), texts("assistant").alias("do_not_use_when"), refs.alias("refs")))


def _spelled(pattern: str) -> str:
    head, sep, tail = (sql_value(x) for x in pattern.partition("{}"))
    return f"{head} || name || {tail}" if sep != "''" else head


def _three(column: str, fallbacks) -> str:
    own = f"list_filter(list_transform(coalesce({column}, []), lambda x: {_STRIP('x')}), lambda x: x <> '')"
    return f"list_concat({own}, list_filter([{', '.join(map(_spelled, fallbacks))}], lambda f: NOT list_contains({own}, f)))[1:3]"


_FIXTURES = ", ".join(f"{{'assertions': {sql_value(list(said))}, 'fixture_id': '{i}', 'kind': '{kind}', 'prompt': {_spelled(prompt) if isinstance(prompt, str) else f'{prompt[0]}_[{prompt[1]}]'}, 'should_trigger': {str(triggers).lower()}}}" for i, kind, prompt, triggers, said in W.FIXTURES)
_CORPUS = f"""sh AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations WHERE length(text) < 80 AND role IN ('user', 'assistant')),
 pr AS ({PRODUCTS.sql()} UNION ALL SELECT 'c' || conv_id, u, a, r FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (SELECT conv_id, list(text ORDER BY turn) FILTER (WHERE role = 'user') AS u, list(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS a, list('t' || turn ORDER BY turn) FILTER (WHERE role = 'user') AS r FROM sh WHERE nth <= 3 GROUP BY 1) USING (conv_id)),
 th AS (SELECT name, refs, {_three('use_when', W.POSITIVE)} AS use_, {_three('do_not_use_when', W.NEGATIVE)} AS not_ FROM pr), fx AS (SELECT name, refs, [{_FIXTURES}] AS f FROM th)"""


@query(f"WITH {_CORPUS}, e AS (SELECT name, unnest(f) AS f, generate_subscripts(f, 1) - 1 AS place FROM fx) SELECT name, place::BIGINT AS place, f.fixture_id, f.kind, f.prompt, f.should_trigger, array_to_string(f.assertions, ',') AS assertions FROM e")
def fixture_corpus(spark, d):
    """The eleven fixtures of each product."""
    return W.fixture_corpus(_products(spark, d))


@query(f"WITH {_CORPUS} SELECT name, sha256(to_json({{'fixtures': f, 'ir_knowledge_refs': list_sort(coalesce(refs, []::VARCHAR[])), 'schema_version': 1, 'skill_name': name}})::VARCHAR) AS fixture_set_id FROM fx")
def fixture_sets(spark, d):
    """The id of each product's set of fixtures."""
    return W.fixture_sets(_products(spark, d))
