"""Queries of what is built from units, of hosts, logs and releases, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedimark.functions import text as T
from sedimark.operators import blocks as B
from sedimark.operators import governance as G
from sedimark.operators import products as P
from sedimark.operators.ordered import numbered
from sedimark.sources.formats import SUFFIXES

from . import catalogue as K
from . import oracles as O
from .literals import Rows, sql_value

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {O._VERSIONS} SELECT unit_id, record_version, ord FROM ver WHERE review_status NOT IN ('superseded', 'rejected')")
def usable_units(spark, d):
    """Versions that are usable, without choosing the current one."""
    return P.usable(K._versions(spark, d)).select("unit_id", "record_version", "ord")


# Descriptions of one task and of several.
DESCRIPTIONS = Rows("id bigint, text string", ((-4, "Plans a week AND ALSO writes mail"), (-3, "Plans; and more"), (-2, "规划以及写作"), (-1, "Plans and writes")))


@query(f"SELECT id, regexp_matches({O.casefold('text')}, {sql_value('|'.join(P.MULTI_TASK))}) AS multi FROM (SELECT item_id AS id, text FROM benchmark UNION ALL {DESCRIPTIONS.sql()})")
def multi_task_marks(spark, d):
    """Whether descriptions seem to tell of several tasks."""
    rows = K.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text").unionByName(DESCRIPTIONS.df(spark))
    return rows.select("id", P.multi_task(F.col("text")).alias("multi"))


# Samples of timings, of which some are not valid, and channels with what they may be sent.
SAMPLES = Rows("sample_id bigint, operation string, provider string, model string, runtime_scope string, prompt_version string, schema_version string, input_tokens bigint, seconds double", (
    (1, "chunk", "p", "m", "a" * 64, "1", "1", 10, 2.0), (2, "chunk", "p", "m", "a" * 64, "1", "1", 0, 2.0), (3, "skills", "p", "m", "a" * 64, "1", "1", 10, 2.0), (4, "chunk", "p", "m", "a" * 63, "1", "1", 10, 2.0), (5, "chunk", "p", "n", "a" * 64, "1", "1", 10, 2.0), (6, "chunk", "p", "m", "a" * 64, "2", "1", 10, 2.0), (7, "chunk", "p", "m", "a" * 64, "1", "1", 5, 0.0), (8, "chunk", "p", "m", "a" * 64, "1", "1", 5, 0.1)))
CHANNELS = Rows("channel string, roles array<string>, policy string, categories array<string>", (("a", ["map", "review"], "send", None), ("b", ["map"], "no_send", None), ("c", ["map"], "send", ["public"]), ("d", ["map"], "send", ["private", "licensed"]), ("e", ["review"], "send", ["private"]), ("f", [], "send", None)))


@query(f"""SELECT sample_id, input_tokens / seconds AS rate FROM ({SAMPLES.sql()} UNION ALL SELECT 100 + event_id, CASE event_type WHEN 'view' THEN 'chunk' WHEN 'click' THEN 'skills' ELSE event_type END, CASE WHEN user_id % 2 = 0 THEN 'p' ELSE 'q' END, 'm', repeat('a', 64), '1', '1', floor(value)::BIGINT, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE 0.5 + event_id % 10 / 2 END::DOUBLE FROM events) WHERE operation = 'chunk' AND provider = 'p' AND model = 'm' AND runtime_scope = repeat('a', 64) AND prompt_version = '1' AND schema_version = '1'
 AND provider <> '' AND model <> '' AND length(runtime_scope) = 64 AND input_tokens > 0 AND seconds > 0""")
def matching_samples(spark, d):
    """The valid timings of one way of running, and their rates: of events, and fixed ones."""
    wanted = {"operation": "chunk", "provider": "p", "model": "m", "runtime_scope": "a" * 64, "prompt_version": "1", "schema_version": "1"}
    e, c = K.table(spark, d, "events"), F.col
    operation = F.when(c("event_type") == "view", "chunk").when(c("event_type") == "click", "skills").otherwise(c("event_type"))
    seconds = F.when(c("event_id") % 7 == 0, 0.0).otherwise(0.5 + c("event_id") % 10 / 2)
    one = F.lit("1")
    timed = e.select((100 + c("event_id")).alias("sample_id"), operation.alias("operation"), F.when(c("user_id") % 2 == 0, "p").otherwise("q").alias("provider"), F.lit("m").alias("model"), F.lit("a" * 64).alias("runtime_scope"), one.alias("prompt_version"), one.alias("schema_version"), F.floor("value").cast("bigint").alias("input_tokens"), seconds.alias("seconds"))
    rows = SAMPLES.df(spark).unionByName(timed)
    for name, value in wanted.items():
        rows = rows.where(F.col(name) == value)
    valid = F.col("operation").isin("chunk", "skills", "synthesis") & (F.length("runtime_scope") == 64) & (F.col("input_tokens") > 0) & (F.col("seconds") > 0)
    return rows.where(valid).select("sample_id", (F.col("input_tokens") / F.col("seconds")).alias("rate"))


@query(f"SELECT channel FROM ({CHANNELS.sql()} UNION ALL SELECT 'u' || user_id, list(DISTINCT CASE event_type WHEN 'view' THEN 'map' ELSE 'review' END), CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 5 THEN 'no_send' ELSE 'send' END, CASE user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN ['public'] ELSE ['private', 'public'] END FROM events GROUP BY user_id) WHERE list_contains(roles, 'map') AND policy <> 'no_send' AND (categories IS NULL OR list_contains(categories, 'private'))")
def eligible_channels(spark, d):
    """Channels that may map private material: those of users by what they have done, and fixed ones."""
    roles = F.collect_set(F.when(F.col("event_type") == "view", "map").otherwise("review"))
    policy = F.when(F.count_if(F.col("event_type") == "error") > 5, "no_send").otherwise("send")
    by = K.table(spark, d, "events").groupBy("user_id").agg(roles.alias("roles"), policy.alias("policy"))
    kinds = F.when(F.col("user_id") % 3 == 1, F.array(F.lit("public"))).when(F.col("user_id") % 3 == 2, F.array(F.lit("private"), F.lit("public")))
    c = CHANNELS.df(spark).unionByName(by.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("channel"), "roles", "policy", kinds.alias("categories")))
    return c.where(F.array_contains("roles", "map") & (F.col("policy") != "no_send") & (F.col("categories").isNull() | F.array_contains("categories", "private"))).select("channel")


# --- building -------------------------------------------------------------------------------------------------------------------


@query(f"WITH {O._UNITS} SELECT source_id, 'skill-' || left(sha256(source_id), 8) AS name, 'A skill compiled from ' || count(*) || ' candidate unit(s) covering kinds: ' || array_to_string(list_sort(list(DISTINCT kind)), ', ') || '.' AS description FROM units GROUP BY 1")
def skill_suggestions(spark, d):
    """The product that each source suggests."""
    return P.suggestions(K._units(spark, d))


# Prompts for a product that has fewer than three of its own.
_FALLBACKS = ["Use it to complete its documented workflow.", "Apply it to a concrete, in-scope task.", "Help me execute the method step by step."]


@query(f"""WITH v AS (SELECT conv_id, list(trim(text) ORDER BY turn) FILTER (WHERE role = 'user' AND length(text) < 60) AS own FROM conversations GROUP BY 1), w AS (SELECT conv_id, list_filter(coalesce(own, []), lambda x: x <> '') AS own FROM v)
 SELECT conv_id, unnest(list_concat(own, list_filter({sql_value(_FALLBACKS)}, lambda f: NOT list_contains(own, f)))[1:3]) AS prompt, generate_subscripts(list_concat(own, list_filter({sql_value(_FALLBACKS)}, lambda f: NOT list_contains(own, f)))[1:3], 1) AS place FROM w""")
def fixture_prompts(spark, d):
    """Three prompts for each conversation: its short questions, then fallbacks."""
    c = K.table(spark, d, "conversations")
    short = c.where((F.col("role") == "user") & (F.length("text") < 60) & (F.trim("text") != ""))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    first = short.withColumn("nth", nth).where("nth <= 3").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("own"))
    c = c.select("conv_id").distinct().join(first, "conv_id", "left").withColumn("own", F.coalesce("own", F.array().cast("array<struct<turn:bigint,text:string>>")))
    prompts = P.at_least_three(F.transform("own", lambda x: x.text), _FALLBACKS)
    return c.select("conv_id", F.posexplode(prompts).alias("i", "prompt")).select("conv_id", "prompt", (F.col("i") + 1).cast("long").alias("place"))


# Designs, from bare to full.
DESIGNS = Rows("name string, description string, use_when bigint, do_not_use_when bigint, steps bigint, steps_without_refs bigint, references bigint, assets bigint, exceptions bigint, examples bigint", (("bare", "One thing", 0, 0, 0, 0, 0, 0, 0, 0), ("full", "One thing", 2, 1, 10, 0, 3, 1, 2, 9), ("broad", "One; and another", 1, 0, 4, 2, 1, 0, 1, 2), ("long", "One thing", 0, 3, 11, 1, 0, 0, 0, 1)))


@query(f"""WITH {O._UNITS}, ds AS (SELECT source_id AS name, source_id AS description, count(*) FILTER (WHERE kind = 'term') AS use_when, count(*) FILTER (WHERE kind = 'case') AS do_not_use_when, count(*) FILTER (WHERE kind = 'technique') AS steps, count(*) FILTER (WHERE kind = 'technique' AND length(content) < 12) AS steps_without_refs,
  count(*) FILTER (WHERE heading_level > 0) AS "references", 0::BIGINT AS assets, count(*) FILTER (WHERE length(content) > 200) AS exceptions, count(*) FILTER (WHERE kind = 'case') AS examples FROM units GROUP BY 1 UNION ALL {DESIGNS.sql().replace('references', '"references"')}),
 b AS (SELECT *, (steps > 10 OR regexp_matches(lower(description), {sql_value('|'.join(P.MULTI_TASK))}))::BIGINT AS broad FROM ds)
 SELECT name, least(5, 2 + (use_when > 0)::BIGINT + 2 * (do_not_use_when > 0)::BIGINT) AS trigger_precision, greatest(0, 5 - 2 * broad) AS task_focus, least(5, 2 + (steps > 0)::BIGINT + 2 * (steps_without_refs = 0)::BIGINT) AS workflow_executability, least(5, 2 + 3 * ("references" > 0)::BIGINT) AS progressive_disclosure,
 least(5, 2 + 2 * (assets > 0)::BIGINT) AS deterministic_tooling, least(5, 1 + 2 * (do_not_use_when > 0)::BIGINT + 2 * (exceptions > 0)::BIGINT) AS failure_boundary, least(5, 1 + least(4, examples)) AS example_quality FROM b""")
def design_scores(spark, d):
    """Scores of the designs that sources would make, and of fixed ones."""
    u, c = K._units(spark, d), F.col
    n = lambda cond: F.count_if(cond)
    own = u.groupBy(c("source_id").alias("name")).agg(
        n(c("kind") == "term").alias("use_when"), n(c("kind") == "case").alias("do_not_use_when"), n(c("kind") == "technique").alias("steps"), n((c("kind") == "technique") & (F.length("content") < 12)).alias("steps_without_refs"),
        n(c("heading_level") > 0).alias("references"), F.lit(0).cast("long").alias("assets"), n(F.length("content") > 200).alias("exceptions"), n(c("kind") == "case").alias("examples"),
    ).withColumn("description", c("name"))
    return P.design_scores(own.unionByName(DESIGNS.df(spark)))


# --- hosts ----------------------------------------------------------------------------------------------------------------------

# A closure with each fault, its files and versions, capabilities and a host.
RESOURCES = Rows("resource_id string, class string, path string, sha256 string, version string", (("core", "required", "lib/core.py", "h1", "1.0.0"), ("gone", "required", "lib/gone.py", "h2", "1.0.0"), ("changed", "required", "lib/changed.py", "h3", "1.0.0"), ("old", "required", "lib/old.py", "h4", "2.0.0"), ("unknown", "exact", "lib/unknown.py", "h5", "1.0.0"), ("extra", "optional", "lib/extra.py", "h6", "9.0.0"), ("outside", "optional", "../x", "h7", "1"), ("other", "optional", "lib/other.py", "h8", "1")))
FILES = Rows("path string, sha256 string", (("lib/core.py", "h1"), ("lib/changed.py", "h0"), ("lib/old.py", "h4"), ("lib/unknown.py", "h5"), ("lib/other.py", "h0")))
RESOLVED = Rows("resource_id string, version string", (("core", "1.0.0"), ("gone", "1.0.0"), ("changed", "1.0.0"), ("old", "1.0.0")))
CAPABILITIES = Rows("capability_id string, kind string, version string, resource_id string", (("run", "bundled_script", "1", "core"), ("lost", "bundled_script", "1", "nowhere"), ("net", "host_required", "1", None), ("gpu", "host_optional", "1", None), ("fs", "host_required", "2", None), ("odd", "unsupported", "1", None), ("ocr", "host_optional", "3", None), ("db", "host_required", "1", None)))
HOST = Rows("capability_id string, version string", (("net", "1"), ("fs", "1"), ("odd", "1"), ("ocr", "2")))


def _pinned(spark, d):
    """Each document as a pinned resource; every seventh has no file, every fifth another hash, every eleventh no version and every thirteenth an unsafe path."""
    c, id_ = F.col, F.col("doc_id")
    rows = K.table(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), id_.cast("string")).alias("resource_id"), F.sha2("text", 256).alias("sha256"), F.when(id_ % 3 == 0, "optional").otherwise("required").alias("class"))
    rows = rows.withColumn("path", F.concat(F.when(id_ % 13 == 0, "docs/../").otherwise("docs/"), "resource_id"))
    resources = rows.select("resource_id", "class", "path", "sha256", F.lit("1.0.0").alias("version"))
    files = rows.where("doc_id % 7 <> 0").select("path", F.when(id_ % 5 == 0, F.lit("other")).otherwise(c("sha256")).alias("sha256"))
    versions = rows.where("doc_id % 11 <> 0").select("resource_id", F.when(id_ % 17 == 0, "2.0.0").otherwise("1.0.0").alias("version"))
    return resources, files, versions


_PINNED = """pin AS (SELECT doc_id, 'd' || doc_id AS resource_id, sha256(text) AS sha256, CASE WHEN doc_id % 3 = 0 THEN 'optional' ELSE 'required' END AS class, CASE WHEN doc_id % 13 = 0 THEN 'docs/../' ELSE 'docs/' END || 'd' || doc_id AS path FROM documents)"""
_NEEDED = """SELECT 'c' || event_id AS capability_id, CASE event_type WHEN 'view' THEN 'host_required' WHEN 'click' THEN 'host_optional' WHEN 'error' THEN 'unsupported' ELSE 'bundled_script' END AS kind, (event_id % 3)::VARCHAR AS version, CASE WHEN event_type IN ('view', 'click', 'error') THEN NULL ELSE 'd' || event_id END AS resource_id FROM events"""
_OFFERED = """SELECT 'c' || event_id AS capability_id, (user_id % 3)::VARCHAR AS version FROM events WHERE event_id % 4 <> 0"""


def _capabilities(spark, d):
    """Each event as a capability that is needed, and those of three in four that a host has, in a version by its user."""
    e, c = K.table(spark, d, "events"), F.col
    name = F.concat(F.lit("c"), c("event_id").cast("string")).alias("capability_id")
    kind = F.when(c("event_type") == "view", "host_required").when(c("event_type") == "click", "host_optional").when(c("event_type") == "error", "unsupported").otherwise("bundled_script")
    bundled = F.when(~c("event_type").isin("view", "click", "error"), F.concat(F.lit("d"), c("event_id").cast("string")))
    needed = e.select(name, kind.alias("kind"), (c("event_id") % 3).cast("string").alias("version"), bundled.alias("resource_id"))
    return needed, e.where("event_id % 4 <> 0").select(name, (c("user_id") % 3).cast("string").alias("version"))


@query(f"""WITH {_PINNED}, r AS ({RESOURCES.sql()} UNION ALL SELECT resource_id, class, path, sha256, '1.0.0' FROM pin), f AS ({FILES.sql()} UNION ALL SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE sha256 END FROM pin WHERE doc_id % 7 <> 0),
 v AS ({RESOLVED.sql()} UNION ALL SELECT resource_id, CASE WHEN doc_id % 17 = 0 THEN '2.0.0' ELSE '1.0.0' END FROM pin WHERE doc_id % 11 <> 0), c AS ({CAPABILITIES.sql()} UNION ALL {_NEEDED}), h AS ({HOST.sql()} UNION ALL {_OFFERED}),
 a AS (SELECT r.resource_id AS id, class, CASE WHEN class <> 'optional' AND v.version IS NULL THEN 'version_missing' WHEN class <> 'optional' AND v.version <> r.version THEN 'version_mismatch' WHEN regexp_matches('/' || r.path || '/', '/(?:\\.|\\.\\.)/') THEN 'path_unsafe' WHEN f.path IS NULL THEN 'resource_missing' WHEN f.sha256 <> r.sha256 THEN 'hash_mismatch' END AS code
  FROM r LEFT JOIN v USING (resource_id) LEFT JOIN f ON f.path = r.path),
 b AS (SELECT capability_id AS id, kind, CASE WHEN kind = 'bundled_script' THEN CASE WHEN c.resource_id NOT IN (SELECT resource_id FROM r) THEN 'bundled_not_pinned' END WHEN kind = 'unsupported' THEN 'capability_unsupported' WHEN h.version IS NULL THEN 'capability_missing' WHEN h.version <> c.version THEN 'capability_mismatch' END AS code FROM c LEFT JOIN h USING (capability_id))
 SELECT id, code, NOT (class = 'optional' AND code = 'resource_missing') AS blocking FROM a WHERE code IS NOT NULL UNION ALL SELECT id, code, NOT (kind = 'host_optional' AND code = 'capability_missing') FROM b WHERE code IS NOT NULL""")
def closure_findings(spark, d):
    """What a runtime closure's files, versions and host do not meet."""
    needed, offered = _capabilities(spark, d)
    fixed = [x.df(spark) for x in (RESOURCES, FILES, RESOLVED, CAPABILITIES, HOST)]
    return P.closure_findings(*[a.unionByName(b) for a, b in zip(fixed, [*_pinned(spark, d), needed, offered])])


@query(f"""WITH c AS ({CAPABILITIES.sql()} UNION ALL {_NEEDED}), h AS ({HOST.sql()} UNION ALL {_OFFERED}), m AS (SELECT c.capability_id, c.version, kind, CASE WHEN kind <> 'unsupported' THEN h.version END AS there FROM c LEFT JOIN h USING (capability_id) WHERE kind <> 'bundled_script')
 SELECT capability_id, unnest(CASE WHEN there IS NULL THEN ['missing'] WHEN there <> version THEN ['mismatch', 'missing'] ELSE [] END) AS code, kind = 'host_optional' AS optional FROM m""")
def host_preflight(spark, d):
    """What a host lacks of a product's capabilities."""
    needed, offered = _capabilities(spark, d)
    return P.preflight(CAPABILITIES.df(spark).unionByName(needed), HOST.df(spark).unionByName(offered))


# Tasks that one source fans out to.
TASKS = Rows("task_id string, product_id string", (("t1", "p1"), ("t2", "p2"), ("t2", "p3"), ("t4", "p1"), ("t5", "p5")))
PROVENANCE = Rows("task_id string, source_id string, sha256 string", (("t1", "s", "h"), ("t2", "z", "h"), ("t4", "s", "g"), ("t5", "s", None)))


@query(f"""WITH t AS ({TASKS.sql()} UNION ALL SELECT 'e' || (event_id - event_id % 2 * (event_id % 50 = 1)::BIGINT), 'p' || event_id FROM events), p AS ({PROVENANCE.sql()} UNION ALL SELECT 'e' || event_id, CASE event_type WHEN 'error' THEN 'z' ELSE 's' END, CASE event_type WHEN 'signup' THEN 'g' ELSE 'h' END FROM events) SELECT task_id, 'duplicate_task' AS code FROM t GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT min(task_id), 'duplicate_product' FROM t GROUP BY product_id HAVING count(*) > 1
 UNION ALL SELECT DISTINCT task_id, CASE WHEN source_id <> 's' THEN 'other_source' ELSE 'other_hash' END FROM p WHERE source_id <> 's' OR sha256 <> 'h'""")
def fan_out_violations(spark, d):
    """What forbids a source's fan-out to tasks."""
    e, c = K.table(spark, d, "events"), F.col
    name = lambda x: F.concat(F.lit("e"), x.cast("string")).alias("task_id")
    tasks = e.select(name(F.when(c("event_id") % 50 == 1, c("event_id") - c("event_id") % 2).otherwise(c("event_id"))), F.concat(F.lit("p"), c("event_id").cast("string")).alias("product_id"))
    origin = e.select(name(c("event_id")), F.when(c("event_type") == "error", "z").otherwise("s").alias("source_id"), F.when(c("event_type") == "signup", "g").otherwise("h").alias("sha256"))
    return P.fan_out_violations(TASKS.df(spark).unionByName(tasks), PROVENANCE.df(spark).unionByName(origin), "s", "h")


# What external tools say, by profile.
EXTERNAL = Rows("profile string, status string, blocking boolean", (("draft", "not_run", False), ("release", "not_run", True), ("clean", "pass", True), ("warned", "warn", False)))


@query(f"""WITH {O._ROLLUP}, i AS (SELECT unnest(['draft', 'release', 'clean', 'warned', 'alone', 'links']) AS profile), worst AS (SELECT max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) FILTER (WHERE check_id = 'source-coverage') AS w, max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) AS a FROM roll),
 s AS (SELECT profile, CASE CASE WHEN profile = 'alone' THEN a WHEN profile = 'links' THEN coalesce(w, 0) ELSE 0 END WHEN 2 THEN 'fail' WHEN 1 THEN 'pass_with_warnings' ELSE 'pass' END AS status FROM i, worst), e AS ({EXTERNAL.sql()}),
 g AS (SELECT profile, bool_or(blocking AND status IN ('fail', 'not_run')) AS blocked, bool_or(status <> 'pass') AS less FROM e GROUP BY 1)
 SELECT s.profile, CASE WHEN s.status = 'fail' OR coalesce(blocked, false) THEN 'fail' WHEN s.status = 'pass_with_warnings' OR coalesce(less, false) THEN 'pass_with_warnings' ELSE 'pass' END AS status FROM s LEFT JOIN g ON g.profile = s.profile""")
def compatibility_rollup(spark, d):
    """Internal and external evidence by profile: one is judged by all checks, one by its links, the others pass within."""
    from sedimark.operators import checks as C

    rank = F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0)
    name = lambda r: F.when(r == 2, "fail").when(r == 1, "pass_with_warnings").otherwise("pass")
    worst = C.worst_by_check(K._findings(spark, d)).agg(F.max(rank).alias("all"), F.max(F.when(F.col("check_id") == "source-coverage", rank)).alias("links"))
    measured = worst.select(F.explode(F.create_map(F.lit("alone"), name(F.col("all")), F.lit("links"), name(F.col("links")))).alias("profile", "status"))
    fixed = spark.createDataFrame([(p, "pass") for p in ("draft", "release", "clean", "warned")], "profile string, status string")
    return P.compatibility(measured.unionByName(fixed), EXTERNAL.df(spark))


# --- logs, releases and sets ----------------------------------------------------------------------------------------------------


# A publication log with failures that cancel what came before, and others.
LOG = Rows("skill string, ord bigint, success boolean, action string, attempt string", (("a", 1, True, "publish", "x"), ("a", 2, True, "publish", "y"), ("a", 3, False, "publish", "y"), ("a", 4, False, "publish", "x"), ("a", 5, True, "rollback", "z"), ("a", 6, False, "publish", "z"), ("b", 1, True, "publish", "x"), ("b", 2, False, "publish", "x"), ("c", 1, False, "publish", "x"), ("c", 2, True, "publish", "w")))


@query(f"""WITH RECURSIVE lg AS (SELECT user_id::VARCHAR AS skill, event_id AS ord, event_type <> 'error' AS success, 'publish' AS action, (floor(value / 40))::BIGINT::VARCHAR AS attempt FROM events UNION ALL {LOG.sql()}),
 n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY ord) AS nth FROM lg),
 w AS (SELECT skill, nth, CASE WHEN success THEN [{{'o': ord, 'c': action, 'a': attempt}}] ELSE [] END AS st FROM n WHERE nth = 1
  UNION ALL SELECT n.skill, n.nth, CASE WHEN n.success THEN list_append(w.st, {{'o': n.ord, 'c': n.action, 'a': n.attempt}}) WHEN len(w.st) > 0 AND w.st[-1].c = 'publish' AND n.action = 'publish' AND w.st[-1].a = n.attempt THEN w.st[1:-2] ELSE w.st END FROM w JOIN n ON n.skill = w.skill AND n.nth = w.nth + 1)
 SELECT skill, st[-1].o AS ord, st[-1].a AS attempt FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY skill ORDER BY nth DESC) = 1) WHERE len(st) > 0""")
def standing_publications(spark, d):
    """The last publication of each user, or of a fixed skill, that no failure of the same attempt has cancelled."""
    e = K.table(spark, d, "events")
    rows = e.select(F.col("user_id").cast("string").alias("skill"), F.col("event_id").alias("ord"), (F.col("event_type") != "error").alias("success"), F.lit("publish").alias("action"), F.floor(F.col("value") / 40).cast("string").alias("attempt"))
    return G.standing_publications(rows.unionByName(LOG.df(spark)))


# Releases, snapshots.
RELEASES = Rows("pack_id string, version string", (("p", "1.10.0"), ("p", "1.9.0"), ("p", "1.9.10"), ("p", "10.0.0"), ("p", "2.0.0"), ("q", "0.0.1")))
SNAPSHOTS = Rows("skill string, name string", (("a", "20260101T000000000000"), ("a", "20260101T000000000001"), ("a", "20251231T235959999999"), ("b", "x")))


@query(f"SELECT pack_id, version, row_number() OVER (PARTITION BY pack_id ORDER BY list_transform(string_split(version, '.'), lambda x: x::BIGINT)) - 1 AS place FROM ({RELEASES.sql()} UNION ALL SELECT DISTINCT 'u' || user_id, (event_id % 3)::VARCHAR || '.' || event_id % 12 || '.' || floor(value)::BIGINT % 11 FROM events)")
def release_order(spark, d):
    """Releases by number, not by text: the versions that each user's events make up, and fixed ones."""
    n = lambda x: x.cast("bigint").cast("string")
    made = F.concat_ws(".", n(F.col("event_id") % 3), n(F.col("event_id") % 12), n(F.floor("value") % 11))
    rows = K.table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("pack_id"), made.alias("version")).distinct()
    return P.release_order(RELEASES.df(spark).unionByName(rows))


@query(f"SELECT skill, max(name) AS name FROM (SELECT user_id::VARCHAR AS skill, strftime(ts, '%Y%m%dT%H%M%S') AS name FROM events UNION ALL {SNAPSHOTS.sql()}) GROUP BY 1")
def latest_snapshots(spark, d):
    """The snapshot of each skill whose name is last."""
    rows = K.table(spark, d, "events").select(F.col("user_id").cast("string").alias("skill"), F.date_format("ts", "yyyyMMdd'T'HHmmss").alias("name")).unionByName(SNAPSHOTS.df(spark))
    return rows.groupBy("skill").agg(F.max("name").alias("name"))


@query(f"WITH {O._VERSIONS} SELECT unit_id, record_version, ord, row_number() OVER (ORDER BY unit_id, record_version, ord) - 1 AS place FROM ver")
def canonical_order(spark, d):
    """The place of each version in the canonical order of a bundle."""
    return numbered(K._versions(spark, d).select("unit_id", "record_version", "ord"), [], ["unit_id", "record_version", "ord"], "place")


@query(f"SELECT format, row_number() OVER (ORDER BY format) - 1 AS place FROM (SELECT DISTINCT unnest({sql_value(list(SUFFIXES.values()))}) AS format UNION SELECT 'query:' || regexp_extract(url, '[?&]([a-z]+)=', 1) FROM pages WHERE regexp_matches(url, '[?&][a-z]+=') UNION SELECT 'host:' || regexp_extract(url, '\\.([a-z]+)(/|$)', 1) FROM pages WHERE regexp_matches(url, '\\.[a-z]+(/|$)'))")
def format_list(spark, d):
    """The formats that are known and the kinds of addresses that pages have, in order."""
    url = F.col("url")
    found = K.table(spark, d, "pages").select(F.explode(F.array_compact(F.array(F.when(url.rlike("[?&][a-z]+="), F.concat(F.lit("query:"), F.regexp_extract(url, "[?&]([a-z]+)=", 1))), F.when(url.rlike(r"\.[a-z]+(/|$)"), F.concat(F.lit("host:"), F.regexp_extract(url, r"\.([a-z]+)(/|$)", 1)))))).alias("format"))
    rows = spark.createDataFrame([(v,) for v in SUFFIXES.values()], "format string").unionByName(found).distinct()
    return numbered(rows, [], ["format"], "place")


@query("""WITH g AS (SELECT source AS key, doc_id * 2 AS ord, substr(sha256(text), 1, 12) AS source_id, lang AS locator, sha256(text) AS sha256 FROM documents UNION ALL SELECT source, doc_id * 2 + 1, substr(sha256(text), 1, 12), lang, sha256(text) FROM documents WHERE length(text) % 2 = 0),
 o AS (SELECT key, source_id, locator, sha256, min(ord) AS f FROM g GROUP BY ALL) SELECT key, row_number() OVER (PARTITION BY key ORDER BY f) - 1 AS place, source_id, locator, sha256 FROM o""")
def provenance_union(spark, d):
    """The references of each source's documents, given twice for some, once each in order."""
    t = F.col("text")
    docs = K._docs(spark, d).select(F.col("source").alias("key"), (F.col("doc_id") * 2).alias("ord"), T.source_id(t).alias("source_id"), F.col("lang").alias("locator"), F.sha2(t, 256).alias("sha256"), F.length(t).alias("n"))
    again = docs.where("n % 2 = 0").withColumn("ord", F.col("ord") + 1)
    return P.provenance_union(docs.unionByName(again).drop("n"))


@query("""WITH a AS (SELECT source AS owner, lang AS c, left(sha256(text), 1) AS k FROM documents), b AS (SELECT source AS owner, lang AS c, left(sha256(text), 1) AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
 n AS (SELECT owner, c, k, sum(x) AS x FROM (SELECT *, 1 AS x FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY ALL) SELECT DISTINCT owner FROM n WHERE x <> 0""")
def signature_differences(spark, d):
    """Sources whose documents, as a multiset of declarations, change without those of poor quality."""
    docs = K._docs(spark, d).select("doc_id", F.col("source").alias("owner"), F.col("lang").alias("capability_id"), F.left(F.sha2("text", 256), F.lit(1)).alias("kind"), F.lit("1").alias("version"), F.lit(None).cast("string").alias("resource_id"))
    poor = K.table(spark, d, "labels").where("quality = 0").select("doc_id").distinct()
    return P.signature_differences(docs, docs.join(poor, "doc_id", "left_anti"))


@query("""WITH f AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1), sk AS (SELECT 'd' || doc_id AS path, 'skipped' AS status FROM documents WHERE length(text) < 40), rs AS (SELECT 'd' || doc_id AS path, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'partial' ELSE 'success' END AS status FROM f WHERE doc_id IN (SELECT doc_id FROM documents WHERE length(text) >= 40)),
 pr AS (SELECT 'd' || doc_id AS path, CASE WHEN length(text) > 5000 THEN 'failed' ELSE 'success' END AS status FROM documents WHERE length(text) >= 40), dn AS (SELECT * FROM rs WHERE status IN ('success', 'partial')),
 u AS (SELECT * FROM sk UNION ALL SELECT * FROM dn UNION ALL SELECT * FROM pr WHERE path NOT IN (SELECT path FROM dn)) SELECT path, status, status IN ('failed', 'skipped') AS failed FROM u""")
def batch_outcomes(spark, d):
    """The outcome of each document of a batch that resumes: short ones are skipped, labelled ones come from the run before."""
    docs = K._docs(spark, d).select("doc_id", F.concat(F.lit("d"), "doc_id").alias("path"), F.length("text").alias("n"))
    labels = K.table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    before = docs.where("n >= 40").join(labels, "doc_id").select("path", F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 0, "partial").otherwise("success").alias("status"))
    now = docs.where("n >= 40").select("path", F.when(F.col("n") > 5000, "failed").otherwise("success").alias("status"))
    return P.batch_outcomes(docs.where("n < 40"), before, now)


@query(f"""WITH {O._UNITS}, known AS (SELECT DISTINCT substr(sha256(text), 1, 12) AS s FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), q AS (SELECT source_id, block_id, max((source_id IN (SELECT s FROM known))::INT) AS hit FROM units GROUP BY 1, 2),
 m AS (SELECT (SELECT count(*) FROM known) AS declared, count(DISTINCT source_id) AS cited, count(*) AS citations, count(DISTINCT source_id) FILTER (WHERE hit = 1) AS hits, count(DISTINCT source_id) FILTER (WHERE hit = 0) AS orphans FROM q)
 SELECT declared, cited, citations, coalesce(hits / nullif(declared, 0), 1.0) AS hit_rate, orphans FROM m""")
def tree_metrics(spark, d):
    """Citations of the units' blocks against the sources that labels declare: how many, the share of declared sources that is cited, and cited ones that are not declared."""
    known = K._docs(spark, d).join(K.table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select(T.source_id(F.col("text")).alias("s"), F.lit(True).alias("hit")).distinct()
    cites = K._units(spark, d).select("source_id", "block_id").distinct().join(known, F.col("source_id") == F.col("s"), "left")
    of = lambda cond: F.count_distinct(F.when(cond, F.col("source_id")))
    hit = F.coalesce("hit", F.lit(False))
    m = cites.agg(F.count_distinct("source_id").alias("cited"), F.count(F.lit(1)).alias("citations"), of(hit).alias("both"), of(~hit).alias("orphans"))
    counts = m.unionByName(known.agg(F.count(F.lit(1)).alias("declared")), True).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("declared", "cited", "citations", "both", "orphans")])
    return counts.select("declared", "cited", "citations", F.coalesce(F.try_divide("both", "declared"), F.lit(1.0)).alias("hit_rate"), "orphans")


@query(f"""WITH {O._UNITS}, s AS (SELECT count(*) AS n, count(*) FILTER (WHERE length(content) >= 12) AS supported, count(DISTINCT unit_id) AS ids, count(DISTINCT block_id) AS refs, count(DISTINCT block_id) FILTER (WHERE length(content) >= 20) AS found FROM units)
 SELECT unnest(['source_reference_coverage', 'locator_resolution_rate', 'content_integrity_blocked', 'duplicate_unit_id_count', 'rebuild_consumer_hash_equal', 'skill_fixture_pass_rate', 'update_consistency', 'semantic_hallucination_rate']) AS metric,
 unnest([coalesce(supported / nullif(n, 0), 1.0), coalesce(found / nullif(refs, 0), 1.0), (found < refs)::INT::DOUBLE, (n - ids)::DOUBLE, 1.0::DOUBLE, NULL, NULL, NULL]) AS value, unnest(['measured', 'measured', 'measured', 'measured', 'measured', 'not_measured', 'not_measured', 'not_measured']) AS state FROM s""")
def benchmark_metrics(spark, d):
    """The five metrics that are measured, each a row, and three that are not; two builds of the same units are compared by their digests."""
    u = K._units(spark, d)
    s = u.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("content") >= 12).alias("supported"), F.count_distinct("unit_id").alias("ids"), F.count_distinct("block_id").alias("refs"), F.count_distinct(F.when(F.length("content") >= 20, F.col("block_id"))).alias("found"))
    digest = lambda rows: rows.agg(F.bit_xor(F.xxhash64(B.canonical_json(rows.select("unit_id", "kind", "content")))).alias("x"))
    same = digest(u).unionByName(digest(u.repartition("unit_id"))).agg((F.count_distinct("x") == 1).cast("double").alias("same"))
    s = s.unionByName(same, True).agg(*[F.max(c).alias(c) for c in ("n", "supported", "ids", "refs", "found", "same")])
    c = F.col
    values = {
        "source_reference_coverage": F.coalesce(F.try_divide(c("supported"), c("n")), F.lit(1.0)), "locator_resolution_rate": F.coalesce(F.try_divide(c("found"), c("refs")), F.lit(1.0)), "content_integrity_blocked": (c("found") < c("refs")).cast("double"),
        "duplicate_unit_id_count": (c("n") - c("ids")).cast("double"), "rebuild_consumer_hash_equal": c("same"), "skill_fixture_pass_rate": None, "update_consistency": None, "semantic_hallucination_rate": None,
    }
    rows = [F.struct(F.lit(k).alias("metric"), (F.lit(None).cast("double") if v is None else v).alias("value"), F.lit("not_measured" if v is None else "measured").alias("state")) for k, v in values.items()]
    return s.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query(f"""WITH {O._UNITS}, m AS (SELECT 's' || source AS source_id_, min(substr(sha256(text), 1, 12)) AS x FROM documents GROUP BY 1), man AS (SELECT DISTINCT substr(sha256(text), 1, 12) AS s FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)), r AS (SELECT DISTINCT source_id, block_id, block_ord FROM units)
 SELECT r.source_id, count(*) AS blocks, man.s IS NOT NULL AS known, sha256(string_agg(block_id, ',' ORDER BY block_ord)) AS provenance FROM r LEFT JOIN man ON man.s = r.source_id GROUP BY 1, 3""")
def resource_provenance(spark, d):
    """The blocks that each source's units refer to, in order, as one digest, and whether a manifest knows the source."""
    refs = K._units(spark, d).select("source_id", "block_id", F.format_string("%020d", "block_ord").alias("at"), "block_ord").distinct()
    known = K._docs(spark, d).join(K.table(spark, d, "labels").where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi").select(T.source_id(F.col("text")).alias("source_id"), F.lit(True).alias("known")).distinct()
    digests = B.joined_digests(refs.select("source_id", "block_ord", "block_id"), "source_id", "block_id", ",", order=["block_ord"])
    return digests.join(known, "source_id", "left").select("source_id", F.col("entries").alias("blocks"), F.coalesce("known", F.lit(False)).alias("known"), F.col("digest").alias("provenance"))
