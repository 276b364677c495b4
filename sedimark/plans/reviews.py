"""Queries from loose candidates to published units, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimark.functions import text as T
from sedimark.operators import checks as C
from sedimark.operators import governance as G
from sedimark.operators import relate as R
from sedimark.operators import reviews as V
from sedimark.sources import sinks

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


# Locators of each kind, and ordinals that are none.
LOCATORS = Rows("source_id string, kind string, ordinal bigint", (("s", "page", 1), ("s", "chapter", 2), ("s", "paragraph", 3), ("s", "table", 4), ("s", "sheet", 5), ("s", "unknown", 6), ("s", "odd", 7), ("s", None, 8), ("s", "page", 0)))
_PREFIX = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.PREFIXES.items()) + " ELSE 'b' END"


@query(f"WITH {O._BLOCKS}, l AS (SELECT source_id, CASE lang WHEN 'en' THEN 'page' WHEN 'de' THEN 'chapter' WHEN 'fr' THEN 'table' END AS kind, block_ord AS ordinal FROM blk UNION ALL {LOCATORS.sql()}) SELECT source_id, kind, ordinal, CASE WHEN ordinal >= 1 THEN source_id || '-' || {_PREFIX} || ordinal END AS block_id FROM l")
def block_ids(spark, d):
    """Ids of blocks by the kinds of their locators, which stand for languages, and of fixed ones."""
    from sedimark.operators import blocks as B

    b = B.blocks(K._docs(spark, d))
    kind = F.when(F.col("lang") == "en", "page").when(F.col("lang") == "de", "chapter").when(F.col("lang") == "fr", "table")
    rows = b.select("source_id", kind.alias("kind"), F.col("block_ord").alias("ordinal")).unionByName(LOCATORS.df(spark))
    return rows.withColumn("block_id", V.block_id(F.col("source_id"), F.col("kind"), F.col("ordinal")))


# Candidates that are slightly off.
LOOSE = Rows("unit_id string, kind string, review_status string, refs array<string>", (("c1", "idea", "new", []), ("c2", "term", "approved", ["s/b"]), ("c3", None, None, None), ("c4", "checklist", "superseded", ["s/b", "s/c"])))


@query(f"""WITH c AS (SELECT 'e' || event_id AS unit_id, event_type AS kind, CASE WHEN value > 90 THEN 'approved' WHEN value > 50 THEN 'unclear' ELSE 'reviewed' END AS review_status, CASE WHEN value > 20 THEN ['u/' || user_id] ELSE [] END AS refs FROM events UNION ALL {LOOSE.sql()})
 SELECT unit_id, CASE WHEN kind IN {G.KINDS} THEN kind ELSE 'technique' END AS kind, CASE WHEN review_status IN {G.STATUSES} THEN review_status ELSE 'candidate' END AS review_status, array_to_string(CASE WHEN len(coalesce(refs, [])) = 0 THEN ['unknown/unknown'] ELSE refs END, ',') AS refs FROM c""")
def cast_candidates(spark, d):
    """Events as loose candidates, and fixed ones, cast to units."""
    e = K.table(spark, d, "events")
    status = F.when(F.col("value") > 90, "approved").when(F.col("value") > 50, "unclear").otherwise("reviewed")
    refs = F.when(F.col("value") > 20, F.array(F.concat(F.lit("u/"), "user_id"))).otherwise(F.array().cast("array<string>"))
    rows = e.select(F.concat(F.lit("e"), "event_id").alias("unit_id"), F.col("event_type").alias("kind"), status.alias("review_status"), refs.alias("refs"))
    return V.cast_units(rows.unionByName(LOOSE.df(spark))).withColumn("refs", F.array_join("refs", ","))


# Loose JSON rows.
JSON = Rows("id bigint, raw string", ((-9, '{"level": 9, "confidence": 2, "record_version": 0, "review_status": "approved", "kind": "term", "content": "x"}'), (-8, '{"level": "3.7", "confidence": "0.25", "record_version": "4"}'), (-7, '{"level": true, "confidence": false, "review_status": "new", "kind": 5}'), (-6, '{"level": null, "confidence": "much", "content": null}'), (-5, "{}"), (-4, '{"level": -2, "confidence": -0.5, "record_version": 2.9}')))
_NUM = lambda k: f"CASE WHEN json_extract_string(raw, '$.{k}') NOT IN ('true', 'false') THEN try_cast(json_extract_string(raw, '$.{k}') AS DOUBLE) END"


@query(f"""WITH j AS (SELECT event_id AS id, props AS raw FROM events UNION ALL {JSON.sql()}) SELECT id, greatest(1, least(6, coalesce(trunc({_NUM('level')})::BIGINT, 1))) AS level, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce({_NUM('confidence')}, 0.5))) AS confidence, greatest(1, coalesce(trunc({_NUM('record_version')})::BIGINT, 1)) AS record_version,
 CASE WHEN json_extract_string(raw, '$.review_status') IN {G.STATUSES} THEN json_extract_string(raw, '$.review_status') ELSE 'candidate' END AS review_status, coalesce(json_extract_string(raw, '$.kind'), '') AS kind, coalesce(json_extract_string(raw, '$.content'), '') AS content FROM j""")
def coerced_candidates(spark, d):
    """Loose JSON rows forced into shape."""
    rows = K.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("raw")).unionByName(JSON.df(spark))
    return rows.select("id", *[c.alias(k) for k, c in V.coerced(F.col("raw")).items()])


@query(f"WITH {O._UNITS} SELECT unit_id, sha256(content) AS content_sha256, source_id || '/' || block_id AS refs, confidence, left(sha256(coalesce(CASE WHEN lang <> 'fr' THEN 'model-' || lang END, 'unknown')), 12) AS anonymized_model_id FROM units")
def critic_cards(spark, d):
    """Units as cards for a critic; the model behind them goes by language, and is not known for one."""
    u = K._units(spark, d).withColumn("refs", F.concat_ws("/", "source_id", "block_id")).withColumn("model", F.when(F.col("lang") != "fr", F.concat(F.lit("model-"), "lang")))
    return V.cards(u).withColumn("content", F.sha2("content", 256)).withColumnRenamed("content", "content_sha256")


@query(f"""WITH {O._UNITS}, l AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) SELECT unit_id, kind || ':' || sha256(trim(regexp_replace({O.casefold('content')}, '\\s+', ' ', 'g'))) AS canonical_key, sha256(content) AS content_sha256, coalesce(toxic, 0) = 0 AS covered
 FROM units LEFT JOIN l ON doc_id = ord WHERE coalesce(quality, 1) = 1""")
def asset_candidates(spark, d):
    """Units as assets: those of poor documents are rejected, and no manifest covers toxic ones."""
    labels = K.table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    u = K._units(spark, d).join(labels, F.col("ord") == F.col("doc_id"), "left")
    units = u.withColumn("review_status", F.when(F.col("quality") == 0, "rejected").otherwise("candidate"))
    return V.asset_candidates(units, u.where("coalesce(toxic, 0) = 0"))


# Overrides with and without faults.
OVERRIDES = Rows("override_id string, field string, value string", (("o1", "confidence", "0.5"), ("o2", "confidence", "1.5"), ("o3", "confidence", '"high"'), ("o4", "confidence", "null"), ("o5", "review_status", '"approved"'), ("o6", "review_status", '"done"'), ("o7", "kind", '"term"'), ("o8", "kind", "7"), ("o9", "conditions", '["a"]'), ("oa", "exceptions", '"a"'), ("ob", "colour", '"red"'), ("oc", "content", '""')))


@query(f"""WITH o AS (SELECT 'e' || event_id AS override_id, 'confidence' AS field, (value / 100)::VARCHAR AS value FROM events UNION ALL {OVERRIDES.sql()}),
 r AS (SELECT override_id, CASE WHEN field NOT IN {sinks.OVERRIDE_FIELDS} THEN 'field' WHEN field = 'confidence' AND value <> 'null' AND NOT coalesce(try_cast(value AS DOUBLE) BETWEEN 0 AND 1, false) THEN 'confidence' WHEN field = 'review_status' AND NOT coalesce(trim(value, '"') IN {G.STATUSES}, false) THEN 'review_status'
  WHEN field IN ('kind', 'content') AND NOT regexp_matches(value, '^".+"$') THEN 'text' WHEN field IN ('conditions', 'exceptions', 'source_refs') AND NOT starts_with(value, '[') THEN 'list' END AS rule FROM o) SELECT * FROM r WHERE rule IS NOT NULL""")
def override_rules(spark, d):
    """Overrides that break their field's rule: events as overrides of a confidence, and fixed ones."""
    e = K.table(spark, d, "events").select(F.concat(F.lit("e"), "event_id").alias("override_id"), F.lit("confidence").alias("field"), (F.col("value") / 100).cast("string").alias("value"))
    return sinks.override_violations(e.unionByName(OVERRIDES.df(spark)))


# Units and conflicts that keep a release from being published.
RELEASED = Rows("unit_id string, review_status string", (("x", "approved"), ("x", "approved"), ("y", None)))


@query(f"""WITH {O._OLD}, u AS (SELECT unit_id, review_status FROM new UNION ALL {RELEASED.sql()}), cf AS (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)
 SELECT 'duplicate_id' AS reason, unit_id AS id FROM u GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'not_approved', unit_id FROM u WHERE review_status IS DISTINCT FROM 'approved' UNION ALL SELECT 'open_conflict', left(sha256(text), 12) FROM cf""")
def publish_blockers(spark, d):
    """What keeps the new collection from being published; texts that come up more than once are open conflicts."""
    units = K._new(spark, d).select("unit_id", "review_status").unionByName(RELEASED.df(spark))
    twice = K._docs(spark, d).groupBy(T.source_id(F.col("text")).alias("conflict_id")).count().where("count > 1")
    return V.publish_blockers(units, twice)


# Rendered units and references that differ in every way.
EXPECTED = Rows("unit_id string, content string", (("e1", "same  text"), ("e2", "other"), ("e3", "gone"), ("e4", "twice"), ("e4", "twice")))
RENDERED = Rows("unit_id string, content string", (("e1", " same text "), ("e2", "changed"), ("e4", "twice"), ("e5", "extra"), ("e5", "extra")))


@query(f"""WITH {O._UNITS}, l AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1), e AS (SELECT unit_id, content FROM units UNION ALL {EXPECTED.sql()}),
 r AS (SELECT unit_id, CASE WHEN toxic = 1 THEN content || ' more' ELSE content END AS content FROM units LEFT JOIN l ON doc_id = ord WHERE coalesce(quality, 1) = 1 UNION ALL {RENDERED.sql()}),
 ep AS (SELECT unit_id, count(*) AS en, max(sha256(trim(regexp_replace(content, '\\s+', ' ', 'g')))) AS eh FROM e GROUP BY 1), rp AS (SELECT unit_id, count(*) AS rn, min(sha256(trim(regexp_replace(content, '\\s+', ' ', 'g')))) AS lo, max(sha256(trim(regexp_replace(content, '\\s+', ' ', 'g')))) AS hi FROM r GROUP BY 1),
 b AS (SELECT * FROM ep FULL JOIN rp USING (unit_id)), x AS (SELECT unnest([CASE WHEN rn IS NULL THEN 'missing_unit' END, CASE WHEN en IS NULL THEN 'extra_unit' END, CASE WHEN en > 1 OR rn > 1 THEN 'duplicate_unit' END, CASE WHEN lo <> eh OR hi <> eh THEN 'content_mismatch' END]) AS reason, unit_id AS id FROM b) SELECT * FROM x WHERE reason IS NOT NULL""")
def unit_reconciliation(spark, d):
    """Units against what was rendered of them: poor documents are left out, toxic ones changed, and fixed ones differ in every way."""
    labels = K.table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    u = K._units(spark, d)
    shown = u.join(labels, F.col("ord") == F.col("doc_id"), "left").where("coalesce(quality, 1) = 1").select("unit_id", F.when(F.col("toxic") == 1, F.concat("content", F.lit(" more"))).otherwise(F.col("content")).alias("content"))
    return V.reconcile_units(u.select("unit_id", "content").unionByName(EXPECTED.df(spark)), shown.unionByName(RENDERED.df(spark)))


@query("""WITH e AS (SELECT source || ' / ' || lang AS ref, count(*) AS e FROM documents GROUP BY 1), r AS (SELECT source || ' / ' || lang AS ref, count(*) AS r FROM (SELECT source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) UNION ALL SELECT source, lang FROM documents WHERE length(text) < 200 UNION ALL SELECT 'none', 'xx') GROUP BY 1),
 b AS (SELECT ref, coalesce(e, 0) AS e, coalesce(r, 0) AS r FROM e FULL JOIN r USING (ref)), x AS (SELECT unnest([CASE WHEN r < e THEN 'missing_ref' END, CASE WHEN r > e THEN 'extra_ref' END, CASE WHEN r > e AND e > 0 THEN 'duplicate_ref' END]) AS reason, ref AS id FROM b) SELECT * FROM x WHERE reason IS NOT NULL""")
def ref_reconciliation(spark, d):
    """References of documents as multisets against those without poor ones, with short ones twice and one of its own."""
    docs = K._docs(spark, d)
    ref = F.concat_ws(" / ", "source", "lang").alias("ref")
    poor = K.table(spark, d, "labels").where("quality = 0").select("doc_id").distinct()
    shown = docs.join(poor, "doc_id", "left_anti").select(ref).unionByName(docs.where(F.length("text") < 200).select(ref)).unionByName(spark.createDataFrame([("none / xx",)], "ref string"))
    return V.reconcile_refs(docs.select(ref), shown)


@query("""WITH s AS (SELECT substr(sha256(text), 1, 12) AS source_id, sha256(text) AS sha256, doc_id FROM documents), e AS (SELECT source_id, count(*) AS en, max(sha256) AS eh FROM s GROUP BY 1),
 d AS (SELECT source_id, count(*) AS dn, max(CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'changed' ELSE sha256 END) AS dh FROM s WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY 1),
 x AS (SELECT unnest([CASE WHEN dn IS NULL THEN 'missing_source' END, CASE WHEN en IS NULL THEN 'extra_source' END, CASE WHEN en > 1 OR dn > 1 THEN 'duplicate_source' END, CASE WHEN en IS NOT NULL AND dn IS NOT NULL AND eh IS DISTINCT FROM dh THEN 'hash_mismatch' END]) AS reason, source_id AS id FROM e FULL JOIN d USING (source_id)) SELECT * FROM x WHERE reason IS NOT NULL""")
def source_reconciliation(spark, d):
    """Sources of documents against a ledger without poor ones and with other hashes for toxic ones."""
    labels = K.table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = K._docs(spark, d).select("doc_id", T.source_id(F.col("text")).alias("source_id"), F.sha2("text", 256).alias("sha256")).join(labels, "doc_id", "left")
    ledger = docs.where("coalesce(quality, 1) = 1").select("source_id", F.when(F.col("toxic") == 1, "changed").otherwise(F.col("sha256")).alias("sha256"))
    return V.reconcile_sources(docs.select("source_id", "sha256"), ledger)


@query(f"""WITH {O._BLOCKS}, q AS (SELECT lang AS source, {O._words('text')} AS words, trim(regexp_replace({O.casefold('text')}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS norm FROM blk), g AS (SELECT source, sha256(norm) AS quote_sha256, count(*) AS n, sum(words)::BIGINT AS words FROM q WHERE norm <> '' GROUP BY source, norm HAVING count(*) >= 2)
 SELECT source, quote_sha256, n, words, CASE WHEN words > 40 THEN 'duplicate_quote_too_long' ELSE 'duplicate_long_quote' END AS code FROM g WHERE words > 25""")
def duplicate_quote_findings(spark, d):
    """Quotes that a source repeats until they add up to more than a cap."""
    from sedimark.operators import blocks as B

    q = B.blocks(K._docs(spark, d)).select(F.col("lang").alias("source"), F.col("block_id").alias("location"), F.col("text").alias("quote"))
    g = R.exact_groups(q).where("words > 25")
    return g.select("source", "quote_sha256", "n", "words", F.when(F.col("words") > 40, "duplicate_quote_too_long").otherwise("duplicate_long_quote").alias("code"))


# A pack and what is approved for it.
BASE = Rows("canonical_key string, sha256 string, scope array<string>, sources array<string>", (("b1", "h1", ["x"], ["s1"]), ("b2", "h2", ["x"], ["s1"]), ("b3", "h3", [], [])))
APPROVED = Rows("canonical_key string, ord bigint, sha256 string, scope array<string>, sources array<string>", (("b1", -5, "h1", ["y", "x"], ["s2"]), ("b1", -4, "h1", ["z"], ["s1"]), ("b2", -3, "h9", ["q"], ["s3"]), ("n1", -2, "h4", ["x"], ["s1"]), ("n1", -1, "h4", ["w"], [])))


@query(f"""WITH a AS (SELECT substr(sha256(text), 1, 3) AS canonical_key, doc_id + 10 AS ord, sha256(text) AS sha256, [source] AS scope, [lang] AS sources FROM documents UNION ALL SELECT canonical_key, ord + 10, sha256, scope, sources FROM ({APPROVED.sql()})),
 r AS (SELECT canonical_key, -1 AS ord, sha256, scope, sources FROM ({BASE.sql()}) UNION ALL SELECT * FROM a), f AS (SELECT canonical_key, min(ord) AS fo, arg_min(sha256, ord) AS fh FROM r GROUP BY 1), m AS (SELECT r.*, fo, fh FROM r JOIN f USING (canonical_key)),
 s AS (SELECT canonical_key, list(v ORDER BY o, i) AS scope FROM (SELECT canonical_key, v, arg_min(i, (ord, i)) AS i, min(ord) AS o FROM (SELECT canonical_key, ord, unnest(scope) AS v, generate_subscripts(scope, 1) AS i FROM m WHERE sha256 = fh) GROUP BY 1, 2) GROUP BY 1),
 p AS (SELECT canonical_key, list(v ORDER BY o, i) AS sources FROM (SELECT canonical_key, v, arg_min(i, (ord, i)) AS i, min(ord) AS o FROM (SELECT canonical_key, ord, unnest(sources) AS v, generate_subscripts(sources, 1) AS i FROM m WHERE sha256 = fh) GROUP BY 1, 2) GROUP BY 1),
 g AS (SELECT canonical_key, fh AS sha256, fo, count(*) FILTER (WHERE sha256 = fh AND ord > fo) AS more, count(*) FILTER (WHERE sha256 <> fh) AS other FROM m GROUP BY ALL)
 SELECT canonical_key, sha256, coalesce(array_to_string(scope, ','), '') AS scope, coalesce(array_to_string(sources, ','), '') AS sources, CASE WHEN other > 0 THEN 'conflict' WHEN more > 0 THEN 'unite' WHEN fo < 0 THEN 'keep' ELSE 'insert' END AS action FROM g LEFT JOIN s USING (canonical_key) LEFT JOIN p USING (canonical_key)""")
def pack_release(spark, d):
    """A pack with approved assets put in: documents under keys made of a hash, and fixed ones."""
    t = F.sha2("text", 256)
    docs = K._docs(spark, d).select(F.left(t, F.lit(3)).alias("canonical_key"), (F.col("doc_id") + 10).alias("ord"), t.alias("sha256"), F.array("source").alias("scope"), F.array("lang").alias("sources"))
    rows = V.pack_release(BASE.df(spark), docs.unionByName(APPROVED.df(spark).withColumn("ord", F.col("ord") + 10)))
    return rows.withColumn("scope", F.array_join("scope", ",")).withColumn("sources", F.array_join("sources", ","))


# Manifests and inventories that differ.
SUPPLIED = Rows("source_id string, version bigint, sha256 string", (("m1", 1, "h"), ("m2", 1, "h"), ("m2", 1, "h"), ("m3", 2, "h"), ("m5", 1, "x")))
VERIFIED = Rows("source_id string, version bigint, sha256 string", (("m1", 1, "h"), ("m2", 1, "h"), ("m3", 1, "h"), ("m4", 1, "h"), ("m5", 1, "h")))


@query(f"""WITH a AS ({SUPPLIED.sql()} UNION ALL SELECT left(sha256(text), 12), doc_id % 2, sha256(text) FROM documents), b AS ({VERIFIED.sql()} UNION ALL SELECT DISTINCT left(sha256(text), 12), 0, sha256(text) FROM documents WHERE doc_id % 5 <> 0) SELECT 'repeated' AS reason, source_id FROM a GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'missing', source_id FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'extra', source_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def manifest_differences(spark, d):
    """Supplied manifests against verified ones."""
    digest = F.sha2("text", 256)
    rows = K.table(spark, d, "documents").select("doc_id", F.left(digest, F.lit(12)).alias("source_id"), digest.alias("sha256"))
    supplied = rows.select("source_id", (F.col("doc_id") % 2).alias("version"), "sha256")
    verified = rows.where("doc_id % 5 <> 0").select("source_id", F.lit(0).cast("bigint").alias("version"), "sha256").distinct()
    return V.manifest_differences(SUPPLIED.df(spark).unionByName(supplied), VERIFIED.df(spark).unionByName(verified))


# Lines of an inventory that do not fit.
LISTED = Rows("path string, sha256 string", (("p1", "AA"), ("p1", "aa"), ("p2", "bb"), ("p4", "cc")))
MEMBERS = Rows("path string, sha256 string", (("p1", "aa"), ("p2", "xx"), ("p3", "yy")))


@query(f"""WITH i AS (SELECT 'd' || doc_id AS path, upper(sha256(text)) AS sha256 FROM documents UNION ALL {LISTED.sql()}), m AS (SELECT 'd' || doc_id AS path, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN sha256(text || '!') ELSE sha256(text) END AS sha256 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) UNION ALL {MEMBERS.sql()}),
 n AS (SELECT path, lower(max(sha256)) AS want FROM i GROUP BY 1), x AS (SELECT CASE WHEN want IS NULL THEN 'unlisted' WHEN sha256 IS NULL THEN 'unknown' WHEN want <> sha256 THEN 'mismatch' END AS reason, path FROM n FULL JOIN m USING (path))
 SELECT * FROM x WHERE reason IS NOT NULL UNION ALL SELECT 'repeated', path FROM i GROUP BY 2 HAVING count(*) > 1""")
def inventory_faults(spark, d):
    """An inventory of documents against members without poor ones and with toxic ones changed, and fixed lines."""
    labels = K.table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = K._docs(spark, d).select("doc_id", "text").join(labels, "doc_id", "left").withColumn("path", F.concat(F.lit("d"), "doc_id"))
    have = docs.where("coalesce(quality, 1) = 1").select("path", F.sha2(F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return V.inventory_faults(docs.select("path", F.upper(F.sha2("text", 256)).alias("sha256")).unionByName(LISTED.df(spark)), have.unionByName(MEMBERS.df(spark)))


@query(f"WITH {O._ROLLUP} SELECT CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'pass_with_warnings' ELSE 'pass' END AS status, count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status = 'warn') AS warned, count(*) FILTER (WHERE status = 'pass') AS passed FROM roll")
def report_status(spark, d):
    """The status of the report on all checks."""
    return V.report_status(C.worst_by_check(K._findings(spark, d)))


@query(f"""WITH {O._UNITS}, dc AS (SELECT DISTINCT substr(sha256(text), 1, 12) AS s FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)), c AS (SELECT unit_id, bool_or(source_id IN (SELECT s FROM dc) AND length(content) >= 12) AS ok FROM units GROUP BY 1)
 SELECT (SELECT count(*) FROM dc) AS sources, count(*) AS candidates, count(*) FILTER (WHERE ok) AS supported, 0::BIGINT AS duplicate_ids, count(*) FILTER (WHERE NOT ok) AS unsupported, count(*) FILTER (WHERE ok) / count(*) AS coverage FROM c""")
def bundle_ratios(spark, d):
    """Metrics of the bundle of all units whose poor documents are not declared and whose short units name no block."""
    poor = K.table(spark, d, "labels").where("quality = 0").select("doc_id").distinct()
    declared = K._docs(spark, d).join(poor, "doc_id", "left_anti").select(T.source_id(F.col("text")).alias("source_id"))
    units = K._units(spark, d).select(F.col("unit_id").alias("row"), "unit_id", "source_id", F.when(F.length("content") >= 12, F.col("block_id")).alias("block_id"))
    return V.bundle_metrics(declared, units)


@query(f"""WITH {O._LITERALS}, ln AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM texts),
 c AS (SELECT id, line_no, unnest([CASE WHEN regexp_matches(line, {sql_value(O._INJECTION)}) OR regexp_matches(line, {sql_value(O._INJECTION_ZH)}) THEN 'phrase' END, CASE WHEN regexp_matches(line, '{T.ZERO_WIDTH}') THEN 'zero_width' END, CASE WHEN regexp_matches(line, '{T.DIRECTIONAL}') THEN 'directional' END, CASE WHEN regexp_matches(line, '{T.CONTROL}') THEN 'control' END]) AS code FROM ln)
 SELECT code, count(*) AS lines, count(DISTINCT id) AS texts FROM c WHERE code IS NOT NULL GROUP BY 1""")
def injection_tally(spark, d):
    """How many lines and texts carry each kind of injection finding, once a line and kind."""
    found = C.line_findings(C.split_lines(K._with_literals(spark, d).where(T.suspicious(F.col("text")))))
    code = F.when(F.col("code").startswith("injection"), "phrase").otherwise(F.regexp_replace("code", "^hidden\\.", ""))
    return found.select("id", "line_no", code.alias("code")).distinct().groupBy("code").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("id").alias("texts"))


# Quotes of one source that are nearly, reordered or exactly the same.
QUOTES = Rows("id string, source string, quote string", (
    ("q1", "s", "the plan for the week is written on monday and read again on friday by all of the team"), ("q2", "s", "The plan for the week is written on Monday, and read again on Friday by all of the teams!"), ("q3", "s", "the plan for the week is written on monday and read again on friday by all of the team."),
    ("q4", "s", "read again on friday by all of the team and the plan for the week is written on monday"), ("q5", "t", "the plan for the week is written on monday and read again on friday by all of the teams"), ("q6", "s", "too short to count at all"), ("q7", "s", "计划写在星期一并在星期五由所有人再读一遍然后归档"), ("q8", "s", "计划写在星期一并在星期五由所有人再读一遍然后存档")))


@query(None)
def quote_ratio_pairs(spark, d):
    """Quotes of each document, and fixed ones, that are nearly the same: pairs by the ratio of matching blocks, and reordered ones by phrases that are not among these."""
    from sedimark.operators import blocks as B

    b = B.blocks(K._docs(spark, d)).select(F.col("block_id").alias("id"), F.col("source_id").alias("source"), F.col("text").alias("quote")).unionByName(QUOTES.df(spark))
    return R.near_quotes(b.withColumn("words", T.effective_words(F.col("quote"))))
