"""Queries of traces, packs, dependencies, constraints and file rules, each with its SQL.

Entities are those of the catalogue; fixed rows stand for the cases that the driver's tables lack.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedimark.functions import semver
from sedimark.functions import text as T
from sedimark.operators import blocks as B
from sedimark.operators import checks as C
from sedimark.operators import dependencies as D
from sedimark.operators import governance as G
from sedimark.operators import relate as R
from sedimark.operators import telemetry as M
from sedimark.operators.ordered import numbered
from sedimark.sources import formats, readers
from sedimark.sources.scratch import fresh_path, remove_on_exit, staged

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


# --- traces ---------------------------------------------------------------------------------------------------------------------

# One case for each fault of a trace.
DECLARED = Rows("source_id string, ord bigint", (("s-twice", -9), ("s-twice", -8), ("s-absent", -7), ("s-other", -6), ("s-mixed", -5), ("s-good", -4)))
REFS = Rows("unit_id string, ord bigint, ref_index bigint, source_id string, block_id string", (("u1", -9, 0, "", "b"), ("u1", -9, 1, None, "b"), ("u2", -8, 0, "s-good", None), ("u3", -7, 0, "s-none", "b1"), ("u4", -6, 0, "s-good", "b1"), ("u5", -5, 0, "s-good", "b9"), ("u6", -4, 0, "s-absent", "b1")))
MANIFESTS = Rows("stored_as string, stored_version bigint, source_id string, version bigint", (("s-twice", 1, "s-twice", 1), ("s-other", 1, "s-else", 1), ("s-mixed", 1, "s-mixed", 2), ("s-good", 1, "s-good", 1), ("s-absent", 2, "s-absent", 2)))
BLOCKS = Rows("stored_as string, nth bigint, source_id string, block_id string", (("s-good", 1, "s-good", "b1"), ("s-good", 2, "s-good", "b2"), ("s-good", 3, "s-good", "b2"), ("s-mixed", 1, "s-good", "b1")))


def _trace(spark, d):
    """Documents of poor quality are not declared, toxic ones not stored, and blocks under 12 characters not in the maps."""
    labels = K.table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    sources = B.sources(K._docs(spark, d)).join(labels, F.col("ord") == F.col("doc_id"), "left").select("source_id", "ord", F.coalesce("quality", F.lit(1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    sources = staged(sources, "sources")
    units = K._units(spark, d).select("unit_id", "ord", F.lit(0).cast("long").alias("ref_index"), "source_id", "block_id", "block_ord", F.length("content").alias("n"))
    declared = sources.where("quality = 1").select("source_id", "ord").unionByName(DECLARED.df(spark))
    refs = units.select("unit_id", "ord", "ref_index", "source_id", "block_id").unionByName(REFS.df(spark))
    manifests = sources.where("toxic = 0").select(F.col("source_id").alias("stored_as"), F.lit(1).cast("long").alias("stored_version"), "source_id", F.lit(1).cast("long").alias("version")).unionByName(MANIFESTS.df(spark))
    maps = units.where("n >= 12").select(F.col("source_id").alias("stored_as"), F.col("block_ord").alias("nth"), "source_id", "block_id").unionByName(BLOCKS.df(spark))
    return G.trace_violations(declared, refs, manifests, maps)


_TRACE = f"""WITH {O._UNITS}, lab AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
 srcs AS (SELECT source_id, ord, coalesce(quality, 1) AS quality, coalesce(toxic, 0) AS toxic FROM src LEFT JOIN lab ON doc_id = ord),
 declared AS (SELECT source_id, ord FROM srcs WHERE quality = 1 UNION ALL {DECLARED.sql()}), refs AS (SELECT unit_id, ord, 0::BIGINT AS ref_index, source_id, block_id FROM units UNION ALL {REFS.sql()}),
 manifests AS (SELECT source_id AS stored_as, 1 AS stored_version, source_id, 1 AS version FROM srcs WHERE toxic = 0 UNION ALL {MANIFESTS.sql()}),
 maps AS (SELECT source_id AS stored_as, block_ord AS nth, source_id, block_id FROM units WHERE length(content) >= 12 UNION ALL {BLOCKS.sql()}),
 once AS (SELECT source_id AS s, min(ord) AS o, count(*) AS n FROM declared GROUP BY 1), st AS (SELECT * FROM once LEFT JOIN manifests ON stored_as = s AND stored_version = 1), there AS (SELECT s, o FROM st WHERE stored_as IS NOT NULL),
 m AS (SELECT maps.*, s, o, row_number() OVER (PARTITION BY stored_as, block_id ORDER BY nth) AS again FROM maps JOIN there ON stored_as = s),
 r AS (SELECT refs.*, s IS NOT NULL AS known, source_id IS NULL OR source_id = '' OR block_id IS NULL OR block_id = '' AS invalid FROM refs LEFT JOIN once ON source_id = s),
 v AS (SELECT 1 AS phase, o AS ord, 0::BIGINT AS nth, 'duplicate_source_ids' AS reason, NULL::VARCHAR AS unit_id, s AS source_id, NULL::VARCHAR AS block_id FROM once WHERE n > 1
  UNION ALL SELECT 2, ord, ref_index, CASE WHEN invalid THEN 'invalid_source_ref' ELSE 'undeclared_source' END, unit_id, source_id, block_id FROM r WHERE invalid OR NOT known
  UNION ALL SELECT 3, o, 0, 'raw_version_missing', NULL, s, NULL FROM st WHERE stored_as IS NULL UNION ALL SELECT 3, o, 0, 'manifest_identity_mismatch', NULL, s, NULL FROM st WHERE source_id <> stored_as OR version <> 1
  UNION ALL SELECT 3, o, nth, 'block_source_mismatch', NULL, s, block_id FROM m WHERE source_id <> stored_as
  UNION ALL SELECT 3, o, nth, 'duplicate_raw_block_id', NULL, s, block_id FROM m WHERE source_id = stored_as AND again > 1
  UNION ALL SELECT 4, r.ord, r.ref_index, 'raw_block_missing', r.unit_id, r.source_id, r.block_id FROM r JOIN there ON r.source_id = there.s WHERE NOT invalid AND NOT EXISTS (SELECT 1 FROM m WHERE m.stored_as = r.source_id AND m.block_id = r.block_id))"""


@query(f"{_TRACE} SELECT * FROM v")
def trace_violations(spark, d):
    """All faults that keep units from being traced, with their reason codes."""
    return _trace(spark, d)


@query(f"{_TRACE} SELECT (SELECT count(*) FROM v) AS violations, reason, unit_id, source_id, block_id FROM v ORDER BY phase, ord, nth LIMIT 1")
def trace_verdict(spark, d):
    """The fault at which a check that stops at the first one ends."""
    return G.first_violation(_trace(spark, d))


# --- conflicts and quotes -------------------------------------------------------------------------------------------------------

# Units that agree, disagree and negate each other.
OPINIONS = Rows("id bigint, kind string, content string", (
    (-9, "principle", "Always write the failing test before the code"), (-8, "anti_pattern", "Write the code before the failing test"), (-7, "principle", "Never write code without a test"), (-6, "principle", "avoid long meetings"),
    (-5, "anti_pattern", "unrelated words entirely"), (-4, "principle", "Take note of every meeting"), (-3, "principle", "Avoid LONG meetings!"), (-2, "term", "a test is not a proof"), (-1, "principle", "")))
_MARKERS = "|".join(R.NEGATION_MARKERS)
_OPINIONS = f"""ops AS (SELECT item_id AS id, CASE WHEN length(text) % 2 = 0 THEN 'principle' ELSE 'anti_pattern' END AS kind, text AS content FROM benchmark UNION ALL {OPINIONS.sql()}),
 sets AS (SELECT id, kind, list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+')) AS items, regexp_matches(lower(content), {sql_value(_MARKERS)}) AS negated FROM ops WHERE kind IN ('principle', 'anti_pattern')),
 tok AS (SELECT id, kind, negated, len(items) AS n, unnest(items) AS t FROM sets),
 met AS (SELECT a.id AS a, b.id AS b, a.kind AS ka, b.kind AS kb, a.negated OR b.negated AS negated, a.n AS na, b.n AS nb, count(*) AS shared FROM tok a JOIN tok b ON a.t = b.t AND a.id < b.id GROUP BY ALL),
 found AS (SELECT a, b FROM met WHERE ka <> kb AND shared >= 0.34 * (na + nb - shared) - 1e-9 UNION SELECT a, b FROM met WHERE ka = 'principle' AND kb = 'principle' AND negated AND NOT (shared = na AND shared = nb))"""


@query(f"WITH {_OPINIONS} SELECT row_number() OVER (ORDER BY a, b) - 1 AS conflict_no, a, b FROM found")
def detected_conflicts(spark, d):
    """Conflicts of benchmark items as principles and anti-patterns, and of fixed ones, numbered in order of their pairs."""
    kind = F.when(F.pmod(F.length("text"), F.lit(2)) == 0, "principle").otherwise("anti_pattern")
    units = K.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), kind.alias("kind"), F.col("text").alias("content")).unionByName(OPINIONS.df(spark))
    return R.numbered_conflicts(units)


# Suggestions that overlap or do not.
SUGGESTED = Rows("id bigint, text string", ((-5, "Plan the week ahead of time"), (-4, "plan the WEEK ahead of the time"), (-3, "写代码 plan"), (-2, "写代码 PLAN"), (-1, "!!!")))


_MARKED = " OR ".join(f"contains(lower(content), {sql_value(m)})" for m in R.NEGATION_MARKERS)


@query(f"""WITH {O._UNITS}, u AS MATERIALIZED (SELECT unit_id AS id, {_MARKED} AS negated, list_sort(list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+'))) AS items FROM units WHERE lang = 'en' OR kind = 'principle'),
 p AS MATERIALIZED (SELECT id, negated, sha256(array_to_string(items, ' ')) AS class_id, items FROM u), t AS (SELECT id, negated, class_id, unnest(items) AS token FROM p),
 hit AS (SELECT DISTINCT a.id, b.id AS other FROM t a JOIN t b ON a.token = b.token AND a.class_id <> b.class_id AND (a.negated OR b.negated)), n AS (SELECT id, count(*) AS links FROM hit GROUP BY 1)
 SELECT class_id, negated, count(*) AS members, coalesce(any_value(links), 0)::BIGINT AS links FROM p LEFT JOIN n USING (id) GROUP BY 1, 2""")
def conflict_links(spark, d):
    """With how many others each class of equal lines is in conflict by negation: English lines of documents as principles."""
    units = K._units(spark, d).where("lang = 'en' or kind = 'principle'").select(F.col("unit_id").alias("id"), F.lit("principle").alias("kind"), "content")
    return R.negated_links(units)


@query(O._pairs(f"SELECT id, 0 AS g, list_distinct(regexp_extract_all({O.casefold('text')}, '[\\p{{L}}\\p{{N}}_]+')) AS items FROM (SELECT item_id AS id, text FROM benchmark UNION ALL {SUGGESTED.sql()})", 0.6, ""))
def suggestion_overlaps(spark, d):
    """Suggestions whose words overlap by 0.6 or more: benchmark items and fixed ones."""
    rows = K.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text").unionByName(SUGGESTED.df(spark))
    words = F.array_distinct(F.regexp_extract_all(T.casefold(F.col("text")), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    return R.similar_pairs(rows.select("id", words.alias("items")), 0.6)


# A reference file with citations in every form.
REFERENCE = Rows("path string, text string", (("references/x.md", '## cu-1\n- src1 / src1-p1 — "a short quote"\n- src1 / src1-p2 — ""\n  -  src2/src2-b3   —  "two words"  \n- src3 / b4\n- no slash — "x"\n- src1 / src1-p9 — "' + "many words " * 30 + '"\n- src1 / src1-p10 — "' + "more words " * 15 + '"'),))
_CITES = r'^\s*-\s+([^\s/]+)\s*/\s*(\S+)\s+—\s+"(.+)"\s*$'
_REFERENCES = f"""{O._UNITS}, refs AS (SELECT 'references/' || unit_id || '.md' AS path, '- ' || source_id || ' / ' || block_id || ' — "' || content || '"' AS text FROM units UNION ALL {REFERENCE.sql()}),
 ln AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM refs),
 q AS (SELECT path, line_no::BIGINT AS line_no, regexp_extract(line, {sql_value(_CITES)}, 1) AS source_id, regexp_extract(line, {sql_value(_CITES)}, 2) AS block_id, regexp_extract(line, {sql_value(_CITES)}, 3) AS quote FROM ln WHERE regexp_matches(line, {sql_value(_CITES)}))"""


def _quotes(spark, d):
    line = F.concat(F.lit("- "), "source_id", F.lit(" / "), "block_id", F.lit(' — "'), "content", F.lit('"'))
    files = K._units(spark, d).select(F.concat(F.lit("references/"), "unit_id", F.lit(".md")).alias("path"), line.alias("text")).unionByName(REFERENCE.df(spark))
    return C.quotes(files)


@query(f"WITH {_REFERENCES} SELECT path, line_no, source_id, block_id, sha256(quote) AS quote_sha256, {O._words('quote')} AS words, CASE WHEN {O._words('quote')} > 40 THEN 'quote_too_long' WHEN {O._words('quote')} > 25 THEN 'long_quote' END AS code FROM q")
def quote_findings(spark, d):
    """Quotes of rendered references and of a fixed file, with the findings of the caps."""
    code = F.when(F.col("words") > 40, "quote_too_long").when(F.col("words") > 25, "long_quote")
    return _quotes(spark, d).select("path", "line_no", "source_id", "block_id", F.sha2("quote", 256).alias("quote_sha256"), "words", code.alias("code"))


_QUOTED = f"""docs AS (SELECT doc_id, source, text, {O._words('text')} AS words, trim(regexp_replace({O.casefold('text')}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS norm, regexp_extract_all({O.casefold('text')}, '[a-z0-9]+|[\\x{{3400}}-\\x{{9FFF}}]') AS w FROM documents),
 sets AS (SELECT doc_id AS id, source AS g, norm, list_distinct([w[i] || '␟' || w[i + 1] || '␟' || w[i + 2] for i in range(1, len(w) - 1)]) AS items FROM docs WHERE words >= 12),
 tok AS (SELECT id, g, norm, len(items) AS n, unnest(items) AS t FROM sets), hit AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM tok a JOIN tok b ON a.g = b.g AND a.t = b.t AND a.id < b.id AND a.norm <> b.norm GROUP BY ALL)"""


@query(f'WITH {_QUOTED} SELECT a, b, shared, na + nb - shared AS "union" FROM hit WHERE shared >= 0.8 * (na + nb - shared) - 1e-9')
def quote_fingerprint_pairs(spark, d):
    """Reordered quotes of one source: documents of twelve words or more whose phrases of three tokens agree to 0.8 and that are not equal once normalized."""
    docs = K._docs(spark, d).select(F.col("doc_id").alias("id"), "source", F.col("text").alias("quote"), T.effective_words(F.col("text")).alias("words"))
    return R.quote_pairs(docs)


@query(f"""WITH {O._LITERALS}, every AS (SELECT * FROM texts UNION ALL {O._CLAIM_LINES}), ln AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM every),
 c AS (SELECT id, line_no, unnest({O._CLAIM_CODES}) AS code FROM ln) SELECT id, line_no, code, count(*) AS n FROM c GROUP BY ALL""")
def claim_counts(spark, d):
    """How many claims without a negation each line makes, by code."""
    docs = K._with_literals(spark, d).unionByName(spark.createDataFrame([(-20, "\n".join(K.CLAIM_LINES))], "id bigint, text string"))
    found = C.split_lines(docs).select("id", "line_no", F.explode(T.claim_codes(F.col("line"))).alias("c"))
    return found.groupBy("id", "line_no", "c.code").agg(F.count(F.lit(1)).alias("n"))


# Messages with credentials and paths.
MESSAGES = Rows("doc_id bigint, text string", ((-3, "open C:\\Users\\x\\f.txt and /var/log/app.log, then"), (-2, "used Key-abcdef123 and sk_live.9876 but token-ab"), (-1, 'quoted "/tmp/a b" end')))


@query(f"""WITH m AS (SELECT doc_id, text FROM documents UNION ALL {MESSAGES.sql()}), r AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, {sql_value(T.SECRET_VALUE)}, '[REDACTED]', 'g'), {sql_value(T.ABSOLUTE_PATH)}, '[PATH]', 'g') AS t FROM m)
 SELECT doc_id, sha256(t) AS sha256, t <> text AS changed FROM r""")
def redacted_texts(spark, d):
    """Texts without credentials and absolute paths."""
    rows = K._docs(spark, d).select("doc_id", "text").unionByName(MESSAGES.df(spark))
    return rows.select("doc_id", F.sha2(T.redacted(F.col("text")), 256).alias("sha256"), (T.redacted(F.col("text")) != F.col("text")).alias("changed"))


# --- slots ----------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {O._UNITS}, w AS (SELECT item_id AS slot_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 6)) AS k FROM benchmark),
 keys AS (SELECT slot_id, unnest(k) AS word FROM w), words AS (SELECT DISTINCT word FROM keys), low AS (SELECT unit_id, kind, heading_level, lower(content) AS c FROM units),
 hit AS (SELECT word, unit_id, kind, heading_level FROM low JOIN words ON contains(c, word)),
 own AS (SELECT slot_id, count(DISTINCT unit_id) FILTER (WHERE kind IN ('technique', 'term', 'case')) AS n, count(DISTINCT unit_id) FILTER (WHERE heading_level > 0 AND length(word) >= 8) AS s FROM keys JOIN hit USING (word) GROUP BY 1)
 SELECT item_id AS slot_id, coalesce(greatest(n, s), 0)::BIGINT AS matched FROM benchmark LEFT JOIN own ON slot_id = item_id""")
def slot_coverage(spark, d):
    """Slots of benchmark items with all their words of six letters or more as keywords, those of eight or more for headings."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.length(w) >= 6))
    slots = K.table(spark, d, "benchmark").select(F.col("item_id").alias("slot_id"), words.alias("keywords"), F.filter(words, lambda w: F.length(w) >= 8).alias("structure_keywords"))
    units = staged(K._units(spark, d).select("kind", "content", "heading_level"), "units")
    return C.slot_coverage(units, slots, ("technique", "term", "case"), units.where("heading_level > 0").select(F.col("content").alias("t")))


# --- packs, dependencies, versions ----------------------------------------------------------------------------------------------

# Assets of a published pack and candidates that meet each other in order.
PACK = Rows("canonical_key string, ord bigint, sha256 string, scope array<string>", (("k1", 1, "h1", ["Planning"]), ("k2", 2, "h2", ["a"]), ("k2", 3, "h3", ["b"])))
CANDIDATES = Rows("canonical_key string, ord bigint, sha256 string, scope array<string>", (
    ("k1", -9, "h2", [" planning "]), ("k1", -8, "h3", ["other"]), ("k1", -7, "h2", ["other"]), ("k1", -6, "h1", ["x"]), ("k1", -5, "h4", ["OTHER"]), ("k2", -4, "h3", ["c"]), ("k2", -3, "h9", ["C "]), ("k3", -2, "h1", []), ("k3", -1, "h5", [])))
_PACK = f"""cand AS (SELECT substr(sha256(text), 1, 3) AS canonical_key, doc_id AS ord, sha256(text) AS sha256, [source, ' ' || upper(lang)] AS scope FROM documents UNION ALL {CANDIDATES.sql()}),
 every AS (SELECT canonical_key, true AS known, ord, sha256, scope FROM ({PACK.sql()}) UNION ALL SELECT canonical_key, false, ord, sha256, scope FROM cand),
 line AS MATERIALIZED (SELECT canonical_key, known, ord, sha256, list_transform(scope, lambda s: lower(trim(s))) AS scope, row_number() OVER (PARTITION BY canonical_key ORDER BY known DESC, ord) AS nth FROM every),
 walk AS (SELECT canonical_key, known, ord, nth, [{{'h': sha256, 's': scope}}] AS seen, 'new' AS relation, NULL::VARCHAR AS existing FROM line WHERE nth = 1
  UNION ALL SELECT l.canonical_key, l.known, l.ord, l.nth, CASE WHEN NOT l.known AND len(list_filter(w.seen, lambda x: x.h = l.sha256)) > 0 THEN [{{'h': l.sha256, 's': list_concat(list_filter(w.seen, lambda x: x.h = l.sha256)[1].s, l.scope)}}] ELSE list_append(w.seen, {{'h': l.sha256, 's': l.scope}}) END,
   CASE WHEN len(list_filter(w.seen, lambda x: x.h = l.sha256)) > 0 THEN 'duplicate' WHEN list_has_any(w.seen[1].s, l.scope) THEN 'overlapping' ELSE 'disjoint' END, CASE WHEN len(list_filter(w.seen, lambda x: x.h = l.sha256)) > 0 THEN l.sha256 ELSE w.seen[1].h END
  FROM walk w JOIN line l ON l.canonical_key = w.canonical_key AND l.nth = w.nth + 1)"""


@query(f"""WITH RECURSIVE {_PACK} SELECT canonical_key, ord, relation, CASE relation WHEN 'new' THEN 'add' WHEN 'duplicate' THEN 'merge' WHEN 'overlapping' THEN 'conflict_review' ELSE 'coexist_review' END AS disposition, existing AS existing_sha256 FROM walk WHERE NOT known""")
def pack_governance(spark, d):
    """Documents as candidates for keys made of a hash, and fixed ones, against a pack."""
    t = F.sha2("text", 256)
    docs = K._docs(spark, d).select(F.substring(t, 1, 3).alias("canonical_key"), F.col("doc_id").alias("ord"), t.alias("sha256"), F.array("source", F.concat(F.lit(" "), F.upper("lang"))).alias("scope"))
    return G.pack_decisions(PACK.df(spark), docs.unionByName(CANDIDATES.df(spark)))


# Extensions and what they need.
EXTENSIONS = Rows("extension_id string, version string", (("app", "1.2.0"), ("base", "2.0.1"), ("core", "2.1.0-rc.1"), ("log", "0.9.0"), ("loop-a", "1.0.0"), ("loop-b", "1.0.0"), ("on-loop", "1.0.0"), ("self", "1.0.0"), ("ui", "3.0.0"), ("wide", "1.0.0")))
NEEDS = Rows("extension_id string, needed string, range string", (
    ("app", "core", ">=2.0.0,<3"), ("app", "ui", "3.x"), ("core", "base", "~=2.0.0"), ("ui", "base", ">2.0.1"), ("ui", "log", "*"), ("loop-a", "loop-b", ""), ("loop-b", "loop-a", ""), ("on-loop", "loop-a", "1.*"), ("self", "self", ""), ("wide", "nowhere", "1.0.0"), ("wide", "app", "=1.2.0")))
# Versions, and ranges to hold them against.
VERSIONS = Rows("version string", tuple((v,) for v in ("1.0.0", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-2", "1.0.0-11", "1.0.0+build.5", "1.10.0", "1.9.9", "2", "2.0.0-rc.1", "0.0.1", "01.2.3", "1.2.3.4", "v1.0.0", " 1.3 ")))
RANGES = Rows("range string", tuple((r,) for r in ("", "*", "1.x", "1.0.x", ">=1.0.0", ">=1.0.0,<2.0.0", "~=1.2.0", "<1.0.0", "==1.0.0", "=1.0.0-alpha", ">1.0.0-alpha.1, <=1.9.9", "1.10.0", ">=2.x", "<= 1.0.0-11")))


def _event_versions(spark, d):
    """The versions that events make up, and fixed ones."""
    e, n = K.table(spark, d, "events"), lambda x: x.cast("bigint").cast("string")
    tail = F.when(F.col("event_type") == "error", F.concat(F.lit("-rc."), n(F.col("event_id") % 12))).when(F.col("event_type") == "signup", F.lit("+b1")).otherwise("")
    made = F.concat(F.concat_ws(".", n(F.col("user_id") % 3), n(F.col("event_id") % 12), n(F.floor("value") % 4)), tail)
    return VERSIONS.df(spark).unionByName(e.select(made.alias("version"))).distinct()


_EVENT_VERSIONS = f"""({VERSIONS.sql()} UNION SELECT (user_id % 3)::VARCHAR || '.' || event_id % 12 || '.' || floor(value)::BIGINT % 4 || CASE event_type WHEN 'error' THEN '-rc.' || event_id % 12 WHEN 'signup' THEN '+b1' ELSE '' END FROM events)"""


def sql_key(t: str) -> str:
    """A version's key as an SQL struct, by the same order as semver.key."""
    part = lambda i: f"regexp_extract(trim({t}), {sql_value(semver.VERSION)}, {i})"
    number = lambda i: f"coalesce(try_cast(nullif({part(i)}, '') AS BIGINT), 0)"
    ids = f"list_transform(string_split({part(4)}, '.'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN '0' || lpad(x, 20, '0') ELSE '1' || x END)"
    return f"CASE WHEN regexp_matches(trim({t}), {sql_value(semver.VERSION)}) THEN struct_pack(a := {number(1)}, b := {number(2)}, c := {number(3)}, r := CASE WHEN {part(4)} = '' THEN '~' ELSE array_to_string({ids}, chr(1)) END) END"


def sql_satisfies(key: str, part: str) -> str:
    """Whether the version of a key satisfies one part of a range."""
    op, operand = (f"regexp_extract(trim({part}), {sql_value(semver.PART)}, {i})" for i in (1, 2))
    wild = lambda i: f"try_cast(nullif(list_filter(string_split(regexp_replace({operand}, '\\.[x*]$', ''), '.'), lambda x: regexp_full_match(x, '[0-9]+'))[{i}], '') AS BIGINT)"
    target = sql_key(operand)
    return f"""CASE WHEN trim({part}) = '' THEN true WHEN regexp_matches({operand}, '\\.[x*]$') THEN coalesce({key}.a = {wild(1)}, true) AND coalesce({key}.b = {wild(2)}, true)
 ELSE CASE {op} WHEN '>' THEN {key} > {target} WHEN '>=' THEN {key} >= {target} WHEN '<' THEN {key} < {target} WHEN '<=' THEN {key} <= {target}
  WHEN '~=' THEN {key} >= {target} AND ({key}.a < ({target}).a OR {key}.a = ({target}).a AND {key}.b < ({target}).b + 1) ELSE {key} = {target} END END"""


_IN_RANGE = lambda key, spec: f"trim({spec}) IN ('', '*') OR (SELECT bool_and({sql_satisfies(key, 'p')}) FROM (SELECT unnest(string_split({spec}, ',')) AS p))"


def _extensions(spark, d):
    """Documents as extensions that need others of their block of 64, some of them none that is there, one in another version, or each other; and fixed ones."""
    i = F.col("doc_id")
    docs = K.table(spark, d, "documents").select("doc_id").distinct()
    name = lambda x: F.concat(F.lit("d"), x.cast("bigint").cast("string"))
    ext = docs.select(name(i).alias("extension_id"), F.concat(F.lit("1."), (i % 10).cast("string"), F.lit(".0")).alias("version"))
    low, top = i % 64, i - i % 64
    need = lambda on, to, spec: F.when(on, F.struct(to.alias("needed"), F.lit(spec).alias("range")))
    each = F.array_compact(F.array(need((low > 0) & (i % 4 != 0), name(top + F.floor(low / 2)), ">=1.0.0,<2"), need((low > 0) & (i % 5 == 0), name(top + F.floor(low / 3)), "1.x"), need((i % 97 == 0) & (low < 63), name(i + 1), "*"), need((i % 97 == 1) & (low > 0), name(i - 1), ""), need(i % 61 == 0, name(top), "<1.0.0"), need(i % 83 == 0, F.concat(F.lit("gone"), low.cast("string")), "*")))
    needs = docs.select(name(i).alias("extension_id"), F.explode(each).alias("n")).select("extension_id", "n.*")
    return EXTENSIONS.df(spark).unionByName(ext), NEEDS.df(spark).unionByName(needs)


_DOC = lambda x: f"'d' || ({x})::BIGINT"
_GRAPH = f"""ext AS ({EXTENSIONS.sql()} UNION ALL SELECT DISTINCT 'd' || doc_id, '1.' || doc_id % 10 || '.0' FROM documents), i AS (SELECT DISTINCT doc_id AS i, doc_id % 64 AS low, doc_id - doc_id % 64 AS top FROM documents),
 needs AS ({NEEDS.sql()} UNION ALL SELECT 'd' || i, {_DOC('top + low // 2')}, '>=1.0.0,<2' FROM i WHERE low > 0 AND i % 4 <> 0 UNION ALL SELECT 'd' || i, {_DOC('top + low // 3')}, '1.x' FROM i WHERE low > 0 AND i % 5 = 0 UNION ALL SELECT 'd' || i, {_DOC('i + 1')}, '*' FROM i WHERE i % 97 = 0 AND low < 63
  UNION ALL SELECT 'd' || i, {_DOC('i - 1')}, '' FROM i WHERE i % 97 = 1 AND low > 0 UNION ALL SELECT 'd' || i, {_DOC('top')}, '<1.0.0' FROM i WHERE i % 61 = 0 UNION ALL SELECT 'd' || i, 'gone' || low, '*' FROM i WHERE i % 83 = 0),
 parts AS (SELECT n.*, e.version IS NOT NULL AS there, {sql_key('e.version')} AS k, unnest(string_split(n.range, ',')) AS part FROM needs n LEFT JOIN ext e ON e.extension_id = n.needed),
 checked AS MATERIALIZED (SELECT extension_id, needed, bool_and(there) AS there, bool_and(trim(range) IN ('', '*') OR {sql_satisfies('k', 'part')}) AS fits FROM parts WHERE extension_id IN (SELECT extension_id FROM ext) GROUP BY 1, 2),
 faults AS (SELECT extension_id, arg_min(CASE WHEN NOT there THEN 'missing:' || needed ELSE 'range:' || needed END, needed) AS fault FROM checked WHERE NOT there OR NOT fits GROUP BY 1),
 edge AS MATERIALIZED (SELECT extension_id AS a, needed AS b FROM checked WHERE there),
 reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
 loops AS MATERIALIZED (SELECT x.a AS id, min(x.b) AS cycle FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY 1),
 bad AS MATERIALIZED (SELECT extension_id AS id FROM faults UNION SELECT id FROM loops),
 fine AS MATERIALIZED (SELECT extension_id AS id, row_number() OVER (ORDER BY extension_id) AS nth FROM ext WHERE extension_id NOT IN (SELECT id FROM bad) AND extension_id NOT IN (SELECT a FROM reach WHERE b IN (SELECT id FROM bad))),
 deps AS MATERIALIZED (SELECT id, list(b ORDER BY b) FILTER (WHERE b IS NOT NULL) AS ds FROM fine LEFT JOIN edge ON a = id GROUP BY 1),
 walk AS (SELECT 0::BIGINT AS step, 1::BIGINT AS pos, []::VARCHAR[] AS stack, []::VARCHAR[] AS done
  UNION ALL SELECT step + 1, CASE WHEN pushed OR len(stack) > 0 THEN pos ELSE pos + 1 END, CASE WHEN nxt IS NOT NULL THEN list_append(stack, nxt) WHEN pushed THEN [root] WHEN len(stack) > 0 THEN stack[:-2] ELSE stack END, CASE WHEN len(stack) > 0 AND nxt IS NULL THEN list_append(done, stack[-1]) ELSE done END FROM (
   SELECT w.*, f.id AS root, len(stack) = 0 AND NOT list_contains(done, f.id) AS pushed, list_filter(d.ds, lambda x: NOT list_contains(w.done, x))[1] AS nxt FROM walk w LEFT JOIN fine f ON f.nth = w.pos LEFT JOIN deps d ON d.id = w.stack[-1] WHERE f.id IS NOT NULL OR len(stack) > 0)),
 placed AS (SELECT unnest(done) AS id, generate_subscripts(done, 1) - 1 AS place FROM (SELECT done FROM walk ORDER BY step DESC LIMIT 1))"""


@query(f"""WITH RECURSIVE {_GRAPH} SELECT e.extension_id, p.place, CASE WHEN fault IS NOT NULL THEN fault WHEN l.id IS NOT NULL THEN 'cycle' WHEN p.id IS NULL THEN 'behind' END AS problem, l.cycle FROM ext e LEFT JOIN placed p ON p.id = e.extension_id LEFT JOIN faults f ON f.extension_id = e.extension_id LEFT JOIN loops l ON l.id = e.extension_id""")
def install_order(spark, d):
    """The order in which extensions can be installed, depth first by id, and what keeps some from it."""
    return D.install_plan(*_extensions(spark, d))


@query(f"""WITH v AS {_EVENT_VERSIONS}, k AS (SELECT version, {sql_key('version')} AS k FROM v) SELECT version, k.a AS major, k.b AS minor, k.c AS patch, k IS NOT NULL AS valid, CASE WHEN k IS NOT NULL THEN dense_rank() OVER (PARTITION BY k IS NOT NULL ORDER BY k) END AS place FROM k""")
def version_order(spark, d):
    """Versions taken apart and in order; equal ones share a place."""
    k = _event_versions(spark, d).withColumn("k", semver.key(F.col("version")))
    places = numbered(k.where("k is not null").select("k").distinct(), [], ["k"], "place", 1)
    k = k.join(places, "k", "left")
    return k.select("version", "k.major", "k.minor", "k.patch", F.col("k").isNotNull().alias("valid"), "place")


_AVAILABLE = f"v AS (SELECT version, {sql_key('version')} AS k FROM {_EVENT_VERSIONS}), pairs AS (SELECT version, k, range, unnest(string_split(range, ',')) AS part FROM (SELECT unnest({sql_value([r[0] for r in RANGES.rows])}) AS range) r, v WHERE k IS NOT NULL), ok AS (SELECT version, any_value(k) AS k, range, bool_and(trim(range) IN ('', '*') OR {sql_satisfies('k', 'part')}) AS fits FROM pairs GROUP BY 1, 3)"


def _fitting(spark, d):
    """Each version with the list of all ranges, which is a fixed value."""
    versions = _event_versions(spark, d).withColumn("k", semver.key(F.col("version"))).where("k is not null")
    rows = versions.select("version", "k", F.explode(F.array(*[F.lit(r[0]) for r in RANGES.rows])).alias("range"))
    return rows.withColumn("fits", semver.in_range(F.col("k"), F.col("range")))


@query(f"WITH {_AVAILABLE} SELECT version, range, fits FROM ok")
def version_ranges(spark, d):
    """Whether each version fits each range."""
    return _fitting(spark, d).select("version", "range", "fits")


@query(f"WITH {_AVAILABLE} SELECT range, arg_max(version, struct_pack(a := k.a, b := k.b, c := k.c, v := version)) FILTER (WHERE fits) AS best FROM ok GROUP BY 1")
def best_versions(spark, d):
    """The newest version that fits each range by its three numbers; of equal ones the last by name."""
    rank = F.when(F.col("fits"), F.struct("k.major", "k.minor", "k.patch", "version"))
    return _fitting(spark, d).groupBy("range").agg(F.max(rank)["version"].alias("best"))


@query("SELECT user_id AS unit_id, record_version, ord, kind, review_status, row_number() OVER (PARTITION BY unit_id ORDER BY record_version, ord) AS nth FROM (SELECT * FROM (WITH " + O._VERSIONS + " SELECT unit_id AS user_id, * FROM ver))")
def version_history(spark, d):
    """All versions of each unit in order."""
    w = Window.partitionBy("unit_id").orderBy("record_version", "ord")
    return K._versions(spark, d).withColumn("nth", F.row_number().over(w).cast("long"))


# --- constraints and updates ----------------------------------------------------------------------------------------------------

# Units that break one rule each, and one that breaks none.
UNITS = Rows("unit_id string, kind string, content string, refs bigint, confidence double, review_status string, record_version bigint, evidence_level string, evidence_note string", (
    ("ok", "term", "x", 1, 1.0, "candidate", 1, "primary", None), ("r1", "term", "", 1, 0.5, "candidate", 1, "primary", None), ("r2", "idea", "x", 1, 0.5, "candidate", 1, "primary", None), ("r3", "term", "x", 0, 0.5, "candidate", 1, "primary", None), ("r4", "term", "x", 1, 1.5, "candidate", 1, "primary", None),
    ("r5", "term", "x", 1, None, "new", 1, "primary", None), ("r6", "term", "x", 1, 0.5, "candidate", 0, "primary", None), ("r7", "term", "x", 1, 0.5, "candidate", 1, "hearsay", None), ("r8", "term", "x", 1, 0.5, "candidate", 1, "inferred", ""), ("r9", "term", "x", 1, 0.5, "candidate", 1, "user_added", "said so"), ("r9", "term", None, None, -0.1, None, None, None, None)))
_CHECKED = f"""{O._UNITS}, rows AS (SELECT unit_id, kind, content, CASE WHEN length(content) < 12 THEN 0 ELSE 1 END::BIGINT AS refs, confidence * 1.3 AS confidence, 'candidate' AS review_status, 1::BIGINT AS record_version, CASE WHEN kind = 'case' THEN 'inferred' ELSE 'primary' END AS evidence_level, NULL::VARCHAR AS evidence_note FROM units UNION ALL {UNITS.sql()})"""


@query(f"""WITH {_CHECKED} SELECT unit_id, 'content' AS rule FROM rows WHERE coalesce(length(content), 0) < 1 UNION ALL SELECT unit_id, 'kind' FROM rows WHERE kind IS NULL OR kind NOT IN {G.KINDS} UNION ALL SELECT unit_id, 'source_refs' FROM rows WHERE coalesce(refs, 0) < 1
 UNION ALL SELECT unit_id, 'confidence' FROM rows WHERE confidence NOT BETWEEN 0 AND 1 UNION ALL SELECT unit_id, 'review_status' FROM rows WHERE review_status IS NULL OR review_status NOT IN {G.STATUSES} UNION ALL SELECT unit_id, 'record_version' FROM rows WHERE record_version < 1
 UNION ALL SELECT unit_id, 'evidence_level' FROM rows WHERE evidence_level NOT IN {G.LEVELS} UNION ALL SELECT unit_id, 'evidence_note' FROM rows WHERE evidence_level IN ('inferred', 'user_added') AND coalesce(evidence_note, '') = ''
 UNION ALL SELECT unit_id, 'unique_id' FROM rows GROUP BY 1 HAVING count(*) > 1""")
def row_constraints(spark, d):
    """Rules that units break: those of the documents, with short ones without a reference, confidences scaled and cases inferred, and fixed ones."""
    u = K._units(spark, d)
    refs = F.when(F.length("content") < 12, 0).otherwise(1).cast("long")
    rows = u.select("unit_id", "kind", "content", refs.alias("refs"), (F.col("confidence") * 1.3).alias("confidence"), F.lit("candidate").alias("review_status"), F.lit(1).cast("long").alias("record_version"), F.when(F.col("kind") == "case", "inferred").otherwise("primary").alias("evidence_level"), F.lit(None).cast("string").alias("evidence_note"))
    return G.row_violations(rows.unionByName(UNITS.df(spark)))


def _update(spark, d, errors, items, overrides):
    from sedimark.operators import versions as V

    change = V.diff(K._old(spark, d), K._new(spark, d)).select("change")
    return G.update_decision(change, errors, items, overrides)


_CHANGES = f"WITH {O._DIFF}, ch AS (SELECT count(*) FILTER (WHERE added) AS added, count(*) FILTER (WHERE gone) AS removed, count(*) FILTER (WHERE NOT added AND NOT gone AND fields <> '') AS modified FROM cmp)"


@query(f"{_CHANGES}, n AS (SELECT (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, (SELECT count(*) FROM documents WHERE length(text) < 20) AS review_items, 0::BIGINT AS overrides) SELECT ch.*, n.*, CASE WHEN removed > 0 AND errors > 0 THEN 'partial_removal' WHEN review_items > 0 THEN 'open_review' WHEN added + removed + modified = 0 THEN 'no_changes' END AS blocker FROM ch, n")
def update_blockers(spark, d):
    """What keeps the update of the old collection to the new one from being published, with error events as failed sources and short documents in review."""
    none = spark.createDataFrame([], "override_id string")
    return _update(spark, d, K.table(spark, d, "events").where("event_type = 'error'"), K._docs(spark, d).where(F.length("text") < 20), none)


@query(f"{_CHANGES}, o AS (SELECT count(DISTINCT unit_id || field) AS overrides FROM (SELECT 'd' || doc_id AS unit_id, 'review_status' AS field FROM labels WHERE quality = 0)) SELECT ch.*, 0::BIGINT AS errors, 0::BIGINT AS review_items, overrides, CASE WHEN overrides > 0 THEN 'preserved_overrides' WHEN added + removed + modified = 0 THEN 'no_changes' END AS blocker FROM ch, o")
def update_overrides(spark, d):
    """The same update with the overrides of units that it removes."""
    gone = K.table(spark, d, "labels").where("quality = 0").select(F.concat(F.lit("d"), "doc_id", F.lit("review_status")).alias("override_id"))
    none = spark.createDataFrame([], "x int")
    return _update(spark, d, none, none, gone)


# Patches in order, some for one unit.
PATCHES = Rows("unit_id string, ord bigint, disposition string, revised string", (("d1", -9, "merge", "first text"), ("d1", -8, "merge", "second text"), ("d1", -7, "accept", None), ("d2", -6, "merge", ""), ("d2", -5, "reject", "not used"), ("nobody", -4, "accept", None)))


@query(f"""WITH {O._OLD}, p AS (SELECT unit_id, 0::BIGINT AS ord, CASE WHEN quality = 0 THEN 'reject' WHEN toxic = 1 THEN 'merge' ELSE 'accept' END AS disposition, CASE WHEN toxic = 1 THEN 'revised ' || unit_id END AS revised FROM lab UNION ALL {PATCHES.sql()}),
 l AS (SELECT unit_id, arg_max(disposition, ord) AS dis, arg_max(revised, ord) FILTER (WHERE disposition = 'merge' AND coalesce(revised, '') <> '') AS content FROM p GROUP BY 1)
 SELECT old.unit_id, coalesce(l.content, old.content) AS content, CASE WHEN dis IS NULL THEN review_status WHEN dis = 'reject' THEN 'rejected' ELSE 'reviewed' END AS review_status FROM old LEFT JOIN l ON l.unit_id = old.unit_id""")
def patched_units(spark, d):
    """Units after review patches that labels and fixed rows stand for."""
    labels = K.table(spark, d, "labels")
    patches = labels.select(F.concat(F.lit("d"), "doc_id").alias("unit_id"), F.lit(0).cast("long").alias("ord"), F.when(F.col("quality") == 0, "reject").when(F.col("toxic") == 1, "merge").otherwise("accept").alias("disposition"), F.when(F.col("toxic") == 1, F.concat(F.lit("revised d"), "doc_id")).alias("revised"))
    return G.patched(K._old(spark, d).select("unit_id", "content", "review_status"), patches.unionByName(PATCHES.df(spark)))


@query("""WITH item AS (SELECT conv_id, turn, 'i' || turn AS input_id, 'b' || (turn // 2) AS block_id FROM conversations), resp AS (SELECT conv_id, turn, 'i' || (turn + 1) AS input_id, text FROM conversations),
 j AS (SELECT r.conv_id, i.block_id, i.turn, sha256(r.text) AS content_sha256, row_number() OVER (PARTITION BY r.conv_id, i.block_id ORDER BY i.turn) AS n FROM resp r JOIN item i ON i.conv_id = r.conv_id AND i.input_id = r.input_id)
 SELECT 'cu-' || conv_id || '-' || block_id || '-' || n AS unit_id, block_id, content_sha256 FROM j""")
def rejoined_responses(spark, d):
    """Responses meet the items of their chunk by input id; those that answer no item are dropped, and ids come from the trusted side with a running number for each block."""
    c = K.table(spark, d, "conversations")
    items = c.select("conv_id", "turn", F.concat(F.lit("i"), "turn").alias("input_id"), F.concat(F.lit("b"), F.floor(F.col("turn") / 2)).alias("block_id"))
    responses = c.select("conv_id", F.concat(F.lit("i"), F.col("turn") + 1).alias("input_id"), "text")
    n = F.row_number().over(Window.partitionBy("conv_id", "block_id").orderBy("turn"))
    rows = responses.join(items, ["conv_id", "input_id"]).withColumn("n", n)
    return rows.select(F.concat_ws("-", F.lit("cu"), "conv_id", "block_id", "n").alias("unit_id"), "block_id", F.sha2("text", 256).alias("content_sha256"))


# Raw answers of a model.
ANSWERS = Rows("event_id bigint, raw string", ((-8, '```json\n[{"a": 1}, {"b": 2}]\n```'), (-7, '[{"a": 1}, 3, "x"]'), (-6, '{"a": 1}'), (-5, "no json"), (-4, "[]"), (-3, "  ```\n[]\n```  "), (-2, '[{"a": [1, {"b": 2}]}'), (-1, "")))


@query(f"""WITH raw AS (SELECT event_id, props AS raw FROM events UNION ALL {ANSWERS.sql()}),
 c AS (SELECT event_id, CASE WHEN starts_with(trim(raw), '```') THEN array_to_string(list_filter(string_split(trim(raw), chr(10)), lambda x: NOT starts_with(trim(x), '```')), chr(10)) ELSE trim(raw) END AS t FROM raw),
 v AS (SELECT event_id, t, t <> '' AND json_valid(t) AS valid FROM c), k AS (SELECT event_id, t, CASE WHEN valid THEN json_type(t) END AS kind FROM v),
 n AS (SELECT event_id, kind, CASE WHEN kind = 'ARRAY' THEN json_array_length(t)::BIGINT ELSE 0 END AS items, CASE WHEN kind = 'ARRAY' THEN len(list_filter(from_json(t, '["JSON"]'), lambda x: json_type(x) = 'OBJECT')) ELSE 0 END AS objects FROM k)
 SELECT event_id, objects, CASE WHEN kind IS NULL THEN 'no_json' WHEN kind <> 'ARRAY' THEN 'no_array' WHEN objects < items THEN 'no_objects' END AS fault FROM n""")
def parsed_answers(spark, d):
    """Raw answers as arrays of objects: how many objects a lenient reader keeps, and the fault at which a strict one stops."""
    rows = K.table(spark, d, "events").select("event_id", F.col("props").alias("raw")).unionByName(ANSWERS.df(spark))
    return C.parsed_arrays(rows, "raw").select("event_id", "objects", "fault")


# --- rules of rendered files ----------------------------------------------------------------------------------------------------

# Rendered pages, good and bad.
PAGES = Rows("id bigint, text string", (
    (-12, "---\nname: plan-week\ndescription: Plans a week of work.\n---\n# Plan\nSee `references/terms.md` and `references/none.md`.\nUse a pomodoro."), (-11, "# no head"), (-10, "---\nname: Plan Week\ndescription: short\n---\n"), (-9, "---\ndescription: 'A description in quotes.'\n---\nbody"), (-8, '---\nname: "quoted-name"\n---\nbody'),
    (-7, "---\njust words\n---\nbody"), (-6, "---\nname: a\n"), (-5, "A habit with its cue and REWARD.\n## Habit execution scaffolding\n"), (-4, "Timebox it.\n\n## runtime EXECUTION scaffolding\nsee `references/terms.md`\nand `references/a/b-c_d.md`"), (-3, "番茄钟 and 习惯"), (-2, "`references/terms.md` `references/terms.md`\n`references/gone.md`"), (-1, "")))
ON_DISK = ("references/terms.md", "references/cases.md")
_PAGES = f"pages_ AS (SELECT doc_id AS id, text FROM documents UNION ALL {PAGES.sql()})"


def _pages(spark, d):
    return K._docs(spark, d).select(F.col("doc_id").alias("id"), "text").unionByName(PAGES.df(spark))


_FIELD = lambda name: f"""coalesce(nullif(regexp_extract(head, {sql_value(C.FIELD_LINE.replace("NAME", name))}, 2), ''), nullif(trim(regexp_extract(head, {sql_value(C.FIELD_LINE.replace("NAME", name))}, 3)), ''))"""


@query(f"""WITH {_PAGES}, h AS (SELECT id, regexp_matches(text, {sql_value(C.FRONT)}) AS has, regexp_extract(text, {sql_value(C.FRONT)}, 1) AS head FROM pages_), f AS (SELECT id, has, regexp_matches(head, {sql_value(C.MAPPING)}) OR trim(head) = '' AS mapping, {_FIELD('name')} AS name, {_FIELD('description')} AS description FROM h)
 SELECT id, unnest(CASE WHEN NOT has THEN ['missing'] WHEN NOT mapping THEN ['not_mapping'] ELSE list_filter([CASE WHEN name IS NULL THEN 'name_missing' WHEN NOT regexp_full_match(name, '[a-z0-9]+(-[a-z0-9]+)*') THEN 'name_pattern' END, CASE WHEN description IS NULL THEN 'description_missing' WHEN length(description) < 10 THEN 'description_short' END], lambda x: x IS NOT NULL) END) AS code FROM f""")
def frontmatter_findings(spark, d):
    """What is wrong with the heads of documents and fixed pages."""
    return C.frontmatter(_pages(spark, d))


@query(f"""WITH {_PAGES}, low AS (SELECT id, {O.casefold('text')} AS t FROM pages_), s AS (SELECT id, unnest([CASE WHEN ({' OR '.join(f"contains(t, {sql_value(s)})" for s in C.TIME_SIGNALS)}) AND NOT contains(t, '{C.TIME_HEADING}') THEN 'missing_time_scaffolding' END, CASE WHEN ({' OR '.join(f"contains(t, {sql_value(s)})" for s in C.HABIT_SIGNALS)}) AND NOT contains(t, '{C.HABIT_HEADING}') THEN 'missing_habit_scaffolding' END]) AS code FROM low)
 SELECT id, code FROM s WHERE code IS NOT NULL""")
def scaffolding_findings(spark, d):
    """Documents and pages that speak of time boxes or habits without the section that belongs to it."""
    return C.scaffolding(_pages(spark, d))


@query(f"""WITH {_PAGES}, ln AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM pages_), t AS (SELECT id, line_no, unnest(regexp_extract_all(line, '`(references/[A-Za-z0-9_/-]+\\.md)`', 1)) AS target FROM ln)
 SELECT id, line_no, target FROM t WHERE target NOT IN {ON_DISK}""")
def missing_links(spark, d):
    """Links of pages to reference files that are not there, with their lines."""
    disk = spark.createDataFrame([(p,) for p in ON_DISK], "target string")
    return C.missing_links(_pages(spark, d), disk)


@query(f"""WITH {O._UNITS}, l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1), u AS (SELECT source_id, kind, CASE WHEN toxic = 1 THEN 'inferred' WHEN kind = 'case' THEN 'user_added' ELSE 'primary' END AS evidence_level FROM units LEFT JOIN l ON doc_id = ord)
 SELECT source_id, count(*) AS executable FROM u WHERE kind IN {G.EXECUTABLE} GROUP BY 1 HAVING NOT bool_or(evidence_level IN {G.DIRECT})""")
def evidence_boundary(spark, d):
    """Sources whose executable units all rest on inferred evidence; toxic documents count as inferred."""
    labels = K.table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    u = K._units(spark, d).join(labels, F.col("ord") == F.col("doc_id"), "left")
    level = F.when(F.col("toxic") == 1, "inferred").when(F.col("kind") == "case", "user_added").otherwise("primary")
    return C.inferred_only(u.select("source_id", "kind", level.alias("evidence_level")))


# Paths that packages may not have, and some that they may.
PATHS = Rows("path string", tuple((p,) for p in ("a/b.md", "/abs", "a//b", "../up", "a/./b", "C:\\x", "c:/x", "a\\b.md", "", "nul\x01x", "aux.txt", "dir/COM1", "a./b", "a /b", "x:y", "ok-name_1/z.txt", "..", "lpt9.tar.gz")))


@query(f"""WITH p AS (SELECT url AS path FROM pages UNION ALL {PATHS.sql()}), n AS (SELECT path, replace(path, chr(92), '/') AS t FROM p)
 SELECT path, NOT (t = '' OR starts_with(t, '/') OR regexp_matches(t, '^[A-Za-z]:') OR regexp_matches(t, '[\\x00-\\x1F]') OR regexp_matches('/' || t || '/', '/(?:|\\.|\\.\\.)/') OR regexp_matches(t, ':') OR regexp_matches(t || '/', '[ .]/') OR regexp_matches('/' || lower(t) || '/', {sql_value(C.RESERVED)})) AS member_ok,
 NOT (contains(path, chr(92)) OR starts_with(path, '/') OR regexp_matches(path, '^[A-Za-z]:') OR path = '' OR regexp_matches('/' || path || '/', '/(?:\\.|\\.\\.)/')) AS closure_ok FROM n""")
def path_safety(spark, d):
    """Whether URLs and fixed paths may be members of a package, and paths of a closure."""
    paths = K.table(spark, d, "pages").select(F.col("url").alias("path")).unionByName(PATHS.df(spark))
    return paths.select("path", C.safe_member(F.col("path")).alias("member_ok"), C.safe_relative(F.col("path")).alias("closure_ok"))


# --- files ----------------------------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT item_id, unnest(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10))) AS b, generate_subscripts(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10)), 1) AS i FROM benchmark)
 SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY i) AS block_ord, sha256(trim(b)) AS text_sha256 FROM t WHERE trim(b) <> ''""")
def ingested_files(spark, d):
    """Benchmark items written as text files with a paragraph for each sentence, found, gated and read back as blocks; each file is named after its item."""
    out = fresh_path(spark, "files")
    items = K.table(spark, d, "benchmark").select("item_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("value"))
    items.write.partitionBy("item_id").text(out)
    remove_on_exit(spark, out)
    files = readers.scan(spark, out, "*.txt")
    # files of equal content are duplicates for the gate, but items of their own here
    files = files.withColumn("error", F.when(F.col("error") != "duplicate", F.col("error")))
    blocks = readers.extract(files)
    return blocks.select(F.regexp_extract("path", "item_id=([0-9-]+)", 1).cast("long").alias("item_id"), "block_ord", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT doc_id, true AS same, length(text)::BIGINT AS n_chars FROM documents")
def decoded_texts(spark, d):
    """Documents in UTF-8 or, by their language, in UTF-16 behind a byte order mark, decoded without being told which."""
    content = F.when(F.col("lang").isin("de", "fr"), F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8"))
    docs = readers.decoded(K._docs(spark, d).select("doc_id", "text", content.alias("content")), "content")
    return docs.select("doc_id", (F.col("decoded") == F.col("text")).alias("same"), F.length("decoded").cast("long").alias("n_chars"))


@query(None)
def text_fragments(spark, d):
    """Documents cut into fragments of at most 100 tokens that are whole lines where they can be, with digests."""
    rows = B.split_texts(K._docs(spark, d).select(F.col("doc_id").alias("id"), "text"), 100)
    return rows.select(F.col("id").alias("doc_id"), "nth", "tokens", F.length("fragment").cast("long").alias("n_chars"), F.sha2("fragment", 256).alias("sha256"))


# --- digests --------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {O._UNITS} SELECT unit_id, sha256('{{"confidence":' || CASE confidence WHEN 0.3 THEN '0.3' WHEN 0.5 THEN '0.5' WHEN 0.7 THEN '0.7' ELSE '0.8' END || ',"content":' || to_json(content)::VARCHAR || ',"kind":"' || kind || '","supersedes":null,"unit_id":"' || unit_id || '"}}') AS sha256 FROM units""")
def canonical_digests(spark, d):
    """The digest of each unit's canonical JSON: keys in order, no spaces, nulls kept, characters as they are."""
    u = K._units(spark, d).select("unit_id", "kind", "content", "confidence", F.lit(None).cast("string").alias("supersedes"))
    return u.select("unit_id", F.sha2(B.canonical_json(u), 256).alias("sha256"))


@query("""SELECT source, count(*) AS files, sha256('{' || string_agg('"doc-' || lpad(doc_id::VARCHAR, 20, '0') || '.txt":"' || sha256(text) || '"', ',' ORDER BY doc_id) || '}') AS digest FROM documents GROUP BY 1""")
def tree_digests(spark, d):
    """A digest of the map from path to content hash of each source's files, in order of path."""
    files = K._docs(spark, d).select("source", F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit(".txt")).alias("path"), F.sha2("text", 256).alias("sha256"))
    return B.map_digests(files, "source", "path", "sha256").select("source", F.col("entries").alias("files"), "digest")


@query("""SELECT source, 'col-' || substr(sha256(string_agg(DISTINCT substr(sha256(text), 1, 12), '|' ORDER BY substr(sha256(text), 1, 12))), 1, 12) AS collection_id FROM documents GROUP BY 1""")
def collection_names(spark, d):
    """The id of each source's collection, from its distinct members in order."""
    members = K._docs(spark, d).select("source", T.source_id(F.col("text")).alias("member")).distinct()
    return B.joined_digests(members, "source", "member", "|").select("source", F.concat(F.lit("col-"), F.left("digest", F.lit(12))).alias("collection_id"))
