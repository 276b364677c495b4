"""Queries of reviews, patches, emitted files, audits and escaped digests, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimark.operators import blocks as B
from sedimark.operators import packs as P
from sedimark.operators import trees as R
from sedimark.sources.scratch import fresh_path, remove_on_exit

from . import catalogue as K
from . import oracles as O
from .literals import Rows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Candidates of each outcome.
ASSETS = Rows("candidate_id string, asset_id string", (("yes", "a"), ("yes", "b"), ("no", "a"), ("less", "a"), ("less", "b"), ("more", "a")))
DECISIONS = Rows("candidate_id string, asset_id string, ord bigint, decision string", (("yes", "a", 1, "reject"), ("yes", "a", 2, "approve"), ("yes", "b", 1, "approve"), ("no", "a", 1, "reject"), ("less", "a", 1, "approve"), ("more", "a", 1, "approve"), ("more", "z", 1, "approve"), ("none", "z", 1, "approve")))


@query(f"""WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1), a AS ({ASSETS.sql()} UNION SELECT source || '/' || lang || '/' || doc_id % 16, 'd' || doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM l) OR doc_id % 101 = 0),
 d AS ({DECISIONS.sql()} UNION ALL SELECT source || '/' || lang || '/' || d.doc_id % 16, 'd' || d.doc_id, 1, CASE WHEN quality = 1 THEN 'approve' ELSE 'reject' END FROM documents d JOIN l USING (doc_id) UNION ALL SELECT source || '/' || lang || '/' || d.doc_id % 16, 'd' || d.doc_id, 2, 'approve' FROM documents d JOIN l USING (doc_id) WHERE toxic = 0),
 last AS (SELECT candidate_id, asset_id, arg_max(decision, ord) AS decision FROM d GROUP BY 1, 2), f AS (SELECT coalesce(a.candidate_id, l.candidate_id) AS candidate_id, a.asset_id IS NOT NULL AS own, l.asset_id IS NOT NULL AS known, decision FROM a FULL JOIN last l ON a.candidate_id = l.candidate_id AND a.asset_id = l.asset_id),
 g AS (SELECT candidate_id, count(*) FILTER (WHERE own) AS assets, count(*) FILTER (WHERE known) AS decided, count(*) FILTER (WHERE own AND NOT known) AS missing, count(*) FILTER (WHERE known AND NOT own) AS extra, count(*) FILTER (WHERE decision = 'approve') AS yes FROM f GROUP BY 1)
 SELECT candidate_id, assets, decided, missing, extra, CASE WHEN missing > 0 OR extra > 0 THEN 'review_required' WHEN yes = decided THEN 'approved' ELSE 'rejected' END AS stage FROM g""")
def pack_reviews(spark, d):
    """Stages of candidates: documents that are labelled are assets with decisions, some others are assets without."""
    name = F.concat_ws("/", "source", "lang", (F.col("doc_id") % 16).cast("string")).alias("candidate_id")
    labels = K.table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = K.table(spark, d, "documents").join(labels, "doc_id", "left").select(name, F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("asset_id"), "doc_id", "quality", "toxic")
    assets = docs.where("quality is not null or doc_id % 101 = 0").select("candidate_id", "asset_id")
    first = docs.where("quality is not null").select("candidate_id", "asset_id", F.lit(1).cast("bigint").alias("ord"), F.when(F.col("quality") == 1, "approve").otherwise("reject").alias("decision"))
    second = docs.where("toxic = 0").select("candidate_id", "asset_id", F.lit(2).cast("bigint").alias("ord"), F.lit("approve").alias("decision"))
    return P.pack_reviews(ASSETS.df(spark).unionByName(assets), DECISIONS.df(spark).unionByName(first).unionByName(second))


# Patches at the edges.
PATCHES = Rows("unit_id string, disposition string, refs array<string>", (("d0", None, None), ("d0", "merge", []), ("d0", "drop", ["x"]), ("nobody", "accept", ["x"]), ("d1", "reject", ["de", "zz"])))


@query(f"""WITH u AS (SELECT 'd' || doc_id AS unit_id, any_value([source, lang]) AS own FROM documents GROUP BY doc_id), l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
 p AS ({PATCHES.sql()} UNION ALL SELECT 'd' || d.doc_id, CASE WHEN quality = 1 THEN 'merge' WHEN toxic = 1 THEN 'drop' END, CASE WHEN d.doc_id % 3 = 0 THEN [source] WHEN d.doc_id % 3 = 1 THEN [lang, 'other'] ELSE [] END FROM documents d JOIN l USING (doc_id)),
 j AS (SELECT p.unit_id, coalesce(disposition, 'accept') AS disposition, own, CASE WHEN len(coalesce(refs, [])) > 0 THEN refs ELSE own END AS r FROM p LEFT JOIN u USING (unit_id))
 SELECT unit_id, disposition, array_to_string(r, ',') AS refs, CASE WHEN own IS NULL THEN 'unknown_unit' WHEN disposition NOT IN ('accept', 'reject', 'merge') THEN 'unknown_disposition' WHEN len(list_filter(r, lambda x: NOT list_contains(own, x))) > 0 THEN 'unknown_refs' END AS code FROM j""")
def review_patches(spark, d):
    """Patches on documents by their labels, and whether they name references that their unit has."""
    labels = K.table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    id_ = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("unit_id")
    docs = K.table(spark, d, "documents").select("doc_id", "source", "lang")
    units = docs.dropDuplicates(["doc_id"]).select(id_, F.array("source", "lang").alias("refs"))
    i = F.col("doc_id") % 3
    refs = F.when(i == 0, F.array("source")).when(i == 1, F.array("lang", F.lit("other"))).otherwise(F.array().cast("array<string>"))
    patches = docs.join(labels, "doc_id").select(id_, F.when(F.col("quality") == 1, "merge").when(F.col("toxic") == 1, "drop").alias("disposition"), refs.alias("refs"))
    return P.patch_faults(PATCHES.df(spark).unionByName(patches), units)


# Folders of a product, some that it does not consume, and paths at the edges.
FOLDERS = ("schemas", "assets", "scripts", "tools", "references", "docs", "tests")
PATHS = Rows("path string", (("SKILL.md",), ("docs/SKILL.md",), ("schemas",), ("",), ("referencesx/a.md",), ("tools/a/b.py",)))


@query(f"""WITH p AS ({PATHS.sql()} UNION ALL SELECT ['{"', '".join(FOLDERS)}'][(page_id % {len(FOLDERS)} + 1)::INT] || '/' || page_id || regexp_extract(url, '\\.[a-z]+(/[a-z]+/)', 1) FROM pages),
 k AS (SELECT path, CASE WHEN path = 'SKILL.md' THEN 'kernel' {' '.join(f"WHEN split_part(path, '/', 1) = '{n}' THEN '{s[0]}'" for n, s in P.SHAPES.items())} END AS kind, CASE WHEN path = 'SKILL.md' THEN 'exact_required' {' '.join(f"WHEN split_part(path, '/', 1) = '{n}' THEN '{s[1]}'" for n, s in P.SHAPES.items())} END AS class FROM p)
 SELECT * FROM k WHERE kind IS NOT NULL""")
def emitted_files(spark, d):
    """Kind and class of the files that a product consumes; pages stand for files in its folders."""
    folders = F.array(*[F.lit(x) for x in FOLDERS])
    pages = K.table(spark, d, "pages").select(F.concat(F.get(folders, (F.col("page_id") % len(FOLDERS)).cast("int")), F.lit("/"), F.col("page_id").cast("string"), F.regexp_extract("url", r"\.[a-z]+(/[a-z]+/)", 1)).alias("path"))
    kind, class_ = P.resource_shape(F.col("path"))
    return PATHS.df(spark).unionByName(pages).select("path", kind.alias("kind"), class_.alias("class")).where("kind is not null")


# Products of each disposition.
SKILLS = Rows("skill_id string, has_main boolean, manifest string, report_code string, closure_hash string", (("x1", True, '{"closure_version": "1"}', None, "h"), ("x2", True, "{", None, "h"), ("x3", True, "[1]", None, None), ("x4", True, '{"other": 1}', None, "h"), ("x5", None, None, None, None), ("x6", True, None, None, None), ("x7", True, "{}", None, None), ("x7", True, "{}", None, None), ("x8", True, '{"closure_version": "1"}', "CLOSURE_HASH", "h")))


@query(f"""WITH s AS ({SKILLS.sql()} UNION ALL SELECT 'd' || doc_id, doc_id % 9 <> 0, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN left(text, 20) ELSE '{{"closure_version":"' || doc_id || '"}}' END, CASE WHEN doc_id % 11 = 0 THEN 'RESOURCE_MISSING' END, sha256(text) FROM documents),
 o AS (SELECT skill_id, count(*) AS n, any_value(has_main) AS has_main, any_value(manifest) AS manifest, any_value(report_code) AS report_code, any_value(closure_hash) AS closure_hash FROM s GROUP BY 1),
 r AS (SELECT *, CASE WHEN n > 1 OR NOT coalesce(has_main, false) THEN 'MIGRATION_INVALID' WHEN manifest IS NULL THEN 'MIGRATION_LEGACY_UNCLOSED' WHEN NOT json_valid(manifest) OR NOT regexp_matches(manifest, '^\\s*\\{{') THEN 'MIGRATION_CLOSURE_INVALID' WHEN json_extract_string(CASE WHEN json_valid(manifest) THEN manifest ELSE '{{}}' END, '$.closure_version') IS NULL THEN 'MIGRATION_CLOSURE_INVALID' ELSE report_code END AS reason FROM o)
 SELECT skill_id, CASE WHEN reason IS NULL THEN 'closure-ready' WHEN reason = 'MIGRATION_LEGACY_UNCLOSED' THEN 'legacy-unclosed' ELSE 'blocked' END AS disposition, reason, CASE WHEN reason IS NULL THEN closure_hash END AS closure_hash FROM r""")
def legacy_products(spark, d):
    """The audit of documents as products from before closures."""
    i = F.col("doc_id")
    manifest = F.when(i % 4 != 0, F.when(i % 7 == 0, F.left("text", F.lit(20))).otherwise(F.concat(F.lit('{"closure_version":"'), i.cast("string"), F.lit('"}'))))
    docs = K.table(spark, d, "documents").select(F.concat(F.lit("d"), i.cast("string")).alias("skill_id"), (i % 9 != 0).alias("has_main"), manifest.alias("manifest"), F.when(i % 11 == 0, "RESOURCE_MISSING").alias("report_code"), F.sha2("text", 256).alias("closure_hash"))
    return P.legacy_assessments(SKILLS.df(spark).unionByName(docs))


_ESCAPED = "array_to_string(list_transform(string_split(j, ''), lambda c: CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 65536 THEN '\\u' || format('{:04x}', unicode(c)) ELSE '\\u' || format('{:04x}', ((unicode(c) - 65536) >> 10) + 55296) || '\\u' || format('{:04x}', ((unicode(c) - 65536) & 1023) + 56320) END), '')"


@query(f"""WITH {O._LITERALS}, j AS (SELECT id, '{{"id":' || id || ',"text":' || to_json(text)::VARCHAR || '}}' AS j FROM (SELECT id, text FROM texts WHERE NOT regexp_matches(text, '[\\x00-\\x08\\x0B\\x0E-\\x1F]') UNION ALL SELECT -30, 'astral ' || chr(128512) || chr(119987) || 'é')) SELECT id, sha256({_ESCAPED}) AS sha256 FROM j""")
def escaped_digests(spark, d):
    """Digests of canonical JSON in which characters beyond ASCII are escaped, as a pack's hash takes them."""
    rows = K._with_literals(spark, d).where(~F.col("text").rlike(r"[\x00-\x08\x0B\x0E-\x1F]")).unionByName(spark.createDataFrame([(-30, "astral 😀𝒳é")], "id bigint, text string"))
    return rows.select("id", F.sha2(P.escaped(B.canonical_json(rows.select("id", "text"))), 256).alias("sha256"))


def _files(spark, d):
    name = F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit(".txt"))
    return K.table(spark, d, "documents").select("doc_id", "source", name.alias("path"), F.sha2("text", 256).alias("sha256"))


@query("""WITH f AS (SELECT source, 'doc-' || lpad(doc_id::VARCHAR, 20, '0') || '.txt' AS path, sha256(text) AS h FROM documents) SELECT source, count(*) AS files, sha256(string_agg(octet_length(encode(path)) || ':' || path || octet_length(encode(h)) || ':' || h, '' ORDER BY path)) AS digest FROM f GROUP BY 1""")
def framed_digests(spark, d):
    """The length-prefixed digest of each source's files."""
    return R.framed_digests(_files(spark, d), "source")


@query("""WITH RECURSIVE f AS (SELECT 'doc-' || lpad(doc_id::VARCHAR, 20, '0') || '.txt' AS path, sha256(text) AS h FROM documents),
 l3 AS (SELECT left(sha256(path), 3) AS prefix, count(*) AS files, sha256(string_agg(octet_length(encode(path)) || ':' || path || octet_length(encode(h)) || ':' || h, '' ORDER BY path)) AS digest FROM f GROUP BY 1),
 l2 AS (SELECT left(prefix, 2) AS p, sum(files)::BIGINT AS files, sha256(string_agg(prefix || '=' || digest, ';' ORDER BY prefix)) AS digest FROM l3 GROUP BY 1), l1 AS (SELECT left(p, 1) AS q, sum(files)::BIGINT AS files, sha256(string_agg(p || '=' || digest, ';' ORDER BY p)) AS digest FROM l2 GROUP BY 1)
 SELECT *, 3 AS depth FROM l3 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT '', sum(files)::BIGINT, sha256(string_agg(q || '=' || digest, ';' ORDER BY q)), 0 FROM l1""")
def digest_tree(spark, d):
    """All nodes of the digest tree of the documents."""
    return R.digest_tree(_files(spark, d).select("path", "sha256"))


@query("""WITH a AS (SELECT 'doc-' || lpad(doc_id::VARCHAR, 20, '0') || '.txt' AS path, sha256(text) AS h, doc_id FROM documents), b AS (SELECT path, CASE WHEN doc_id % 50 = 0 THEN sha256(h) ELSE h END AS h FROM a WHERE doc_id % 77 <> 3 UNION ALL SELECT 'page-' || page_id, sha256(html) FROM pages WHERE page_id % 90 = 1)
 SELECT path, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b USING (path) WHERE a.h IS DISTINCT FROM b.h""")
def tree_changes(spark, d):
    """What has changed between two stored trees, found by their digests."""
    old = _files(spark, d)
    new = old.where("doc_id % 77 <> 3").select("path", F.when(F.col("doc_id") % 50 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    new = new.unionByName(K.table(spark, d, "pages").where("page_id % 90 = 1").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("path"), F.sha2("html", 256).alias("sha256")))
    paths = [fresh_path(spark, "tree") for _ in "ab"]
    for files, path in zip((old.select("path", "sha256"), new), paths):
        remove_on_exit(spark, path)
        R.write_tree(files, path)
    return R.compare_trees(spark, *paths)


@query("""WITH f AS (SELECT source, ['references', 'assets', 'scripts', 'docs'][(doc_id % 4 + 1)::INT] || '/' || lang || '/' || doc_id || '.txt' AS path, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents)
 SELECT source, count(*) AS files, sha256(unhex(string_agg(format('{:08x}', octet_length(encode(path))) || hex(encode(path)) || format('{:016x}', n) || h, '' ORDER BY string_split(path, '/')))) AS digest FROM f WHERE NOT starts_with(path, 'docs/') GROUP BY 1""")
def consumer_digests(spark, d):
    """The digest of what consumers see of each source's files."""
    folder = F.get(F.array(*[F.lit(x) for x in ("references", "assets", "scripts", "docs")]), (F.col("doc_id") % 4).cast("int"))
    path = F.concat(folder, F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return R.consumer_digests(K.table(spark, d, "documents").select("source", path.alias("path"), F.col("text").cast("binary").alias("content")), "source")
