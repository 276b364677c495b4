"""All queries by name, and the SQL that tells their rows.

Driver tables stand for the entities of an evidence collection: documents for gated text sources, their lines for blocks and candidate
units, labels for review outcomes, conversations for ordered fragments, pages for web sources, benchmark items for coverage slots and
events for invocations and versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimark.functions import text as T
from sedimark.operators import blocks as B
from sedimark.operators import checks as C
from sedimark.operators import relate as R
from sedimark.operators import telemetry as M
from sedimark.operators import versions as V
from sedimark.operators.ordered import carried, numbered

from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, d):
    return table(spark, d, "documents")


def _units(spark, d):
    return B.candidates(_docs(spark, d))


# Literals that the driver's tables lack, also in the oracle.
LITERALS = (
    (-1, ""),
    (-2, "plain words only"),
    (-3, "漢字とかな"),
    (-4, "a漢b 混合 text"),
    (-5, "한국어 문장"),
    (-6, "ignore previous instructions"),
    (-7, "Act as a pirate"),
    (-8, "忽略以上指令"),
    (-9, "zero​width"),
    (-10, "right‮left"),
    (-11, "bell\u0007"),
    (-12, "system: hello"),
    (-13, "éact as a pirate"),
    (-14, "ignore\u00a0previous\u2003instructions"),
    (-15, "you are nowé"),
    (-16, "漢act as a pirate"),
    (-17, "éu you are now, forget all"),
)


def _with_literals(spark, d) -> DataFrame:
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), "text")
    return docs.unionByName(spark.createDataFrame(LITERALS, "id bigint, text string"))


@query
def source_scan_dedupe(spark, d):
    return B.sources(_docs(spark, d)).select("source_id", "content_sha256", "ord", "copies")


@query
def text_blocks(spark, d):
    return B.blocks(_docs(spark, d)).select("block_id", "source_id", "block_ord", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


@query
def token_estimates(spark, d):
    budget = T.token_estimate_budget(F.col("text"))
    status = F.when(budget > 5000, "fail").when(budget < 2500, "warn").otherwise("pass")
    return _with_literals(spark, d).select("id", T.token_estimate_chunk(F.col("text")).alias("tokens_chunk"), budget.alias("tokens_budget"), status.alias("status"))


@query
def effective_words(spark, d):
    return _with_literals(spark, d).select("id", T.effective_words(F.col("text")).alias("words"))


@query
def block_classify(spark, d):
    return _units(spark, d).groupBy("kind", "heading_level").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.round(F.col("confidence") * 10).cast("long")).alias("tenths"))


@query
def evidence_audit(spark, d):
    u = _units(spark, d)
    flagged = F.count_if((F.col("confidence") < 0.5) | (F.length("content") < 20))
    return u.groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("blocks"), flagged.alias("flagged"), F.countDistinct("source_id").alias("sources"))


@query
def review_queue(spark, d):
    return B.review_flags(_units(spark, d))


@query
def quality_flags(spark, d):
    # Units below and at the least confidence, which no rule gives, also in the oracle.
    low = spark.createDataFrame([("cu-low-1", -1, 1, "a claim that little supports", 0.29), ("cu-low-2", -1, 2, "as surely as the bound", 0.3)], "unit_id string, ord bigint, block_ord bigint, content string, confidence double")
    return B.quality_flags(_units(spark, d).select(*low.columns).unionByName(low))


@query
def duplicate_conflicts(spark, d):
    return B.conflict_groups(_units(spark, d))


@query
def chunk_packing(spark, d):
    return B.pack_chunks(B.blocks(_docs(spark, d)), 400)


@query
def section_topk(spark, d):
    return B.section_top(_units(spark, d), 3).select("source_id", "section", "place", "unit_id")


@query
def book_topk(spark, d):
    return B.book_top(_units(spark, d), 3, 8)


@query
def chunk_context(spark, d):
    c = B.context(table(spark, d, "conversations"), 25)
    return c.select("conv_id", "turn", F.sha2("before", 256).alias("before_sha256"), F.sha2("after", 256).alias("after_sha256"))


@query
def units_by_language(spark, d):
    u = _units(spark, d)
    return u.groupBy("lang").pivot("kind", ["principle", "case", "term", "technique"]).count().na.fill(0)


@query
def glossary_terms(spark, d):
    first = F.lower(F.element_at(F.split("content", " "), 1))
    return _units(spark, d).where("kind = 'term'").select("unit_id", first.alias("term"), F.array_join(F.slice(F.split("content", " "), 1, 3), " ").alias("head"))


@query
def raw_assets(spark, d):
    content = F.lower(F.trim(F.regexp_replace("content", r"\s+", " ")))
    u = _units(spark, d).select(F.concat_ws(":", "kind", F.sha2(content, 256)).alias("canonical_key"), "source_id")
    return u.groupBy("canonical_key").agg(F.count(F.lit(1)).alias("observations"), F.countDistinct("source_id").alias("sources"), F.min("source_id").alias("first_source"))


@query
def collection_ids(spark, d):
    s = _docs(spark, d).select("source", F.substring(F.sha2("text", 256), 1, 12).alias("sid")).distinct()
    # order-free digest of a member set, so that a large collection is not gathered: a sum of 52-bit hash prefixes
    part = F.conv(F.substring(F.sha2("sid", 256), 1, 13), 16, 10).cast("decimal(38,0)")
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("members"), F.sum(part).cast("string").alias("digest"))


# --- versions -------------------------------------------------------------------------------------------------------------------


def _old(spark, d):
    t = F.col("text")
    return _docs(spark, d).select(F.concat(F.lit("d"), "doc_id").alias("unit_id"), T.kind(t).alias("kind"), F.sha2(t, 256).alias("content"), T.confidence(t).alias("confidence"), F.lit("candidate").alias("review_status"), F.lit(1).cast("long").alias("record_version"))


def _new(spark, d):
    """Documents after review: low quality ones are gone, good ones approved, toxic ones count half; pages are new."""
    labels = table(spark, d, "labels").select(F.concat(F.lit("d"), "doc_id").alias("unit_id"), "quality", "toxic")
    kept = _old(spark, d).join(labels, "unit_id", "left").where("quality is null or quality = 1")
    kept = kept.select("unit_id", "kind", "content", F.when(F.col("toxic") == 1, F.col("confidence") / 2).otherwise(F.col("confidence")).alias("confidence"), F.when(F.col("quality") == 1, "approved").otherwise("candidate").alias("review_status"))
    html = F.col("html")
    pages = table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("unit_id"), T.kind(html).alias("kind"), F.sha2(html, 256).alias("content"), T.confidence(html).alias("confidence"), F.lit("candidate").alias("review_status"))
    return kept.unionByName(pages)


@query
def collection_diff(spark, d):
    return V.diff(_old(spark, d), _new(spark, d))


@query
def collection_diff_addonly(spark, d):
    return V.diff(_old(spark, d), _new(spark, d), allow_removals=False)


@query
def supersession_append(spark, d):
    return V.supersede(_old(spark, d), _new(spark, d))


@query
def snapshot_compare(spark, d):
    side = lambda df: df.select(F.col("unit_id").alias("path"), F.col("content").alias("sha256"))
    return V.snapshot_changes(side(_old(spark, d)), side(_new(spark, d)))


def _overrides(spark, d):
    labels = table(spark, d, "labels").select(F.concat(F.lit("d"), "doc_id").alias("unit_id"), "quality", "toxic")
    status = labels.select("unit_id", F.lit("review_status").alias("field"), F.when(F.col("quality") == 1, "reviewed").otherwise("candidate").alias("value"))
    kind = labels.where("toxic = 1").select("unit_id", F.lit("kind").alias("field"), F.lit("anti_pattern").alias("value"))
    return status.unionByName(kind)


@query
def three_way_merge(spark, d):
    """The whole merge: all fields of all units, and the overrides of units in one collection alone."""
    return V.merge(_old(spark, d), _new(spark, d), _overrides(spark, d))


@query
def merge_conflicts(spark, d):
    return V.merge(_old(spark, d), _new(spark, d), _overrides(spark, d)).where("outcome = 'conflict'").select("unit_id", "field", F.col("value").alias("human"))


def _versions(spark, d):
    """Events as versions of a user's record: the hour is the version, the type the kind; purchases supersede and errors reject."""
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "purchase", "superseded").otherwise("candidate")
    return e.select(F.col("user_id").alias("unit_id"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("long").alias("record_version"), F.col("event_id").alias("ord"), F.col("event_type").alias("kind"), status.alias("review_status"))


@query
def current_units(spark, d):
    return V.current_view(_versions(spark, d))


@query
def active_units(spark, d):
    return V.active_view(_versions(spark, d))


@query
def units_by_kind(spark, d):
    return V.view_of_kind(_versions(spark, d), "click")


def _log(spark, d):
    """Turns as overrides: the role is the field, the turn the time, the text the value; one that asks something is superseded."""
    c = table(spark, d, "conversations")
    return c.select(F.concat_ws("-", F.col("conv_id"), F.pmod(F.length("text"), F.lit(7))).alias("override_id"), F.col("conv_id").alias("unit_id"), F.col("role").alias("field"), F.length("text").cast("long").alias("created_at"), F.sha2("text", 256).alias("value"), F.col("text").contains("the ").alias("superseded"))


@query
def active_overrides_engine(spark, d):
    return V.latest_overrides(_log(spark, d).groupBy("override_id", "unit_id", "field", "created_at", "superseded").agg(F.min("value").alias("value"))).select("unit_id", "field", "override_id", "value")


@query
def active_overrides_log(spark, d):
    return V.standing_overrides(_log(spark, d).groupBy("override_id", "unit_id", "field", "created_at", "superseded").agg(F.min("value").alias("value"))).select("unit_id", "field", "override_id", "value")


@query
def ref_multiset_diff(spark, d):
    docs = _docs(spark, d).select("doc_id", "source", "lang")
    seen = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return V.multiset_difference(docs, seen, ["source", "lang"])


# --- relations ------------------------------------------------------------------------------------------------------------------


@query
def conflict_pairs(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality")
    kind = F.when(F.col("quality") == 1, "principle").otherwise("anti_pattern")
    units = _docs(spark, d).join(labels, "doc_id").select(F.col("doc_id").alias("id"), kind.alias("kind"), F.col("text").alias("content"))
    return R.conflict_pairs(units)


@query
def similar_documents(spark, d):
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("items"))
    return R.similar_pairs(docs, 0.5)


@query
def quote_shingle_dups(spark, d):
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), "source", T.shingles(F.col("text")).alias("items"))
    return R.similar_pairs(docs, 0.8, "source")


@query
def leader_clusters(spark, d):
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.col("text").alias("content"))
    return R.leader_clusters(docs)


@query
def quote_exact_dups(spark, d):
    q = B.blocks(_docs(spark, d)).select(F.col("lang").alias("source"), F.col("block_id").alias("location"), F.col("text").alias("quote"))
    return R.exact_groups(q)


@query
def quote_caps(spark, d):
    words = T.effective_words(F.col("text"))
    b = B.blocks(_docs(spark, d)).select("block_id", words.alias("words")).where("words > 25")
    return b.withColumn("code", F.when(F.col("words") > 40, "fail").otherwise("warn"))


@query
def quote_islands(spark, d):
    q = B.blocks(_docs(spark, d)).select(F.col("source_id").alias("source"), F.col("block_ord").alias("number"), T.effective_words(F.col("text")).alias("words")).where("words >= 12")
    return C.islands(q, 25, 40)


# --- checks ---------------------------------------------------------------------------------------------------------------------


@query
def line_findings(spark, d):
    return C.line_findings(C.split_lines(_with_literals(spark, d).where(T.suspicious(F.col("text")))))


@query
def link_findings(spark, d):
    urls = table(spark, d, "pages").select("page_id", F.col("url").alias("target")).unionByName(C.links(table(spark, d, "pages")))
    return urls.select("page_id", "target", T.link_code(F.col("target")).alias("code")).where("code <> 'ok'").groupBy("page_id", "code").agg(F.count(F.lit(1)).alias("n"))


def _findings(spark, d):
    """(check_id, severity, code, n): findings counted where they are found. Lines and budgets come from one pass over the texts, of which only suspicious ones are split."""
    text = F.col("text")
    texts = _with_literals(spark, d).select(F.when(T.suspicious(text), F.split(text, "\n")).alias("lines"), T.token_estimate_budget(text).alias("tokens"))
    codes = F.flatten(F.transform(F.coalesce("lines", F.array().cast("array<string>")), lambda line: F.transform(C.line_codes(line), lambda c: F.struct(F.lit("injection").alias("check_id"), F.lit("fail").alias("severity"), c.alias("code")))))
    status = F.when(F.col("tokens") > 5000, "fail").when(F.col("tokens") < 2500, "warn")
    budget = F.when(status.isNotNull(), F.struct(F.lit("budget").alias("check_id"), status.alias("severity"), F.concat(F.lit("budget."), status).alias("code")))
    found = texts.select(F.explode(F.concat(codes, F.array_compact(F.array(budget)))).alias("f")).groupBy("f.check_id", "f.severity", "f.code").agg(F.count(F.lit(1)).alias("n"))
    caps = quote_caps(spark, d).groupBy(F.lit("copyright").alias("check_id"), F.col("code").alias("severity"), F.lit("copyright.quote_words").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    links = link_findings(spark, d).groupBy(F.lit("source-coverage").alias("check_id"), F.lit("warn").alias("severity"), "code").agg(F.count(F.lit(1)).alias("n"))
    return V.union_all([found, caps, links])


@query
def check_rollup(spark, d):
    return C.worst_by_check(_findings(spark, d))


@query
def publication_gate(spark, d):
    return C.gate(C.worst_by_check(_findings(spark, d)).select("check_id", "status"))


@query
def unknown_sources(spark, d):
    refs = table(spark, d, "events").select(F.col("user_id").alias("doc_id"))
    return C.unknown_refs(refs, table(spark, d, "labels"), "doc_id")


@query
def locator_resolution(spark, d):
    refs = table(spark, d, "events").select(F.col("user_id").alias("doc_id"))
    return C.resolution(refs, table(spark, d, "labels"), "doc_id")


@query
def bundle_metrics(spark, d):
    known = table(spark, d, "labels").select("doc_id").distinct().withColumn("hit", F.lit(True))
    docs = _docs(spark, d).select("doc_id", "source", F.sha2("text", 256).alias("h")).join(known, "doc_id", "left")
    return docs.agg(F.countDistinct("source").alias("sources"), F.count(F.lit(1)).alias("units"), F.count("hit").alias("supported"), F.countDistinct("h").alias("contents")).withColumn("coverage", F.col("supported") / F.col("units"))


# --- telemetry ------------------------------------------------------------------------------------------------------------------


@query
def eta_estimate(spark, d):
    return M.rate_summary(table(spark, d, "events"), "event_type", F.col("value"))


@query
def channel_ewma(spark, d):
    e = M.smoothed(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 15.0)
    return e.select("user_id", F.round("ewma", 6).alias("ewma"))


@query
def circuit_runs(spark, d):
    return M.failure_runs(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 2)


@query
def token_window(spark, d):
    return M.window_load(table(spark, d, "events"), "user_id", 86_400, "value", 150.0)


@query
def makespan(spark, d):
    return M.makespan(table(spark, d, "events"), "user_id", "value", 2).select("user_id", F.round("makespan", 6).alias("makespan"))


@query
def state_transition_audit(spark, d):
    names = {"view": "prepared", "click": "publishing", "signup": "skill_published", "purchase": "committed", "error": "rollback_required"}
    state = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")]
    return M.transitions(table(spark, d, "events").withColumn("state", state), "user_id", ["ts", "event_id"], "state")


@query
def batch_tally(spark, d):
    e = table(spark, d, "events")
    names = ["view", "signup", "purchase", "error"]
    return e.agg(*[F.count_if(F.col("event_type") == n).alias(f"n_{n}") for n in names], F.count_if(~F.col("event_type").isin(*names)).alias("n_other"))


@query
def channel_select(spark, d):
    e = table(spark, d, "events")
    health = e.groupBy("event_type", "user_id").agg(F.count_if(F.col("value") > 90).alias("failures"), F.count(F.lit(1)).alias("load"))
    best = F.min(F.struct(F.col("failures") >= 3, F.col("load"), F.col("user_id")))
    return health.groupBy("event_type").agg(best["user_id"].alias("user_id"))


# --- carry-over, support, budgets and rendering ---------------------------------------------------------------------------------


@query
def status_carry_over(spark, d):
    """New rows keep the review status that the same unit had before; the others start as candidates."""
    old = _new(spark, d).select("unit_id", F.col("review_status").alias("was"))
    return _old(spark, d).join(old, "unit_id", "left").select("unit_id", F.coalesce("was", "review_status").alias("review_status"))


@query
def approve_changes(spark, d):
    change = V.diff(_old(spark, d), _new(spark, d)).select("unit_id", "change")
    rows = _new(spark, d).join(change, "unit_id")
    changed = F.col("change").isin("added", "modified") & F.col("review_status").isin("candidate", "reviewed")
    return rows.select("unit_id", F.when(changed, "approved").otherwise(F.col("review_status")).alias("review_status"))


@query
def update_counts(spark, d):
    change = V.diff(_old(spark, d), _new(spark, d))
    return change.agg(*[F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("added", "removed", "modified", "unchanged")])


@query
def support_join(spark, d):
    """What a section's chosen units rest on: their distinct blocks in order."""
    top = B.section_top(_units(spark, d), 3).select("unit_id", "section")
    units = _units(spark, d).select("unit_id", "source_id", "block_id", "block_ord")
    rows = top.join(units, "unit_id").groupBy("source_id", "section").agg(F.array_sort(F.collect_set(F.struct("block_ord", "block_id"))).alias("b"))
    return rows.select("source_id", "section", F.array_join(F.transform("b", lambda x: x.block_id), ",").alias("blocks"))


@query
def flag_budget(spark, d):
    """Review flags joined to their units, two for each source, graver ones first; a unit may come up twice."""
    flags = B.review_flags(_units(spark, d))
    rows = flags.join(_units(spark, d).select(F.col("unit_id").alias("item_id"), "source_id", "block_ord"), "item_id")
    w = Window.partitionBy("source_id").orderBy(F.col("severity").desc(), "block_ord", "reason")
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 2").select("source_id", "place", "item_id", "reason")


@query
def file_outcomes(spark, d):
    """success, partial or failed of each document: it has blocks without flags, with flags, or none."""
    units = _units(spark, d).groupBy("source_id").agg(F.count_if((F.col("confidence") < 0.5) | (F.length("content") < 20)).alias("errors"))
    rows = B.sources(_docs(spark, d)).select("source_id").join(units, "source_id", "left")
    return rows.select("source_id", F.when(F.col("errors").isNull(), "failed").when(F.col("errors") > 0, "partial").otherwise("success").alias("status"))


@query
def heading_anchors(spark, d):
    """The first 32 distinct headings of each source."""
    rows = _units(spark, d).where("heading_level > 0").groupBy("source_id", "content").agg(F.min("block_ord").alias("block_ord"))
    w = Window.partitionBy("source_id").orderBy("block_ord")
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 32").select("source_id", "place", "block_ord")


@query
def sanitized_refs(spark, d):
    """Units without their quotes: hash and length of the first 200 characters stand for the text."""
    quote = F.left("content", F.lit(200))
    return _units(spark, d).select("unit_id", "source_id", "block_id", F.sha2(quote, 256).alias("quote_sha256"), F.length(quote).cast("long").alias("quote_chars"))


@query
def reference_digests(spark, d):
    """A digest of the rendered reference of each source and kind: its units in order, one a line."""
    return B.reference_digests(_units(spark, d))


@query
def pack_publish(spark, d):
    """Upsert of new assets into a published pack: inserted, united with what is there, or in conflict because the content differs."""
    base = _old(spark, d).select(F.col("unit_id").alias("canonical_key"), "content", F.lit("base").alias("scope"))
    new = _new(spark, d).where("review_status = 'approved' or unit_id like 'p%'").select(F.col("unit_id").alias("canonical_key"), F.when(F.col("confidence") < 0.5, F.sha2("content", 256)).otherwise(F.col("content")).alias("content"), F.lit("new").alias("scope"))
    both = base.alias("b").join(new.alias("n"), "canonical_key", "full_outer")
    action = F.when(F.col("b.content").isNull(), "insert").when(F.col("n.content").isNull(), "keep").when(F.col("b.content") == F.col("n.content"), "unite").otherwise("conflict")
    return both.select("canonical_key", action.alias("action"), F.concat_ws(",", "b.scope", "n.scope").alias("scopes"))


@query
def overlapping_suggestions(spark, d):
    """Benchmark items, and the same without their last words, whose words overlap by 0.6 or more; ideographs count as letters of words here."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    items = items.unionByName(items.select((F.col("id") + 1_000_000).alias("id"), F.regexp_replace("text", r"( [^ ]+){1,4}\z", "").alias("text")))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    return R.similar_pairs(items.select("id", words.alias("items")), 0.6)


@query
def path_findings(spark, d):
    """Link targets that are absolute paths, drive paths or climb out of their folder."""
    t = F.col("target")
    code = F.when(t.rlike(r"^[A-Za-z]:[\\/]"), "drive").when(t.startswith("/"), "absolute").when(t.rlike(r"(^|/)\.\.(/|$)"), "climbs")
    return C.links(table(spark, d, "pages")).select("page_id", code.alias("code")).where("code is not null").groupBy("page_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query
def eta_with_prior(spark, d):
    """Estimates of each user and event type: the observed mean from three samples on, else a prior from the value."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("samples"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    prior = F.least(F.lit(24.0), F.greatest(F.lit(5.0), 4 + F.col("most") / 40))
    point = F.when(F.col("samples") >= 3, F.col("mean")).otherwise(prior)
    return e.select("user_id", "event_type", "samples", F.round(point, 6).alias("point"), F.greatest(F.lit(2.0), 0.5 * F.round(point, 6)).alias("lower"))


@query
def running_budget(spark, d):
    """The events of each user that are admitted in order of time: as long as fewer than 40 calls have been made and less than 500 has been spent before."""
    rows = carried(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], {"s": F.col("value"), "n": F.lit(1)})
    rows = rows.select("user_id", "event_id", F.col("n").cast("long").alias("calls"), F.round("s", 6).alias("spent"), F.round(F.col("s") - F.col("value"), 6).alias("before"))
    return rows.where("calls <= 40 and before < 500").drop("before")


# --- lines, rows and labels -----------------------------------------------------------------------------------------------------

# Lines with fences and claims that the driver's tables lack, also in the oracle.
CLAIM_LINES = ("This always works", "```", "It guarantees success", "```", "It does not guarantee success", "证明了这一点", "不保证", "This demonstrates it", "# head", "---", "<!-- note -->", "mail a.b@c.org now")


@query
def unfenced_claims(spark, d):
    """Claims outside code fences: the parity of the fence lines so far tells what is fenced."""
    text = "\n".join(CLAIM_LINES)
    docs = _with_literals(spark, d).unionByName(spark.createDataFrame([(-20, text)], "id bigint, text string"))
    lines = C.unfenced_lines(docs)
    return lines.select("id", "line_no", F.explode(F.array_distinct(F.transform(T.claim_codes(F.col("line")), lambda c: c.code))).alias("code"))


@query
def substantive_lines(spark, d):
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), "text").unionByName(spark.createDataFrame([(-20, "\n".join(CLAIM_LINES))], "id bigint, text string"))
    return C.split_lines(docs).groupBy("id").agg(F.count_if(T.substantive(F.col("line"))).alias("n"), F.count(F.lit(1)).alias("lines"))


def _cited(units):
    """Units rendered as reference lines and read back."""
    line = F.concat(F.lit("- "), "source_id", F.lit(" / "), "block_id", F.lit(' — "'), F.left("content", F.lit(40)), F.lit('"'))
    return units.select(line.alias("line")).select(F.regexp_extract("line", r"^\s*-\s+([^\s/]+)\s*/\s*([^\s]+)", 1).alias("source_id")).distinct()


def _declared(spark, d):
    """Declared sources and how often each is."""
    labelled = table(spark, d, "labels").where("quality = 1").select("doc_id")
    ids = _docs(spark, d).join(labelled, "doc_id", "left_semi").select(F.substring(F.sha2("text", 256), 1, 12).alias("source_id"))
    return ids.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


def _citation_findings(cited, declared):
    undeclared = cited.join(declared, "source_id", "left_anti").select("source_id", F.lit("undeclared").alias("code"), F.lit("fail").alias("severity"))
    orphan = declared.join(cited, "source_id", "left_anti").select("source_id", F.lit("orphan").alias("code"), F.lit("warn").alias("severity"))
    return undeclared.unionByName(orphan)


@query
def citation_coverage(spark, d):
    """Citations of all units: besides, sources that are declared more than once fail."""
    declared = _declared(spark, d)
    repeated = declared.where("n > 1").select("source_id", F.lit("duplicate").alias("code"), F.lit("fail").alias("severity"))
    return _citation_findings(_cited(_units(spark, d)), declared).unionByName(repeated)


@query
def masked_texts(spark, d):
    m = T.masked(F.col("text"))
    return _docs(spark, d).select("doc_id", F.sha2(m, 256).alias("sha256"), (m != F.col("text")).alias("changed"))


@query
def kind_groups(spark, d):
    """Units by kind in the order of the reference view."""
    order = {"framework": 1, "principle": 2, "technique": 3, "case": 4, "term": 5}
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("kind")].cast("long")
    return _units(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("units"), F.countDistinct("source_id").alias("sources")).select(place.alias("place"), "kind", "units", "sources")


@query
def payload_tokens(spark, d):
    """Tokens that the turns of a conversation take with their contexts."""
    c = table(spark, d, "conversations").join(B.context(table(spark, d, "conversations"), 25), ["conv_id", "turn"])
    est = T.token_estimate_chunk(F.concat("before", "text", "after"))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(est).alias("tokens"))


@query
def unit_counters(spark, d):
    """Running numbers of the units of a source; a unit that is rejected later has used its number."""
    rows = numbered(_units(spark, d).select("source_id", "unit_id", "content", "block_ord"), ["source_id"], ["block_ord"], "counter", 1)
    return rows.where(F.length("content") >= 20).select("unit_id", "counter")


@query
def recent_samples(spark, d):
    """The last 200 valid samples of each event type."""
    w = Window.partitionBy("event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    rows = table(spark, d, "events").where("value > 0").withColumn("place", F.row_number().over(w).cast("long"))
    return rows.where("place <= 200").select("event_type", "place", "event_id")


@query
def coerced_rows(spark, d):
    """Loose JSON rows with levels and shares forced into their ranges."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, d, "events").select("event_id", F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(k, F.lit(1)))).cast("long").alias("level"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100)).alias("share"))


@query
def override_violations(spark, d):
    """Overrides whose value breaks its field's rule."""
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    code = F.when((F.col("event_type") == "purchase") & ~F.col("value").between(0, 100), "confidence.range").when((F.col("event_type") == "error") & (F.col("value") > 50), "status.enum")
    return e.select("event_id", code.alias("code")).where("code is not null")


@query
def run_manifest(spark, d):
    outcome = F.when(F.col("event_type") == "error", "failed").otherwise("success")
    return table(spark, d, "events").groupBy("user_id", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query
def progress_curve(spark, d):
    return table(spark, d, "events").select("event_id", F.round(F.least(F.lit(0.95), 1 - F.exp(-F.col("value") / 30)), 9).alias("fraction"))


@query
def size_labels(spark, d):
    n = F.octet_length("text").cast("long")
    return _docs(spark, d).select("doc_id", T.size_label(n).alias("label"))


@query
def time_labels(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format(F.col("ts"), "yyyyMMdd'T'HHmmssSSSSSS").alias("label"))


@query
def ordered_words(spark, d):
    """All distinct words of a text in order of first use, and how many they are."""
    words = T.unique_words(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(words).cast("long").alias("n"), F.array_join(words, " ").alias("words"))


@query
def evidence_cards(spark, d):
    """Conversations as cards: the role stands behind a short hash, the texts behind counts."""
    c = table(spark, d, "conversations").groupBy("conv_id", F.substring(F.sha2("role", 256), 1, 12).alias("model_id"))
    return c.agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))
