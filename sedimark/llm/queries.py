"""The queries opN_<name> over whole tables and, where SQL can tell their rows, the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, fingerprint, importance, mixing, mpegts, near_dedup, packing, secret_scan, sharding, toxicity, url_filter, warc
from .common import staged


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.place_draws(mixing.mix_plan(_read(spark, sf_dir, "documents")))
    shards = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d.epoch, d.shard, d.words, d.position)), ",")
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", shards.alias("draws"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")
    plain = lambda c: F.transform(c, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))
    wide = F.filter("live", lambda s: s.kind == 3)
    return found.select(
        F.col("id").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.spell(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.spell(F.concat(plain("base"), wide)).alias("spans"),
        F.col("n_live").cast("long").alias("n_live"),
        F.col("n_copied").cast("long").alias("n_copied"),
    )


def op3_shard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(_read(spark, sf_dir, "documents"), 24)
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels)
    scored = staged(toxicity.score(docs, model, lang_col="lang"), "scored")
    flagged = toxicity.flagged(scored, toxicity.thresholds(scored, labels, model), "flagged")
    held_out = F.coalesce(toxicity.fold(F.col("id")) == 0, F.lit(False))
    return flagged.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("flagged").cast("int").alias("flagged"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(_read(spark, sf_dir, "pages"), url_filter.LISTED + url_filter.GENERAL)
    listed = F.col("rule").isin(*[r.name for r in url_filter.LISTED])
    return judged.select(F.col("id").alias("page_id"), "host", "path", F.when(listed, F.col("rule")).alias("rule"), "verdict")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(_read(spark, sf_dir, "pages")))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), near_dedup.NearDup(words=4)).withColumnRenamed("id", "doc_id")


def op9_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.read_media(mpegts.write_media(_read(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op12_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_read(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op13_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_secret_scan, op3_shard_groups, op4_fingerprint, op5_toxicity, op6_url_filter, op7_warc, op8_near_dedup, op9_transport_stream, op10_pack, op11_importance, op12_bpe_words, op13_align_tokenizers)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '/{path}')"


def _like(glob: str) -> str:
    """A glob as an SQL pattern with the escape character !."""
    return "'" + "".join({"*": "%", "%": "!%", "_": "!_", "!": "!!", "'": "''"}.get(c, c) for c in glob) + "' ESCAPE '!'"


def _general(glob: str) -> str:
    host, slash, path = glob.partition("/")
    return f"('.' || host) LIKE {_like(f'*.{host}')}" + (f" AND path LIKE {_like(f'/{path}')}" if slash else "")


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


_BY_LENGTH = sorted(url_filter.LISTED, key=lambda r: (-r.rank, r.name))
ORACLES: dict[str, str] = {
    "op6_url_filter": f"""WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
 r AS (SELECT *, CASE {' '.join(f"WHEN {_fits(r.name)} THEN '{r.name}'" for r in _BY_LENGTH)} END AS rule FROM h)
 SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{r.name}' THEN '{r.action}'" for r in _BY_LENGTH)} WHEN host = '' OR {' OR '.join(_general(r.name) for r in url_filter.GENERAL)} THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op7_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
 r AS (SELECT *, CASE WHEN n >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY h) THEN max(page_id) OVER (PARTITION BY h) END AS refers_to FROM p)
 SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r""",
    "op11_importance": f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS w FROM documents), t AS MATERIALIZED (SELECT {_words('text')} AS w FROM benchmark),
 u AS MATERIALIZED (SELECT r, unnest(w) AS f FROM d), v AS MATERIALIZED (SELECT unnest(w) AS f FROM t),
 k AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(1, octet_length(encode(f)) + 1), lambda i: ('0x' || substr(hex(f), 2 * i::INT - 1, 2))::BIGINT),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS b FROM (SELECT f FROM u UNION SELECT f FROM v)),
 s AS (SELECT b, count(*) AS n FROM u JOIN k USING (f) GROUP BY b), q AS (SELECT b, count(*) AS n FROM v JOIN k USING (f) GROUP BY b),
 g AS MATERIALIZED (SELECT b, floor(1000 * ln((coalesce(q.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM u) + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM v) + 10000))))::BIGINT AS gain FROM (SELECT DISTINCT b FROM k) LEFT JOIN s USING (b) LEFT JOIN q USING (b)),
 m AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM u JOIN k USING (f) JOIN g USING (b) GROUP BY r),
 z AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN m USING (r)),
 o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS fit FROM z)
 SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= fit * 10 // 100 THEN place END AS rank FROM o""",
    "op8_near_dedup": f"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] for i in range(1, len(w) - 2)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM t),
 e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
 links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
 reach AS (SELECT doc_id AS id, doc_id AS m FROM documents UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.m = l.a),
 c AS (SELECT id, min(m) AS component_id FROM reach GROUP BY id)
 SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.id = s.doc_id""",
}
