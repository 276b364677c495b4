"""A corpus pipeline: documents without toxic ones, one of each group of near-duplicates, live secrets masked, mixed to weights and packed.

Each stage takes (spark, docs, sf_dir); run() writes each stage's rows as Parquet in the shared folder, reads them as
the next one's docs and removes what no later stage reads.

Cases: a null or empty text is scored from padding alone, is nobody's near-duplicate, holds no secret, is drawn with its neighbours in the mix
unless its source has no word at all, and is packed as the end token; null ids, langs and sources are values like others; rows that are repeated are one group of
near-duplicates if they have words; very long texts go through whole; extra columns of documents are dropped at the first stage; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.llm import mixing, near_dedup, packing, secret_scan, toxicity
from sedimark.llm.common import staged, unstage
from sedimark.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays under their language's threshold."""
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, labels, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by shingles of five words at a similarity of 0.8."""
    return near_dedup.keep_one(docs.select(*COLUMNS), near_dedup.NearDup())


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live credentials masked. Ownership counts over the whole table of documents, whose copies the stages before have folded."""
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return secret_scan.redact(docs.select(*COLUMNS), corpus=corpus).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole, in the shuffled order of its shards."""
    return mixing.mix_rows(docs.select(*COLUMNS), mixing.Mix(cut=False), shard_col=None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and offset."""
    return packing.pack_documents(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]
#: Training, hashing permutations and tokenizing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        unstage(before)  # documents itself was not staged and stays
    return STAGES[-1][1](spark, docs, sf_dir)
