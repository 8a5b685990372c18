"""A corpus pipeline of five stages over ``documents``, each written and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, langid, minhash, mixing, secrets
from loomgraph.llm.common import bounded_broadcast, shared_dir
from loomgraph.llm.queries import tokenizer_file


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells; those it rejects go. A source of many rows needs no shuffle."""
    return langid.keep_identified(docs, langid.training_text(docs.where(~langid.held_out())))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8); of rows that share an id, the first by content. Rows without an id stay."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    ids = bounded_broadcast(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), minhash.BROADCAST_ROWS)
    once = left.join(ids, "doc_id", "left_anti").select(docs.columns)
    more = left.join(ids, "doc_id", "left_semi").select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    first = more.groupBy("doc_id").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
    return once.unionAll(first.select("row.*"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by their kinds; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole: a part taken counts as once."""
    got = mixing.mix(docs, F.array("source"), keep=tuple(docs.columns))
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    got = got.select("kept", times.alias("times")).where("times > 0")
    return got.select("kept", F.explode(F.sequence(F.lit(1), "times"))).select("kept.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and decoded text."""
    return bpe.encode_documents(docs, tokenizer_file())


STAGES = [
    ("language_id", identified),
    ("minhash_dedup", one_of_each),
    ("secret_scan", without_secrets),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: Compression and byte-pair merges aren't SQL: tests hold each stage, on what the one before kept, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/loomgraph/stage-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
