"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again by the next.

1. quality classifier: rows scored under 0.3 go.
2. SimHash near-dedup: of each class of linked documents the one with the smallest id stays. Links are fingerprints three
   bits apart or fewer, and texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
3. secret scans: each span found is masked; n_chars follows.
4. mixing: each document is taken as often as systematic sampling towards its source's target says.
5. BPE: the ids of each text, and whether they decode to it.

Defined cases are those of the operators; every stage takes empty input and keeps null ids, sources and texts. Columns of
`documents` beyond these five go in the first stage. Of rows that repeat an id and text, near-dedup keeps one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe_codec, mixing, near_copies, quality, secrets
from lodestone.llm.common import table
from lodestone.llm.queries import tokenizer_path
from lodestone.llm.warc import archive_place

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, net, keep=tuple(COLUMNS)).filter(F.col("score") >= LEAST_SCORE).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs).select(COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokens = bpe_codec.round_trip(docs, tokenizer_path("byte_bpe_50k.json"), keep=("source", "n_chars"))
    return tokens.select("doc_id", "source", "n_chars", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids", "whole")


STAGES = [("quality classifier", keep_good), ("SimHash near-dedup", drop_near_copies), ("secret scans", mask_secrets), ("mixing to target weights", mix_sources), ("BPE encoding", encode)]

#: The classifier, fingerprints and encoding are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, place = table(spark, sf_dir, "documents"), archive_place(spark)
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{i}")
        docs = spark.read.parquet(f"{place}/{i}")
    return docs
