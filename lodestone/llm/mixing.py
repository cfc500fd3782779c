"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source is given a target of words: the sources, by code point with null last, weigh as `weights` in repetition and
share `share` times all words; none takes more than `most` times its own words, and what is above is shared again by
weight. That fixed point is computed in closed form: with sources sorted by limit per weight, the level
``(all - limits before) / (weights from here on)`` is largest exactly where limits stop to bind.

A document's expected number of copies is its source's target over its source's words. Systematic sampling adds these up
within the source, from one offset drawn for the source, and takes a document once for each integer that its step
crosses. As the step is the same for all documents of a source, the prefix sum is the step times the document's number;
numbers come from two levels, so that no source meets in one task: documents are dealt into strata by (source, size
class, hash of the id), strata are counted and numbered in this order, and documents are numbered within strata. Sorting
by size class keeps the taken words close to the target. The offset and the hash are taken from MD5, so reruns agree.

Defined cases: a null or empty text has size 0 and may be taken at no cost; a null source is a source, the last; rows of
one id are documents of their own; a source without words has target 0; ties in size go by the id's hash; the caller's
columns travel in one struct, so that none clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, settle

#: Strata of a (source, size class), and the rows that a stratum has at most on average.
SALTS, STRATUM_ROWS = 32, 1_000_000
KEYS = ["_source", "_class", "_salt"]


def sized(docs: DataFrame, carry: tuple[str, ...] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc, id, source, size): the columns `carry` of `docs` (all, if None) as one struct, and the number of words of the text."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.struct(*(f"`{c}`" for c in carry or docs.columns)).alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))


def _md5_number(value: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, digits), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """`sources` (source, source_size) with the column target. The windows run over one row a source."""
    whole, order = W.partitionBy(), W.orderBy(F.col("_source").isNull(), "_source")
    s = sources.withColumn("_n", F.row_number().over(order)).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_n") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_limit", most * F.col("source_size"))
    before = W.orderBy(F.col("_limit") / F.col("_w"), "_n").rowsBetween(W.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    s = s.withColumn("_level", level)
    return s.withColumn("target", F.least("_limit", F.max("_level").over(whole) * F.col("_w"))).drop("_n", "_w", "_limit", "_level")


def mix(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc, id, source, size, source_size, target, copies) of `rows` (see `sized`)."""
    cols = rows.columns
    rows = rows.withColumn("_source", F.col("source"))
    salts = max(SALTS, -(-rows.count() // STRATUM_ROWS))
    low = F.greatest(F.length(F.bin("size")) - 3, F.lit(0))  # a size class: sizes with the same three leading bits
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    rows = rows.withColumn("_class", F.call_function("shiftleft", F.call_function("shiftright", F.col("size"), low), low)).withColumn("_hash", F.md5(key.cast("binary")))
    rows = rows.withColumn("_salt", (_md5_number(key, 8) % salts).cast("int"))
    strata = settle(rows.groupBy(*KEYS).agg(F.count("*").alias("_rows"), F.sum("size").alias("_words")))
    plan = targets(strata.groupBy("_source").agg(F.sum("_words").alias("source_size")), weights, share, most)
    drawn = _md5_number(F.concat(F.lit("mix:"), F.coalesce("_source", F.lit(""))), 8) / F.lit(4294967296.0)
    plan = plan.withColumn("_step", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("_drawn", drawn)
    ahead = W.partitionBy("_source").orderBy("_class", "_salt").rowsBetween(W.unboundedPreceding, -1)
    numbered = strata.withColumn("_ahead", F.coalesce(F.sum("_rows").over(ahead), F.lit(0))).drop("_rows", "_words")
    numbered = numbered.join(plan.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    numbered = numbered.select(*[F.col(k).alias(f"{k}_") for k in KEYS], "_ahead", "source_size", "target", "_step", "_drawn")
    own = W.partitionBy(*KEYS).orderBy("size", "_hash")
    rows = rows.withColumn("_n", F.row_number().over(own)).join(numbered, F.col("_source").eqNullSafe(F.col("_source_")) & (F.col("_class") == F.col("_class_")) & (F.col("_salt") == F.col("_salt_")))
    n = F.col("_ahead") + F.col("_n")
    copies = F.floor(F.col("_drawn") + n * F.col("_step")) - F.floor(F.col("_drawn") + (n - 1) * F.col("_step"))
    return rows.withColumn("copies", copies.cast("long")).select(*cols, "source_size", "target", "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    rows = mix(sized(docs, None, id_col, text_col, source_col)).filter("copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
