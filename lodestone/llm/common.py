"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: One word of a text: a run of bytes other than space, \t, \n, \v, \f and \r. ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Compute `df` once into the shared checkpoint folder and cut its lineage there.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset in a local session, as in tests, a
    temporary folder is taken. On a cluster the setting is needed: executors do not share a folder of the driver's.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def first_of_classes(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` that stay, by their `classes` (id, t, root, component; t is the text's hash, as `text_hash` gives it).

    Of each class one row stays: that of the smallest id, of those the smallest text hash, of those the smallest hash of
    the whole row. Rows of one id with texts of different classes are documents of their own. Rows with a null id stay:
    nothing tells them from one another.
    """
    keep = classes.filter("id = component").groupBy("root", "component").agg(F.min("t").alias("_kept_t")).select(F.col("component").alias("_kept_id"), "_kept_t")
    own = docs.select(F.struct("*").alias("_doc"), F.col(id_col).cast("long").alias("_id"), text_hash(F.col(text_col)).alias("_t"))
    plain = [F.col(f"_doc.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    kept = own.join(keep, (F.col("_id") == F.col("_kept_id")) & (F.col("_t") == F.col("_kept_t")), "left_semi")
    kept = kept.withColumn("_n", F.row_number().over(W.partitionBy("_id", "_t").orderBy(F.xxhash64(*plain)))).filter("_n = 1")
    return kept.select("_doc.*").union(docs.filter(F.col(id_col).isNull()))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of text in all rows (one aggregate; used only to choose numbers of groups)."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0)


def pieces(total: int, each: int, least: int = 64) -> int:
    """How many groups of about `each` make up `total`."""
    return max(least, math.ceil(total / each))


def spread(n: int, *cols: Column) -> Column:
    """A group number in [0, n) from the columns' hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
