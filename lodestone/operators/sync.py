"""Incremental synchronization by snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(stored: DataFrame, seen: DataFrame, key: str, change_cols: list[str]) -> DataFrame:
    """(key, change): added, replaced, removed or unchanged."""
    mark = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in change_cols)).cast("binary"), 256)
    a, b = stored.select(key, mark.alias("_old")), seen.select(key, mark.alias("_new"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("replaced")
    return a.join(b, key, "full_outer").select(key, kind.alias("change"))


def apply(stored: DataFrame, fresh: DataFrame, changes: DataFrame, key: str, failed: DataFrame | None = None) -> DataFrame:
    """The new snapshot: what is unchanged, the fresh version of what changed; a replaced row whose extraction failed keeps its old state."""
    take = changes.filter(F.col("change").isin("added", "replaced"))
    if failed is not None:
        take = take.join(failed.select(key), key, "left_anti").unionByName(take.filter("change = 'added'").join(failed.select(key), key, "left_semi"))
    keep = changes.filter("change <> 'removed'").join(take.select(key), key, "left_anti")
    return stored.join(keep.select(key), key, "left_semi").unionByName(fresh.join(take.select(key), key, "left_semi"))


def upsert(stored: DataFrame, fresh: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row with the latest `order`; of equal ones the fresh row."""
    from pyspark.sql import Window as W

    both = stored.withColumn("_side", F.lit(0)).unionByName(fresh.withColumn("_side", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order), F.desc("_side")))).filter("_n = 1").drop("_n", "_side")
