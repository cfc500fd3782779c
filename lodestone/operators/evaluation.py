"""Retrieval quality and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hits_at(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, n_hits, n_relevant): of each query with relevant rows. ranked: query_id, paper_id, rank; relevant: query_id, paper_id."""
    found = ranked.filter(F.col("rank") <= k).select("query_id", "paper_id").distinct().withColumn("hit", F.lit(1))
    return relevant.distinct().join(found, ["query_id", "paper_id"], "left").groupBy("query_id").agg(F.count("hit").alias("n_hits"), F.count("*").alias("n_relevant"))


def recall(hits: DataFrame) -> DataFrame:
    """The macro average over queries."""
    return hits.agg(F.round(F.avg(F.col("n_hits") / F.col("n_relevant")), 6).alias("recall"))


def hard_negative_rate(hits: DataFrame) -> DataFrame:
    """The micro average; null without hard negatives."""
    return hits.agg(F.round(F.sum("n_hits") / F.nullif(F.sum("n_relevant"), F.lit(0)), 6).alias("rate"))


def formulation_recall(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, formulation, recall): what each wording of a query finds by itself. ranked has formulation too; a wording without results counts 0."""
    wordings = ranked.select("query_id", "formulation").distinct()
    found = ranked.filter(F.col("rank") <= k).select("query_id", "formulation", "paper_id").distinct().withColumn("hit", F.lit(1))
    return wordings.join(relevant.distinct(), "query_id").join(found, ["query_id", "formulation", "paper_id"], "left").groupBy("query_id", "formulation").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def missed(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    return relevant.distinct().join(ranked.filter(F.col("rank") <= k), ["query_id", "paper_id"], "left_anti")


def nearest_rank(values: str, share: float) -> Column:
    """Aggregate: the value at ceil(share n) in order (counted by value, not gathered)."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {values})")
