"""Ranked retrieval: postings, weighted BM25, cosine, fusion, rescue and passage allocation."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.query import And, Or, Phrase, all_leaves, leaves

K1, B, LEAST_IDF, RRF_K = 1.2, 0.75, 1e-6, 60


@dataclass
class Index:
    """postings (term, id, col, places, n_tokens) of every row, how many rows there are and how long they are on average.

    The two numbers count all rows, also those that filters leave out later. n_tokens is the length of the posting's row.
    """

    postings: DataFrame
    rows: int
    mean: float

    @staticmethod
    def postings_of(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
        cols = rows.select(F.col(id_col).alias("id"), *(tokens(F.col(c)).alias(c) for c in columns))
        total = sum((F.size(c) for c in columns), F.lit(0)).cast("long")
        words = cols.select("id", total.alias("n_tokens"), F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("words")) for c in columns))).alias("w"))
        words = words.select("id", "n_tokens", "w.col", F.posexplode("w.words").alias("place", "term"))
        return words.groupBy("term", "id", "col").agg(F.sort_array(F.collect_list("place")).alias("places"), F.first("n_tokens").alias("n_tokens"))

    @staticmethod
    def statistics(rows: DataFrame, columns: list[str]) -> tuple[int, float]:
        total = sum((F.size(tokens(F.col(c))) for c in columns), F.lit(0))
        n, mean = rows.agg(F.count("*"), F.avg(total)).first()
        return n, float(mean or 0)


def _fits(term: Column, p: Phrase, i: int) -> Column:
    return term.startswith(p.tokens[i]) if p.prefix and i == len(p.tokens) - 1 else term == p.tokens[i]


def _weighted(weights: dict[str, float], columns: list[str], p: Phrase, count) -> Column:
    """The sum of count(column) times its weight over the columns that the phrase may stand in."""
    parts = [F.lit(float(weights.get(c, 1.0))) * count(c) for c in columns if not p.columns or c in p.columns]
    return sum(parts[1:], parts[0]) if parts else F.lit(0.0)


def _frequencies(index: Index, leaves_: list[Phrase], weights: dict[str, float]) -> DataFrame:
    """(id, n_tokens, f0, f1, ...): weighted occurrences of each leaf, from the postings of the query's terms alone."""
    wanted = F.lit(False)
    for p in leaves_:
        for i in range(len(p.tokens)):
            wanted = wanted | _fits(F.col("term"), p, i)
    hits = index.postings.filter(wanted).groupBy("id").agg(F.first("n_tokens").alias("n_tokens"), F.collect_list(F.struct("term", "col", "places")).alias("hits"))

    def places(c: str, p: Phrase, i: int) -> Column:
        return F.flatten(F.transform(F.filter("hits", lambda h: (h["col"] == c) & _fits(h["term"], p, i)), lambda h: F.transform(h["places"], lambda x: x - i)))

    def count(p: Phrase):
        def of(c: str) -> Column:
            at = places(c, p, 0)
            for i in range(1, len(p.tokens)):
                at = F.array_intersect(at, places(c, p, i))
            return F.size(F.filter(at, lambda x: x == 0) if p.first else at)

        return of

    return hits.select("id", "n_tokens", *(_weighted(weights, list(weights), p, count(p)).alias(f"f{i}") for i, p in enumerate(leaves_)))


def _scanned(rows: DataFrame, id_col: str, leaves_: list[Phrase], weights: dict[str, float], keep: tuple[str, ...]) -> DataFrame:
    """The same of all rows, read off their texts, without an index."""
    toks = rows.select(F.col(id_col).alias("id"), *keep, *(tokens(F.col(c)).alias(f"_{i}") for i, c in enumerate(weights)))
    number = {c: f"_{i}" for i, c in enumerate(weights)}

    def count(p: Phrase):
        m = len(p.tokens)

        def of(c: str) -> Column:
            t = F.col(number[c])
            if m == 1 and not p.first:
                return F.size(F.filter(t, lambda x: _fits(x, p, 0)))
            here = lambda i: F.size(F.filter(F.array(*(_fits(F.get(t, i + k), p, k) for k in range(m))), lambda y: y)) == m
            begins = F.filter(F.transform(t, lambda x, i: F.when(_fits(x, p, 0), i)), lambda i: i.isNotNull() & here(i))
            return F.size(F.filter(begins, lambda i: i == 0) if p.first else begins)

        return of

    total = sum((F.size(number[c]) for c in weights), F.lit(0)).cast("long")
    return toks.select("id", *keep, total.alias("n_tokens"), *(_weighted(weights, list(weights), p, count(p)).alias(f"f{i}") for i, p in enumerate(leaves_)))


def _scored(found: DataFrame, query, n: int, mean: float, frequency: list[int], keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, score) of the rows that match; smaller is better. Repeated terms count as often as they stand."""
    scored, distinct = leaves(query), list(dict.fromkeys(all_leaves(query)))
    score = F.lit(0.0)
    for i, p in enumerate(distinct):
        idf = math.log((n - frequency[i] + 0.5) / (frequency[i] + 0.5))
        idf, f = (LEAST_IDF if idf <= 0 else idf) * scored.count(p), F.col(f"f{i}")
        score = score + F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n_tokens") / F.lit(mean or 1.0)))

    def holds(node) -> Column:
        if isinstance(node, Phrase):
            return F.col(f"f{distinct.index(node)}") > 0
        if isinstance(node, And | Or):
            out = holds(node.parts[0])
            for p in node.parts[1:]:
                out = (out & holds(p)) if isinstance(node, And) else (out | holds(p))
            return out
        return holds(node.keep) & ~holds(node.drop)

    return found.filter(holds(query)).select("id", *keep, (-score).alias("score"))


def bm25(index: Index, query, weights: dict[str, float]) -> DataFrame:
    """(id, score) of the rows of an index that match. The terms of the query are read once, for all its leaves."""
    distinct = list(dict.fromkeys(all_leaves(query)))
    found = _frequencies(index, distinct, weights)
    frequency = found.agg(*(F.count_if(F.col(f"f{i}") > 0) for i in range(len(distinct)))).first()
    return _scored(found, query, index.rows, index.mean, list(frequency))


def bm25_rows(rows: DataFrame, id_col: str, query, weights: dict[str, float], keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, `keep`, score) of `rows` that match, without an index: one pass over the texts; what is shuffled is a few numbers a row."""
    distinct = list(dict.fromkeys(all_leaves(query)))
    found = _scanned(rows, id_col, distinct, weights, keep).persist()  # a few numbers a row; spills to disk
    n, mean, *frequency = found.agg(F.count("*"), F.avg("n_tokens"), *(F.count_if(F.col(f"f{i}") > 0) for i in range(len(distinct)))).first()
    return _scored(found, query, n, float(mean or 0), frequency, keep)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; a zero norm counts as one."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.when(dot(x, x) > 0, F.sqrt(dot(x, x))).otherwise(1.0)
    return dot(a, b) / (norm(a) * norm(b))


def ranked(rows: DataFrame, *order: Column, limit: int | None = None) -> DataFrame:
    """The first `limit` rows with their rank from 1; the window runs over what the limit leaves.

    Without a limit, rows are sorted over all partitions and numbered within them, after what stands in those before.
    """
    if limit is not None:
        return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*order)))
    placed = rows.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).persist()
    ahead, before = 0, []
    for r in placed.groupBy("_part").count().orderBy("_part").collect():  # a row for each partition
        before += [F.lit(r["_part"]), F.lit(ahead)]
        ahead += r["count"]
    start = F.element_at(F.create_map(*before), F.col("_part")) if before else F.lit(0)
    return placed.withColumn("rank", (start + F.col("_at") + 1).cast("long")).drop("_part", "_at")


def fuse(arms: DataFrame, limit: int | None = None, k: int = RRF_K) -> DataFrame:
    """(paper_id, fusion_score, rank) of arms (arm, paper_id, rank); ties go to what was seen first."""
    rows = arms.groupBy("paper_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("fusion_score"), F.min(F.struct("arm", "rank")).alias("first"))
    return ranked(rows, F.desc("fusion_score"), F.col("first"), F.col("paper_id"), limit=limit).select("paper_id", "fusion_score", "rank")


def best_per_work(scored: DataFrame, n: int = 1) -> DataFrame:
    """The best `n` passages (paper_id, id, score, ...) of each work; ties go by the kind of artifact (kind_order), if given, then by id."""
    w = W.partitionBy("paper_id").orderBy("score", *(["kind_order"] if "kind_order" in scored.columns else []), "id")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def rescue(scored: DataFrame, pool: int = 1000) -> DataFrame:
    """(paper_id, id, rank, rescue_score): the best passage of each work, cut to the pool after that, scored by rank."""
    top = ranked(best_per_work(scored).drop("place"), F.col("score"), F.col("id"), limit=pool)
    return top.withColumn("rescue_score", 1.0 / (RRF_K + F.col("rank")))


def round_robin(rows: DataFrame, budget: int) -> DataFrame:
    """Of passages (paper_id, branch, place, locator) at most `budget` a work: all first places, then all second, without repeats."""
    once = rows.groupBy("paper_id", "locator").agg(F.min(F.struct("place", "branch")).alias("s")).select("paper_id", "locator", "s.*")
    return once.withColumn("slot", F.row_number().over(W.partitionBy("paper_id").orderBy("place", "branch", "locator"))).filter(F.col("slot") <= budget)
