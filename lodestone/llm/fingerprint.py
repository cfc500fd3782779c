"""Document fingerprints by SimHash, and the search for those within a Hamming radius, in DataFrame operations only.

The terms of a document are its pairs of adjacent lower-case words (its one word, if it has but one). A term's weight is
the number of its occurrences: each occurrence votes with the signed bits of the term's 64-bit hash, and a fingerprint
bit is one where the vote is above zero. Votes are counted sixteen bits to a lane, four lanes to a long, in blocks of
32,767 terms (so that no lane overflows) that are then added up, so a text of any length is counted whole.

`within` finds all fingerprints in a radius r by permuted block tables: the 64 bits are cut into 2 r blocks; of r
differing bits at least r blocks stay clean, so each choice of r blocks is one table whose key is those blocks brought
to the front. A pair is reported by the first table only in which it meets.

`edited_pairs` brings each document its successor in descending order of the id without one global sort: documents are
dealt into contiguous ranges of ids and sorted there. Only the last row of each range waits for the head of the next one;
these two rows a range are joined afterwards.

Defined cases: a null text is an empty text; a text without words has fingerprint zero; equal ids are ordered by the
text's hash, null ids come last, ordered likewise; one document alone is its own successor.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, settle

#: Ids are first cut at quantiles, then evenly; ranges hold about so many bytes of text; there are so many at least.
QUANTILES, RANGE_BYTES, RANGES = 64, 8 << 20, 512
BLOCK, LANES, LANE = 32_767, 0x0001000100010001, 0xFFFF


def term_hashes(words: Column) -> Column:
    n = F.size(words)
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))
    return F.when(n >= 2, pairs).otherwise(F.transform(words, lambda w: F.xxhash64(w)))


def _votes(block: Column) -> Column:
    """64 counts of set bits: place 4 k + j is for bit k + 16 j."""
    sums = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.aggregate(block, F.lit(0).cast("long"), lambda a, x: a + F.call_function("shiftrightunsigned", x, k).bitwiseAND(F.lit(LANES))))
    return F.flatten(F.transform(sums, lambda s: F.array(*(F.shiftrightunsigned(s, 16 * j).bitwiseAND(F.lit(LANE)) for j in range(4)))))


def simhash(hashes: Column) -> Column:
    """The fingerprint (long) of an array of term hashes."""
    n = F.size(hashes)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / BLOCK).cast("int") - 1, F.lit(0))), lambda q: F.slice(hashes, q * BLOCK + 1, BLOCK))
    votes = F.aggregate(blocks, F.array_repeat(F.lit(0).cast("long"), 64), lambda a, b: F.zip_with(a, _votes(b), lambda x, y: x + y))
    bits = F.transform(votes, lambda v, p: F.when(2 * v > n, F.call_function("shiftleft", F.lit(1).cast("long"), (F.floor(p / 4) + 16 * (p % 4)).cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def with_fingerprint(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """`df` with the fingerprint of a text column. Words and hashes are columns of their own, so that each is made once."""
    df = df.withColumn("_words", F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(WORD), F.lit(0)))
    return df.withColumn("_terms", term_hashes(F.col("_words"))).withColumn(name, simhash(F.col("_terms"))).drop("_words", "_terms")


def likeness(a: str, b: str) -> Column:
    """1 minus the share of differing bits."""
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / 64


def ranged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` with _tie, the text's hash, and _range: contiguous ranges in the order of the id, then (where it is null) of the tie."""
    bare, size = F.col(id_col).isNull(), F.octet_length(text_col).cast("long")
    seen = docs.agg(F.sum(size).alias("bytes"), F.sum(F.when(bare, size)).alias("bare"), F.min(id_col).alias("low"), F.max(id_col).alias("high"), F.percentile_approx(id_col, [i / QUANTILES for i in range(1, QUANTILES)], 10_000).alias("cuts")).first()
    edges = sorted({seen["low"], *(seen["cuts"] or [])} - {None})
    fine = -(-max(RANGES, (seen["bytes"] or 0) // RANGE_BYTES) // QUANTILES)
    ident, tie, last = F.col(id_col), F.xxhash64(text_col), max(1, (seen["bare"] or 0) // RANGE_BYTES)
    share = lambda of, n: F.least(F.floor(of * n), F.lit(n - 1))
    at = share(tie.cast("double") / 2.0**64 + 0.5, last) - last
    if edges:
        steps = F.array(*(F.lit(e).cast("long") for e in [*edges, min(seen["high"] + 1, (1 << 63) - 1)]))
        cut = F.size(F.filter(steps, lambda e: e <= ident))
        low, high = (F.coalesce(F.get(steps, i), ident).cast("double") for i in (cut - 1, cut))
        at = F.when(ident.isNotNull(), cut * fine + share(F.when(high > low, (ident.cast("double") - low) / (high - low)).otherwise(0.0), fine)).otherwise(at)
    return docs.withColumn("_range", at.cast("long")).withColumn("_tie", tie)


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(id, n_chars, edited_text, edited_sha256, fp, edited_fp, next_fp) of every row; see the module's text. The text is left out on demand."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = ranged(with_fingerprint(own, "text", "fp"), "id", "text")
    kept = ["id", "n_chars", *(["edited_text"] if keep_text else []), "edited_sha256", "fp", "edited_fp", "next_fp"]

    def edited(rows: DataFrame) -> DataFrame:
        n = F.col("n_chars")
        cut = F.floor(n / 3).cast("int")
        rows = rows.withColumn("edited_text", F.concat(F.substr("text", F.lit(1), (n - cut).cast("int")), F.substr("next_text", F.lit(1), cut)))
        return with_fingerprint(rows, "edited_text", "edited_fp").withColumn("edited_sha256", F.sha2(F.col("edited_text").cast("binary"), 256))

    w = W.partitionBy("_range").orderBy(F.desc_nulls_last("id"), F.desc("_tie"))
    rows = own.withColumns({"next_text": F.lead("text").over(w), "next_fp": F.lead("fp").over(w), "_n": F.row_number().over(w)})
    rows = edited(rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("_head", F.col("_n") == 1).withColumn("_end", F.col("next_fp").isNull()))
    rows = settle(rows.select(*kept, "_range", "_head", "_end", F.when(F.col("_head") | F.col("_end"), F.col("text")).alias("text")))
    # The last row of a range is followed by the head of the next range below, the very last by the very first.
    heads = rows.filter("_head").select(F.col("_range").alias("_of"), F.col("text").alias("next_text"), F.col("fp").alias("next_fp"))
    below = heads.select("_of").select(F.col("_of").alias("_range"), F.coalesce(F.lead("_of").over(W.orderBy(F.desc("_of"))), F.max("_of").over(W.partitionBy())).alias("_of"))
    ends = rows.filter("_end").select("id", "n_chars", "fp", "text", "_range").join(below, "_range").join(heads, "_of")
    return rows.filter("NOT _end").select(kept).unionByName(edited(ends).select(kept))


def within(fps: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """(query_fp, fp, distance): all distinct fingerprints of `fps` (fp) at most `radius` bits from those of `queries` (fp)."""
    n = max(2, 2 * radius)
    ends = [64 * i // n for i in range(n + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(ends, ends[1:], strict=False)]
    long = lambda x: F.lit(x - (1 << 64) if x >> 63 else x)
    tables = [sum(masks[i] for i in c) for c in combinations(range(n), n - radius)]
    keyed = lambda df, name: df.select(F.col("fp").alias(name)).distinct().select(name, F.posexplode(F.array(*(F.col(name).bitwiseAND(long(t)) for t in tables))).alias("table", "key"))
    differ = F.col("q").bitwiseXOR(F.col("f"))
    first = F.coalesce(*(F.when(differ.bitwiseAND(long(t)) == 0, F.lit(i)) for i, t in enumerate(tables)))
    met = keyed(queries, "q").join(keyed(fps, "f"), ["table", "key"]).filter((F.bit_count(differ) <= radius) & (first == F.col("table")))
    return met.select(F.col("q").alias("query_fp"), F.col("f").alias("fp"), F.bit_count(differ).alias("distance"))
