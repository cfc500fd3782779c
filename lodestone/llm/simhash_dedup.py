"""SimHash near-duplicate groups by multi-index hashing.

A fingerprint is cut into two 32-bit segments. Two fingerprints that differ in at most three bits differ in at most one
bit in one of the segments, so every link is met by probing, for each segment, the table of exact segment values with
the small Hamming ball of radius one around the own value; the complete distance is then verified. A ball is enumerated
upwards only (a zero bit set to one), which meets each pair from one of its two ends. Links connect distinct
fingerprints; equal ones are one class from the start, so groups of copies yield no pairs, and the join returns verified
links alone. Connected components come from alternating large-star and small-star rounds over the links, each settled
in the shared checkpoint folder; documents without a link take no part in the rounds.

Defined cases: a null or empty text (or one without words) has fingerprint zero, linked like any other; a text of fewer
words than a shingle is one shingle; repeated rows and repeated ids are kept, each with its row's result; a row with a null
id gets its text's class but never names one (a class of null ids only has a null component).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_of_classes, settle, text_hash
from .token_counts import slices

SEED = 42
LANES = np.uint64(0x0101010101010101)


def shingles(words: list[bytes], size: int = 3) -> list[bytes] | Iterator[bytes]:
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of `counts` hashes, the bits set in over half of them.

    Eight passes add up eight byte-wide lanes each, in blocks of at most 255 hashes so that no lane overflows.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    starts = np.cumsum(n) - n
    blocks = -(-n // 255)
    of = np.repeat(np.arange(len(n)), blocks)
    first = np.cumsum(blocks) - blocks
    cuts = starts[of] + 255 * (np.arange(len(of)) - first[of])
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & LANES, cuts)
        lanes = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for j in range(8):  # lane j holds bit 8 j + k (little endian)
            out[full] |= (2 * lanes[:, j] > n).astype(np.uint64) << np.uint64(8 * j + k)
    return out


def fingerprints_of(texts: list[bytes | None], size: int = 3) -> np.ndarray:
    """The 64-bit fingerprints of UTF-8 texts, in slices of about 2 MB of text."""
    out, at = [], 0
    while at < len(texts):
        end, room = at, 2 << 20
        while end < len(texts) and (room > 0 or end == at):
            room -= len(texts[end] or b"")
            end += 1
        lists = [list(shingles((t or b"").lower().split(), size)) for t in texts[at:end]]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in chain.from_iterable(lists)), np.uint64, int(counts.sum()))
        out.append(majority_bits(hashes, counts))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, t, fp) of every row: fp is a long that holds the 64 bits, t the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.concatenate([np.zeros(0, np.uint64), *(fingerprints_of(part.to_pylist(), size) for part in slices(b.column(2), 2 << 20))]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["id", "t", "fp"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(F.col(text_col)).alias("t"), F.col(text_col).cast("string").cast("binary").alias("x"))
    return own.mapInArrow(run, "id long, t long, fp long")


def links(classes: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b) for distinct fingerprints `classes` (fp) at most `radius` (up to 3) bits apart; a < b, repeats possible."""
    if not 0 <= radius <= 3:
        raise ValueError("two segments with balls of radius one find at most three differing bits")
    at = ["(fp & 4294967295L)", "shiftrightunsigned(fp, 32)"]
    exact = ", ".join(f"{at[s]} | {s << 32}L" for s in (0, 1))
    ball = ", ".join(f"transform(filter(sequence(0, 31), i -> ({at[s]} & shiftleft(1L, i)) = 0), i -> {at[s]} | shiftleft(1L, i) | {s << 32}L)" for s in (0, 1))
    held = classes.selectExpr("fp", f"explode(array({exact})) AS key")
    probes = held.selectExpr("fp", "key", "false AS moved").union(classes.selectExpr("fp", f"explode(concat({ball})) AS key", "true AS moved"))
    near = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("h.fp"))).between(1, radius) & (F.col("p.moved") | (F.col("p.fp") < F.col("h.fp")))
    met = probes.alias("p").join(held.alias("h"), (F.col("p.key") == F.col("h.key")) & near)
    return met.select(F.least("p.fp", "h.fp").alias("a"), F.greatest("p.fp", "h.fp").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the smallest node of each component of `edges` (a, b), for every node but the roots."""
    edges = settle(edges.filter("a <> b").distinct())
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), F.col("b")).filter("a <> b").distinct()
        down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        edges = settle(down.join(least, "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).filter("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3) -> DataFrame:
    """(id, t, fp, root, component): every row with its text's hash, its fingerprint, what tells its class from all others (ids may
    repeat) and the smallest id that links reach from it."""
    fps = settle(fingerprints(docs, id_col, text_col, size))
    classes = settle(fps.groupBy("fp").agg(F.min("id").alias("rep")))
    roots = components(links(classes.select("fp"), radius))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component")), "root").select("fp", "root", "component")
    return fps.join(named, "fp").select("id", "t", "fp", "root", "component")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one of each component (see `first_of_classes`)."""
    return first_of_classes(docs, simhash_classes(docs, id_col, text_col), id_col, text_col)
