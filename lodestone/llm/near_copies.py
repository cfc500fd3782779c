"""Near copies by exact Jaccard similarity, next to the links of SimHash fingerprints.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of `LEAST` or more, or if their
fingerprints (`simhash_dedup`, 3-word shingles) differ in at most three bits. Fingerprints alone miss most texts between
0.8 and 0.95, and a wider radius over them meets too many strangers. So candidates of the first kind come from MinHash:
`BANDS` bands of `ROWS` least hashes each; a pair at similarity s shares a band with probability
``1 - (1 - s**ROWS)**BANDS`` (0.9993 at 0.8), strangers hardly ever. Texts that share a band are a bucket.

A bucket yields no pairs but a spanning forest of its verified links: from one text all texts not yet reached are
compared exactly, those linked are reached, and so on from each of them. That gives the components of comparing all
pairs, with one link a text. Equal texts are one node from the start; buckets of the same members are met once. A text
travels to each of its buckets as the set of its shingles, of whose hashes 40 bits are sent.

Defined cases: those of `simhash_dedup`; a text of fewer words than a shingle is one shingle; a text without words has
no shingles and is linked by its fingerprint only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_of_classes, pieces, settle, spread, text_hash
from .simhash_dedup import SEED, components, fingerprints_of, links, shingles
from .substring_dedup import packed, unpacked
from .token_counts import slices as parts

#: LEAST is a fraction, so that similarities compare in whole numbers.
SIZE, LEAST = 5, (4, 5)
BANDS, ROWS = 24, 6
GROUP_ROWS = 2048

_DRAWN = np.random.default_rng(SEED)
XORS = _DRAWN.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
FACTORS = _DRAWN.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def slices(texts: list[bytes | None], room: int = 1 << 19) -> Iterator[list[bytes | None]]:
    at = 0
    while at < len(texts):
        end, left = at, room
        while end < len(texts) and (left > 0 or end == at):
            left -= len(texts[end] or b"")
            end += 1
        yield texts[at:end]
        at = end


def shingle_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the shingles of all texts in a row, and how many each text has."""
    lists = [list(shingles((t or b"").lower().split(), SIZE)) for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in chain.from_iterable(lists)), np.uint64, int(counts.sum())), counts


def band_keys(texts: list[bytes | None]) -> np.ndarray:
    """(texts with words, BANDS) bucket numbers."""
    out = [np.zeros((0, BANDS), np.uint64)]
    for part in slices(texts):
        hashes, counts = shingle_hashes(part)
        counts = counts[counts > 0]
        if not len(counts):
            continue
        starts = np.cumsum(counts) - counts
        keys = np.empty((len(counts), BANDS), np.uint64)
        for b in range(BANDS):
            key = np.full(len(counts), b + 1, np.uint64)
            for i in range(b * ROWS, (b + 1) * ROWS):
                key = (key ^ np.minimum.reduceat((hashes ^ XORS[i]) * FACTORS[i], starts)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            keys[:, b] = key
        out.append(keys)
    return np.concatenate(out)


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, fp, keys) of every row: the text's hash, its fingerprint and its bucket numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in parts(b.column(2), 2 << 20):
                texts = part.to_pylist()
                has = np.fromiter((bool((t or b"").split(None, 1)) for t in texts), bool, len(texts))
                offsets = np.concatenate([[0], np.cumsum(has) * BANDS]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band_keys(texts).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), b.column(1).slice(at, len(texts)), pa.array(fingerprints_of(texts).view(np.int64)), keys], names=["id", "t", "fp", "keys"])
                at += len(texts)

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text).alias("t"), text.cast("binary").alias("x")).mapInArrow(run, "id long, t long, fp long, keys array<long>")


class Index:
    """Which of `rows` hold each shingle."""

    def __init__(self, sets: list[np.ndarray], rows: np.ndarray):
        flat, owner = np.concatenate([sets[i] for i in rows]), np.repeat(rows, [len(sets[i]) for i in rows])
        order = np.argsort(flat, kind="stable")
        self.rows, self.owner, (self.values, self.starts) = rows, owner[order], np.unique(flat[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(flat))

    def shared(self, mine: np.ndarray, n: int) -> np.ndarray:
        """For each of `n` rows the number of shingles that it shares with the set `mine`."""
        at = np.minimum(np.searchsorted(self.values, mine), len(self.values) - 1)
        at = at[self.values[at] == mine]
        starts, counts = self.starts[at], self.ends[at] - self.starts[at]
        places = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return np.bincount(self.owner[places], minlength=n)


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of `sets` (sorted, without repeats, not empty) whose similarity is `LEAST` or more."""
    n, (up, down) = len(sets), LEAST
    sizes = np.fromiter(map(len, sets), np.int64, n)
    left, out = np.ones(n, bool), []
    index = Index(sets, np.arange(n)) if n else None
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed], reached = False, [seed]
        while reached and left.any():
            i = reached.pop()
            if 2 * np.count_nonzero(left) < len(index.rows):
                index = Index(sets, np.flatnonzero(left))
            both = index.shared(sets[i], n)
            near = np.flatnonzero(left & (down * both >= up * (sizes[i] + sizes - both)))
            left[near] = False
            out += [(i, int(j)) for j in near]
            reached += near.tolist()
    return out


def near_links(docs: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """(a, b) of text hashes: links whose components are those of all pairs that share a bucket and are near enough."""
    held = settle(rows.dropDuplicates(["t"]).select("t", F.explode("keys").alias("key")))
    full = held.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("t")).alias("members"), F.min("t").alias("least")).filter("n > 1")
    met = settle(held.join(full.groupBy("n", "members", "least").agg(F.min("key").alias("key")).select("key"), "key"))

    def as_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = []
            for part in parts(b.column(1), 1 << 19):
                hashes, counts = shingle_hashes(part.to_pylist())
                sets += [packed(np.unique(s >> np.uint64(24))) for s in np.split(hashes, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["t", "s"])

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        key, ids, sets = t.column("key").to_numpy(), t.column("t").to_numpy(), list(map(unpacked, t.column("s").to_pylist()))
        cuts, found = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)), []
        for a, b in zip(cuts, cuts[1:], strict=False):
            found += [(a + i, a + j) for i, j in forest(sets[a:b])]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]]})

    text = F.col(text_col).cast("string")
    once = docs.select(text_hash(text).alias("t"), text.cast("binary").alias("x")).dropDuplicates(["t"])  # copies go before the shuffle
    wanted = once.join(met.select("t").distinct(), "t", "left_semi")
    groups = pieces(met.count(), GROUP_ROWS)
    laden = met.join(wanted.mapInArrow(as_set, "t long, s binary"), "t").withColumn("g", spread(groups, F.col("key")))
    return laden.groupBy("g").applyInArrow(compare, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_copy_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, root, component): as `simhash_classes`, without fingerprints."""
    rows = settle(described(docs, id_col, text_col))
    prints = settle(rows.groupBy("fp").agg(F.min("t").alias("first")))
    same = rows.select("fp", "t").distinct().join(prints, "fp").filter("t <> first").select(F.col("first").alias("a"), F.col("t").alias("b"))
    name = lambda end: prints.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_t"))
    close = links(prints.select("fp")).distinct().join(name("a"), "a").join(name("b"), "b").select(F.least("a_t", "b_t").alias("a"), F.greatest("a_t", "b_t").alias("b"))
    roots = components(same.union(close).union(near_links(docs, rows, text_col)))
    texts = rows.groupBy("t").agg(F.min("id").alias("least"))
    rooted = texts.join(roots.withColumnRenamed("node", "t"), "t", "left").select("t", "least", F.coalesce("root", "t").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("t", "root", "component")
    return rows.select("id", "t").join(named, "t").select("id", "t", "root", "component")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one of each component (see `first_of_classes`)."""
    return first_of_classes(docs, near_copy_classes(docs, id_col, text_col), id_col, text_col)
