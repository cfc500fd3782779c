"""Removal of passages that also stand in an earlier document, found through difference-cover anchors.

Two occurrences of one window of `window` words share, whatever their positions, an offset below `PERIOD` at which both
stand on a cover position (the residues `COVER` modulo `PERIOD` hold every difference). So only the short grams of
``window - PERIOD + 1`` words at cover positions are hashed and matched across documents (first round); a gram met in
two documents is an anchor, and only windows that hold an anchor are extended to their whole length and matched by a
96-bit hash (second round). Everything is exact but for hash collisions.

Documents are dealt by a hash of their id into groups of some megabytes. A group sends each hash once, packed with its
neighbours of the same hash range into one binary row, so what one very common passage costs grows with the number of
groups, not of documents. Windows are judged on the input, not on what is left.

Groups and hash ranges grow with the square root of the input, from 4 to 64 MB, so that a packet holds many keys. Keys have
64 bits, of which 40 are sent; that bounds the input at some 10**15 bytes, beyond which the operator refuses.

Defined cases: a null or empty text has no words; a text shorter than a window loses nothing; equal windows within one
document, or in rows of the same id, do not remove each other; a row with a null id keeps all its words and removes none.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, spread, text_bytes

#: A perfect difference set: its differences are all residues modulo seven.
PERIOD, COVER = 7, (0, 1, 3)
LEAST_BYTES, MOST_BYTES, KEY_BITS = 4 << 20, 64 << 20, 40
C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def grams(words: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    """The hash of the `size` words from each place on, as if all words were one text."""
    m = max(0, len(words) - size + 1)
    out = np.zeros(m, np.uint64)
    for k in range(size):
        out = out * factor + words[k : k + m]
    return mixed(out)


class Group:
    """The documents of one group, their words hashed in one array."""

    def __init__(self, t: pa.Table, window: int):
        self.window = window
        self.ids = t.column("id")
        self.lists = [(b or b"").split() for b in t.column("t").to_pylist()]
        self.counts = np.fromiter(map(len, self.lists), np.int64, len(self.lists))
        self.total = int(self.counts.sum())
        self.starts = np.cumsum(self.counts) - self.counts
        self.words = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(self.lists)), np.uint64, self.total)
        named = np.array(self.ids.is_valid().to_pylist(), bool) if len(self.lists) else np.zeros(0, bool)
        of = np.repeat(np.arange(len(self.lists)), self.counts)
        self.place = np.arange(self.total) - self.starts[of]
        self.whole = (self.place + window <= self.counts[of]) & named[of]  # a window begins here
        self.long = (self.counts[of] >= window) & named[of]
        self.id = np.array(self.ids.fill_null(0).to_pylist(), np.int64)[of] if self.total else np.zeros(0, np.int64)
        self.left = self.counts[of] - self.place

    def anchors(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys (bucket and 40 bits) of the grams at cover positions."""
        size = self.window - PERIOD + 1
        h = grams(self.words, size, C1)
        ok = np.isin(self.place[: len(h)] % PERIOD, COVER) & (self.left[: len(h)] >= size) & self.long[: len(h)]
        at = np.flatnonzero(ok)
        return at, h[at] >> np.uint64(64 - bits - KEY_BITS)


def packed(keys: np.ndarray) -> bytes:
    """The low 40 bits of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) * 8 // KEY_BITS, 8), np.uint8)
    out[:, : KEY_BITS // 8] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BITS // 8)
    return out.view("<u8").reshape(-1)


def firsts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def send_anchors(bits: int, window: int):
    def run(t: pa.Table) -> pa.Table:
        g = Group(t, window)
        at, keys = g.anchors(bits)
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], g.id[at[order]]
        f = firsts(keys)
        many = np.minimum.reduceat(ids, f) != np.maximum.reduceat(ids, f) if len(f) else np.zeros(0, bool)
        keys = keys[f]
        buckets = (keys >> np.uint64(KEY_BITS)).astype(np.int64)
        cuts = firsts(buckets)
        ends = np.append(cuts[1:], len(keys)) if len(cuts) else cuts
        rows = [(int(buckets[a]), packed(keys[a:b]), np.packbits(many[a:b]).tobytes()) for a, b in zip(cuts, ends, strict=True)]
        grp = t.column("grp")[0].as_py()
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "grp": pa.array([grp] * len(rows), pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary()), "many": pa.array([r[2] for r in rows], pa.binary())})

    return run


def met_anchors(t: pa.Table) -> pa.Table:
    """Of one hash range, the keys that stand in two documents, told to each group that sent them."""
    keys = [unpacked(x) for x in t.column("keys").to_pylist()]
    many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)).astype(bool) for m, k in zip(t.column("many").to_pylist(), keys, strict=True)])
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    f = firsts(flat[order])
    runs = np.diff(np.append(f, len(flat)))
    hit = np.empty(len(flat), bool)
    hit[order] = np.repeat((runs > 1) | np.logical_or.reduceat(many[order], f), runs)
    parts = [(g, packed(k[h])) for g, k, h in zip(t.column("grp").to_pylist(), keys, np.split(hit, np.cumsum(sizes)[:-1]), strict=True) if h.any()]
    bucket = t.column("bucket")[0].as_py()
    return pa.table({"grp": pa.array([p[0] for p in parts], pa.int32()), "bucket": pa.array([bucket] * len(parts), pa.int32()), "keys": pa.array([p[1] for p in parts], pa.binary())})


def send_windows(bits: int, window: int, buckets: int):
    def run(docs: pa.Table, met: pa.Table) -> pa.Table:
        empty = pa.table({n: pa.array([], k) for n, k in (("bucket", pa.int32()), ("grp", pa.int32()), ("h", pa.binary()), ("g", pa.binary()), ("id", pa.binary()), ("many", pa.binary()))})
        if not docs.num_rows or not met.num_rows:
            return empty
        g = Group(docs, window)
        at, keys = g.anchors(bits)
        known = np.concatenate([unpacked(k) | (np.uint64(b) << np.uint64(KEY_BITS)) for b, k in zip(met.column("bucket").to_pylist(), met.column("keys").to_pylist(), strict=True)])
        marks = np.zeros(g.total + PERIOD + 1, np.int64)
        marks[at[np.isin(keys, known)] + 1] = 1
        marks = np.cumsum(marks)
        begin = np.arange(g.total)
        cand = np.flatnonzero(g.whole & (marks[begin + PERIOD] > marks[begin]))
        if not len(cand):
            return empty
        h, second, ids = grams(g.words, window, C1)[cand], grams(mixed(g.words), window, C2)[cand].astype(np.uint32), g.id[cand]
        order = np.lexsort((ids, second, h))
        h, second, ids = h[order], second[order], ids[order]
        f = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (second[1:] != second[:-1])]))
        last = np.append(f[1:], len(h)) - 1
        h, second, low, many = h[f], second[f], ids[f], ids[last] != ids[f]
        of = (mixed(h) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        cuts = firsts(of[order])
        rows = [(int(of[o[0]]), h[o].tobytes(), second[o].tobytes(), low[o].tobytes(), np.packbits(many[o]).tobytes()) for o in np.split(order, cuts[1:])]
        grp = docs.column("grp")[0].as_py()
        cols = {"bucket": pa.array([r[0] for r in rows], pa.int32()), "grp": pa.array([grp] * len(rows), pa.int32())}
        return pa.table(cols | {n: pa.array([r[i] for r in rows], pa.binary()) for i, n in enumerate(("h", "g", "id", "many"), 1)})

    return run


def met_windows(t: pa.Table) -> pa.Table:
    """Of one hash range, the windows in two documents, each with the smallest id, told to each group that sent them."""
    read = lambda name, kind: [np.frombuffer(x, kind) for x in t.column(name).to_pylist()]
    hs = read("h", np.uint64)
    sizes = np.fromiter(map(len, hs), np.int64, len(hs))
    h, second, ids = np.concatenate(hs), np.concatenate(read("g", np.uint32)), np.concatenate(read("id", np.int64))
    many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n).astype(bool) for m, n in zip(t.column("many").to_pylist(), sizes, strict=True)])
    order = np.lexsort((ids, second, h))
    a, b = h[order], second[order]
    f = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    runs = np.diff(np.append(f, len(a)))
    low, hit = np.empty(len(a), np.int64), np.empty(len(a), bool)
    low[order] = np.repeat(ids[order][f], runs)
    hit[order] = np.repeat(runs > 1, runs)
    hit = (hit & (low < ids)) | many  # the group that holds the first one needs nothing
    ends = np.cumsum(sizes)
    parts = [(g, np.flatnonzero(hit[e - n : e]) + e - n) for g, e, n in zip(t.column("grp").to_pylist(), ends, sizes, strict=True)]
    parts = [(g, k) for g, k in parts if len(k)]
    return pa.table({"grp": pa.array([g for g, _ in parts], pa.int32()), "h": pa.array([h[k].tobytes() for _, k in parts], pa.binary()), "g": pa.array([second[k].tobytes() for _, k in parts], pa.binary()), "id": pa.array([low[k].tobytes() for _, k in parts], pa.binary())})


def cut(window: int):
    def run(docs: pa.Table, met: pa.Table) -> pa.Table:
        g = Group(docs, window)
        gone = np.zeros(g.total + 1, np.int64)
        if met.num_rows:
            h = np.concatenate([np.frombuffer(x, np.uint64) for x in met.column("h").to_pylist()])
            second = np.concatenate([np.frombuffer(x, np.uint32) for x in met.column("g").to_pylist()])
            low = np.concatenate([np.frombuffer(x, np.int64) for x in met.column("id").to_pylist()])
            order = np.lexsort((second, h))
            h, second, low = h[order], second[order], low[order]
            begin = np.flatnonzero(g.whole)
            own = grams(g.words, window, C1)[begin]
            at = np.searchsorted(h, own)
            maybe = np.flatnonzero((at < len(h)) & (h[np.minimum(at, len(h) - 1)] == own))
            begin, own, at = begin[maybe], own[maybe], at[maybe]
            check = grams(mixed(g.words), window, C2)[begin].astype(np.uint32)
            found = np.zeros(len(begin), bool)
            while len(at):  # equal first halves stand side by side
                live = at < len(h)
                live[live] = h[at[live]] == own[live]
                if not live.any():
                    break
                hit = np.flatnonzero(live)
                hit = hit[second[at[hit]] == check[hit]]
                found[hit] |= low[at[hit]] < g.id[begin[hit]]
                at = np.where(live, at + 1, len(h))
            np.add.at(gone, begin[found], 1)
            np.add.at(gone, begin[found] + window, -1)
        stay = np.cumsum(gone)[: g.total] == 0
        texts, removed = [], []
        for words, a, n in zip(g.lists, g.starts, g.counts, strict=True):
            keep = stay[a : a + n]
            k = int(keep.sum())
            removed.append(int(n) - k)
            texts.append(b" ".join(words if k == n else [w for w, x in zip(words, keep, strict=True) if x]))
        return pa.table({"id": pa.array(g.ids.to_pylist(), pa.int64()), "n_words": pa.array(g.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(texts, pa.binary())})

    return run


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """(id, n_words, n_removed, kept_text) of every row; see the module's text. `window` is 7 words at least."""
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    size = text_bytes(docs, text_col)
    each = min(MOST_BYTES, max(LEAST_BYTES, int((570 * size) ** 0.5)))  # a hundred keys a packet as long as that allows
    groups = pieces(size, each)
    bits = (pieces(size * 2 // 5, each) - 1).bit_length()
    if bits + KEY_BITS > 64:
        raise ValueError(f"{size} bytes need {bits + KEY_BITS} bits of a 64-bit hash")
    ident = F.col(id_col).cast("long")
    own = docs.select(ident.alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"), spread(groups, F.coalesce(ident, F.xxhash64(text_col))).alias("grp"))
    sent = own.groupBy("grp").applyInArrow(send_anchors(bits, window), "bucket int, grp int, keys binary, many binary")
    met = sent.groupBy("bucket").applyInArrow(met_anchors, "grp int, bucket int, keys binary")
    sent = own.groupBy("grp").cogroup(met.groupBy("grp")).applyInArrow(send_windows(bits, window, 1 << bits), "bucket int, grp int, h binary, g binary, id binary, many binary")
    met = sent.groupBy("bucket").applyInArrow(met_windows, "grp int, h binary, g binary, id binary")
    out = own.groupBy("grp").cogroup(met.groupBy("grp")).applyInArrow(cut(window), "id long, n_words long, n_removed long, kept binary")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))
