"""Approximate nearest neighbours by cosine in a hash-prefix forest.

A tree turns a vector by a rotation of its own and writes it as a string of 64 bits: first the number of the coordinate
that stands out most, with its sign, then the signs of further coordinates. Each tree keeps its strings as sorted arrays.
A query first descends in every tree to the longest prefixes that it shares with anything there: the `BESIDE` strings on
either side of its own place. That gives first neighbours, and from the worst of the best `k`, at angle t, follows how far
to ascend: two vectors at angle t share the first ``b`` bits of a tree with a known probability ``p(t, b)``, so all trees
ascend together to the longest prefix at which ``(1 - p)**trees`` is small enough (some stay a bit below, as far as that
suffices), and every string that shares a prefix of that length in any tree is a candidate. They ascend twice, as what the first ascent finds makes the second a short one
(`MISSES`: the probability at which each stops). Queries in dense places so stop deep; those without near neighbours go
up to the whole of their tree if need be. All candidates are scored on the original vectors, in double precision.

Nothing is compared with all: strings are dealt by tree and range of strings (ranges are fitted on a bounded sample once
a tree exceeds `PIECE_ROWS`; a string that fills whole ranges is dealt over them by hash), a query visits the pieces that
its prefix meets, and of the shards of vectors those that hold a candidate of it. All trees index every row.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, as rows or as queries;
vectors meet those of their own length only; rows equal in id and vector are one row, and are asked once; rows of one id
with several vectors are rows and queries of their own (each query has its own ranks), and no query finds a row of its
own id; equal vectors tie and go by id, so of one vector the ``k + 1`` smallest ids are all that any query can need; with
fewer than `k` candidates all are returned; a null id is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pieces, settle, spread

TREES, BITS, WIDTH, SEED, BESIDE, MISSES = 224, 64, 64, 2024, 2, (0.5, 0.1)
PIECE_ROWS, SHARD_ROWS, BLOCK_ROWS, SAMPLE = 1 << 20, 2048, 64, 1 << 14
ANGLES = np.linspace(0, np.pi, 61)
#: In place of a number of bits: what stands beside the own string; nothing yet.
DESCEND, NOTHING = 255, 254


class Trees:
    """The strings of vectors of one length."""

    def __init__(self, dim: int, trees: int):
        rng = np.random.default_rng((SEED, dim))
        self.trees, self.width = trees, min(dim, WIDTH)
        self.head = (2 * self.width - 1).bit_length()
        turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, : self.width] if dim <= WIDTH else rng.standard_normal((dim, self.width)) for _ in range(trees)]
        self.planes = np.concatenate(turns, axis=1).astype(np.float32)
        tail = BITS - self.head  # the signs come from the coordinates of the trees that follow
        self.signs = (np.arange(1, trees + 1)[:, None] * self.width + np.arange(tail)) % (trees * self.width)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, trees) of 64-bit strings."""
        out = np.empty((len(vectors), self.trees), np.uint64)
        scale = np.abs(vectors).max(axis=1, keepdims=True) if len(vectors) else 1.0
        for a in range(0, len(vectors), 256):
            x = (vectors[a : a + 256] / scale[a : a + 256]).astype(np.float32) @ self.planes
            each = x.reshape(len(x), self.trees, self.width)
            most = np.abs(each).argmax(axis=2)
            digit = 2 * most + (np.take_along_axis(each, most[:, :, None], 2)[:, :, 0] > 0)
            tail = np.zeros((len(x), self.trees, BITS), bool)
            tail[:, :, self.head :] = (x > 0)[:, self.signs]
            out[a : a + 256] = np.packbits(tail, axis=2).view(">u8")[:, :, 0] | (digit.astype(np.uint64) << np.uint64(BITS - self.head))
        return out

    @property
    def shared(self) -> np.ndarray:
        """For each of `ANGLES` the probability that two vectors at that angle share a tree's first number (measured)."""
        rng = np.random.default_rng(SEED)
        a, z = rng.standard_normal((2, 1 << 13, self.width)).astype(np.float32)
        i, out = np.abs(a).argmax(axis=1), []
        for t in ANGLES:
            b = np.float32(np.cos(t)) * a + np.float32(np.sin(t)) * z
            same = (np.abs(b).argmax(axis=1) == i) & (np.sign(np.take_along_axis(b, i[:, None], 1)) == np.sign(np.take_along_axis(a, i[:, None], 1)))[:, 0]
            out.append(same.mean())
        return np.array(out)

    def ascent(self, cosines: np.ndarray, miss: float) -> tuple[np.ndarray, np.ndarray]:
        """How far to go up so that a row this near is missed with probability `miss` at most: (bits, trees), where so many trees
        are asked for so many leading bits and the others for one more."""
        angle = np.arccos(np.clip(cosines, -1, 1))
        p, need, none = np.interp(angle, ANGLES, shared(self.width)), 1 - miss ** (1 / self.trees), np.log(max(miss, 1e-300))
        with np.errstate(divide="ignore", invalid="ignore"):
            more = np.floor(np.log(need / p) / np.log1p(-angle / np.pi))
            more = np.nan_to_num(np.where(angle < 1e-6, BITS, more), nan=0, posinf=BITS)
            low, high = (np.log1p(-np.minimum(p * (1 - angle / np.pi) ** (more + k), 1 - 1e-12)) for k in (0, 1))
            some = np.clip(np.ceil((none - self.trees * high) / (low - high)), 1, self.trees)
        bits = np.where(p < need, 0, np.minimum(self.head + more, BITS))
        return bits.astype(np.uint16), np.where((bits == 0) | (bits == BITS), self.trees, np.nan_to_num(some, nan=self.trees)).astype(np.uint16)


@lru_cache(8)
def trees_of(dim: int, trees: int) -> Trees:
    return Trees(dim, trees)


@lru_cache(64)
def shared(width: int) -> np.ndarray:
    return Trees(width, 1).shared


def flat_vectors(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def raw(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def planes(a: np.ndarray) -> bytes:
    """The first bytes of all numbers (of 64 bits), then the second ones, and so on; what they share packs away in a shuffle."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()


def joined(t: pa.Table, name: str, kind=None) -> np.ndarray:
    """The numbers of all rows of a column; without a kind, those of `planes`."""
    if kind is None:
        return np.concatenate([np.zeros(0, np.uint64), *map(unplanes, t.column(name).to_pylist())])
    return np.frombuffer(b"".join(t.column(name).to_pylist()), kind)


def binaries(rows: list[tuple], names: str) -> pa.Table:
    """Rows as a table; a name that ends in a star is an int, others are binary."""
    kinds = [(n.rstrip("*"), pa.int32() if n.endswith("*") else pa.binary()) for n in names.split()]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds)})


def schema(names: str) -> str:
    return ", ".join(f"{n.rstrip('*')} {'int' if n.endswith('*') else 'binary'}" for n in names.split())


ENTRIES, QUERIES = "dim* tree* part* strings keys", "dim* tree* part* block* keys strings bits had"
HITS, STATE = "dim* block* query counts keys", "dim* block* keys ids vectors bits found scored"
ASKS, ANSWERS = "dim* shard* block* query vectors counts keys", "dim* block* query keys ids scores scored"
#: One found row: of which query, its key, its id, its score.
FOUND = np.dtype([("q", "<i8"), ("key", "<u8"), ("id", "<i8"), ("score", "<f8")])


class Ranges:
    """Into which parts the strings of each tree of one length are dealt: part i holds those from cut i on."""

    def __init__(self, sample: np.ndarray, total: int, piece_rows: int):
        n = max(1, -(-total // piece_rows))
        places = (np.arange(1, n) * len(sample)) // n
        self.cuts = np.sort(sample, axis=0)[places] if n > 1 else np.zeros((0, sample.shape[1]), np.uint64)

    def of(self, tree: int, strings: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The part of each string; strings that fill several parts are dealt by key."""
        cuts = self.cuts[:, tree]
        low, high = np.searchsorted(cuts, strings, side="left"), np.searchsorted(cuts, strings, side="right")
        wide = np.maximum(high - low, 1).astype(np.uint64)
        return (high - (keys % wide).astype(np.int64)).astype(np.int32)

    def met(self, tree: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last part that can hold strings from `low` to `high`."""
        cuts = self.cuts[:, tree]
        first, last = np.searchsorted(cuts, low, side="left"), np.searchsorted(cuts, high, side="right")
        return np.minimum(first + (first < last) * np.isin(low, cuts), last), last


def span(strings: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and highest string that shares that many leading bits."""
    bits = np.minimum(bits, BITS).astype(np.uint64)
    free = np.where(bits == 0, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(np.uint64(BITS) - bits, np.uint64(63))) - np.uint64(1))
    return strings & ~free, strings | free


def send_entries(trees: int, ranges: dict[int, Ranges]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, keys, rows = b.column(2).to_numpy(), b.column(0).to_numpy().astype(np.uint64), []
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                strings, own = trees_of(int(dim), trees).strings(flat_vectors(b.column(1).take(pa.array(at)), dim)), keys[at]
                for t in range(trees):
                    part = ranges[int(dim)].of(t, strings[:, t], own)
                    order = np.lexsort((strings[:, t], part))
                    for here in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                        rows.append((int(dim), t, int(part[here[0]]), planes(strings[here, t]), planes(own[here])))
            yield from binaries(rows, ENTRIES).to_batches()

    return run


def send_queries(trees: int, ranges: dict[int, Ranges]):
    """Each block's queries to the pieces they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                dim, keys = r["dim"], np.frombuffer(r["keys"], np.int64)
                forest = trees_of(dim, trees)
                strings = forest.strings(np.frombuffer(r["vectors"], np.float64).reshape(-1, dim))
                levels = np.frombuffer(r["bits"], np.uint16).reshape(4, -1)
                rows = []
                for t in range(trees):
                    bits, had = levels[0] + (t >= levels[1]), levels[2] + (t >= levels[3])
                    ask = np.flatnonzero((bits > 0) | (t == 0))  # a whole tree is asked for once
                    low, high = span(strings[ask, t], bits[ask])
                    first, last = ranges[dim].met(t, low, high)
                    for p in range(int(first.min()), int(last.max()) + 1) if len(ask) else ():
                        here = ask[(first <= p) & (p <= last)]
                        if len(here):
                            rows.append((dim, t, p, r["block"], raw(keys[here]), raw(strings[here, t]), raw(bits[here].astype(np.uint8)), raw(had[here].astype(np.uint8))))
                yield from binaries(rows, QUERIES).to_batches()

    return run


def meet(entries: pa.Table, asked: pa.Table) -> pa.Table:
    """Of one piece: the keys of the strings that each query asks for."""
    rows = []
    if entries.num_rows and asked.num_rows:
        strings, keys = joined(entries, "strings"), joined(entries, "keys")
        order = np.argsort(strings, kind="stable")
        strings, keys = strings[order], keys[order]
        for r in asked.to_pylist():
            own, bits, had = np.frombuffer(r["strings"], np.uint64), np.frombuffer(r["bits"], np.uint8), np.frombuffer(r["had"], np.uint8)
            places = lambda b: (np.searchsorted(strings, span(own, b)[0], side="left"), np.searchsorted(strings, span(own, b)[1], side="right"))
            (a, b), (c, d), beside, place = places(bits), places(had), bits == DESCEND, np.searchsorted(strings, own)
            left, right = np.maximum(place - BESIDE, 0), np.minimum(place + BESIDE, len(strings))
            a, b = np.where(beside, left, a), np.where(beside, right, b)
            # What was told before is not told again: first what stands beside, then what the shorter ascent met.
            c, d = np.where(had == NOTHING, np.where(beside, a, np.maximum(a, left)), c), np.where(had == NOTHING, np.where(beside, a, np.minimum(b, right)), d)
            starts, n = np.stack([a, d], axis=1).ravel(), np.maximum(np.stack([c - a, b - d], axis=1).ravel(), 0)
            at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows.append((r["dim"], r["block"], r["keys"], raw(n.reshape(-1, 2).sum(axis=1)), planes(keys[at])))
    return binaries(rows, HITS)


def ask_shards(shards: int):
    """Of one block: each query's candidates, once each, to the shards that hold them."""

    def run(state: pa.Table, hits: pa.Table) -> pa.Table:
        rows = []
        for s in state.to_pylist():
            queries = np.frombuffer(s["keys"], np.int64)
            vectors = np.frombuffer(s["vectors"], np.float64).reshape(len(queries), -1)
            got: dict[int, list[np.ndarray]] = {}
            for h in hits.to_pylist():
                parts = np.split(unplanes(h["keys"]), np.cumsum(np.frombuffer(h["counts"], np.int64))[:-1])
                for q, p in zip(np.frombuffer(h["query"], np.int64).tolist(), parts, strict=True):
                    if len(p):
                        got.setdefault(q, []).append(p)
            order = np.argsort(queries, kind="stable")
            names = queries[order]
            owner, keys = [], []
            for i, q in zip(order.tolist(), names.tolist(), strict=True):
                if q in got:
                    own = np.unique(np.concatenate(got.pop(q)))
                    owner.append(np.full(len(own), i))
                    keys.append(own)
            if not keys:
                continue
            of, key = np.concatenate(owner), np.concatenate(keys)
            shard = (key % np.uint64(shards)).astype(np.int64)
            for sh in np.unique(shard):
                mine = shard == sh
                here, n = np.unique(of[mine], return_counts=True)
                by = np.argsort(of[mine], kind="stable")
                rows.append((s["dim"], int(sh), s["block"], raw(queries[here]), raw(vectors[here]), raw(n.astype(np.int64)), planes(key[mine][by])))
        return binaries(rows, ASKS)

    return run


def answer(k: int):
    """Of one shard: the best `k + 1` of each query's candidates (one of them may be the query's own row)."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and asked.num_rows:
            dim = rows.column("dim")[0].as_py()
            keys, ids, data = rows.column("key").to_numpy().astype(np.uint64), rows.column("id").to_numpy(), flat_vectors(rows.column("v"), dim)
            order = np.argsort(keys, kind="stable")
            keys, ids, data = keys[order], ids[order], data[order]
            norms = np.sqrt((data * data).sum(axis=1))
            for r in asked.to_pylist():
                queries, n = np.frombuffer(r["query"], np.int64), np.frombuffer(r["counts"], np.int64)
                vectors = np.frombuffer(r["vectors"], np.float64).reshape(-1, dim)
                own = np.sqrt((vectors * vectors).sum(axis=1))
                at = np.searchsorted(keys, unplanes(r["keys"]))
                of = np.repeat(np.arange(len(queries)), n)
                scores = np.empty(len(at))
                for a in range(0, len(at), 16384):
                    i, j = at[a : a + 16384], of[a : a + 16384]
                    scores[a : a + 16384] = (data[i] * vectors[j]).sum(axis=1) / (norms[i] * own[j])
                by = np.lexsort((ids[at], -scores, of))
                place = np.arange(len(by)) - np.repeat(np.cumsum(n) - n, n)
                by = by[place < k + 1]
                out.append((r["dim"], r["block"], raw(queries[of[by]]), raw(keys[at[by]]), raw(ids[at[by]].astype(np.int64)), raw(scores[by]), raw(np.stack([queries, n]).T.astype(np.int64))))
        return binaries(out, ANSWERS)

    return run


def merge(k: int, trees: int, miss: float):
    """Of one block: the best `k` of each query among what was found before and now, and how many bits these call for next."""

    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for s in state.to_pylist():
            keys, ids = np.frombuffer(s["keys"], np.int64), np.frombuffer(s["ids"], np.int64)
            new = np.zeros(len(q := joined(answers, "query", np.int64)), FOUND)
            new["q"], new["key"], new["id"], new["score"] = q, joined(answers, "keys", np.uint64), joined(answers, "ids", np.int64), joined(answers, "scores", np.float64)
            found = np.concatenate([np.frombuffer(s["found"] or b"", FOUND), new])
            order = np.argsort(keys, kind="stable")
            found = found[found["id"] != ids[order][np.searchsorted(keys[order], found["q"])]]
            found = found[np.unique(found[["q", "key"]], return_index=True)[1]]
            found = found[np.lexsort((found["id"], -found["score"], found["q"]))]
            begin = np.flatnonzero(np.append(True, found["q"][1:] != found["q"][:-1])) if len(found) else np.zeros(0, np.int64)
            place = np.arange(len(found)) - np.repeat(begin, np.diff(np.append(begin, len(found))))
            seen = dict(zip(keys.tolist(), np.frombuffer(s["scored"] or bytes(8 * len(keys)), np.int64).tolist(), strict=True))
            for q, n in joined(answers, "scored", np.int64).reshape(-1, 2).tolist():
                seen[q] += n
            worst = dict(zip(found["q"][place == k - 1].tolist(), found["score"][place == k - 1].tolist(), strict=True))
            before, many = np.frombuffer(s["bits"], np.uint16).reshape(4, -1)[:2]
            had = np.where(before == DESCEND, NOTHING, before)
            bits, some = trees_of(s["dim"], trees).ascent(np.array([worst.get(q, -2.0) for q in keys.tolist()]), miss)
            back = (bits > had) | ((bits == had) & (some < many))  # never down again
            bits, some = np.where(back, had, bits), np.where(back, many, some)
            rows.append((s["dim"], s["block"], s["keys"], s["ids"], s["vectors"], raw(np.stack([bits, some, had, many]).astype(np.uint16)), raw(found[place < k]), raw(np.array([seen[q] for q in keys.tolist()], np.int64))))
        return binaries(rows, STATE)

    return run


def packed(trees: int):
    return lambda t: _packed(t, trees)


def _packed(t: pa.Table, trees: int) -> pa.Table:
    """One row for a block of queries."""
    dim = t.column("dim")[0].as_py()
    bits = np.repeat(np.array([[DESCEND], [trees], [NOTHING], [trees]], np.uint16), t.num_rows, axis=1)
    row = (dim, t.column("block")[0].as_py(), raw(t.column("key").to_numpy()), raw(t.column("id").to_numpy().astype(np.int64)), raw(flat_vectors(t.column("v"), dim)), raw(bits), None, None)
    return binaries([row], STATE)


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in b.to_pylist():
            keys, found = np.frombuffer(s["keys"], np.int64), np.frombuffer(s["found"], FOUND)
            name = dict(zip(keys.tolist(), zip(np.frombuffer(s["ids"], np.int64).tolist(), np.frombuffer(s["scored"], np.int64).tolist(), strict=True), strict=True))
            ranks, rows = {}, []
            for q, i, score in zip(found["q"].tolist(), found["id"].tolist(), found["score"].tolist(), strict=True):
                ranks[q] = ranks.get(q, 0) + 1
                rows.append((name[q][0], ranks[q], i, score, name[q][1]))
            kinds = {"query_id": pa.int64(), "rank": pa.int32(), "id": pa.int64(), "score": pa.float64(), "n_scored": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds.values())], names=list(kinds))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(query_id, rank, id, score, n_scored): the best `k` of `vectors` found for each of `queries`, and how many rows were scored for it."""
    v = F.col(vector_col).cast("array<double>")
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = lambda df: df.filter(F.col(id_col).isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim"))
    rows, asked = usable(vectors).select(F.xxhash64("id", "v").alias("key"), "*"), usable(queries).dropDuplicates(["id", "v"]).select(F.xxhash64("id", "v").alias("key"), "*")
    same = W.partitionBy("v").orderBy("id")  # cut down before the shuffle to the first places of each task
    rows = settle(rows.withColumn("_n", F.dense_rank().over(same)).filter(F.col("_n") <= k + 1).drop("_n").dropDuplicates(["key"]).withColumn("key", F.monotonically_increasing_id()))
    ranges = {}
    for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect():  # a row for each length of vectors
        sample = np.zeros((0, trees), np.uint64)
        if r["n"] > piece_rows:
            few = rows.filter(F.col("dim") == r["dim"]).orderBy("key").limit(SAMPLE).select("v").toArrow()  # at most `SAMPLE` rows
            sample = trees_of(r["dim"], trees).strings(flat_vectors(few.column("v"), r["dim"]))
        ranges[r["dim"]] = Ranges(sample, r["n"], piece_rows)
    # The rows' keys are their numbers in the written table.
    shards, blocks = pieces(rows.count(), SHARD_ROWS, 16), pieces(asked.count(), BLOCK_ROWS, 4)
    entries = rows.select("key", "v", "dim").mapInArrow(send_entries(trees, ranges), schema(ENTRIES))
    held = rows.withColumn("shard", (F.col("key") % shards).cast("int"))
    state = asked.withColumn("block", spread(blocks, F.col("key"))).groupBy("dim", "block").applyInArrow(packed(trees), schema(STATE))
    for miss in (*MISSES, 0.0):
        sent = state.mapInArrow(send_queries(trees, ranges), schema(QUERIES))
        hits = entries.groupBy("dim", "tree", "part").cogroup(sent.groupBy("dim", "tree", "part")).applyInArrow(meet, schema(HITS))
        wanted = state.groupBy("dim", "block").cogroup(hits.groupBy("dim", "block")).applyInArrow(ask_shards(shards), schema(ASKS))
        answers = held.groupBy("dim", "shard").cogroup(wanted.groupBy("dim", "shard")).applyInArrow(answer(k), schema(ANSWERS))
        state = state.groupBy("dim", "block").cogroup(answers.groupBy("dim", "block")).applyInArrow(merge(k, trees, miss), schema(STATE))
    return state.mapInArrow(listed, "query_id long, rank int, id long, score double, n_scored long")
