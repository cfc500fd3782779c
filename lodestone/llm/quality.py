"""A quality classifier on random-indexing word vectors.

Every word has an index vector, sparse and ternary, drawn for the word's hash. A word's vector is the sum of the index
vectors of the words that stand within `WINDOW` places of it, over all documents. A document is pooled as the mean of its
words' vectors, next to three lengths. A network of two layers, in numpy, is fitted on the pooled vectors of labelled
documents by Adam; a temperature fitted on rows kept from training calibrates its probabilities.

Words are runs of letters (all bytes beyond ASCII count as letters), of digits or of other characters; white space only
parts them. Words are dealt by hash over `SLOTS` slots, those of one slot share a vector; this bounds what the driver and
each task hold, whatever the vocabulary. Sums are whole numbers, added up per task before they are sent, so reruns agree.
A slot's vector is used at unit length.

The vectors come from every document. The fit takes at most `SAMPLE` labelled documents, those with the smallest hashes of
their ids; this bound is a parameter. Scoring covers every row. Texts are read in parts of about `PART` bytes, cut at
white space; words do not meet across such a cut.

Defined cases: null and empty texts have the zero vector and a score; labels other than 0 and 1, null labels and labels
without document are left out, of repeated labels the largest counts, of repeated documents the one with the smallest hash
of its text is learned from; without labels of both kinds every score is the share of ones (0.5 if there are no labels);
a null id counts as the empty text for `held_out` (true) and is never learned from; repeated rows each get their score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .token_counts import slices

SAMPLE = 6000
SLOTS, DIM, NONZERO, WINDOW, SEED = 1 << 14, 64, 4, 2, 7
HIDDEN, EPOCHS, RATE, DECAY, BATCH = 48, 60, 3e-3, 1e-4, 64
PART, RANGE, SLICE = 1 << 18, 64, 4 << 20


def index_vectors() -> np.ndarray:
    """A sparse ternary vector for each slot."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((SLOTS, DIM), np.int16)
    at = np.argsort(rng.random((SLOTS, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice([-1, 1], (SLOTS, NONZERO)).astype(np.int16), axis=1)
    return out


INDEX = index_vectors()
#: The kind of each byte: 0 white space, 1 letter (and all beyond ASCII), 2 digit, 3 else.
KINDS = np.array([0 if b == 32 or 9 <= b <= 13 else 2 if 48 <= b <= 57 else 1 if chr(b).isalpha() else 3 for b in range(128)] + [1] * 128, np.int8)
FACTOR = 0x9E3779B97F4A7C15
POWERS, INVERSES = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * PART, f, np.uint64)])) for f in (FACTOR, pow(FACTOR, -1, 1 << 64)))


def parts(text: bytes) -> Iterator[bytes]:
    """Consecutive parts of at most 2 * `PART` bytes, cut at white space where there is some."""
    at = 0
    while at < len(text):
        end = at + PART
        if end < len(text):
            space = min((p for p in (text.find(b" ", end, at + 2 * PART), text.find(b"\n", end, at + 2 * PART)) if p >= 0), default=at + 2 * PART)
            end = min(space, len(text))
        yield text[at:end]
        at = end


def blocks(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, bytes]]:
    """Texts side by side, about `PART` bytes at a time: of which text each stretch is (place, length), and the bytes."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for p in parts(t or b""):
            if held and size + len(p) + 1 > PART:
                yield np.array([(j, len(x) + 1) for j, x in held]), b"\n".join([x for _, x in held])
                held, size = [], 0
            held.append((i, p))
            size += len(p) + 1
    if held:
        yield np.array([(j, len(x) + 1) for j, x in held]), b"\n".join([x for _, x in held])


def words(stretches: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of a block: its slot, its hash, its length in bytes and the stretch that it stands in."""
    code = np.frombuffer(text, np.uint8)
    kind = KINDS[code]
    cut = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    ends = np.append(cut[1:], len(code))
    real = kind[cut] > 0
    start, end = cut[real], ends[real]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * INVERSES[: len(code)])])
    h = (sums[end] - sums[start]) * POWERS[start]  # the sum of (byte + 1) / FACTOR**place within the word
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    of = np.searchsorted(np.cumsum(stretches[:, 1]), start, side="right")
    return (h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64), h, end - start, of


def beside(slots: np.ndarray, of: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For each word the sum of the index vectors of the words within the window."""
    own = index[slots]
    out = np.zeros_like(own)
    for k in range(1, WINDOW + 1):
        away = np.flatnonzero(of[k:] != of[:-k])  # few: the ends of texts
        out[k:] += own[:-k]
        out[away + k] -= own[away]
        out[:-k] += own[k:]
        out[away] -= own[away + k]
    return out


def gather(texts: list[bytes | None], table: np.ndarray) -> None:
    """Adds the texts' neighbours to the table of sums."""
    for stretches, text in blocks(texts):
        slots, _, _, of = words(stretches, text)
        for a in range(0, len(slots), 1 << 16):  # two more words on either side, which get their sums elsewhere
            low, high = max(a - WINDOW, 0), min(a + (1 << 16) + WINDOW, len(slots))
            sums = beside(slots[low:high], of[low:high], INDEX)[a - low : min(a + (1 << 16), len(slots)) - low]
            mine = slots[a : a + (1 << 16)]
            order = np.argsort(mine, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(mine[order]) > 0]))
            table[mine[order][first]] += np.add.reduceat(sums[order], first, axis=0, dtype=np.int32)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(slots, DIM) unit vectors, from all rows of `docs`. What reaches the driver is one table of that size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((SLOTS, DIM), np.int64)
        for b in batches:
            for part in slices(b.column(0), SLICE):
                gather(part.to_pylist(), table)
        ranges = [r for r in range(SLOTS // RANGE) if table[r * RANGE : (r + 1) * RANGE].any()]
        sums = [table[r * RANGE : (r + 1) * RANGE] for r in ranges]
        small = [bool(np.abs(s).max() < 2**31) for s in sums]
        yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array([(s.astype(np.int32) if k else s).tobytes() for s, k in zip(sums, small, strict=True)], pa.binary())], names=["r", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int32 if len(x) == RANGE * DIM * 4 else np.int64).astype(np.int64) for x in t.column("sums").to_pylist())
        return pa.table({"r": t.column("r").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    sums = docs.select(F.col(text_col).cast("string").cast("binary").alias("t")).mapInArrow(count, "r int, sums binary").groupBy("r").applyInArrow(add, "r int, sums binary")
    out = np.zeros((SLOTS, DIM), np.float64)
    for row in sums.collect():  # at most SLOTS / RANGE rows
        out[row["r"] * RANGE : (row["r"] + 1) * RANGE] = np.frombuffer(row["sums"], np.int64).reshape(RANGE, DIM)
    return (out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32)


def pooled(texts: list[bytes | None], vectors: np.ndarray) -> np.ndarray:
    """The pooled vectors of UTF-8 texts."""
    out, n, size, kinds = np.zeros((len(texts), DIM + 3)), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
    for stretches, text in blocks(texts):
        slots, hashes, sizes, of = words(stretches, text)
        if not len(slots):
            continue
        doc = stretches[of, 0]
        first = np.flatnonzero(np.concatenate([[True], np.diff(doc) > 0]))
        ends, at = np.append(first[1:], len(doc)), doc[first]
        n[at] += ends - first
        size[at] += np.add.reduceat(sizes, first)
        for i, a, b in zip(at, first, ends, strict=True):
            kinds[i] += len(np.unique(hashes[a:b]))
            for c in range(a, b, 1 << 16):
                out[i, :DIM] += vectors[slots[c : min(c + (1 << 16), b)]].sum(axis=0, dtype=np.float64)
    has = n > 0
    out[has, :DIM] /= n[has, None]
    out[has, DIM:] = np.stack([np.log1p(n[has]), kinds[has] / n[has], np.log1p(size[has] / n[has])], axis=1)
    return out.astype(np.float32)


@dataclass
class Network:
    """Word vectors, and two layers over standardised inputs; the last number is the temperature."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = (x.astype(np.float64) - self.mean) / self.scale
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, vectors: np.ndarray) -> Network:
    """Fitted on four rows of five; the temperature on the fifth."""
    y = y.astype(np.float64)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        logit = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
        return Network(vectors, np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), logit)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(x))
    held, train = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x[train].mean(axis=0, dtype=np.float64), x[train].std(axis=0, dtype=np.float64) + 1e-3
    z = (x.astype(np.float64) - mean) / scale
    p = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    best, best_loss = [a.copy() for a in p], np.inf
    loss = lambda s, t: np.mean(np.logaddexp(0, s) - t * s)
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            h = np.tanh(z[rows] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[rows]) / len(rows)
            back = d[:, None] * p[2] * (1 - h * h)
            grads = [z[rows].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ d + DECAY * p[2], np.array([d.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        now = loss(np.tanh(z[held] @ p[0] + p[1]) @ p[2] + p[3], y[held]) if len(held) else 0.0
        if now < best_loss:
            best, best_loss = [a.copy() for a in p], now
    net = Network(vectors, mean, scale, best[0], best[1], best[2], float(best[3][0]))
    if len(held):
        s = net.logits(x[held])
        net.temperature = min(np.geomspace(0.25, 8, 61), key=lambda t: loss(s / t, y[held]))
    return net


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Network:
    """Word vectors of all `docs`; the network is fitted on a sample of the labelled rows that are not held out."""
    vectors = word_vectors(docs, text_col)
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    rows = own.join(F.broadcast(known), "id").select("id", "y", F.xxhash64("t").alias("h"), "t")  # at most `sample` rows of two numbers
    held = docs.sparkSession.sparkContext.broadcast(vectors)  # a table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pooled(b.column(3).to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "y", "h", "x"])

    pool = rows.mapInArrow(run, "id long, y int, h long, x binary").groupBy("id").agg(F.min(F.struct("h", "y", "x")).alias("r"))
    got = pool.select("id", "r.y", "r.x").toPandas().sort_values("id", kind="stable")  # a row for each id of the sample
    return fit(np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, DIM + 3), got["y"].to_numpy(), vectors)


def scored(docs: DataFrame, net: Network, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(`keep`, score) of every row. A text that is kept travels once."""
    held = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size
    kept = text_col in keep and docs.schema[text_col].dataType.simpleString() == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in slices(b.column(keep.index(text_col) if kept else b.num_columns - 1).cast(pa.binary()), SLICE):
                scores = held.value.score(pooled(part.to_pylist(), held.value.vectors))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(part)) for c in b.columns[: len(keep)]), pa.array(scores)], names=[*b.schema.names[: len(keep)], "score"])
                at += len(part)

    own = docs.select(*keep, *([] if kept else [F.col(text_col).cast("string").alias("_t")]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[: len(keep)])
    return own.mapInArrow(run, f"{schema}, score double")
