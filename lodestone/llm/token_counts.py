"""Token counts of a SentencePiece byte-pair model by merging with a heap over a linked list.

Spaces become U+2581 and one is put in front. Symbols start as characters; the adjacent pair whose piece ranks lowest
(by score, then by place) is merged again and again; the count is the initial symbols minus the merges, where a symbol
that is no piece counts its UTF-8 bytes, as byte fallback spells it. No identifiers are emitted.

Texts are handled in slices, each distinct word of a slice once. Merging never crosses a place where the two characters beside it are adjacent in no piece, so texts are cut there before
merging: before each run of U+2581, and, as long as the text has no character that the vocabulary joins to both sides,
between punctuation and other characters. Counts of the cut parts are remembered in two generations of bounded size.

Defined cases: null and empty texts have no bytes and no tokens; a text of any length is merged whole where it cannot be
cut; repeated rows each get their count.
"""

from __future__ import annotations

import heapq
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
REMEMBERED = 350_000


class Memory(dict):
    """Values of `f`, in two generations: a full young one becomes the old one. Long keys are not kept."""

    def __init__(self, f, most: int = REMEMBERED, longest: int = 64):
        super().__init__()
        self.f, self.most, self.longest, self.old = f, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.f(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def slices(texts: pa.Array, size: int = 8 << 20) -> Iterator[pa.Array]:
    """Consecutive parts of about `size` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)))
        yield texts.slice(at, to - at)
        at = to


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of texts cut at single spaces and before line ends; the place in it of each word; where texts begin."""
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    coded = lists.flatten().dictionary_encode()
    cuts = lists.offsets.to_numpy()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), cuts - cuts[0]


class Counter:
    """Counts tokens as the model does."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        bigrams = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        if any(b[1] == SPACE and b[0] != SPACE for b in bigrams) or any("\n" in b for b in bigrams):
            raise ValueError("a piece holds U+2581 after another character, or a line end")
        # Ranks number the pieces by falling score. Runs of U+2581 share one score: what holds such a run is merged by score and place.
        ranked = sorted((p for p in self.score if len(p) > 1), key=lambda p: -self.score[p])
        shared = [p for p, q in zip(ranked, ranked[1:], strict=False) if self.score[p] == self.score[q]]
        if any(p.strip(SPACE) for p in shared):
            raise ValueError("pieces of equal score")
        number = {p: i for i, p in enumerate(self.score)}
        self.chars = {p: i for p, i in number.items() if len(p) == 1}
        self.made = [number[p] for p in ranked]
        self.ranks = {(number[p[:i]] << 20) | number[p[i:]]: r for r, p in enumerate(ranked) for i in range(1, len(p)) if p[:i] in number and p[i:] in number}
        marks = set(string.punctuation + "\n\t")
        mixed = {b for b in bigrams if SPACE not in b and (b[0] in marks) != (b[1] in marks)}
        self.joiners = frozenset(c for b in mixed for c in b if c not in marks)
        inner = re.escape("".join(sorted(marks)))
        self.fine = re.compile(f"{SPACE}*[{inner}]+|{SPACE}*[^{inner}{SPACE}]+|{SPACE}+")
        self.coarse = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.parts = Memory(self.merged)

    def merged(self, part: str) -> int:
        """The tokens of a part, by merging."""
        if SPACE * 2 in part:
            return self.merged_by_place(part)
        chars, ranks, made = self.chars, self.ranks, self.made
        symbols = [chars.get(c, -1) for c in part]
        n = count = len(symbols)
        shift = n.bit_length()  # a heap entry is one number: the rank, then the place
        places = (1 << shift) - 1
        at = [ranks.get((a << 20) | b, -1) for a, b in zip(symbols, symbols[1:], strict=False)]  # the rank of the pair that begins here
        heap = [(r << shift) | i for i, r in enumerate(at) if r >= 0]
        if heap:
            heapq.heapify(heap)
            at.append(-1)
            following, before = list(range(1, n + 1)), list(range(-1, n - 1))
            push, pop = heapq.heappush, heapq.heappop
            while heap:
                e = pop(heap)
                i, r = e & places, e >> shift
                if at[i] != r:
                    continue  # one of the two is merged already
                symbol = symbols[i] = made[r]
                j = following[i]
                k = following[i] = following[j]
                at[j] = at[i] = -1
                symbols[j] = -2
                count -= 1
                if k < n:
                    before[k] = i
                    if (r := ranks.get((symbol << 20) | symbols[k], -1)) >= 0:
                        at[i] = r
                        push(heap, (r << shift) | i)
                if (h := before[i]) >= 0:
                    r = at[h] = ranks.get((symbols[h] << 20) | symbol, -1)
                    if r >= 0:
                        push(heap, (r << shift) | h)
        if -1 in symbols:
            count += sum(len(c.encode()) - 1 for c, s in zip(part, symbols, strict=True) if s == -1)
        return count

    def merged_by_place(self, part: str) -> int:
        """The same where pieces may share a score: of equal ones the leftmost goes first."""
        score = self.score
        symbols: list = list(part)
        n = count = len(symbols)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-r, i, pair) for i, pair in enumerate(map("".join, zip(symbols, symbols[1:], strict=False))) if (r := score.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            left = symbols[i]
            if left is None or (j := following[i]) >= n or left + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            count -= 1
            k = following[i] = following[j]
            if k < n:
                before[k] = i
                if (r := score.get(p := pair + symbols[k])) is not None:
                    heapq.heappush(heap, (-r, i, p))
            if (h := before[i]) >= 0 and (r := score.get(p := symbols[h] + pair)) is not None:
                heapq.heappush(heap, (-r, h, p))
        return count + sum(len(s.encode()) - 1 for s in symbols if s is not None and s not in score)

    def spelled(self, text: str) -> int:
        """The tokens of a text in which U+2581 stands for the space."""
        cut = self.fine if self.joiners.isdisjoint(text) else self.coarse
        return sum(map(self.parts.__getitem__, cut.findall(text)))

    def word(self, word: str) -> int:
        """The tokens of what stands after a space, or from a line end on."""
        return self.parts["\n"] + self.spelled(word[1:]) if word[:1] == "\n" else self.spelled(SPACE + word)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """The tokens of each text (no nulls)."""
        out = np.zeros(len(texts), np.int64)
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.match_substring(texts, SPACE), pc.starts_with(texts, " "))).to_numpy(zero_copy_only=False)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd & ~empty):
            out[i] = self.spelled(SPACE + texts[int(i)].as_py().replace(" ", SPACE))
        plain = np.flatnonzero(~odd & ~empty)
        if len(plain):
            words, of, cuts = split_words(texts.take(pa.array(plain)))
            counts = np.fromiter(map(self.word, words), np.int64, len(words))
            out[plain] = np.add.reduceat(counts[of], cuts[:-1])
        return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each Python worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path)
        for b in batches:
            tokens = np.concatenate([np.zeros(0, np.int64), *map(count, slices(pc.fill_null(b.column(2), "")))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tokens)], names=["id", "n_bytes", "n_tokens"])

    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("t"))
    out = own.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
