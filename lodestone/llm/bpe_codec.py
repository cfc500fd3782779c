"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For each prefix of a word exactly one token can end its encoding. It is found without merging: the automaton reports the
tokens that end at a place, longest first; a token is the one if the prefix before it ends with a last token that is
compatible with it. Two tokens are compatible if merging their joined bytes leaves them apart, which is read off the
merge tree along the seam: the later-made of the two is split again and again, and the pieces that then touch must not
merge earlier than that. Back-pointers from the whole word give the ids.

Texts are first cut at the vocabulary's added tokens, then by the pattern of the byte-level pre-tokenizer. The ids of
words are remembered in two generations of bounded size. Decoding joins the tokens' bytes and reads them as UTF-8, with
U+FFFD for what isn't.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows each get their result; very
long words cost time in proportion to their length.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_counts import Memory, slices, split_words

#: The byte-level pre-tokenizer's pattern, with its white space spelled out. Fixed by the file format.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Two characters of white space side by side, or one that is the whole text.
SPACES = "[\t-\r \x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LOOSE = rf"{SPACES}{{2}}|\A{SPACES}\z"
AGREEMENTS, REMEMBERED, SLICE = 100_000, 100_000, 2 << 20


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes as the vocabulary's own library does. Without `encoder` it only decodes, and is small."""

    def __init__(self, path: str, encoder: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or model["unk_token"] or model["ignore_merges"]:
            raise ValueError("only plain byte-level BPE is read")
        letters = byte_letters()
        self.bytes = [b""] * (1 + max([*model["vocab"].values(), *(a["id"] for a in spec["added_tokens"])]))
        ids = {}
        for piece, i in model["vocab"].items():
            self.bytes[i] = bytes(letters[c] for c in piece)
            ids[piece] = i
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for text, i in self.added.items():
            self.bytes[i] = text.encode()
        if not encoder:
            return
        self.pairs: dict[tuple[int, int], int] = {}  # the rank at which a pair merges
        self.made = {}  # token: rank, left, right
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.pairs.setdefault((left, right), rank)
            self.made.setdefault(whole, (rank, left, right))
        self.agree: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for i in ids.values():
            if len(self.bytes[i]) == 1 or i in self.made and self.stands(i):
                self.automaton.add_word(self.bytes[i].decode("latin-1"), (i, len(self.bytes[i])))
        self.automaton.make_automaton()
        self.set_apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cut = regex.compile(WORDS)
        self.parts = Memory(self.word, REMEMBERED)

    def stands(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        if token not in self.made:
            return True
        rank, left, right = self.made[token]
        return self.stands(left) and self.stands(right) and self.compatible(left, right, rank)

    def compatible(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Whether `a` and `b`, side by side, do not merge across their seam before `limit`."""
        none = (-1, -1, -1)
        while True:
            if self.pairs.get((a, b), limit) < limit:
                return False
            (ra, _, right), (rb, left, _) = self.made.get(a, none), self.made.get(b, none)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # `a` was made last; of equal merges the left comes first, so an equal one at the seam comes too late
                a, limit = right, ra
            else:  # and here it comes before
                b, limit = left, rb + 1

    def word(self, text: str) -> bytes:
        """The ids of one word, as little-endian unsigned 32-bit integers."""
        raw = text.encode()
        n = len(raw)
        last, sizes = [-1] * (n + 1), [0] * (n + 1)
        agree = self.agree
        for at, (token, size) in self.automaton.iter(raw.decode("latin-1")):  # of those that end at one place, the longest first
            if last[at + 1] >= 0:
                continue
            start = at + 1 - size
            if start:
                pair = (last[start] << 24) | token
                ok = agree.get(pair)
                if ok is None:
                    if len(agree) >= AGREEMENTS:
                        agree.clear()
                    ok = agree[pair] = self.compatible(last[start], token)
                if not ok:
                    continue
            last[at + 1], sizes[at + 1] = token, size
        out = []
        while n:
            out.append(last[n])
            n -= sizes[n]
        out.reverse()
        return struct.pack(f"<{len(out)}I", *out)

    def cut_up(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.cut.findall(text)))

    def word_ids(self, word: str) -> bytes:
        """The ids of what stands after a space, or from a line end on."""
        return self.cut_up(word if word[:1] == "\n" else " " + word)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        if any(a in text for a in self.added):
            return b"".join(struct.pack("<I", self.added[p]) if p in self.added else self.cut_up(p) for p in self.set_apart.split(text) if p)
        return self.cut_up(text)

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """The ids of each text (no nulls). Where white space stands alone, a space begins a word whatever is around."""
        odd = pc.match_substring_regex(texts, LOOSE).to_numpy(zero_copy_only=False)
        for a in self.added:
            odd |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~odd)
        out: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(odd):
            out[i] = self.encode(texts[int(i)].as_py())
        if len(plain):
            # A line end is put before each text, so that the first word is not taken for one after a space; its id, and that of the space before it, are left out.
            words, of, cuts = split_words(pc.binary_join_element_wise("", texts.take(pa.array(plain)), "\n"))
            ids = list(map(self.word_ids, words))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
            n = sizes[of]
            ends = np.cumsum(n)
            all_ids = flat[np.repeat(starts[of] - (ends - n), n) + np.arange(ends[-1])]
            bounds = np.append(ends - n, ends[-1])[cuts]
            for i, a, b in zip(plain, bounds, bounds[1:], strict=False):
                out[i] = all_ids[a + 2 : b].tobytes()
        return pa.array(out, pa.binary())

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[tuple[str, bool], Codec] = {}


def codec(path: str, encoder: bool = True) -> Codec:
    """One for each Python worker and direction."""
    if (path, encoder) not in _codecs:
        _codecs[path, encoder] = Codec(path, encoder)
    return _codecs[path, encoder]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, `keep`, ids) of every row; ids binary, four little-endian bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = list(map(c.encode_all, slices(pc.fill_null(b.column(b.num_columns - 1), ""), SLICE)))
            if ids:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.concat_arrays(ids)], names=[*b.schema.names[:-1], "ids"])

    own = docs.select(F.col(id_col).cast("long").alias(id_col), *keep, F.col(text_col).cast("string").alias("_t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(run, f"{schema}, ids binary")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """`tokens` (with ids as `encoded` gives them) with the column decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, encoder=False)
        for b in batches:
            texts = [c.decode(x.as_py() or b"") for x in b.column(b.schema.get_field_index("ids"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(run, f"{schema}, decoded string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, `keep`, ids, decoded, whole) of every row: the ids as `encoded` gives them, what they decode to, and whether that is the text.

    One worker does both, slice by slice, so that a core needs one Python process and ids don't pass through the JVM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            at = 0
            for part in slices(pc.fill_null(b.column(b.num_columns - 1), ""), SLICE):
                ids = c.encode_all(part)
                texts = pa.array([c.decode(x.as_py()) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*(x.slice(at, len(part)) for x in b.columns[:-1]), ids, texts, pc.equal(texts, part)], names=[*b.schema.names[:-1], "ids", "decoded", "whole"])
                at += len(part)

    own = docs.select(F.col(id_col).cast("long").alias(id_col), *keep, F.col(text_col).cast("string").alias("_t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(run, f"{schema}, ids binary, decoded string, whole boolean")
