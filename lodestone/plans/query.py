"""Queries as small trees: Term, Prefix and Phrase leaves under And, Or and Not; a column may be named."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, replace

from ..functions.text import ACCENTED, MARKS, PLAIN

FOLD = str.maketrans(ACCENTED, PLAIN)


@dataclass(frozen=True)
class Phrase:
    """Adjacent tokens of one column, any of `columns` if there are some; one token is a term; `prefix` applies to the last; `first`: at the column's begin."""

    tokens: tuple[str, ...]
    columns: tuple[str, ...] = ()
    prefix: bool = False
    first: bool = False


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    keep: object
    drop: object


def tokens_of(text: str) -> tuple[str, ...]:
    """The index's tokens of a text (see functions.text.tokens)."""
    out, word = [], ""
    for c in [*re.sub(MARKS, "", text.translate(FOLD)).lower(), " "]:
        kind = unicodedata.category(c)
        if kind[0] in "LNM" or kind == "Co":
            word += c
        elif word:
            out.append(word)
            word = ""
    return tuple(out)


def safe(text: str, match: str = "all"):
    """Every word is looked for as it stands: all of them, any, or all as one phrase. A word that splits is a phrase."""
    words = re.findall(r"\w+", text)
    parts = [Phrase(t) for w in words if (t := tokens_of(w))]
    if not parts:
        raise ValueError("the query has no word")
    if match == "phrase":
        return Phrase(tuple(t for p in parts for t in p.tokens))
    if match not in ("all", "any"):
        raise ValueError(f"match is all, any or phrase, not {match}")
    return And(tuple(parts)) if match == "all" else Or(tuple(parts))


#: What may stand outside quotes: letters, digits, _, U+001A and everything beyond ASCII.
BARE = re.compile(r"[A-Za-z0-9_\x1a\u0080-\U0010ffff]+")


class _Parser:
    def __init__(self, text: str):
        self.items = re.findall(r'"(?:[^"]|"")*"|[A-Za-z0-9_\x1a\u0080-\U0010ffff]+|\S', text)
        self.at = 0

    def peek(self) -> str | None:
        return self.items[self.at] if self.at < len(self.items) else None

    def take(self) -> str:
        if (x := self.peek()) is None:
            raise ValueError("the query ends too soon")
        self.at += 1
        return x

    def either(self):
        parts = [self.both()]
        while self.peek() == "OR":
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both(self):
        parts = [self.without()]
        while self.peek() not in (None, ")", "OR"):
            if self.peek() == "AND":
                self.take()
            parts.append(self.without())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def without(self):
        out = self.leaf()
        while self.peek() == "NOT":
            self.take()
            out = Not(out, self.leaf())
        return out

    def leaf(self, columns: tuple[str, ...] = ()):
        if self.peek() == "(":
            self.take()
            out = self.either()
            if self.take() != ")":
                raise ValueError("a parenthesis is not closed")
            return within(out, columns) if columns else out
        if self.peek() == "{" or (self.at + 1 < len(self.items) and self.items[self.at + 1] == ":"):
            if columns:
                raise ValueError("a column filter stands before a column filter")
            names = [self.take()]
            if names == ["{"]:
                names = []
                while self.peek() != "}":
                    names.append(self.take())
                self.take()
            if self.take() != ":" or not names or not all(map(BARE.fullmatch, names)):
                raise ValueError("a column filter is one name or names in braces, then a colon")
            return self.leaf(tuple(names))
        first = self.peek() == "^"
        if first:
            self.take()
        tokens = self.string()
        while self.peek() == "+":
            self.take()
            tokens += self.string()
        prefix = self.peek() == "*"
        if prefix:
            self.take()
        return Phrase(tokens, columns, prefix, first)

    def string(self) -> tuple[str, ...]:
        x = self.take()
        if x in ("AND", "OR", "NOT") or not (x[0] == x[-1] == '"' and len(x) > 1 or BARE.fullmatch(x)):
            raise ValueError(f"unexpected {x}")
        if x == "NEAR" and self.peek() == "(":
            raise ValueError("NEAR is not supported")
        if not (t := tokens_of(x.replace('""', " ") if x[0] == '"' else x)):
            raise ValueError(f"no word in {x}")
        return t


def within(node, columns: tuple[str, ...]):
    """A query whose phrases are bound to the columns, as far as they are not already."""
    if isinstance(node, Phrase):
        return node if node.columns else replace(node, columns=columns)
    if isinstance(node, Not):
        return Not(within(node.keep, columns), within(node.drop, columns))
    return type(node)(tuple(within(p, columns) for p in node.parts))


def raw(text: str):
    """Boolean syntax: AND (or nothing), OR, NOT, quoted phrases, a + b (a phrase), prefix*, ^first, column: or {columns}:
    before a phrase or parenthesis. Everything else raises, NEAR and unquoted punctuation too."""
    p = _Parser(text)
    out = p.either()
    if p.peek() is not None:
        raise ValueError(f"unexpected {p.peek()}")
    return out


def leaves(node) -> list[Phrase]:
    """The phrases that count in the score, repeats included; what NOT drops does not."""
    if isinstance(node, Phrase):
        return [node]
    if isinstance(node, Not):
        return leaves(node.keep)
    return [x for p in node.parts for x in leaves(p)]


def all_leaves(node) -> list[Phrase]:
    if isinstance(node, Phrase):
        return [node]
    if isinstance(node, Not):
        return all_leaves(node.keep) + all_leaves(node.drop)
    return [x for p in node.parts for x in all_leaves(p)]
