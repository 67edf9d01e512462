"""Boolean query language: analysis of words, parsing to a tree, driver-side evaluation."""

from __future__ import annotations

import re
from dataclasses import dataclass

from textloom.functions.text import analyze


class QuerySyntaxError(ValueError):
    """The query has no meaning: an operand or a parenthesis is missing, or no word is left."""


@dataclass(frozen=True)
class Word:
    term: str


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Nothing:
    """`()`: no document."""


_MARKS = {"&&", "||", "!", "(", ")"}


def preprocess(query: str, stems: bool = True) -> list[str]:
    """Operators and stems in order. A piece of text may give several stems, or none."""
    out = []
    for piece in re.split(r"(&&|\|\||[()!])", query):
        if piece in _MARKS:
            out.append(piece)
        elif piece.strip():
            out += analyze(piece) if stems else piece.strip().lower().split()
    return out


def lex(prepared: str) -> list[str]:
    """Tokens of an already prepared query: words end at white space or parentheses only."""
    return re.findall(r"&&|\|\||!|[()]|[^\s()]+", prepared) if prepared.strip() else []


def parse(tokens: list[str]):
    """Precedence `!` over `&&` (also implied by adjacency) over `||`; an extra `)` is ignored."""
    # Every `)` without its `(` goes first, so that the grammar below sees balanced text.
    kept, depth = [], 0
    for t in tokens:
        depth += t == "("
        if t == ")" and not depth:
            continue
        depth -= t == ")"
        kept.append(t)
    if depth:
        raise QuerySyntaxError("unmatched (")
    if not kept:
        raise QuerySyntaxError("no words in the query")
    if kept == ["(", ")"]:
        return Nothing()
    at = 0

    def peek():
        return kept[at] if at < len(kept) else None

    def either():
        nonlocal at
        left = both()
        while peek() == "||":
            at += 1
            left = Or(left, both())
        return left

    def both():
        nonlocal at
        left = unary()
        while peek() not in (None, "||", ")"):
            at += peek() == "&&"
            left = And(left, unary())
        return left

    def unary():
        nonlocal at
        t = peek()
        if t in (None, "&&", "||", ")"):
            raise QuerySyntaxError(f"operand missing before {t or 'the end'}")
        at += 1
        if t == "!":
            return Not(unary())
        if t != "(":
            return Word(t)
        inner = either()
        at += 1
        return inner

    tree = either()
    if at != len(kept):
        raise QuerySyntaxError(f"unexpected {kept[at]}")
    return tree


def words(tree) -> list[str]:
    """Distinct terms, in order of appearance."""
    if isinstance(tree, Word):
        return [tree.term]
    parts = [tree.of] if isinstance(tree, Not) else [] if isinstance(tree, Nothing) else [tree.left, tree.right]
    return list(dict.fromkeys(w for p in parts for w in words(p)))


def evaluate(tree, leaf, both, either, negate, nothing):
    """Folds a tree with the given operations."""
    go = lambda t: evaluate(t, leaf, both, either, negate, nothing)
    match tree:
        case Word(term):
            return leaf(term)
        case Not(of):
            return negate(go(of))
        case And(left, right):
            return both(go(left), go(right))
        case Or(left, right):
            return either(go(left), go(right))
    return nothing


def matches_empty(tree) -> bool:
    """Whether a document with none of the words is a hit."""
    return evaluate(tree, lambda _: False, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a, False)
