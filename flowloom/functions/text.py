"""Keyword search: tokens, English stems and boolean queries with & | ! and parentheses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.functions.stemmer import EXCEPTIONS, stem, stem_column

STOP = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
_WORD = r"[^a-z0-9]+"


def words(text: Column) -> Column:
    """Distinct lower-case ASCII words; an empty array for a null text."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _WORD), lambda w: w != ""))


def parse(query: str):
    """Boolean tree of a query: a word, ('!', x), ('&', x, y) or ('|', x, y); neighbouring words are joined by &."""
    tokens = re.findall(r"[&|!()]|[^\s&|!()]+", query.lower())
    at = 0

    def either():
        nonlocal at
        left = both()
        while at < len(tokens) and tokens[at] == "|":
            at += 1
            left = ("|", left, both())
        return left

    def both():
        nonlocal at
        left = one()
        while at < len(tokens) and tokens[at] not in "|)":
            at += tokens[at] == "&"
            left = ("&", left, one())
        return left

    def one():
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"query ends too early: {query!r}")
        token = tokens[at]
        at += 1
        if token == "!":
            return ("!", one())
        if token == "(":
            inner = either()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError(f"unbalanced parenthesis: {query!r}")
            at += 1
            return inner
        if token in "&|)":
            raise ValueError(f"{token} isn't expected in {query!r}")
        return token

    tree = either()
    if at < len(tokens):
        raise ValueError(f"unbalanced parenthesis: {query!r}")
    return tree


def without_stop_words(tree):
    """The tree without stop words and what they leave empty; None if nothing is left."""
    if isinstance(tree, str):
        return None if tree in STOP else tree
    parts = [without_stop_words(x) for x in tree[1:]]
    if tree[0] == "!":
        return None if parts[0] is None else ("!", parts[0])
    left = [x for x in parts if x is not None]
    return (tree[0], *left) if len(left) == 2 else left[0] if left else None


def words_of(tree) -> list[str]:
    return [tree] if isinstance(tree, str) else [w for x in tree[1:] for w in words_of(x)]


def may_stem_to(word: Column, stems: list[str]) -> Column:
    """True for every word with one of the stems, and for few others: no rule changes the first two characters of a word, save the listed exceptions."""
    there = word.isin(*EXCEPTIONS)
    for start in sorted({s[:2] for s in stems}):
        there = there | word.startswith(start)
    return there


def matches(text: Column, query: str, stemmed: bool = True) -> Column:
    """True where the text satisfies the query. Stemmed queries lose their stop words; one of stop words alone matches no text."""
    tree = parse(query)
    held = words(text)
    if stemmed:
        tree = without_stop_words(tree)
        if tree is None:
            return F.lit(False)
        stems = [stem(w) for w in words_of(tree)]
        held = F.transform(F.filter(held, lambda w: may_stem_to(w, stems)), stem_column)

    def test(tree, held) -> Column:
        if isinstance(tree, str):
            return F.array_contains(held, stem(tree) if stemmed else tree)
        if tree[0] == "!":
            return ~test(tree[1], held)
        a, b = test(tree[1], held), test(tree[2], held)
        return a & b if tree[0] == "&" else a | b

    # Bound once: else every word of the query would split and stem the text again.
    return F.get(F.transform(F.array(held), lambda h: test(tree, h)), F.lit(0)) if stemmed else test(tree, held)
