"""Raw match expressions of full-text search: terms, prefixes, phrases, AND, OR, NOT, parentheses.

``a b`` means both; NOT is binary, ``a NOT b``; operators are upper-case words;
NOT binds closest, then AND, then OR.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fts import B, K1, TOKEN, tokens

LEXEME = re.compile(r'\s*(?:("(?:[^"]|"")*"\s?\*?)|([()])|([^\s()"]+))')


class MatchError(ValueError):
    pass


@dataclass(frozen=True)
class Phrase:
    """Tokens in a row, the last one a prefix or not."""

    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Both:
    op: str
    left: object
    right: object


def lex(text: str) -> list[object]:
    out: list[object] = []
    at = 0
    while at < len(text.rstrip()):
        m = LEXEME.match(text, at)
        if not m:
            raise MatchError(f"cannot read {text[at:]!r}")
        at = m.end()
        quoted, bracket, word = m.groups()
        if bracket or word in ("AND", "OR", "NOT"):
            out.append(bracket or word)
            continue
        raw = quoted or word
        words = tuple(re.findall(TOKEN, raw.lower()))
        if words:
            out.append(Phrase(words, raw.rstrip().endswith("*")))
        elif quoted is None:
            raise MatchError(f"no token in {raw!r}")
    return out


def parse(text: str):
    """The expression as a tree of ``Phrase`` and ``Both``."""
    items = lex(text)

    def peek():
        return items[0] if items else None

    def one():
        x = items.pop(0) if items else None
        if x == "(":
            inner = either()
            if (items.pop(0) if items else None) != ")":
                raise MatchError("a parenthesis is open")
            return inner
        if not isinstance(x, Phrase):
            raise MatchError(f"a term is missing at {x!r}")
        return x

    def without():
        left = one()
        while peek() == "NOT":
            items.pop(0)
            left = Both("NOT", left, one())
        return left

    def every():
        left = without()
        while peek() == "AND" or peek() == "(" or isinstance(peek(), Phrase):
            if peek() == "AND":
                items.pop(0)
            left = Both("AND", left, without())
        return left

    def either():
        left = every()
        while peek() == "OR":
            items.pop(0)
            left = Both("OR", left, every())
        return left

    tree = either()
    if items:
        raise MatchError(f"{items[0]!r} is too much")
    return tree


def phrases(tree) -> list[Phrase]:
    """All phrases of a tree, each once; those behind NOT count for nothing and are left out."""
    if isinstance(tree, Phrase):
        return [tree]
    out = phrases(tree.left) + ([] if tree.op == "NOT" else phrases(tree.right))
    return list(dict.fromkeys(out))


def count_of(ts: Column, p: Phrase) -> Column:
    """Places where a phrase stands."""

    def here(word: Column, i: Column) -> Column:
        test = F.lit(True)
        for j, w in enumerate(p.words):
            x = word if j == 0 else F.get(ts, i + j)
            test = test & F.coalesce(x.startswith(w) if p.prefix and j == len(p.words) - 1 else x == w, F.lit(False))
        return test

    return F.size(F.filter(ts, here))


def bm25_raw(rows: DataFrame, id_col: str, text_col: str, expression: str) -> DataFrame:
    """id, score of the rows that an expression matches, by its phrases outside NOT; statistics are of all rows."""
    tree = parse(expression)
    scored = phrases(tree)

    def all_of(t) -> list[Phrase]:
        return [t] if isinstance(t, Phrase) else all_of(t.left) + all_of(t.right)

    every = list(dict.fromkeys(all_of(tree)))
    name = {p: f"f{j}" for j, p in enumerate(every)}
    split = rows.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("ts"))
    c = split.select("id", F.size("ts").alias("dl"), *[count_of(F.col("ts"), p).alias(name[p]) for p in every])

    def holds(t) -> Column:
        if isinstance(t, Phrase):
            return F.col(name[t]) > 0
        left, right = holds(t.left), holds(t.right)
        return left | right if t.op == "OR" else left & right if t.op == "AND" else left & ~right

    stats = c.agg(F.count("*").alias("n_rows"), F.avg("dl").alias("avgdl"), *[F.count(F.when(F.col(name[p]) > 0, 1)).alias("n_" + name[p]) for p in scored])
    # one row of statistics
    hit = c.filter(holds(tree)).join(F.broadcast(stats))
    score = F.lit(0.0)
    for p in scored:
        f, n = F.col(name[p]), F.col("n_" + name[p])
        idf = F.greatest(F.lit(1e-6), F.log((F.col("n_rows") - n + 0.5) / (n + 0.5)))
        score = score + F.when(f > 0, idf * f * (K1 + 1) / (f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    return hit.select("id", score.alias("score"))
