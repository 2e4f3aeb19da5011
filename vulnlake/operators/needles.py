"""Literal needles of patterns: a line meets a regular expression only if it holds a text that every match must contain."""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shortest text that serves as a needle.
SHORTEST = 2


def _required(parts) -> frozenset[str] | None:
    """Texts of which each match of the parts holds one at least; None if there is no such set."""
    best, run = None, ""

    def better(new: frozenset[str] | None) -> None:
        nonlocal best
        if new and min(map(len, new)) >= SHORTEST and (best is None or (min(map(len, new)), -len(new)) > (min(map(len, best)), -len(best))):
            best = new

    for kind, value in parts:
        if kind is C.LITERAL:
            run += chr(value)
            continue
        if kind is C.AT:
            continue
        if run:
            better(frozenset([run]))
            run = ""
        if kind is C.SUBPATTERN:
            better(_required(value[-1]))
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] >= 1:
            better(_required(value[-1]))
        elif kind is C.BRANCH:
            each = [_required(b) for b in value[1]]
            better(frozenset().union(*each) if all(each) else None)
    if run:
        better(frozenset([run]))
    return best


@lru_cache(maxsize=None)
def needles(pattern: str) -> tuple[str, ...]:
    """Lower-case texts of which every match of the pattern holds one (in any case); empty if none can be told."""
    try:
        found = _required(parser.parse(pattern))
    except (parser.error, OverflowError):  # what only the engine's own dialect knows
        return ()
    texts = {t.lower() for t in found or ()}
    if not all(t.isascii() for t in texts):
        return ()
    return tuple(sorted(t for t in texts if not any(o != t and o in t for o in texts)))


def may_match(lowered: Column, pattern: str) -> Column | None:
    """Whether a line (in lower case) holds a needle of the pattern; None if the pattern has none."""
    found = needles(pattern)
    return reduce(Column.__or__, [lowered.contains(n) for n in found]) if found else None


def matched(text: str, patterns: list[str]) -> Column:
    """Numbers of the patterns that a text matches.

    Inside a lambda the patterns are evaluated one by one and not compiled into one method, which would be too large."""
    def ids(x: Column) -> Column:
        tests = []
        for i, p in enumerate(patterns):
            guard, rx = may_match(x["low"], p), x["text"].rlike(p)
            tests.append(F.when(rx if guard is None else guard & rx, F.lit(i)))
        return F.array_compact(F.array(*tests))

    return F.transform(F.array(F.struct(F.col(text).alias("text"), F.lower(text).alias("low"))), ids)[0]


def tests_left(lines: DataFrame, patterns: list[str], text: str = "code") -> DataFrame:
    """tests: (line, pattern) pairs that reach the regular expression; all: those there are."""
    low = lines.where(F.col(text) != "").select(F.lower(text).alias("_low"))
    guards = [may_match(F.col("_low"), p) for p in patterns]
    count = sum((g.cast("long") if g is not None else F.lit(1).cast("long") for g in guards), F.lit(0).cast("long"))
    return low.agg(F.sum(count).alias("tests"), (F.count(F.lit(1)) * len(patterns)).alias("all"))
