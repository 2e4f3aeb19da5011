"""URL filters: glob rules packed into multiword Shift-And masks, all simulated at once over each canonical URL.

A canonical URL is ``.`` + host + path. In a glob, ``*`` is any run without a slash and ``**`` any run. Bit i of a pattern
means that its first i literals are matched; a wildcard there lets the bit stay. All patterns share one row of 64-bit
words, and all URLs of a batch advance by one byte per step.

Edge cases. A null url, or one without ``://``, has an empty host and path; no host rule fits it and it gets the default
verdict. Urls are matched as UTF-8 bytes at full length. Repeated rows are judged each. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import ship, table
from vulnlake.llm.registry import query

#: Host and path rules (verdict, host, path), fixed by the query's contract.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: What decides where no rule fits: globs, then the default.
GLOBS = (("block", "*.spam-farm.**"), ("block", "*.cheap-pills.**"), ("block", "*.casino-win.**"), ("block", "*.free-bets.**"))
DEFAULT = "allow"


class Pattern(NamedTuple):
    verdict: str
    glob: str
    name: str | None  # None: a glob that only supplies a verdict
    rank: tuple


def compile_rules(rules, globs) -> list[Pattern]:
    """Best first: rules by length, then globs as listed."""
    out = [Pattern(v, f"*.{host}{path}**", host + path, (0, -len(host + path), i)) for i, (v, host, path) in enumerate(rules)]
    out += [Pattern(v, g, None, (1, 0, i)) for i, (v, g) in enumerate(globs)]
    return sorted(out, key=lambda p: p.rank)


class ShiftAnd:
    """Masks of a list of globs; ``first`` gives the index of the first glob that matches each text."""

    def __init__(self, globs: list[str]):
        literals: list[tuple[int, int]] = []  # (bit, byte that leads to it)
        loops: list[tuple[int, bool]] = []  # (bit, may pass a slash)
        starts, ends, bit = [], [], 0
        for g in globs:
            starts.append(bit)
            for token in re.findall(r"\*\*|\*|[^*]", g):
                if token[0] == "*":
                    loops.append((bit, token == "**"))
                else:
                    for byte in token.encode():
                        bit += 1
                        literals.append((bit, byte))
            ends.append(bit)
            bit += 1
        words = max(1, (bit + 63) // 64)
        self.step, self.stay, self.start = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64), np.zeros(words, np.uint64)
        one = lambda b: np.uint64(1 << (b & 63))
        for b, byte in literals:
            self.step[byte, b >> 6] |= one(b)
        for b, slash in loops:
            for byte in range(256):
                if slash or byte != ord("/"):
                    self.stay[byte, b >> 6] |= one(b)
        for b in starts:
            self.start[b >> 6] |= one(b)
        self.ends = [(b >> 6, one(b)) for b in ends]

    def first(self, flat: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """``flat``: bytes of all texts; -1 where nothing matches."""
        n = len(at)
        order = np.argsort(-length, kind="stable")
        begin, size = at[order], length[order]
        state = np.tile(self.start, (n, 1))
        rows = np.arange(n)  # those still advancing, longest first
        for j in range(int(size[0]) if n else 0):
            rows = rows[: np.searchsorted(-size[rows], -j, side="left")]
            if j % 16 == 0:
                rows = rows[state[rows].any(axis=1)]
            if not len(rows):
                break
            byte, now = flat[begin[rows] + j], state[rows]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[rows] = (moved & self.step[byte]) | (now & self.stay[byte])
        found = np.full(n, -1)
        for k in range(len(self.ends) - 1, -1, -1):
            word, mask = self.ends[k]
            found[order[(state[:, word] & mask) != 0]] = k
        return found


def judge_urls(pages: DataFrame, rules=RULES, globs=GLOBS, default: str = DEFAULT, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (of the longest host rule that fits, else null), verdict."""
    patterns = compile_rules(rules, globs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd([p.glob for p in patterns])
        for b in batches:
            texts = [f".{h}{p}".encode() for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist())]
            length = np.fromiter(map(len, texts), np.int64, len(texts))
            found = automaton.first(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(length) - length, length)
            rule = [patterns[k].name if k >= 0 else None for k in found]
            verdict = [patterns[k].verdict if k >= 0 else default for k in found]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path")), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    part = lambda k: F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k)
    host = F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), part(2).alias("path")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS pos FROM pages),
a AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r AS (SELECT *, '.' || host AS h FROM p),
f AS (SELECT *, CASE WHEN ends_with(h, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                     WHEN ends_with(h, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                     WHEN ends_with(h, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
                     WHEN ends_with(h, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                     WHEN ends_with(h, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM r)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(h || path, '^[^/]*[.](spam-farm|cheap-pills|casino-win|free-bets)[.]') THEN 'block'
            ELSE 'allow' END AS verdict FROM f"""


@query("op9_url_filter", SQL)
def op9_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))


ship(__name__)
