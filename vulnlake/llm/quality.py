"""Quality rules: one threshold table compiled into one projection, without user functions.

Edge cases. A null text has no words and is judged like an empty one (rejected by ``base_failed``). Repeated rows are
judged one by one. An empty table gives an empty result. Other input columns, also those named like a result column,
are ignored by ``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import SHINGLE_WORDS, SPACE, WORD, let, text_of, words_of
from vulnlake.llm.common import table
from vulnlake.llm.registry import query

#: Stop words are looked up among the pieces between white space, symbols and sentence marks.
PIECE = r"[\x20\x09-\x0D#*$%&|<>!,.;:]+"
#: Common function words of the supported languages (fixed values, lower case).
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "it", "that", "for", "was", "on", "with", "as", "be", "at", "by", "this", "are", "from", "or", "an", "a"],
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "dans", "pour", "par", "sur", "au", "avec", "est", "pas"],
    "es": ["el", "la", "los", "las", "de", "del", "que", "y", "en", "un", "una", "por", "con", "para", "se", "no", "su", "al", "lo", "es", "como"],
}


class Rule(NamedTuple):
    """A document fails where ``100 * part`` lies outside ``least * whole`` .. ``most * whole`` (both in percent; None: open).

    ``from_words``: the rule says nothing about shorter documents."""

    name: str
    part: str
    whole: str
    least: float | None
    most: float | None
    from_words: int = 0


#: The rules that the contract of the base check fixes.
BASE_RULES = (
    Rule("few_words", "n_words", "one", 1000, None),
    Rule("repeated_windows", "n_repeat_words", "n_words", None, 20, 1),
)
#: Length, symbol, stop-word and line ratios.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 2000, 1),
    Rule("symbols", "n_symbols", "n_words", None, 15, 1),
    Rule("shouting", "n_bangs", "n_words", None, 15, 1),
    Rule("bars", "n_bars", "n_words", None, 15, 1),
    Rule("stop_words", "n_stop_words", "n_words", 3, None, 40),
    Rule("same_next_word", "n_same_next", "n_words", None, 20, 1),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 50, 1),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90, 1),
    Rule("letters", "n_letter_words", "n_words", 50, None, 1),
)


def repeated_window_words(words: Column) -> Column:
    """Words that stand in a five-word window found twice or more in the text, the first occurrence included.

    Windows are sorted by (hash, place); a window repeats if a neighbour has its hash. Sorting the places of these,
    each adds five words, or as many as lie before the next one. No step is worse than n log n in the text's length."""
    n = SHINGLE_WORDS

    def of(w: Column) -> Column:
        return let(F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, n)])), F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0))), covered)

    def covered(h: Column) -> Column:
        windows = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        same = lambda s, x, j: F.get(s, j)["h"].eqNullSafe(x["h"])
        repeated = let(F.sort_array(windows), lambda s: F.transform(F.filter(s, lambda x, j: ((j > 0) & same(s, x, j - 1)) | same(s, x, j + 1)), lambda x: x["i"]))
        total = let(F.sort_array(repeated), lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(n), F.coalesce(F.get(p, j + 1) - x, F.lit(n)))), F.lit(0).cast("long"), lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(total)  # most texts repeat nothing

    return let(words, of)


def signals(text: Column) -> dict[str, Column]:
    """All figures that rules refer to, over the whole text."""
    words, lines = F.col("_words"), F.col("_lines")
    stop = [w for lang in STOP_WORDS.values() for w in lang]
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    char = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return {
        "n_words": F.size(words),
        "word_chars": F.length(text) - count(SPACE),
        "n_symbols": count("[#*$%&|<>]"),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_window_words(words),
        "n_lines": F.size(lines),
        "n_bangs": char("!"),
        "n_bars": char("|"),
        "n_stop_words": F.size(F.filter(F.split(F.lower(text), PIECE), lambda w: w.isin(stop))),
        "n_same_next": F.size(F.filter(words, lambda w, i: w.eqNullSafe(F.get(words, i - 1)))),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]"))),
        "n_letter_words": count(r"\p{L}[^\x20\x09-\x0D]*"),
    }


def parts(text: Column) -> Column:
    """Generator of the words and of the lines with a word: as columns of their own, for an alias would be inlined into every use."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return F.inline(F.array(F.struct(words_of(text).alias("_words"), lines.alias("_lines"))))


def compiled(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression: some rule fails."""
    failed = F.lit(False)
    for r in rules:
        part, whole = F.lit(100) * F.col(r.part), F.col(r.whole) if r.whole != "one" else F.lit(1)
        outside = F.lit(False)
        if r.least is not None:
            outside = outside | (part < F.lit(r.least) * whole)
        if r.most is not None:
            outside = outside | (part > F.lit(r.most) * whole)
        failed = failed | (outside & (F.col("n_words") >= r.from_words))
    return failed


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES, *, names: bool = False) -> DataFrame:
    """One row per input row: doc_id, every signal, ``base_failed`` and ``kept``; with ``names`` also the failed rules."""
    df = text_of(docs).select("doc_id", "text", parts(F.col("text")))
    df = df.select("doc_id", *[x.cast("long").alias(k) for k, x in signals(F.col("text")).items()])
    df = df.withColumn("base_failed", compiled(base))
    df = df.withColumn("kept", ~F.col("base_failed") & ~compiled(rules))
    if names:
        df = df.withColumn("failed_rules", F.filter(F.array(*[F.when(compiled((r,)), F.lit(r.name)) for r in (*base, *rules)]), lambda x: x.isNotNull()))
    return df


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns. Judged in the same projection: no join, no shuffle."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    df = row.select("_row", "_text", parts(F.col("_text")))
    df = df.select("_row", *[x.cast("long").alias(k) for k, x in signals(F.col("_text")).items()])
    return df.where(~compiled(base) & ~compiled(rules)).select("_row.*")


_STOPS = ", ".join(f"'{w}'" for lang in STOP_WORDS.values() for w in lang)
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT k, unnest(generate_series(1, len(w) - 4)) AS i, w FROM t WHERE len(w) > 5),
keyed AS (SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS c FROM win),
cover AS (SELECT k, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n
          FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM keyed WHERE c > 1) GROUP BY k),
s AS (SELECT doc_id, len(w)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(cover.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
             (length(text) - length(replace(text, '!', '')))::BIGINT AS n_bangs,
             (length(text) - length(replace(text, '|', '')))::BIGINT AS n_bars,
             len(list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D#*$%&|<>!,.;:]+'), lambda x: x IN ({_STOPS})))::BIGINT AS n_stop_words,
             len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_same_next,
             len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*\x{{2022}}]')))::BIGINT AS n_bullet_lines,
             len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words
      FROM t LEFT JOIN cover USING (k)),
b AS (SELECT *, n_words < 10 OR (n_words >= 1 AND 100 * n_repeat_words > 20 * n_words) AS base_failed FROM s)
SELECT *, NOT base_failed AND NOT (n_words >= 1 AND (100 * word_chars < 200 * n_words OR 100 * word_chars > 2000 * n_words
    OR 100 * n_symbols > 15 * n_words OR 100 * n_bangs > 15 * n_words OR 100 * n_bars > 15 * n_words
    OR (n_words >= 40 AND 100 * n_stop_words < 3 * n_words) OR 100 * n_same_next > 20 * n_words
    OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_bullet_lines > 90 * n_lines OR 100 * n_letter_words < 50 * n_words)) AS kept
FROM b"""


@query("op2_quality_rules", SQL)
def op2_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))
