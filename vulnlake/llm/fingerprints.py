"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Every five-word window is hashed once; the high bits choose one of ``BINS`` bins and the smallest hash of a bin counts.
An empty bin borrows the value of a bin found by probing: ``PROBES`` bins in an order that depends on the empty bin alone,
then the non-empty bin that a hash of (empty bin, bin) puts first. Each bin keeps four low-order bits of its mixed value,
one hexadecimal digit of the fingerprint. Of two unrelated values one in 16 agrees by chance, so likeness is ``(agree - 1/16) / (1 - 1/16)``,
not below 0.

Edge cases. A null text is empty. A text without words has the fingerprint ``-`` (likeness 1 to another such text, else 0);
one to four words form one window. Equal texts have equal fingerprints. Documents with the same doc_id (or none: they come
last) follow each other by text. The only document of a table is its own next one. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from vulnlake.llm.common import let, shingles_of, shuffle_partitions, table, text_of, words_of
from vulnlake.llm.registry import query

BITS_OF_BIN = 8
BINS = 1 << BITS_OF_BIN
PROBES = 24
DIGITS = "0123456789abcdef"
NOTHING = "-"


def bin_of(h: Column) -> Column:
    """High bits, in the order of signed hashes."""
    return (F.shiftright(h, 64 - BITS_OF_BIN) + BINS // 2).cast("int")


def smallest(hashes: Column) -> Column:
    """The smallest hash of each bin that has one, by bin: after sorting, bins are contiguous and in order."""
    return let(F.sort_array(hashes), lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))


def densified(least: Column) -> Column:
    """A value for every bin; null where there is no hash at all."""

    def fill(m: Column) -> Column:
        return F.when(F.size(m) == BINS, m).when(F.size(m) > 0, let(let(F.transform(m, bin_of), lambda b: spread(m, b)), lambda d: F.transform(d, lambda x, i: F.coalesce(x, *probes(d, i), last(m, i)))))

    def spread(m: Column, b: Column) -> Column:
        """The values at their bins. Bin i stands at most as many places before i as bins are missing: only those are looked through."""
        missing = F.lit(BINS) - F.size(m)
        first = lambda i: F.greatest(F.lit(0), i - missing)
        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.get(m, first(i) + F.nullif(F.array_position(F.slice(b, first(i) + 1, missing + 1), i), F.lit(0)).cast("int") - 1))

    def probes(d: Column, i: Column) -> list[Column]:
        return [F.get(d, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]

    def last(m: Column, i: Column) -> Column:
        return F.array_min(F.transform(m, lambda x: F.struct(F.xxhash64(i, bin_of(x)).alias("o"), x.alias("x"))))["x"]

    return let(least, fill)


def fingerprint_of(text: Column) -> Column:
    # Mixed with the bin's number first: else a value that many bins borrow would agree by chance in all of them together.
    digit = lambda x, i: F.substring(F.lit(DIGITS), F.xxhash64(x, i).bitwiseAND(15).cast("int") + 1, F.lit(1))
    digits = F.transform(densified(smallest(shingles_of(words_of(text)))), digit)
    return F.coalesce(F.array_join(digits, ""), F.lit(NOTHING))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, corrected for chance agreement."""
    agree = let(F.split(b, ""), lambda y: F.size(F.filter(F.split(a, ""), lambda x, i: x == F.get(y, i))))
    chance = 1.0 / len(DIGITS)
    estimate = F.greatest(F.lit(0.0), (agree / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a == b, F.lit(1.0)).when((a == NOTHING) | (b == NOTHING), F.lit(0.0)).otherwise(estimate)


def with_next(docs: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """Each document with ``next_<column>`` of the one with the next lower doc_id, the last with the first's.

    Documents are dealt once, into ranges of doc_id of about equal size; only the bounds of the ranges and the highest
    doc_id in each (``buckets`` numbers) pass the driver. The first document of a range also goes to the range before it,
    so that no range waits for another."""
    spark, ids = docs.sparkSession, docs.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 10 * buckets).alias("c")).first()["c"] or []
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<bigint>")
    # Range 0 holds rows without doc_id, which come last.
    number = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(1 + F.size(F.filter(cuts, lambda c: c < F.col("doc_id"))))
    tops = sorted((r["range"], r["top"]) for r in ids.withColumn("range", number).groupBy("range").agg(F.max("doc_id").alias("top")).collect())
    # A range's first document also ends the range above it; the very first one ends the lowest range.
    ghosts = spark.createDataFrame([(b, top, tops[(k + 1) % len(tops)][0]) for k, (b, top) in enumerate(tops)], "range int, top long, above int")
    row = docs.withColumn("range", number).join(F.broadcast(ghosts), "range")
    place = lambda r, ghost: F.struct(F.col(r).alias("range"), F.lit(ghost).alias("ghost"))
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(place("range", False), place("above", True))).otherwise(F.array(place("range", False)))
    row = row.select(*docs.columns, F.inline(copies)).repartition(shuffle_partitions(spark), "range")
    order = W.partitionBy("range").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    return row.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("NOT ghost").drop("ghost", "range")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each document."""
    return text_of(docs).select("doc_id", fingerprint_of(F.col("text")).alias("fingerprint"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each text against itself with its second half replaced by the start of the next document, and against that document."""
    d = text_of(docs).withColumn("fingerprint", fingerprint_of(F.col("text")))
    d = with_next(d, ["text", "fingerprint"], 4 * shuffle_partitions(docs.sparkSession))
    half = F.floor(F.length("text") / 2).cast("int")
    d = d.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fingerprint", "next_fingerprint",
                 F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"))
    d = d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint_of(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    fp = F.col("fingerprint")
    return d.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                    likeness(fp, F.col("edited_fingerprint")).alias("near_edited"), likeness(fp, F.col("next_fingerprint")).alias("near_next"))


@query("op5_document_fingerprints")
def op5_document_fingerprints(spark, sf_dir):
    return edited_likeness(table(spark, sf_dir, "documents"))
