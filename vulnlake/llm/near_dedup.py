"""Near duplicates by ProbMinHash, banding and verification.

Signatures. The distinct five-word shingles of a text, weighted by 1 + log2 of their count, arrive as Poisson processes
whose rates are the weights; each arrival falls to a random register, which keeps the earliest. A shingle stops once its
next arrival is later than all registers hold. Two registers agree with the probability Jaccard similarity. A text that
repeats shingles gets a second signature in which each weighs 1, whose registers agree with the plain Jaccard similarity
that links are made by; for other texts both signatures are the same.

Candidates. ``BANDS`` bands of ``ROWS`` registers of each signature name the buckets of a text. First every text is compared with one leader of
its buckets, which joins groups of copies at one comparison each. Then more and more texts of a bucket lead, until no two
of it are left that were neither compared, nor in one class already, nor shown to share too few shingles. So no pair that
shares a bucket is lost, and no group is compared pair by pair.

Links. A pair is linked if the plain Jaccard similarity of its shingle sets is ``THRESHOLD`` or more. Classes are the
connected components of texts, named by their smallest (doc_id, key of the text). Exact copies share one representative
from the start. Texts and not doc_ids are compared, so two texts under one doc_id may lie in two classes; class_key then
tells these apart.

Edge cases. A null text is empty; texts without a word are near only their exact copies; one to four words form one
shingle. A document without doc_id is known by a number below -2**62 that its text gives. Rows repeated in full are copies
of each other, each with a row in the result. An empty table gives an empty result. ``classes`` ignores extra columns;
``keep_one`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from vulnlake.llm.common import ship, shingles_of, table, text_of, words_of, written
from vulnlake.llm.ordering import in_ranges
from vulnlake.llm.registry import query

BANDS, ROWS, THRESHOLD = 40, 7, 0.8
#: 64-bit words of the parity sketch that bounds how much two sets differ.
PARITY = 16
#: Leaders per bucket: SLOTS, then SLOTS times as many in each further round.
SLOTS = 4096
UNNAMED = -(1 << 62)
#: Parts over which the members of a class are dealt to learn its name.
PARTS = 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-known 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prob_minhash(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Registers of each document; ``doc`` numbers the documents of the (distinct) items. All documents need an item."""
    earliest = np.full(n_docs * registers, np.inf)
    owner = np.zeros(n_docs * registers, np.uint64)
    latest = np.full(n_docs, np.inf)
    time, step = np.zeros(len(doc)), np.uint64(0)
    golden = np.uint64(0x9E3779B97F4A7C15)
    while len(doc):
        # One arrival of each at a time; several when few are left, which saves rounds and changes nothing.
        burst = 1 if len(doc) > 20_000 else 8
        ticks = (step + np.arange(1, burst + 1, dtype=np.uint64)) * golden
        step += np.uint64(burst)
        r = mixed(item[:, None] + ticks)
        gap = -np.log(((r >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / weight[:, None]
        arrival = time[:, None] + np.cumsum(gap, axis=1)
        place = ((mixed(r ^ golden) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64) + doc[:, None] * registers
        flat, at = place.ravel(), arrival.ravel()
        useful = at < earliest[flat]
        flat, at, who = flat[useful], at[useful], np.repeat(item, burst)[useful]
        np.minimum.at(earliest, flat, at)
        won = earliest[flat] == at
        owner[flat[won]] = who[won]
        latest = earliest.reshape(n_docs, registers).max(axis=1)
        time = arrival[:, -1]
        going = time < latest[doc]
        doc, item, weight, time = doc[going], item[going], weight[going], time[going]
    return owner.reshape(n_docs, registers)


def keys_of(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, bands: int, rows: int) -> np.ndarray:
    """Band keys (a row per document) of one signature."""
    registers = prob_minhash(doc, item, weight, n_docs, bands * rows).reshape(n_docs, bands, rows)
    key = mixed(np.arange(1, bands + 1, dtype=np.uint64))[None, :] + np.zeros((n_docs, 1), np.uint64)
    for r in range(rows):
        key = mixed(key ^ registers[:, :, r])
    return key.view(np.int64)


def band_keys(hashes: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> list[np.ndarray]:
    """Band keys of each document from its shingle hashes, repeats included: those of the weighted signature, then those of
    the plain one where shingles are repeated. Both lie in one space, so that texts without repeats meet either."""
    keys: list[np.ndarray] = [np.zeros(0, np.int64)] * len(hashes)
    full = [k for k, h in enumerate(hashes) if len(h)]
    if not full:
        return keys
    doc = np.repeat(np.arange(len(full)), [len(hashes[k]) for k in full])
    item = np.concatenate([hashes[k] for k in full]).view(np.uint64)
    order = np.lexsort((item, doc))
    doc, item = doc[order], item[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
    count = np.diff(np.append(first, len(doc)))
    doc, item = doc[first], item[first]
    for k, row in zip(full, keys_of(doc, item, 1 + np.log2(count), len(full), bands, rows)):
        keys[k] = row
    repeats = np.zeros(len(full), bool)
    repeats[doc[count > 1]] = True
    some = np.flatnonzero(repeats)
    if len(some):
        own = repeats[doc]
        for k, row in zip(some, keys_of((np.cumsum(repeats) - 1)[doc[own]], item[own], np.ones(own.sum()), len(some), bands, rows)):
            keys[full[k]] = np.unique(np.append(keys[full[k]], row))
    return keys


def named(docs: DataFrame) -> DataFrame:
    """id, key (of the text) and text."""
    d = text_of(docs)
    unnamed = F.lit(UNNAMED) - F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1))
    return d.select(F.coalesce("doc_id", unnamed).alias("id"), F.md5("text").alias("key"), "text")


def signatures(d: DataFrame) -> DataFrame:
    """id, key and band keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                lists = s.column("hashes")
                ends, flat = np.asarray(lists.offsets), lists.values.to_numpy(zero_copy_only=False)
                keys = band_keys([flat[x:y] for x, y in zip(ends[:-1], ends[1:])])
                out = pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)], dtype=np.int32), pa.array(np.concatenate(keys), pa.int64()))
                yield pa.RecordBatch.from_arrays([s.column("id"), s.column("key"), out], ["id", "key", "bands"])

    return d.select("id", "key", shingles_of(words_of(F.col("text"))).alias("hashes")).mapInArrow(run, "id long, key string, bands array<long>")


def unfinished(edges: DataFrame) -> DataFrame:
    """Nodes that keep edges (a > b) from being stars: with two smaller neighbours, or with a smaller and a larger one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).where("down > 1 OR (down = 1 AND up > 0)")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of all nodes of edges (a, b), comp being the smallest id, by alternating stars.

    Each step is a minimum per node, combined before the shuffle, and a join; no group is ever gathered."""
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not unfinished(e).isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))).where("a <> b").distinct()
        e = written(small, "edges")
    return e.select(F.col("a").alias("id"), F.col("b").alias("comp"))


def similarity(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    one = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    two = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    return pairs.join(one, "b").join(two, "a").where(similarity(F.col("of_a"), F.col("of_b")) >= threshold).select("a", "b")


def with_comp(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return members.withColumn("comp", F.col("id"))
    return members.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def numbered_texts(rows: DataFrame) -> DataFrame:
    """key, doc, id: every distinct text with its smallest doc_id and a number of its own, in the order of (doc, key)."""
    order = [F.col("doc"), F.col("key")]
    return in_ranges(rows.groupBy("key").agg(F.min("id").alias("doc")), order, order, ["key", "doc"], "texts").select("key", "doc", F.col("_at").alias("id"))


def near_components(docs: DataFrame, rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame | None:
    """(id, comp) of the texts that are near another, by number; None if no two share a bucket."""
    reps = rows.groupBy("key").agg(F.first("bands").alias("bands")).join(texts, "key")
    buckets = reps.select("id", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = written(buckets.join(shared, "bucket").select("bucket", "id", "n"), "members")
    if members.isEmpty():
        return None
    # Texts in the largest and most buckets lie in the middle of their group: these lead.
    score = members.groupBy("id").agg(F.sum("n").alias("score"))
    members = written(members.join(score, "id").select("bucket", "id", "score"), "members")
    # Only the row with a text's smallest doc_id gives its shingles.
    needed = texts.join(members.select("id").distinct(), "id", "left_semi").select("key", "doc", F.col("id").alias("text_id"))
    wanted = named(docs).withColumnRenamed("id", "doc").join(needed.hint("merge"), ["doc", "key"]).dropDuplicates(["text_id"])
    sets = written(wanted.select(F.col("text_id").alias("id"), F.array_distinct(shingles_of(words_of(F.col("text")))).alias("shingles")), "sets")
    # First each text meets the leader with whom it shares most buckets; that joins most classes.
    met = members.join(leaders_of(members, 1).select("bucket", "leader"), "bucket").where("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("n"))
    best = met.groupBy("id").agg(F.max(F.struct("n", (-F.col("leader")).alias("minus"))).alias("top")).select("id", (-F.col("top.minus")).alias("leader"))
    comps = components(linked(pairs_of(best), sets, threshold))
    # Then all texts of a bucket that lie in different classes, unless what they share with other classes is too little.
    slots = SLOTS
    while True:
        placed = with_comp(members, comps)
        left = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
        placed = written(placed.join(left, "bucket"), "placed")
        if placed.isEmpty():
            return comps
        placed = written(placed.join(shared_across(placed, sets), "id").where(F.col("common") >= F.col("size") * threshold - 1e-9), "placed")
        facts = ["comp", "size", "common", *(f"parity{k}" for k in range(PARITY))]
        leaders = leaders_of(placed, slots, *facts)
        met = placed.join(leaders, "bucket").where((F.col("id") != F.col("leader")) & (F.col("comp") != F.col("leader_comp")) & may_be_near(threshold))
        found = linked(pairs_of(met.select("id", "leader")), sets, threshold)
        comps = components(found.unionByName(comps.select(F.col("id").alias("a"), F.col("comp").alias("b"))))
        members = placed.select("bucket", "id", "score").join(leaders.select("bucket", F.col("leader").alias("id")), ["bucket", "id"], "left_anti")
        slots *= SLOTS


def leaders_of(members: DataFrame, slots: int, *facts: str) -> DataFrame:
    """The text with the highest score (of these the smallest id) in each bucket and slot, a slot being a part of the ids."""
    top = F.max(F.struct(F.col("score"), (-F.col("id")).alias("minus"), *facts)).alias("top")
    best = members.groupBy("bucket", F.pmod(F.xxhash64("id"), F.lit(slots)).alias("slot")).agg(top)
    return best.select("bucket", (-F.col("top.minus")).alias("leader"), *[F.col(f"top.{f}").alias(f"leader_{f}") for f in facts])


def pairs_of(met: DataFrame) -> DataFrame:
    return met.select(F.greatest("id", "leader").alias("b"), F.least("id", "leader").alias("a")).distinct()


def shared_across(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """id, size (distinct shingles), common (those that a text of another class has as well) and a sketch of the latter: the
    parity of how many fall on each of 64 * PARITY bits."""
    texts = placed.select("id", "comp").distinct().join(sets, "id")
    each = texts.select("id", "comp", F.explode("shingles").alias("shingle"))
    across = each.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("shingle")
    word, bit = F.shiftrightunsigned("shingle", 6).bitwiseAND(F.lit(PARITY - 1)), F.expr("shiftleft(1L, cast(shingle & 63 AS int))")
    parity = [F.coalesce(F.bit_xor(F.when(word == k, bit)), F.lit(0).cast("bigint")).alias(f"parity{k}") for k in range(PARITY)]
    common = each.join(across, "shingle").groupBy("id").agg(F.count("*").alias("common"), *parity)
    return texts.select("id", F.size("shingles").alias("size")).join(common, "id")


def may_be_near(threshold: float) -> Column:
    """False only where a text and a leader of another class cannot reach the threshold: their sets differ by all that is not
    common on either side, and by at least the bits in which the sketches of the common parts differ."""
    own = (F.col("size") - F.col("common")) + (F.col("leader_size") - F.col("leader_common"))
    bits = sum((F.bit_count(F.col(f"parity{k}").bitwiseXOR(F.col(f"leader_parity{k}"))) for k in range(PARITY)), F.lit(0))
    return own + bits <= (F.col("size") + F.col("leader_size")) * ((1 - threshold) / (1 + threshold)) + 1e-9


def class_names(texts: DataFrame, comps: DataFrame | None) -> DataFrame:
    """key, copy_of, class_id, class_key of every distinct text. A class of any size is dealt over ``PARTS`` tasks."""
    alone = texts.select("id", "key", F.col("doc").alias("copy_of"))
    if comps is None:
        return alone.select("key", "copy_of", F.col("copy_of").alias("class_id"), F.col("key").alias("class_key"))
    first = comps.select("comp").distinct().join(texts.select(F.col("id").alias("comp"), F.col("doc").alias("class_id"), F.col("key").alias("class_key")), "comp")
    first = first.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    named_comps = comps.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).join(first, ["comp", "part"]).select("id", "class_id", "class_key")
    return alone.join(named_comps, "id", "left").select("key", "copy_of", F.coalesce("class_id", "copy_of").alias("class_id"), F.coalesce("class_key", "key").alias("class_key"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: id, key, copy_of (smallest id of the exact copies), class_id and class_key (of the class's first text)."""
    rows = written(signatures(named(docs)), "signatures")
    texts = numbered_texts(rows)
    names = class_names(texts, near_components(docs, rows, texts, threshold))
    return rows.select("id", "key").join(names, "key").select("id", "key", "copy_of", "class_id", "class_key")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that name their class; of repeated rows, one."""
    kept = classes(docs, threshold).where("id = class_id AND key = class_key").select("id", "key").distinct()
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    unnamed = F.lit(UNNAMED) - F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1))
    d = d.select("_row", F.coalesce("doc_id", unnamed).alias("id"), F.md5("text").alias("key"))
    only = F.row_number().over(W.partitionBy("id", "key").orderBy(F.lit(0)))
    return d.join(kept, ["id", "key"]).withColumn("_nth", only).where("_nth = 1").select("_row.*")


@query("op3_near_dedup")
def op3_near_dedup(spark, sf_dir):
    c = classes(table(spark, sf_dir, "documents"))
    return c.select(F.when(F.col("id") >= UNNAMED, F.col("id")).alias("doc_id"), "class_id", "copy_of")


ship(__name__)
