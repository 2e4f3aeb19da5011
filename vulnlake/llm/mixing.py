"""Mixing sources to target weights by a low-discrepancy slot schedule over equal-token blocks.

Each source's documents are laid, in an order shuffled by a keyed hash of the doc_id, on a token line that may be run
through twice. The line is cut into blocks of equal size. Slot ``n`` of the mix takes the golden-ratio point
``frac(n * phi)``; the source whose interval of cumulative target shares holds the point gets the slot, and the k-th slot
of a source takes its k-th block. Any prefix of the mix is therefore close to the targets.

Edge cases. A null text has size 0 and takes nothing; null sources form one source of their own, ordered last. Repeated
rows are separate documents next to each other on the line. An empty table, or one without words, gives targets of 0.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from vulnlake.llm.common import NO_ID, SPACE, WORD, n_words_of, table, written
from vulnlake.llm.registry import query

GOLDEN = 0.6180339887498949
SHARE, EPOCHS, WEIGHTS = 1.5, 2, (3, 1, 2)
#: Blocks hold total / SLOTS words, so that the schedule has about SHARE * SLOTS slots for any input.
SLOTS = 1 << 18
#: Slots are ranked in runs of so many, documents summed in so many ranges of the shuffling hash, points looked up in so many cells.
RUN, RANGES, CELLS = 4096, 4096, 4096
SALT = "mix"


def whole_text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def source_sizes(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: source_size and weight, dealt out by code point order, null last."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return by.withColumn("place", place).withColumn("weight", F.get(cycle, F.pmod("place", F.lit(len(weights)))))


def targets(sources: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``target`` per source: by weight, stopped at ``epochs`` times the source's size, the excess reshared by weight.

    Sources reach their stop in the order of stop / weight, so one running sum over that order finds all that are stopped;
    the others share the rest. (One row per source; documents are not involved.)"""
    stop = F.col("source_size") * epochs
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    order = W.orderBy((stop / F.col("weight")).asc(), F.col("place"))
    t = (sources.withColumn("_all", F.sum("source_size").over(whole) * share)
         .withColumn("_w_left", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
         .withColumn("_stopped", F.coalesce(F.sum(stop).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    t = t.withColumn("_level", (F.col("_all") - F.col("_stopped")) / F.col("_w_left"))
    # The first source that is not stopped fixes the level; it is the highest of those, for each later one leaves out more.
    t = t.withColumn("_level", F.max(F.when(F.col("weight") * F.col("_level") <= stop, F.col("_level"))).over(whole))
    target = F.least(stop.cast("double"), F.coalesce(F.col("weight") * F.col("_level"), stop.cast("double")))
    return t.select("source", "place", "source_size", "weight", target.alias("target"))


def schedule(sources: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One row per slot: slot, place (of its source), k (how many slots of the source came before), block.

    Slots go on until every source has its blocks; points that fall to a source already served are skipped, and what a
    source may still lack at the end (its count differs from its share by a logarithmic term) is appended."""
    s = planned(sources, slots)
    total = s.agg(F.sum("n_blocks")).first()[0] or 0
    spark = sources.sparkSession
    order = W.orderBy("place")
    share = F.col("n_blocks") / F.sum("n_blocks").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    edges = s.where("n_blocks > 0").withColumn("hi", F.sum(share).over(order.rowsBetween(W.unboundedPreceding, 0)))
    edges = edges.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0))).withColumn("hi", F.when(F.lead("hi").over(order).isNull(), 2.0).otherwise(F.col("hi")))
    edges = edges.select("place", "n_blocks", "lo", "hi")
    # Points meet the sources of their cell only: at most one row per source and per cell on that side.
    cells = edges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1).cast("long")))))
    points = spark.range(total).select(F.col("id").alias("slot"), frac(F.col("id") * F.lit(GOLDEN)).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    hit = points.join(cells, "cell").where("lo <= u AND u < hi").select("slot", "place", "n_blocks", F.floor(F.col("slot") / RUN).alias("run"))
    counts = hit.groupBy("place", "run").agg(F.count("*").alias("c"))
    before = counts.select("place", "run", F.coalesce(F.sum("c").over(W.partitionBy("place").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    in_run = F.row_number().over(W.partitionBy("place", "run").orderBy("slot")) - 1
    ranked = hit.withColumn("i", in_run).join(before, ["place", "run"]).withColumn("k", F.col("before") + F.col("i")).where("k < n_blocks").select("slot", "place", "k")
    got = counts.groupBy("place").agg(F.sum("c").alias("got"))
    lacking = edges.join(got, "place", "left").where("coalesce(got, 0) < n_blocks")
    extra = lacking.select((F.lit(total) + F.col("place")).alias("slot"), "place", F.explode(F.sequence(F.coalesce("got", F.lit(0)).cast("long"), F.col("n_blocks") - 1)).alias("k"))
    return ranked.unionByName(extra)


def frac(x: Column) -> Column:
    return x - F.floor(x)


def planned(sources: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Sources with ``block`` (words per block, the same for all), ``want`` (whole words) and ``n_blocks``."""
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    block = F.greatest(F.lit(1), F.floor(F.sum("source_size").over(whole) / slots)).cast("long")
    return sources.withColumn("block", block).withColumn("want", F.round("target").cast("long")).withColumn("n_blocks", F.ceil(F.col("want") / F.col("block")).cast("long"))


def lined_up(sized: DataFrame, sources: DataFrame, salt: str = SALT) -> DataFrame:
    """``sized`` with place, source_size, target and ``start``, the words before it on its source's shuffled line.

    A running sum over ranges of the hash comes first, so that no task sees more than one range of a hot source."""
    key = F.md5(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    d = sized.withColumn("key", key).withColumn("part", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(RANGES)))
    d = d.join(sources, F.col("s").eqNullSafe(F.col("source")))
    parts = d.groupBy("place", "part").agg(F.sum("size").alias("n"))
    before = parts.select("place", "part", F.coalesce(F.sum("n").over(W.partitionBy("place").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = W.partitionBy("place", "part").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    return d.withColumn("inside", F.coalesce(F.sum("size").over(order), F.lit(0))).join(before, ["place", "part"]).withColumn("start", F.col("before") + F.col("inside"))


def mix(docs: DataFrame, *, share: float = SHARE, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS, slots: int = SLOTS, salt: str = SALT) -> dict[str, DataFrame]:
    """``taken``: a row per document with the words the mix takes of it and
    the epochs in which it takes any; ``pieces``: what each slot takes, in mixing
    order (slot, doc_id, epoch, from, words); ``sources``: targets."""
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("s"), n_words_of(whole_text()).alias("size"), F.md5(whole_text()).alias("content"))
                    .withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    sources = written(planned(targets(source_sizes(sized.withColumnRenamed("s", "source"), weights), share, epochs), slots), "mix-sources")
    line = lined_up(sized, sources, salt)
    order = schedule(sources, slots)
    # A document lies in the blocks that its words touch, in each run through the line; the last block ends at the target.
    loops = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")
    on_line = line.where("size > 0").select("row", "doc_id", "size", "place", "block", "want", "start", "source_size", loops).withColumn("a", F.col("start") + F.col("epoch") * F.col("source_size"))
    on_line = on_line.withColumn("b", F.least(F.col("a") + F.col("size"), F.col("want"))).where("a < b")
    touch = on_line.withColumn("k", F.explode(F.sequence(F.floor(F.col("a") / F.col("block")), F.floor((F.col("b") - 1) / F.col("block")))))
    lo, hi = F.greatest(F.col("a"), F.col("k") * F.col("block")), F.least(F.col("b"), (F.col("k") + 1) * F.col("block"))
    pieces = touch.join(order, ["place", "k"]).select("slot", "k", "place", "row", "doc_id", "epoch", (lo - F.col("a")).alias("from"), (hi - lo).alias("words"))
    per_row = pieces.groupBy("row").agg(F.sum("words").alias("taken"), F.count_if(F.col("from") == 0).alias("epochs"))
    taken = line.join(per_row, "row", "left").select("doc_id", "content", F.col("s").alias("source"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("epochs", F.lit(0)).alias("epochs"))
    return {"taken": taken, "pieces": pieces, "sources": sources}


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` as the mix reads them: each row as often as the mix begins it, rows it never reaches left out. Where the target ends
    inside a row, only the words before that point are kept (with the white space between them), and ``n_chars`` is theirs."""
    alike = W.partitionBy("_id", "_content").orderBy(F.lit(0))  # repeated rows: the n-th meets the n-th
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.md5(whole_text()).alias("_content"))
    rows = rows.withColumn("_nth", F.row_number().over(alike))
    taken = mix(docs, **settings)["taken"].select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("content").alias("_content"), "epochs", "size", "taken")
    taken = taken.withColumn("_nth", F.row_number().over(alike)).where("epochs > 0")
    each = rows.join(taken, ["_id", "_content", "_nth"]).select("_row", "epochs", "size", "taken", F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs").cast("long"))).alias("_epoch"))
    # The target ends the line, so only the last epoch of a row can take less than all of it, and then its first words.
    last = F.col("taken") - (F.col("epochs") - 1) * F.col("size")
    cut = (F.col("_epoch") == F.col("epochs")) & (last < F.col("size"))
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("_row.text").cast("string"), F.lit(f"{SPACE}*{WORD}"), F.lit(0)), F.lit(1), F.greatest(last, F.lit(0)).cast("int")), "")
    kinds = dict(docs.dtypes)
    each = each.withColumn("_part", F.when(cut, part))
    new = {c: x for c, x in (("text", F.col("_part")), ("n_chars", F.length("_part"))) if c in kinds}
    return each.select(*[F.when(F.col("_part").isNotNull(), new[c].cast(kinds[c])).otherwise(F.col("_row")[c]).alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns])


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('mix' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][(place % 3) + 1] AS weight, 2 * source_size AS stop, 1.5::DOUBLE * sum(source_size) OVER () AS goal FROM s),
l AS (SELECT *, (goal - coalesce(sum(stop) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY stop / weight, place)),
t AS (SELECT *, least(stop::DOUBLE, weight * max(CASE WHEN weight * level <= stop THEN level END) OVER ()) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS want,
             coalesce(sum(d.size) OVER (PARTITION BY t.place ORDER BY hash_part, d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
      FROM (SELECT *, ('0x' || key[1:8])::BIGINT % 4096 AS hash_part FROM d) d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (greatest(0, least(a + size, want) - a) + greatest(0, least(a + size + source_size, want) - a - source_size))::BIGINT AS taken FROM p"""


@query("op7_source_mixing", SQL)
def op7_source_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))["taken"].select("doc_id", "size", "source_size", "target", "taken")
