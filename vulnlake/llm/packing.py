"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the largest length are cut into pieces of it and a rest. Pieces are dealt at random into groups of
about ``GROUP_ITEMS``, and each group is packed alone, so no task holds more than a group and the room lost at the edges
is a bin or two per group. In a group, pieces go longest first into the open bin that they fill best. If none has room,
the length opens whose cost per word is least, counting the words that are still to come and would fit. Afterwards each
bin shrinks to the least permitted length that holds its contents. The whole is done once for each largest length allowed
for opening, and the cheapest result stays.

Edge cases. A null or empty text has no words and takes no bin (bin_id, capacity null). Repeated rows are packed each. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import n_words_of, ship, table, text_of, written
from vulnlake.llm.registry import query

LENGTHS = (256, 512, 1024, 2048, 4096)
GROUP_ITEMS = 1024
#: Cost of a bin beyond its length, in words.
PER_BIN = 16


def cost(length: int) -> float:
    return length + PER_BIN


def best_fit(sizes: list[int], lengths: list[int]) -> tuple[list[int], list[int]]:
    """Bin of each size (sizes are given longest first) and capacity of each bin, as opened."""
    waiting = sorted(sizes)
    sums = np.concatenate(([0], np.cumsum(waiting)))
    place, capacity, room = [], [], []  # room: sorted (free words, bin)
    for k, size in enumerate(sizes):
        at = bisect.bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            left = len(sizes) - k - 1  # the shorter ones, waiting[:left], are still to come

            def per_word(length: int) -> float:
                fits = min(left, bisect.bisect_right(waiting, length - size))
                return cost(length) / (size + min(length - size, int(sums[fits])))

            free = min((x for x in lengths if x >= size), key=per_word)
            b = len(capacity)
            capacity.append(free)
        place.append(b)
        bisect.insort(room, (free - size, b))
    return place, capacity


def pack_group(sizes: list[int], lengths: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size, given longest first, and the final capacity of each bin."""
    best = None
    for largest in lengths:
        if largest < sizes[0]:
            continue
        place, _ = best_fit(sizes, [x for x in lengths if x <= largest])
        offset, full = [], [0] * (max(place) + 1)
        for b, size in zip(place, sizes):
            offset.append(full[b])
            full[b] += size
        final = [lengths[bisect.bisect_left(lengths, f)] for f in full]
        spent = sum(map(cost, final))
        if best is None or spent < best[0]:
            best = spent, place, offset, final
    return best[1:]


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """A row per piece: doc_id, piece, start (first word in the document), n_words, bin_id, capacity, bin_offset."""
    lengths = tuple(sorted(lengths))
    most = lengths[-1]
    # The row number tells repeated rows apart; written, so that a repeated task cannot deal it anew.
    items = written(text_of(docs).select("doc_id", n_words_of(F.col("text")).alias("n")).withColumn("row", F.monotonically_increasing_id()), "pack-sizes")
    pieces = items.select("doc_id", "row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("n") / most) - 1))).alias("piece"))
    pieces = pieces.select("doc_id", "row", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("n") - F.col("piece") * most).cast("long").alias("n_words"))
    total = items.agg(F.sum(F.ceil(F.col("n") / most))).first()[0] or 0
    groups = max(1, -(-total // group_items))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["n_words", "row", "piece"], ascending=[False, True, True], ignore_index=True)
        place, offset, final = pack_group(g["n_words"].tolist(), lengths)
        g["bin_id"] = int(g["grp"].iloc[0]) * (group_items << 6) + np.array(place)
        g["capacity"], g["bin_offset"] = np.array(final)[place], offset
        return g[["doc_id", "piece", "start", "n_words", "bin_id", "capacity", "bin_offset"]]

    schema = "doc_id long, piece long, start long, n_words long, bin_id long, capacity long, bin_offset long"
    dealt = pieces.where("n_words > 0").withColumn("grp", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    packed = dealt.groupBy("grp").applyInPandas(run, schema)
    none = F.lit(None).cast("long")
    return packed.unionByName(pieces.where("n_words = 0").select("doc_id", "piece", "start", "n_words", none.alias("bin_id"), none.alias("capacity"), none.alias("bin_offset")))


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


ship(__name__)
