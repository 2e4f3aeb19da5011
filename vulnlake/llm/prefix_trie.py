"""Prefix trie of conversations by a van Emde Boas recursion.

Sequences are cut at half their depth, again and again, until a piece holds ``LEAF_TURNS`` turns.

* Up: a piece's name is the digest of its two halves' names, so all pieces of one height are named by one equijoin.
* Down: the prefix at a cut is named by the upper half's own prefix and the name of the piece above the cut; with it the
  lower half is a trie of its own below that name. All upper tries and lower forests of a height are made by one join,
  so a sequence of any length is named in log2(length) steps, dealt out by (sequence, piece).
* Grafting: totals are summed inside every small trie first; then, from small heights to large ones, each cut node hands
  the totals of the forest below it to its ancestors in the upper trie it hangs from.

A conversation of n turns gives at most n/2 such pairs a height, so the work is turns x log2(depth), never pairs of
conversations. Nodes are named by 128 bits of a SHA-256 over all they spell. Nothing but the greatest depth reaches the
driver.

Edge cases. Turns are ordered by turn (null first), equal ones by role and text; a row that occurs twice is two turns.
A null role or text is empty. Rows without conv_id are one conversation, the smallest; its conv_id is null, its decimal
form is ``null``, and it takes no turns from another. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import NO_ID, ship, table, written
from vulnlake.llm.ordering import in_ranges, placed, runs_of
from vulnlake.llm.registry import query

#: Height at which the recursion ends: such a piece of a sequence is one row. A power of two.
LEAF_TURNS = 4
#: Characters of role and text that choose a row's range; the order itself takes them whole.
RANGE_CHARS = 64
#: Ids in one piece of a node's list of conversations that end there.
PIECE_IDS = 1 << 14
ROOT = b"\x00" * 16
SHARED_TURNS, SHARED_BY = 6, 100


def named(*parts: Column) -> Column:
    return F.unhex(F.left(F.sha2(F.concat(*parts), 256), F.lit(32)))


def turns_of(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, _part, _at, sym, chars: every turn in order; sym names role and text. Texts are left behind here."""
    t = conversations.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                             *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    head = lambda c: F.left(F.col(c), F.lit(RANGE_CHARS))
    sym = named(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    first = F.col("turn").asc_nulls_first()
    return in_ranges(t, [F.col("conv"), first, head("role"), head("text")], [F.col("conv"), first, F.col("role"), F.col("text")],
                     ["conv", sym.alias("sym"), F.length("text").cast("long").alias("chars")], "trie-turns")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences of the conversations themselves: (conv, d, sym, chars) with d from 1, and (conv, len)."""
    runs = runs_of(turns, "conv")
    rows = placed(turns, runs, "conv").select("conv", (F.col("_pos") + 1).alias("d"), "sym", "chars")
    return rows, runs.where("_before = 0").select("conv", F.col("_total").alias("len"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``as_they_are``, each conversation c with the first crc32(c) % 6 turns of conversation c - c % 100 instead of its own."""
    runs = written(runs_of(turns, "conv"), "trie-runs")
    own = F.col("conv") != NO_ID
    heads = runs.where("_before = 0").select("conv", F.col("_total").alias("total"),
                                             F.when(own, F.crc32(F.col("conv").cast("string")) % SHARED_TURNS).otherwise(F.lit(0)).alias("h"),
                                             F.when(own, F.col("conv") - F.col("conv") % SHARED_BY).otherwise(F.col("conv")).alias("giver"))
    lens = heads.where(F.col("conv") == F.col("giver")).select("giver", F.col("total").alias("given"))
    taken = F.least("h", F.coalesce("given", F.lit(0)))
    heads = heads.join(lens, "giver", "left").select("conv", "giver", "h", taken.alias("taken"), (taken + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("len"))
    heads = written(heads, "trie-heads")
    rest = placed(turns, runs.join(heads.select("conv", "h", "taken"), "conv"), "conv").where("_pos >= h")
    rest = rest.select("conv", (F.col("_pos") - F.col("h") + F.col("taken") + 1).alias("d"), "sym", "chars")
    # A giver serves at most 199 conversations, with at most five turns each.
    first = placed(turns, runs.where((F.col("conv") % SHARED_BY == 0) & (F.col("_before") < SHARED_TURNS)), "conv").where(F.col("_pos") < SHARED_TURNS - 1)
    first = first.select(F.col("conv").alias("giver"), (F.col("_pos") + 1).alias("d"), "sym", "chars")
    lent = heads.where("taken > 0").join(first, "giver").where("d <= taken").select("conv", "d", "sym", "chars")
    return rest.unionByName(lent), heads.select("conv", "len")


def prefixes(rows: DataFrame, lens: DataFrame, leaf: int = LEAF_TURNS) -> DataFrame:
    """conv, d, name, parent, chars, last: the name of every prefix of every sequence, the empty one (d = 0) included."""
    pieces = rows.withColumn("x", F.floor((F.col("d") - 1) / leaf)).groupBy("conv", "x").agg(F.array_sort(F.collect_list(F.struct("d", "sym", "chars"))).alias("turns"))
    pieces = written(pieces, "trie-pieces")
    deepest = lens.agg(F.max("len")).first()[0] or 0
    levels = (deepest // leaf).bit_length()
    # Up: whole pieces of leaf * 2^j turns. A row per piece; the halves of one come from its neighbours below.
    whole = [written(pieces.where(F.size("turns") == leaf).select("conv", "x", named(F.concat(F.lit(b"p"), F.aggregate("turns", F.lit(b""), lambda a, t: F.concat(a, t.sym)))).alias("name")), "trie-whole")] if levels else []
    for _ in range(1, levels):
        low = whole[-1].where("x % 2 = 0").select("conv", F.shiftright("x", 1).alias("x"), F.col("name").alias("upper"))
        high = whole[-1].where("x % 2 = 1").select("conv", F.shiftright("x", 1).alias("x"), F.col("name").alias("lower"))
        whole.append(written(low.join(high, ["conv", "x"]).select("conv", "x", named(F.lit(b"p"), F.col("upper"), F.col("lower")).alias("name")), "trie-whole"))
    # Down: a sequence joins in at the greatest height at which it is cut; every cut adds the prefix that ends there.
    starts = lambda lo, hi: lens.where((F.col("len") >= lo) & (F.col("len") < hi)).select("conv", F.lit(0).cast("long").alias("x"), F.lit(ROOT).alias("name"))
    cuts = None
    for j in range(levels - 1, -1, -1):
        begun = starts(leaf << j, leaf << (j + 1))
        cuts = begun if cuts is None else cuts.unionByName(begun)
        upper = whole[j].where("x % 2 = 0").select("conv", (F.col("x") * (1 << j)).alias("x"), F.col("name").alias("piece"))
        cut = F.when(F.col("piece").isNotNull(), F.array(F.struct("x", "name"), F.struct((F.col("x") + (1 << j)).alias("x"), named(F.lit(b"c"), F.col("name"), F.col("piece")).alias("name"))))
        cuts = cuts.join(upper, ["conv", "x"], "left").select("conv", F.explode(F.coalesce(cut, F.array(F.struct("x", "name")))).alias("c")).select("conv", "c.x", "c.name")
        if j % 4 == 0 and j:
            cuts = written(cuts, "trie-cuts")
    short = starts(0, leaf)
    cuts = short if cuts is None else cuts.unionByName(short)
    # Inside a piece each prefix follows from the one before; the one that ends it has the name of that cut.
    cuts = written(cuts, "trie-cuts")
    step = lambda a, t: F.concat(a, F.array(named(F.lit(b"t"), F.element_at(a, -1), t.sym)))
    ended = cuts.where("x > 0").select("conv", (F.col("x") - 1).alias("x"), F.col("name").alias("end"))
    inner = F.aggregate(F.slice("turns", 1, leaf - 1), F.array(F.col("name")), step)
    spelt = pieces.join(cuts, ["conv", "x"]).join(ended, ["conv", "x"], "left").select("conv", "turns", F.concat(inner, F.array(F.col("end"))).alias("names"))
    below = spelt.select("conv", F.posexplode("turns").alias("i", "t"), "names").select(
        "conv", "t.d", F.get("names", F.col("i") + 1).alias("name"), F.get("names", F.col("i")).alias("parent"), "t.chars")
    ends = lens.where("len > 0").select("conv", F.col("len").alias("d"), F.lit(True).alias("last"))
    root = lens.select("conv", F.lit(0).cast("long").alias("d"), F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"), (F.col("len") == 0).alias("last"))
    return written(below.join(ends, ["conv", "d"], "left").withColumn("last", F.coalesce("last", F.lit(False))).unionByName(root), "trie-prefixes")


def grafted(nodes: DataFrame, paths: DataFrame, deepest: int, leaf: int = LEAF_TURNS) -> DataFrame:
    """name, leaves, saved: totals over all nodes below each node (itself left out)."""

    def handed(givers: DataFrame, begin: Column, kind: str) -> DataFrame:
        """Totals of givers (member, depth, leaves, saved) to their ancestors from depth ``begin`` up to their parent."""
        steps = givers.select("member", "leaves", "saved", F.explode(F.sequence(F.shiftright(begin, 12), F.shiftright(F.col("depth") - 1, 12))).alias("hi"), begin.alias("lo"), "depth")
        steps = steps.select("member", "leaves", "saved", F.explode(F.sequence(F.greatest("lo", F.shiftleft("hi", 12)), F.least(F.col("depth") - 1, F.shiftleft("hi", 12) + 4095))).alias("d"))
        up = steps.join(paths.select(F.col("conv").alias("member"), "d", "name"), ["member", "d"])
        return written(up.groupBy("name", F.col("d").alias("depth")).agg(F.min("member").alias("member"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), kind)

    weights = nodes.where("depth > 0").select("member", "depth", F.col("is_leaf").alias("leaves"), F.col("own").alias("saved"))
    begin = (F.floor((F.col("depth") - 1) / leaf) * leaf).cast("long")
    sums = [handed(weights, begin, "trie-inner")]
    height = leaf
    while height < deepest:
        below = reduce(DataFrame.unionByName, sums).where(F.col("depth") % (2 * height) == height)
        givers = below.groupBy("name", "depth").agg(F.min("member").alias("member"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        sums.append(handed(givers, F.col("depth") - height, "trie-grafts"))
        height *= 2
    return reduce(DataFrame.unionByName, sums).groupBy("name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def ends_hashed(ends: DataFrame) -> DataFrame:
    """name, ends_sha256 of (name, conv): SHA-256 of each name's ids, ascending, joined by commas.

    Ids are joined into pieces by range; only the pieces of a name follow each other through one task, as a stream."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, ids = None, 0, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)], pa.string())], ["name", "first", "ids"])

        for b in batches:
            for n, c in zip(b.column("name").to_pylist(), b.column("conv").to_pylist()):
                if ids and (n != name or len(ids) >= PIECE_IDS):
                    yield out()
                    ids = []
                if not ids:
                    name, first = n, c
                ids.append("null" if c == NO_ID else str(c))
        if ids:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        done: list[tuple[bytes, str]] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["name", "ends_sha256"])

        for b in batches:
            for n, ids in zip(b.column("name").to_pylist(), b.column("ids").to_pylist()):
                if n != name:
                    if state is not None:
                        done.append((name, state.hexdigest()))
                    name, state = n, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(done) > 10_000:
                yield out()
                done.clear()
        if state is not None:
            done.append((name, state.hexdigest()))
        if done:
            yield out()

    ranged = ends.repartitionByRange("name", "conv").sortWithinPartitions("name", "conv")
    joined = ranged.mapInArrow(pieces, "name binary, first long, ids string")
    return joined.repartition("name").sortWithinPartitions("name", "first").mapInArrow(digests, "name binary, ends_sha256 string")


def trie(sequences: tuple[DataFrame, DataFrame], leaf: int = LEAF_TURNS) -> DataFrame:
    """A row per node of the trie of (rows, lens), as ``rebuilt`` and ``as_they_are`` give them."""
    rows, lens = sequences
    paths = prefixes(rows, lens, leaf)
    nodes = paths.groupBy("name", "parent", F.col("d").alias("depth"), "chars").agg(F.min("conv").alias("member"), F.count(F.lit(1)).alias("n_convs"))
    children = nodes.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(nodes.withColumn("is_leaf", (F.col("n_children") == 0).cast("long")).withColumn("own", (F.col("n_convs") - 1) * F.col("chars")), "trie-nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    totals = grafted(nodes, paths, deepest, leaf)
    above = nodes.select(F.col("name").alias("parent"), F.col("member").alias("above"))
    ends = ends_hashed(paths.where("last").select("name", "conv"))
    out = nodes.join(totals, "name", "left").join(ends, "name", "left").join(above, "parent", "left")
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    total = lambda own, c: F.col(own) + F.coalesce(c, F.lit(0))
    return out.select(shown("member").alias("conv_id"), "depth", shown("above").alias("parent_conv_id"), "n_convs", "n_children", total("is_leaf", "leaves").alias("n_leaves"),
                      total("own", "saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


#: crc32 of a decimal number, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({v}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda k, i: xor(k >> 1, CASE WHEN k & 1 = 1 THEN 3988292384 ELSE 0 END))))"""

SQL = f"""
WITH o AS (SELECT conv_id c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) i, coalesce(role, '') role, coalesce(text, '') AS text FROM conversations),
h AS (SELECT c, {CRC32.format(v='c')} % 6 AS h, count(*) n FROM o GROUP BY c),
s AS (SELECT h.c, h.h, least(h.h, coalesce(g.n, 0)) k FROM h LEFT JOIN h g ON g.c = h.c - h.c % 100),
r AS (SELECT s.c, o.i, role, text FROM s JOIN o ON o.c = s.c - s.c % 100 AND o.i <= s.k
      UNION ALL SELECT s.c, o.i - s.h + s.k, role, text FROM s JOIN o ON o.c = s.c AND o.i > s.h),
q AS (SELECT s.c, coalesce(list(struct_pack(r := role, t := text) ORDER BY i) FILTER (WHERE i IS NOT NULL), []) l FROM s LEFT JOIN r ON r.c = s.c GROUP BY s.c),
p AS (SELECT c, d, len(l) AS size, list_slice(l, 1, d) AS p, CASE WHEN d > 0 THEN length(l[d].t) ELSE 0 END AS chars FROM (SELECT c, l, unnest(range(len(l) + 1)) d FROM q)),
n AS (SELECT p, d, min(c) m, count(*) n, max(chars) chars, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE size = d) AS ends FROM p GROUP BY p, d),
a AS (SELECT n.*, (SELECT p.p FROM p WHERE p.c = n.m AND p.d = n.d - 1) AS pp FROM n),
k AS (SELECT a.*, coalesce(x.k, 0) AS k FROM a LEFT JOIN (SELECT pp, d, count(*) k FROM a GROUP BY pp, d) x ON x.pp = a.p AND x.d = a.d + 1),
t AS (SELECT p.p, p.d, sum(CASE WHEN k.k = 0 THEN 1 ELSE 0 END) AS leaves, sum((k.n - 1) * k.chars) AS saved FROM k JOIN p ON p.c = k.m AND p.d <= k.d GROUP BY p.p, p.d)
SELECT k.m AS conv_id, k.d AS depth, u.m AS parent_conv_id, k.n AS n_convs, k.k AS n_children, t.leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, sha256(coalesce(k.ends, '')) AS ends_sha256
FROM k JOIN t ON t.p = k.p AND t.d = k.d LEFT JOIN n u ON u.p = k.pp AND u.d = k.d - 1"""


@query("op11_prefix_trie", SQL)
def op11_prefix_trie(spark, sf_dir):
    return trie(rebuilt(turns_of(table(spark, sf_dir, "conversations"))))


ship(__name__)
