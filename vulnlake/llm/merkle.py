"""Merkle dataset manifest by sibling-shift self-joins.

A leaf is the digest of a row. Per group (language), leaves stand in order; every level equijoins its nodes with
themselves on computed sibling indices (index XOR 1 in a binary tree, the other slots of the run otherwise), and the rows in
slot zero emit the parents. The groups' roots are the leaves of one more tree of the same kind, whose root is the
manifest's. Every level is written, so a proof is one join per level on the way down: a node's path is its siblings and
its parent's path. Nothing but a tree's greatest number of leaves and the one root reaches the driver; a group of any size
is dealt out by (group, index).

Edge cases. Each null field is ``-``. Rows with equal doc_id follow each other by digest of the row, null doc_ids come
first; rows repeated in full are leaves of their own. A null language is a group of its own, the first. A group with one
row has that leaf as its root. An empty table has no root and gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import ship, table, written
from vulnlake.llm.ordering import in_ranges, placed, runs_of
from vulnlake.llm.prefix_trie import CRC32
from vulnlake.llm.registry import query

#: Levels that one plan of the way down joins before its result is written.
LEVELS_A_PLAN = 6


class Tree(NamedTuple):
    """``levels[l]``: key, idx, hash, before, after (hashes of the siblings on either side) of all nodes that have a parent;
    level 0 keeps all columns of the leaves. ``roots``: key, hash, height. ``leaves``: the rows given, with key, idx, n."""

    arity: int
    leaves: DataFrame
    levels: list[DataFrame]
    roots: DataFrame


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(fields: list[Column]) -> Column:
    """Each field as its bytes' number, a colon and itself, or a dash."""
    return digest(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (f.cast("string") for f in fields)])


def hexed(b: Column) -> Column:
    return F.lower(F.hex(b))


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (key, idx, n, hash) with the hashes of their siblings before and after them: one equijoin per other slot."""
    if arity == 2:
        other = nodes.select("key", F.col("idx").alias("_sib"), F.col("hash").alias("_h"))
        out = nodes.withColumn("_sib", F.col("idx").bitwiseXOR(F.lit(1).cast("long"))).join(other, ["key", "_sib"], "left")
        first = F.col("idx") % 2 == 0
        return out.withColumn("before", F.when(first, F.lit(b"")).otherwise(F.unhex("_h"))).withColumn("after", F.when(first, F.coalesce(F.unhex("_h"), F.lit(b""))).otherwise(F.lit(b""))).drop("_sib", "_h")
    slot = F.col("idx") % arity
    out, before, after = nodes, [], []
    for j in range(1, arity):
        other = nodes.select("key", F.col("idx").alias("_sib"), F.col("hash").alias(f"_h{j}"))
        out = out.withColumn("_sib", F.col("idx") - slot + (slot + j) % arity).join(other, ["key", "_sib"], "left").drop("_sib")
        h = F.coalesce(F.unhex(f"_h{j}"), F.lit(b""))
        before.append(F.when(slot + j >= arity, h).otherwise(F.lit(b"")))
        after.append(F.when(slot + j < arity, h).otherwise(F.lit(b"")))
    return out.withColumn("before", F.concat(*before)).withColumn("after", F.concat(*after)).drop(*[f"_h{j}" for j in range(1, arity)])


def build(leaves: DataFrame, arity: int = 2, kind: str = "merkle") -> Tree:
    """Trees over leaves (key, idx from 0 within key, n rows of the key, hash and others)."""
    most, levels, nodes = leaves.agg(F.max("n")).first()[0] or 0, [], leaves
    roots = [nodes.where("n = 1").select("key", "hash", F.lit(0).alias("height"))]
    while most > 1:
        most = -(-most // arity)
        level = written(with_siblings(nodes.where("n > 1"), arity), f"{kind}-level")
        levels.append(level)
        # Slot zero emits the parent.
        nodes = level.where(F.col("idx") % arity == 0).select("key", F.floor(F.col("idx") / arity).alias("idx"), F.ceil(F.col("n") / arity).alias("n"), digest(F.col("hash"), hexed(F.col("after"))).alias("hash"))
        roots.append(nodes.where("n = 1").select("key", "hash", F.lit(len(levels)).alias("height")))
    return Tree(arity, leaves, levels, written(reduce(DataFrame.unionByName, roots), f"{kind}-roots"))


def paths(tree: Tree, tops: DataFrame) -> DataFrame:
    """The leaves with path and the other columns of ``tops`` (key, path and more, one row per root).

    A path lists (before, after) from the leaf's level up and goes on with its root's path in ``tops``."""
    more = [c for c in tops.columns if c not in ("key", "path")]
    own = [c for c in tree.leaves.columns if c not in ("key", "idx", "n")]
    tops = written(tree.roots.select("key", "height").join(tops, "key"), "merkle-tops")
    at = lambda h: tops.where(F.col("height") == h).select("key", F.lit(0).cast("long").alias("_up"), "path", *more)
    known = at(len(tree.levels))
    for l in range(len(tree.levels) - 1, -1, -1):
        below = tree.levels[l].select("key", "idx", F.floor(F.col("idx") / tree.arity).alias("_up"), F.struct("before", "after").alias("_step"), *(own if l == 0 else []))
        known = below.join(known, ["key", "_up"]).select("key", "idx", F.concat(F.array("_step"), "path").alias("path"), *more, *(own if l == 0 else []))
        if l:
            known = known.withColumnRenamed("idx", "_up").unionByName(at(l))
            known = written(known, "merkle-paths") if l % LEVELS_A_PLAN == 0 else known
    alone = tree.leaves.where("n = 1").join(at(0).drop("_up"), "key").select("key", "idx", "path", *more, *own)
    return known.unionByName(alone) if tree.levels else alone


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(hexed(s.before), h, hexed(s.after)))


def proof_hash(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(hexed(s.before), hexed(s.after))), ""), 256)


def numbered(rows: DataFrame, order: list[Column], keep: list[str], kind: str) -> DataFrame:
    """``keep``, key, and idx and n within key."""
    ordered = in_ranges(rows, [F.col("key"), *order], [F.col("key"), *order], ["key", *keep], kind)
    out = placed(ordered, runs_of(ordered, "key"), "key")
    return out.select(*keep, "key", F.col("_pos").alias("idx"), F.col("_total").alias("n"))


def manifest(docs: DataFrame, *, arity: int = 2, changed: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path of every row; ``now`` is the digest of the row with ``changed`` as its n_chars, null if that is the same.

    The lone root reaches the driver; everything else stays in written tables."""
    fields = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), F.col("text")]
    now = F.when(~changed.eqNullSafe(fields[3]), leaf_hash([*fields[:3], changed, fields[4]])) if changed is not None else F.lit(None).cast("string")
    # A language is never empty here, so null stays first and the order is by bytes.
    rows = docs.select(fields[0].alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("key"), leaf_hash(fields).alias("hash"), now.alias("now"))
    leaves = written(numbered(rows, [F.col("doc_id").asc_nulls_first(), F.col("hash")], ["doc_id", "hash", "now"], "merkle-rows"), "merkle-leaves")
    groups = build(leaves, arity)
    subroots = groups.roots.select(F.col("key").alias("group"), "hash", F.lit("").alias("key"))
    tops = written(numbered(subroots, [F.col("group")], ["group", "hash"], "merkle-groups"), "merkle-subroots")
    top = build(tops, arity, "merkle-top")
    found = top.roots.select("hash").first()
    root = F.lit(found[0] if found else None).cast("string")
    nothing = F.array().cast("array<struct<before:binary,after:binary>>")
    above = paths(top, top.roots.select("key", nothing.alias("path"))).select(F.col("group").alias("key"), "path", F.col("hash").alias("subroot"))
    return paths(groups, above).select("doc_id", F.col("hash").alias("leaf"), "now", "subroot", root.alias("root"), "path")


def verified(proofs: DataFrame) -> DataFrame:
    """Adds proof_sha256, folded_root (from ``now`` where it is given) and verified to the rows of ``manifest``."""
    out = proofs.withColumn("proof_sha256", proof_hash(F.col("path"))).withColumn("folded_root", folded(F.coalesce("now", "leaf"), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
LEAF = "sha256(" + " || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
SQL = f"""
WITH RECURSIVE d AS (SELECT *, {LEAF.format('n_chars')} AS leaf,
    CASE WHEN {CRC32.format(v='doc_id')} % 7 = 0 THEN {LEAF.format('n_chars + 1')} END AS now FROM documents),
o AS (SELECT doc_id, coalesce('=' || lang, '') k, leaf, now, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (SELECT k, 0 AS l, i, n, leaf AS h FROM o
      UNION ALL SELECT k, l + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY k, l, i // 2),
s AS (SELECT k, l, h, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS l, i, n, h FROM s UNION ALL SELECT l + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY l, i // 2),
p AS (SELECT o.k, o.i, t.l, t.h, t.i % 2 AS slot FROM o JOIN t ON t.k = o.k AND t.n > 1 AND t.i = xor(o.i >> t.l, 1)
      UNION ALL SELECT o.k, o.i, t.l, NULL, NULL FROM o JOIN t ON t.k = o.k AND t.n > 1 AND t.i = o.i >> t.l AND t.i % 2 = 0 AND t.i = t.n - 1
      UNION ALL SELECT o.k, o.i, s.l + u.l, u.h, u.i % 2 FROM o JOIN s ON s.k = o.k JOIN u ON u.n > 1 AND u.i = xor(s.i >> u.l, 1)
      UNION ALL SELECT o.k, o.i, s.l + u.l, NULL, NULL FROM o JOIN s ON s.k = o.k JOIN u ON u.n > 1 AND u.i = s.i >> u.l AND u.i % 2 = 0 AND u.i = u.n - 1),
f AS (SELECT k, i, 0 AS l, coalesce(now, leaf) AS h FROM o
      UNION ALL SELECT f.k, f.i, f.l + 1, sha256(CASE WHEN p.slot = 0 THEN p.h || f.h ELSE f.h || coalesce(p.h, '') END) FROM f JOIN p ON p.k = f.k AND p.i = f.i AND p.l = f.l),
g AS (SELECT k, i, arg_max(h, l) AS h FROM f GROUP BY k, i),
q AS (SELECT k, i, sha256(coalesce(string_agg(h, '' ORDER BY l), '')) AS h FROM p GROUP BY k, i)
SELECT o.doc_id, o.leaf, s.h AS subroot, u.h AS root, coalesce(q.h, sha256('')) AS proof_sha256, g.h AS folded_root, g.h = u.h AS verified
FROM o JOIN s ON s.k = o.k JOIN u ON u.n = 1 JOIN g ON g.k = o.k AND g.i = o.i LEFT JOIN q ON q.k = o.k AND q.i = o.i"""


@query("op12_merkle_manifest", SQL)
def op12_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = F.col("n_chars").cast("decimal(20,0)")
    proofs = manifest(docs, changed=F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, n + 1).otherwise(n))
    return verified(proofs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


ship(__name__)
