"""Version keys, constraints and range matching.

A version becomes an array of its numbers without trailing zeros, then 0 for a release or -1, stage and number for a
pre-release. Spark compares arrays element by element, so any number of parts sorts right, and each pre-release sorts
below its release and above every lower version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stages in order (fixed values).
STAGES = {"dev": 1, "alpha": 2, "a": 2, "beta": 3, "b": 3, "rc": 4, "pre": 4}
TOP = (1 << 63) - 1
PRE = r"(?i)-\.?(dev|alpha|beta|rc|pre|a(?=[0-9])|b(?=[0-9]))[.-]?([0-9]*)"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def _numbers(text: Column) -> Column:
    """All numeric parts, without trailing zeros; what is no number counts as 0, what is too long as the largest."""
    number = lambda x: F.coalesce(x.try_cast("bigint"), F.when(x.rlike("^[0-9]+$"), F.lit(TOP)).otherwise(F.lit(0)))
    nums = F.transform(F.split(text, "[.]"), number)
    return F.slice(nums, F.lit(1), F.array_max(F.transform(nums, lambda x, i: F.when(x != 0, i + 1).otherwise(0))))


def _longs(*values) -> Column:
    return F.array(*[v.cast("bigint") if isinstance(v, Column) else F.lit(v).cast("bigint") for v in values])


def version_key(version: str | Column) -> Column:
    """Sortable array<bigint> of a version with any number of parts."""
    v = F.regexp_replace(F.trim(_c(version)), "^[vV]+", "")
    stage = F.lower(F.regexp_extract(v, PRE, 1))
    kind = F.lit(None)
    for word, place in STAGES.items():
        kind = F.when(stage == word, place).otherwise(kind)
    end = F.when(stage == "", _longs(0)).otherwise(_longs(-1, kind, F.coalesce(F.regexp_extract(v, PRE, 2).try_cast("bigint"), F.lit(0))))
    return F.concat(_numbers(F.regexp_replace(v, r"[-+].*$", "")), end)


def part(key: Column, i: int) -> Column:
    """The i-th number of a release key (0 where it was cut off)."""
    return F.coalesce(F.get(key, F.lit(i)), F.lit(0))


def constraint_bounds(rule: str | Column) -> Column:
    """struct<lo, lo_inclusive, hi, hi_inclusive> of one condition: ``<x``, ``<=x``, ``>x``, ``>=x``, ``~x``, ``^x``, ``x.*``, ``a - b``,
    ``a ~ b`` or an exact version."""
    r = F.trim(_c(rule))
    v = F.regexp_replace(r, r"^[<>=~^\sv]+", "")
    wild = F.regexp_replace(v, r"(\.[xX*])+$", "")
    plain = F.regexp_replace(v, r"[-+].*$", "")
    k = version_key(v)
    parts = lambda t: F.transform(F.split(t, "[.]"), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0)))

    def next_after(text: Column, at: Column) -> Column:
        """Lowest key beyond all versions that agree with ``text`` in its first ``at`` parts; that of a pre-release, so that
        those of the next version lie beyond it as well."""
        raised = F.transform(F.slice(parts(text), F.lit(1), at), lambda x, i: F.when(i + 1 == at, x + 1).otherwise(x))
        return F.concat(raised, _longs(-1, 0))

    size = lambda t: F.size(F.split(t, "[.]"))
    first = F.array_position(F.transform(parts(plain), lambda x: x != 0), True).cast("int")
    caret = F.when(first == 0, size(plain)).otherwise(first)
    span = F.split(r, r"\s+~\s+|\s+-\s+")
    lowest, highest = _longs(-TOP), _longs(TOP)
    b = lambda lo, lo_inc, hi, hi_inc: F.struct(lo.alias("lo"), F.lit(lo_inc).alias("lo_inclusive"), hi.alias("hi"), F.lit(hi_inc).alias("hi_inclusive"))
    return (
        F.when(F.size(span) == 2, b(version_key(span[0]), True, version_key(span[1]), True))
        .when(r == "*", b(lowest, True, highest, True))
        .when(r.startswith("<="), b(lowest, True, k, True)).when(r.startswith("<"), b(lowest, True, k, False))
        .when(r.startswith(">="), b(k, True, highest, True)).when(r.startswith(">"), b(k, False, highest, True))
        .when(r.startswith("~"), b(k, True, next_after(plain, F.greatest(size(plain) - 1, F.lit(1))), False))
        .when(r.startswith("^"), b(k, True, next_after(plain, caret), False))
        .when(r.rlike(r"\.[xX*]$"), b(version_key(wild), True, next_after(wild, size(wild)), False))
        .otherwise(b(k, True, k, True)))


def in_bounds(key: Column, bounds: Column) -> Column:
    lower = F.when(bounds["lo_inclusive"], key >= bounds["lo"]).otherwise(key > bounds["lo"])
    upper = F.when(bounds["hi_inclusive"], key <= bounds["hi"]).otherwise(key < bounds["hi"])
    return lower & upper


def alternatives(rule: str | Column) -> Column:
    """array<array<bounds>> of a whole constraint: alternatives (``|``, ``||``) of conditions (comma or space) that hold together."""
    either = F.split(F.trim(_c(rule)), r"\s*\|\|?\s*")
    return F.transform(either, lambda e: F.transform(F.split(F.trim(e), r"\s*,\s*|\s+(?=[<>=^]|~\S)"), constraint_bounds))


def satisfies(key: Column, rule: str | Column) -> Column:
    return F.exists(alternatives(rule), lambda e: F.forall(e, lambda b: in_bounds(key, b)))


def lower_bound(rule: str | Column) -> Column:
    """Key of the lowest version that a constraint lets in: per alternative the highest of its lower bounds."""
    return F.array_min(F.transform(alternatives(rule), lambda e: F.array_max(F.transform(e, lambda b: b["lo"]))))


def lowest_satisfying(constraints: DataFrame, rule: str, keys=("project",)) -> DataFrame:
    """Lowest version that meets every lower bound of a project."""
    return constraints.groupBy(*keys).agg(F.max(lower_bound(rule)).alias("floor"))


def match_advisories(packages: DataFrame, advisories: DataFrame, version="version", lo="lo", hi="hi") -> DataFrame:
    """Affected (package, version, advisory) with how many projects install it.

    Installations are counted per distinct version first, so a package that
    every project uses is matched once per version, not once per project; and
    versions meet only the advisories that hold them (``interval_join``)."""
    from vulnlake.operators.intervals import interval_join

    versions = packages.groupBy("package", version).agg(F.count(F.lit(1)).alias("installs"), F.countDistinct("project").alias("projects"))
    k = versions.withColumn("_k", version_key(version))
    return interval_join(k, advisories, ["package"], "_k", lo, hi).drop("_k")


def left_out(text: Column, most: int, start: int | Column = 1) -> Column:
    """``text`` and everything it becomes when up to ``most`` letters from place ``start`` on are left out.

    Letters are left out from left to right, so a choice of places is made once."""
    if most == 0:
        return F.array(text)
    places = F.when(F.length(text) >= start, F.sequence(F.lit(start) if isinstance(start, int) else start, F.length(text))).otherwise(F.array().cast("array<int>"))
    shorter = F.transform(places, lambda i: left_out(F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))), most - 1, i))
    return F.concat(F.array(text), F.flatten(shorter))


def near_names(names: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """Names at edit distance 1..``most`` of a known name of the same vendor.

    Two names that close become equal when each loses at most ``most`` letters. Names meet on these signatures, which only
    names within twice the distance share: a piece that a million names have in common brings none of them together.
    A name of n letters has about n ** most / 2 signatures, carried as hashes; equality of vendors and the distance are
    checked on the pairs, before these are made distinct. Null names and vendors have no neighbours."""
    def signed(frame: DataFrame, out: str) -> DataFrame:
        rows = frame.select("vendor", F.col("name").alias(out)).where("vendor IS NOT NULL AND name IS NOT NULL").distinct()
        return rows.select("vendor", out, F.explode(left_out(F.col(out), most)).alias("_s")).select(
            F.xxhash64("vendor", "_s").alias("_s"), F.col("vendor").alias(f"{out}_vendor"), out)

    hits = signed(names, "name").join(signed(known, "known_name"), "_s")
    distance = F.levenshtein("name", "known_name", most)
    near = hits.where(F.col("name_vendor") == F.col("known_name_vendor")).withColumn("distance", distance)
    return near.where(F.col("distance").between(1, most)).select(F.col("name_vendor").alias("vendor"), "name", "known_name", "distance").distinct()
