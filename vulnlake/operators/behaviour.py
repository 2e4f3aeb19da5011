"""Integrity and behaviour checks over business tables, logs and inventories (B*, J39)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.values import micros
from vulnlake.operators.ordered import dealt, previous, running, spread_join


def without_followup(events: DataFrame, log: DataFrame, key: str, hours: int, ts: str = "ts") -> DataFrame:
    """Events with no log record of the same key in the following ``hours``.

    Both sides go into one ordered scan that carries the next log time back to
    each event, so no event is paired with every record of a busy key."""
    rows = events.withColumn("_log", F.lit(False)).unionByName(log.withColumn("_log", F.lit(True)), allowMissingColumns=True)
    us = micros(ts)
    # newest first; at equal times the log record comes first so that it counts
    scanned = running(
        rows.withColumn("_us", us).withColumn("_neg", -us), [key], ["_neg", F.col("_log").desc(), *_ties(rows, ts)],
        {"_next": ("min", F.when(F.col("_log"), F.col("_us")))})
    late = F.col("_next").isNull() | (F.col("_next") - F.col("_us") > hours * 3_600_000_000)
    return scanned.where(~F.col("_log") & late).drop("_log", "_us", "_neg", "_next")


def _ties(df: DataFrame, ts: str) -> list[str]:
    return [c for c in df.columns if c not in (ts, "_log")]


def value_violations(rows: DataFrame, quantity="l_quantity", price="l_extendedprice", rate="l_discount", max_quantity: float = 10_000, max_rate: float = 1.0) -> DataFrame:
    q, p, r = F.col(quantity), F.col(price), F.col(rate)
    reasons = F.array_compact(F.array(
        F.when(q < 0, "negative_quantity"), F.when(q == 0, "zero_quantity"), F.when(q != F.floor(q), "fractional_quantity"), F.when(q > max_quantity, "extreme_quantity"),
        F.when(p < 0, "negative_price"), F.when(p == 0, "zero_price"), F.when((r < 0) | (r > max_rate), "rate_out_of_range")))
    return rows.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def price_mismatch(lines: DataFrame, catalogue: DataFrame, key: str, charged: Column, listed: Column, tolerance: float) -> DataFrame:
    """Lines whose price differs from the catalogue (one row per key) beyond a relative tolerance."""
    j = spread_join(lines, catalogue, key)
    return j.withColumn("_gap", F.abs(charged - listed)).where(F.col("_gap") > listed * tolerance).drop("_gap")


def coupon_reuse(uses: DataFrame, code: str, order: str, most_orders: int, discount: str, most_discount: float) -> DataFrame:
    """Codes used in too many orders; orders that stack discounts above a cap."""
    by_code = uses.groupBy(F.col(code).cast("string").alias("subject")).agg(F.countDistinct(order).alias("n"), F.round(F.sum(discount), 2).alias("discount"))
    by_order = uses.groupBy(F.col(order).cast("string").alias("subject")).agg(F.countDistinct(code).alias("n"), F.round(F.sum(discount), 2).alias("discount"))
    a = by_code.where(F.col("n") > most_orders).withColumn("issue", F.lit("code_reused"))
    return a.unionByName(by_order.where(F.col("discount") > most_discount).withColumn("issue", F.lit("stacked_discount")))


def coupon_misuse(uses: DataFrame, code: str, user: str, order: str, used_on: str, expires: str) -> DataFrame:
    """Codes that one user redeems in several orders, and uses after the code's last day, per (code, user).

    Uses of one order are counted first, dealt by all three, so a busy (code, user) sends one row per order on."""
    late = F.count_if(F.col(used_on) > F.col(expires))
    each = dealt(uses, code, user, order).groupBy(code, user, order).agg(late.alias("late"))
    g = dealt(each, code, user).groupBy(code, user).agg(F.count(order).alias("orders"), F.sum("late").alias("late"))
    issues = F.array_compact(F.array(F.when(F.col("orders") > 1, "reused_by_user"), F.when(F.col("late") > 0, "used_after_expiry")))
    return g.withColumn("issue", F.explode(issues))


def self_approval(log: DataFrame, item: str, actor: str, step: str, submit: str, approve: str) -> DataFrame:
    """Items that somebody both submitted and approved."""
    g = log.groupBy(item, actor).agg(F.bool_or(F.col(step) == submit).alias("_s"), F.bool_or(F.col(step) == approve).alias("_a"))
    return g.where("_s AND _a").drop("_s", "_a")


def settlement_gaps(orders: DataFrame, payments: DataFrame, key: str, total: str, paid: str, fulfilled: Column, cents: float = 0.01) -> DataFrame:
    """Fulfilled orders without payment or paid below their total."""
    p = payments.groupBy(key).agg(F.sum(paid).alias("_paid"))
    j = orders.where(fulfilled).join(p, key, "left")
    issue = F.when(F.col("_paid").isNull(), "unpaid").when(F.col("_paid") < F.col(total) - cents, "underpaid")
    return j.withColumn("issue", issue).where(F.col("issue").isNotNull()).drop("_paid")


def refund_issues(refunds: DataFrame, key: str, amount: str, limit: str) -> DataFrame:
    g = refunds.groupBy(key).agg(F.count(F.lit(1)).alias("refunds"), F.round(F.sum(amount), 2).alias("refunded"), F.max(limit).alias("_limit"))
    issue = F.when(F.col("refunded") > F.col("_limit"), "oversized").when(F.col("refunds") > 1, "repeated")
    return g.withColumn("issue", issue).where(F.col("issue").isNotNull()).drop("_limit")


def missing_step(log: DataFrame, key: str, step: str, needs: str, then: str, ts: str = "ts") -> DataFrame:
    """Rows of step ``then`` with no earlier ``needs`` of the same key: only the first ``needs`` time matters."""
    first = log.where(F.col(step) == needs).groupBy(key).agg(F.min(ts).alias("_first"))
    j = log.where(F.col(step) == then).join(first, key, "left")
    return j.where(F.col("_first").isNull() | (F.col("_first") >= F.col(ts))).drop("_first")


def illegal_transitions(log: DataFrame, key: str, state: str, order: Sequence[str], allowed: set[tuple[str, str]]) -> DataFrame:
    """Adjacent state pairs outside the allowed table."""
    p = previous(log, [key], order, {"prev_state": state}).where(F.col("prev_state").isNotNull())
    ok = F.concat_ws(">", "prev_state", state).isin([f"{a}>{b}" for a, b in allowed])
    return p.where(~ok)


def flooding(log: DataFrame, key: str, ts: str, width: str, limit: int, slide: str | None = None) -> DataFrame:
    w = F.window(F.col(ts).cast("timestamp"), width, slide) if slide else F.window(F.col(ts).cast("timestamp"), width)
    return log.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(key, F.col("w.start").alias("start"), "n")


def replayed_tokens(uses: DataFrame, token: str, ok: Column) -> DataFrame:
    return uses.groupBy(token).agg(F.count_if(ok).alias("accepted")).where(F.col("accepted") > 1)


def imbalance(before: DataFrame, after: DataFrame, key: str, amount: str, cents: float = 0.005) -> DataFrame:
    """Keys whose totals differ between two states of the books."""
    a = before.groupBy(key).agg(F.round(F.sum(amount), 2).alias("before_total"))
    b = after.groupBy(key).agg(F.round(F.sum(amount), 2).alias("after_total"))
    j = a.join(b, key, "full_outer").fillna(0.0, ["before_total", "after_total"])
    return j.where(F.abs(F.col("before_total") - F.col("after_total")) > cents)


def overdrawn(moves: DataFrame, key: str, order: Sequence[str | Column], delta: str | Column, opening: str | Column | None = None) -> DataFrame:
    """Moves after which the running balance of a key is negative."""
    d = F.col(delta) if isinstance(delta, str) else delta
    start = F.lit(0) if opening is None else (F.col(opening) if isinstance(opening, str) else opening)
    b = running(moves.withColumn("_delta", d), [key], list(order), {"balance": ("sum", F.col("_delta"))})
    return b.withColumn("balance", F.col("balance") + start).where(F.col("balance") < 0).drop("_delta")


def used_after_logout(log: DataFrame, session: str, ts: str, logout: Column) -> DataFrame:
    """Activity after the last sign-out of a session."""
    last = log.where(logout).groupBy(session).agg(F.max(ts).alias("_out"))
    return log.where(~logout).join(last, session).where(F.col(ts) > F.col("_out")).drop("_out")


def key_inventory(keys: DataFrame, least_bits: int = 256, max_age_days: int = 365) -> DataFrame:
    """Keys shared between environments or purposes, too short, or never rotated. Needs key_sha, env, purpose, bits, age_days."""
    g = keys.groupBy("key_sha").agg(
        F.countDistinct("env").alias("envs"), F.countDistinct("purpose").alias("purposes"), F.min("bits").alias("bits"), F.max("age_days").alias("age_days"))
    issues = F.array_compact(F.array(
        F.when(F.col("envs") > 1, "shared_between_environments"), F.when(F.col("purposes") > 1, "several_purposes"),
        F.when(F.col("bits") < least_bits, "short_key"), F.when(F.col("age_days") > max_age_days, "no_rotation")))
    return g.withColumn("issues", issues).where(F.size("issues") > 0)


def repeated_blocks(value: str | Column, width: int = 32) -> Column:
    """Whether a hex text repeats an aligned block (a symptom of ECB mode)."""
    v = F.col(value) if isinstance(value, str) else value
    blocks = F.regexp_extract_all(v, F.lit("(.{%d})" % width), F.lit(1))
    return F.size(blocks) > F.size(F.array_distinct(blocks))


def shared_hashes(accounts: DataFrame, hash_col: str, user: str) -> DataFrame:
    """Hash values that several accounts share: stored without salt."""
    return accounts.groupBy(hash_col).agg(F.countDistinct(user).alias("accounts")).where(F.col("accounts") > 1)


def progress_bar(done: Column, total: Column, cells: int = 20) -> Column:
    n = F.when(total > 0, F.floor(done * cells / total)).otherwise(0).cast("int")
    return F.concat(F.repeat(F.lit("▓"), n), F.repeat(F.lit("░"), F.lit(cells) - n))
