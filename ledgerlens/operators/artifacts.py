"""Statistics fitted on training rows and applied unchanged elsewhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import flag
from ledgerlens.operators.ranking import quantiles

HIGH_RISK_DAYS = (0, 4, 6)


def group_rates(df: DataFrame, group: str = "mcc", label: str = "fraud") -> DataFrame:
    """Rows and label rate of each group."""
    return df.groupBy(group).agg(F.count(label).alias("cnt"), F.avg(label).alias("rate"))


def ranked_rates(df: DataFrame, n: int, group: str = "mcc", label: str = "fraud") -> DataFrame:
    """The ``n`` groups of the highest label rate, with all their rows counted; equal rates by the group."""
    rates = df.groupBy(group).agg(F.count(F.lit(1)).alias("cnt"), F.avg(label).alias("rate"))
    return rates.orderBy(F.desc("rate"), F.asc(group)).limit(n)


def risky_groups(df: DataFrame, *, group: str = "mcc", label: str = "fraud", least: int = 1000, times: float = 3.0) -> DataFrame:
    """Groups of at least ``least`` rows whose rate is at least ``times`` the base rate (one row holds the base rate)."""
    base = df.agg(F.avg(label).alias("base"))
    # The right side is a single row, by its aggregate.
    return group_rates(df, group, label).join(F.broadcast(base)).where((F.col("cnt") >= least) & (F.col("rate") >= times * F.col("base"))).select(group, "cnt", "rate")


def risky_by_quantile(df: DataFrame, *, group: str = "mcc", label: str = "fraud", q: float = 0.95, least: int = 200, cutoff_year: int | None = None, year: str = "tx_year") -> DataFrame:
    """Groups of at least ``least`` rows (up to ``cutoff_year``) whose rate reaches the q quantile of all such groups' rates; raises if there are none."""
    if cutoff_year is not None:
        df = df.where(F.col(year) <= cutoff_year)
    rates = group_rates(df, group, label).where(F.col("cnt") >= least)
    (cut,) = quantiles(rates, "rate", [q])
    if cut is None:
        raise ValueError(f"no group has {least} rows")
    return rates.where(F.col("rate") >= cut)


def flag_members(df: DataFrame, members: DataFrame, name: str, key: str = "mcc") -> DataFrame:
    """1 where the key is among ``members`` (distinct keys); the planner broadcasts them while they are small."""
    return df.join(members.select(key, F.lit(1).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def fit(train: DataFrame, *, high_amount_q: float = 0.9, least: int = 1000, times: float = 3.0, high_risk_days: Sequence[int] = HIGH_RISK_DAYS) -> dict:
    """The training artifacts as plain values; the risky categories are at most as many as there are categories of ``least`` rows."""
    (threshold,) = quantiles(train, "log_abs_amount", [high_amount_q])
    risky = [r[0] for r in risky_groups(train, least=least, times=times).select("mcc").orderBy("mcc").collect()]
    return {"base_rate": train.agg(F.avg("fraud")).first()[0], "high_amount_q": high_amount_q, "high_amount_thr": threshold, "mcc_min_cnt": least, "mcc_rate_mult": times, "highrisk_mcc": risky, "high_risk_days": list(high_risk_days)}


def amount_flag(df: DataFrame, threshold: float, name: str = "high_amount") -> DataFrame:
    return df.withColumn(name, flag(F.col("log_abs_amount") >= threshold))
