"""Exact global order statistics without a global sort in one task.

Everything starts from one row per distinct value with its counts (pre-aggregated before the shuffle, so a hot value is one
row). Distinct values are dealt into about ``BUCKETS`` ranges by approximate quantiles; sums by range are cumulated over
these few rows, sums within ranges by a window per range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def distinct_values(df: DataFrame, value: str, sums: dict[str, str]) -> DataFrame:
    """One row per distinct non-null value with SQL aggregates."""
    return df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(*(F.expr(e).alias(n) for n, e in sums.items()))


def cumulated(values: DataFrame, names: Sequence[str], *, descending: bool = False) -> DataFrame:
    """``values`` with ``cum_<name>``: each sum over all values up to and with the row's, in order."""
    bounds = sorted(set(values.approxQuantile("value", [i / BUCKETS for i in range(1, BUCKETS)], 0.5 / BUCKETS)))
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("value"))) if bounds else F.lit(0)
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    dealt = values.withColumn("bucket", bucket)
    by = Window.orderBy(order("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).select("bucket", *(F.coalesce(F.sum(n).over(by), F.lit(0)).alias(f"before_{n}") for n in names))
    within = Window.partitionBy("bucket").orderBy(order("value"))
    # At most BUCKETS rows: their broadcast is bounded.
    joined = dealt.withColumns({f"cum_{n}": F.sum(n).over(within) for n in names}).join(F.broadcast(before), "bucket")
    return joined.withColumns({f"cum_{n}": F.col(f"cum_{n}") + F.col(f"before_{n}") for n in names}).drop("bucket", *(f"before_{n}" for n in names))


def quantiles(df: DataFrame, value: str, qs: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation, as numbers on the driver (two picked rows for each)."""
    ranked = cumulated(distinct_values(df, value, {"n": "count(1)"}), ["n"])
    total = df.where(F.col(value).isNotNull()).count()
    if not total:
        return [None] * len(qs)
    at = [(total - 1) * q for q in qs]
    wanted = sorted({r for p in at for r in (math.floor(p), math.ceil(p))})
    # The few rows that hold a wanted rank (counted from 0).
    holds = F.exists(F.array(*map(F.lit, wanted)), lambda r: (r >= F.col("cum_n") - F.col("n")) & (r < F.col("cum_n")))
    rows = ranked.where(holds).select("value", "n", "cum_n").collect()
    picks = {r: float(x.value) for r in wanted for x in rows if x.cum_n - x.n <= r < x.cum_n}
    return [picks[math.floor(p)] + (picks[math.ceil(p)] - picks[math.floor(p)]) * (p - math.floor(p)) for p in at]
