"""Correlations, rankings, importances and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def correlation_pairs(df: DataFrame, columns: Sequence[str], least: float | None = 0.8) -> DataFrame:
    """Absolute Pearson correlation of each pair of columns (upper triangle), largest first; one aggregation over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.abs(F.corr(a, b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("abs_corr")) for i, (a, b) in enumerate(pairs)))).alias("r")).select("r.*")
    return (rows if least is None else rows.where(F.col("abs_corr") >= least)).orderBy(F.desc("abs_corr"), "feature_a", "feature_b")


def drop_correlated(df: DataFrame, columns: Sequence[str], least: float = 0.8) -> DataFrame:
    """``df`` without those of ``columns`` that correlate with an earlier kept one at ``least`` or more."""
    high, kept = {(r.feature_a, r.feature_b) for r in correlation_pairs(df, columns, least).collect()}, []
    for c in columns:
        if not any((k, c) in high for k in kept):
            kept.append(c)
    return df.drop(*(c for c in columns if c not in kept))


def mean_abs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean absolute value of each column, as (feature, importance)."""
    one = df.agg(*(F.avg(F.abs(c)).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in columns))).alias("r")).select("r.*")


def rank_gap(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Two importances (feature, importance) side by side, missing ones 0, with their ranks (ties share the best) and the gap."""
    x, y = a.select("feature", F.col("importance").alias(names[0])), b.select("feature", F.col("importance").alias(names[1]))
    both = x.join(y, "feature", "full").na.fill(0, list(names))
    # One row per feature: a handful of rows in one window.
    ranked = both.withColumns({f"rank_{n}": F.rank().over(Window.orderBy(F.desc(n))) for n in names})
    return ranked.withColumn("rank_gap", F.abs(F.col(f"rank_{names[0]}") - F.col(f"rank_{names[1]}")))


def flagged_share(df: DataFrame, candidates: Mapping[str, float], value: str) -> DataFrame:
    """For each candidate threshold the share of rows at or above it."""
    one = df.agg(*(F.avg((F.col(value) >= t).cast("double")).alias(n) for n, t in candidates.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("candidate"), F.lit(float(t)).alias("threshold"), F.col(n).alias("share")) for n, t in candidates.items()))).alias("r")).select("r.*")


def stratified_split(df: DataFrame, label: str, id_col: str = "id", share: float = 0.8, seed: int = 42) -> DataFrame:
    """``is_train``: of each class the first ``share`` of the rows in the order of a seeded hash, exactly; strata are counted in 256 parts by the hash."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))
    a = df.withColumn("__h", h).withColumn("__part", F.substring("__h", 1, 2))
    parts = a.groupBy(label, "__part").agg(F.count(F.lit(1)).alias("__n"))
    by = Window.partitionBy(label)
    placed = parts.withColumns({"__before": F.coalesce(F.sum("__n").over(by.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__total": F.sum("__n").over(by)})
    r = F.row_number().over(Window.partitionBy(label, "__part").orderBy("__h", id_col))
    # 256 parts per class: the planner joins them by size.
    b = a.withColumn("__r", r).join(placed.drop("__n"), [label, "__part"])
    return b.withColumn("is_train", ((F.col("__before") + F.col("__r")) <= F.ceil(F.col("__total") * share)).cast("int")).drop("__h", "__part", "__r", "__before", "__total")


def chronological_split(df: DataFrame, cut: str, date: str = "date") -> tuple[DataFrame, DataFrame]:
    at = F.lit(cut).cast("timestamp_ntz")
    return df.where(F.col(date) < at), df.where(F.col(date) >= at)


def rebalanced(df: DataFrame, label: str = "fraud", *, over: int = 1, under: float = 1.0, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Positives repeated ``over`` times, a seeded ``under`` share of the negatives."""
    positives = df.where(F.col(label) == 1).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(over)))).drop("__copy")
    keep = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1_000_000)) < int(under * 1_000_000)
    return positives.unionByName(df.where((F.col(label) == 0) & keep))
