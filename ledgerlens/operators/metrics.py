"""Exact ranking metrics, thresholds and reports from (label, score) rows: one shuffle by distinct score, no global sort."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.ranking import cumulated, distinct_values, quantiles


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def score_table(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row per distinct score, from the top: rows ``n`` and positives ``p``, and both cumulated."""
    return cumulated(distinct_values(df, score, {"n": "count(1)", "p": f"sum({label})"}), ["n", "p"], descending=True)


def rank_metrics(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """ROC-AUC (ties count half), average precision and the base rate, exact."""
    t = score_table(df, label, score)
    n, p = F.col("n").cast("double"), F.col("p").cast("double")
    sums = t.agg(F.sum("n").alias("rows"), F.sum("p").alias("pos"), F.sum(p * F.col("cum_p") / F.col("cum_n")).alias("ap"), F.sum((n - p) * (F.col("cum_p") - 0.5 * p)).alias("wins"))
    neg = F.col("rows") - F.col("pos")
    return sums.select((F.col("wins") / (F.col("pos").cast("double") * neg)).alias("auc"), (F.col("ap") / F.col("pos")).alias("prauc"), (F.col("pos") / F.col("rows")).alias("base_rate"))


def topk(df: DataFrame, shares: Sequence[float] = (0.001, 0.002, 0.005, 0.01), label: str = "label", score: str = "score", id_col: str = "id") -> DataFrame:
    """Precision, recall and lift of the top max(ceil(n * share), 1) rows; equal scores are taken by ascending id."""
    n, pos = df.where(F.col(score).isNotNull()).agg(F.count(F.lit(1)), F.coalesce(F.sum(label), F.lit(0))).first()
    grid = [(float(s), max(math.ceil(n * s), 1)) for s in shares]
    schema = "top_pct double, k long, `precision` double, recall double, lift double, base_rate double"
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    # The distinct score that each cut falls into: one row per share, found in one pass.
    row = F.struct("value", "n", "p", "cum_n", "cum_p")
    at = score_table(df, label, score).agg(*(F.max(F.when((F.col("cum_n") >= k) & (F.col("cum_n") - F.col("n") < k), row)).alias(f"c{i}") for i, (_, k) in enumerate(grid))).first()
    hits, cut = {}, {}
    for i, (_, k) in enumerate(grid):
        c = at[f"c{i}"]
        if c is None:  # more asked for than there is
            hits[i] = pos
        elif c.cum_n == k:
            hits[i] = c.cum_p
        else:
            hits[i], cut[i] = c.cum_p - c.p, (c.value, k - c.cum_n + c.n)
    # Of the cut's own ties the first by id: a bounded sorted take, not a ranking of all ties.
    parts = [df.where(F.col(score) == value).select(id_col, label).orderBy(id_col).limit(take).agg(F.lit(i).alias("i"), F.sum(label).alias("hit")) for i, (value, take) in cut.items()]
    if parts:
        for r in functools.reduce(DataFrame.unionByName, parts).collect():
            hits[r.i] += r.hit
    rows = [(s, k, hits[i] / k, hits[i] / max(pos, 1), hits[i] / k / (pos / n) if pos else 0.0, pos / n) for i, (s, k) in enumerate(grid)]
    return df.sparkSession.createDataFrame([tuple(float(x) if j != 1 else int(x) for j, x in enumerate(r)) for r in rows], schema)


def at_thresholds(df: DataFrame, thresholds: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """``thresholds`` (a few rows with ``threshold``) with alerts, tp, fp, fn, precision and recall of score >= threshold.

    The rows are pre-aggregated by the interval between neighbouring thresholds that their score falls into.
    """
    edges = sorted({r.threshold for r in thresholds.select("threshold").distinct().collect()})
    # How many edges a score reaches, by binary search; a score that is missing reaches none.
    reach = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="__score", outputCol="__level", handleInvalid="keep")
    x = F.col(score).cast("double")
    held = df.select(x.alias("__score"), F.col(label).alias("__label"))
    level = F.when(F.col("__score").isNull(), 0).when(F.isnan("__score"), len(edges)).otherwise(F.least(F.col("__level"), F.lit(len(edges)))).cast("int")
    counts = {r.level: (r.n, r.p or 0) for r in reach.transform(held).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("__label").alias("p")).collect()}
    pos, rows = sum(p for _, p in counts.values()), []
    for i, e in enumerate(edges):
        alerts, tp = (sum(x) for x in zip(*[v for k, v in counts.items() if k > i])) if any(k > i for k in counts) else (0, 0)
        rows.append((float(e), int(alerts), int(tp), int(alerts - tp), int(pos - tp), tp / alerts if alerts else 0.0, tp / pos if pos else 0.0))
    table = df.sparkSession.createDataFrame(rows, "threshold double, alerts long, tp long, fp long, fn long, `precision` double, recall double")
    return thresholds.join(F.broadcast(table), "threshold")


def sweep(df: DataFrame, shares: Sequence[float], label: str = "label", score: str = "score") -> DataFrame:
    """For each share of alerts: its exact threshold (score quantile) and what it gives."""
    cuts = quantiles(df, score, [1 - s for s in shares])
    grid = df.sparkSession.createDataFrame(list(zip(map(float, shares), cuts)), "top_pct double, threshold double")
    return at_thresholds(df, grid, label, score)


def best_under_recall(swept: DataFrame, least: float = 0.5) -> DataFrame:
    """The row of highest precision (then recall) among those with enough recall; none if there are none."""
    return swept.where(F.col("recall") >= least).orderBy(F.desc("precision"), F.desc("recall"), F.asc("threshold")).limit(1)


def operating_point(swept: DataFrame, least: float = 0.5) -> DataFrame:
    """``best_under_recall``, else the row of highest recall (then precision), with how it was chosen."""
    ok = (F.col("recall") >= least).cast("int")
    first, second = F.when(ok == 1, F.col("precision")).otherwise(F.col("recall")), F.when(ok == 1, F.col("recall")).otherwise(F.col("precision"))
    return swept.orderBy(ok.desc(), first.desc(), second.desc(), F.asc("threshold")).limit(1).withColumn("chosen_by", F.when(F.col("recall") >= least, "best_precision_under_recall").otherwise("max_recall_in_grid"))


def fixed_threshold(df: DataFrame, least: float = 0.5, n: int = 500, label: str = "label", score: str = "score") -> DataFrame:
    """Of n even thresholds from 0 to 1 the lowest with the highest precision under the recall floor."""
    from ledgerlens.functions.scalars import grid

    swept = at_thresholds(df, df.sparkSession.createDataFrame([(x,) for x in grid(0.0, 1.0, n)], "threshold double"), label, score)
    return swept.where(F.col("recall") >= least).orderBy(F.desc("precision"), F.asc("threshold")).limit(1)


def pr_point(df: DataFrame, least: float = 0.6, label: str = "label", score: str = "score") -> DataFrame:
    """On the whole precision-recall curve: the highest precision with recall >= ``least``; the lowest such threshold."""
    t = score_table(df, label, score)
    pos = t.agg(F.sum("p")).first()[0]
    curve = t.select(F.col("value").alias("threshold"), (F.col("cum_p") / F.col("cum_n")).alias("precision"), (F.col("cum_p") / F.lit(pos)).alias("recall"))
    return curve.where(F.col("recall") >= least).orderBy(F.desc("precision"), F.asc("threshold")).limit(1)


def gate(df: DataFrame, threshold: float, score: str = "score", id_col: str = "id") -> DataFrame:
    """The ids that pass to the next stage."""
    return df.where(F.col(score) >= threshold).select(id_col)


def classification_report(df: DataFrame, predicted: str = "predicted", label: str = "label") -> DataFrame:
    """Per class precision, recall, F1 and support, with the accuracy on every row."""
    c = df.agg(*(F.count_if((F.col(predicted) == i) & (F.col(label) == j)).alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1)))
    total = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    out = None
    for k, right, alerts, support in ((0, "c00", F.col("c00") + F.col("c01"), F.col("c00") + F.col("c10")), (1, "c11", F.col("c10") + F.col("c11"), F.col("c01") + F.col("c11"))):
        p, r = _safe(F.col(right), alerts), _safe(F.col(right), support)
        row = c.select(F.lit(k).alias("class"), p.alias("precision"), r.alias("recall"), _safe(2 * p * r, p + r).alias("f1"), support.alias("support"), _safe(F.col("c00") + F.col("c11"), total).alias("accuracy"))
        out = row if out is None else out.unionByName(row)
    return out


def top_decile_lift(df: DataFrame, q: float = 0.9, label: str = "label", score: str = "score") -> DataFrame:
    """The label rate of rows with score >= its q quantile over the base rate."""
    (cut,) = quantiles(df, score, [q])
    a = df.agg(F.avg(F.when(F.col(score) >= cut, F.col(label))).alias("top_rate"), F.avg(label).alias("base_rate"))
    return a.withColumns({"lift": _safe(F.col("top_rate"), F.col("base_rate")), "threshold": F.lit(cut)})


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Negatives per positive."""
    a = df.agg(F.sum(label).alias("pos"), (F.count(label) - F.sum(label)).alias("neg"))
    return a.withColumn("weight", _safe(F.col("neg"), F.col("pos")))


def as_frame(spark: SparkSession, values: dict) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))
