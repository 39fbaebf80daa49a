"""Point-in-time window features.

An entity's log is ordered by (date, id), so ties have a fixed order. All features of one entity share one exchange and one
sort: windows partitioned by (entity) and by (entity, value) are both satisfied by a hash of the entity. Frames end
before the current row unless a function says otherwise, so later rows never change earlier features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import flag

ORDER = ("date", "id")


def log_of(*entity: str, order: Sequence[str] = ORDER) -> WindowSpec:
    return Window.partitionBy(*entity).orderBy(*order)


def lagged(c: str, k: int, entity: str, default=None) -> Column:
    out = F.lag(c, k).over(log_of(entity))
    return out if default is None else F.coalesce(out, F.lit(default))


def sum_last(c: str, n: int, entity: str) -> Column:
    """The sum over the n rows before; missing rows count 0."""
    return F.coalesce(F.sum(c).over(log_of(entity).rowsBetween(-n, -1)), F.lit(0))


def past_sum(c: str, entity: str) -> Column:
    return F.coalesce(F.sum(c).over(log_of(entity).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def past_count(entity: str) -> Column:
    return F.row_number().over(log_of(entity)) - 1


def past_mean(c: str, entity: str) -> Column:
    """The mean of all rows before; on the first row the row's own value."""
    return F.coalesce(F.avg(c).over(log_of(entity).rowsBetween(Window.unboundedPreceding, -1)), F.col(c))


def prior_count(c: str, entity: str) -> Column:
    """How often the entity had this value before (null is a value)."""
    return F.row_number().over(log_of(entity, c)) - 1


def first_seen(c: str, entity: str) -> Column:
    return flag(prior_count(c, entity) == 0)


def matches_last(c: str, n: int, entity: str) -> Column:
    """How many of the n rows before had this row's value."""
    out = F.lit(0)
    for k in range(1, n + 1):
        out = out + flag(F.col(c) == F.lag(c, k).over(log_of(entity)))
    return out


def seen_last(c: str, n: int, entity: str) -> Column:
    return flag(matches_last(c, n, entity) > 0)


def changes_before(c: str, entity: str, n: int = 5) -> Column:
    """Changes among the n rows before (n - 1 transitions, this row left out); a missing row counts as a change."""
    out = F.lit(0)
    for k in range(1, n):
        a, b = F.lag(c, k).over(log_of(entity)), F.lag(c, k + 1).over(log_of(entity))
        out = out + F.coalesce(a != b, F.lit(True)).cast("int")
    return out


def changed(c: str, entity: str) -> Column:
    """Whether the value differs from the row before; the first row changes."""
    return F.coalesce(F.col(c) != F.lag(c, 1).over(log_of(entity)), F.lit(True)).cast("int")


def changes_in(df: DataFrame, c: str, entity: str, name: str, n: int = 5) -> DataFrame:
    """Adds the number of changes in the n rows up to and with this one."""
    temp = f"__{name}"
    return df.withColumn(temp, changed(c, entity)).withColumn(name, F.sum(temp).over(log_of(entity).rowsBetween(-(n - 1), 0)).cast("int")).drop(temp)


def recent_mean(c: str, entity: str, n: int = 10) -> Column:
    return F.avg(c).over(log_of(entity).rowsBetween(-n, -1))


def trailing_count(entity: str, seconds: int = 3600, tsec: str = "tsec") -> Column:
    """Rows in the last ``seconds`` up to this row in (date, id) order: the lower bound is in time, the upper one a row."""
    older = F.count(F.lit(1)).over(Window.partitionBy(entity).orderBy(tsec).rangeBetween(Window.unboundedPreceding, -seconds - 1))
    return (F.row_number().over(log_of(entity)) - older).cast("int")


def rolling_quantile(c: str, q: float, entity: str, n: int = 50, least: int = 10) -> Column:
    """The exact quantile of the n rows before; null with fewer than ``least``."""
    frame = log_of(entity).rowsBetween(-n, -1)
    return F.when(F.count(c).over(frame) >= least, F.percentile(c, F.lit(q)).over(frame))


def seconds_since_previous(entity: str, tsec: str = "tsec") -> Column:
    return F.coalesce(F.col(tsec) - F.lag(tsec, 1).over(log_of(entity)), F.lit(0))


def whole_zscore(c: str, entity: str, eps: float = 1e-6, spread_default: float | None = 0.0) -> Column:
    """(value - mean) / (std + eps) over the entity's whole log, later rows included; for offline use."""
    by = Window.partitionBy(entity)
    spread = F.stddev_samp(c).over(by)
    if spread_default is not None:
        spread = F.coalesce(spread, F.lit(spread_default))
    return (F.col(c) - F.avg(c).over(by)) / (spread + eps)


def past_zscore(c: str, entity: str, eps: float = 1e-6) -> Column:
    """The same with rows before only; 0 on the first row."""
    before = log_of(entity).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce((F.col(c) - F.avg(c).over(before)) / (F.coalesce(F.stddev_samp(c).over(before), F.lit(0.0)) + eps), F.lit(0.0))
