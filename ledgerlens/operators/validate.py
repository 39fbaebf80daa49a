"""Checks and column selections: they fail early, by name, and never scan data unless they must."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which the keys may come.
KEY_ALIASES = {"client_id": ("user_id", "customer_id", "client", "user"), "card_id": ("card", "cardid")}


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df


def rename_keys(df: DataFrame, aliases: Mapping[str, Sequence[str]] = KEY_ALIASES) -> DataFrame:
    """Give the keys their names where they come under an alias (the first alias found, whatever its case)."""
    by_lower = {c.lower(): c for c in df.columns}
    for name, others in aliases.items():
        if name not in df.columns:
            found = next((by_lower[o] for o in (name, *others) if o in by_lower), None)
            if found is None:
                raise KeyError(f"no column for {name}")
            df = df.withColumnRenamed(found, name)
    return df


def keep_columns(df: DataFrame, keep: Iterable[str]) -> DataFrame:
    """Those of ``keep`` that are there, in the frame's own order."""
    wanted = set(keep)
    return df.select([c for c in df.columns if c in wanted])


def exact_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return require_columns(df, columns).select(*columns)


def conform(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Select and cast to a declared schema."""
    return require_columns(df, types).select(*(F.col(c).cast(t).alias(c) for c, t in types.items()))


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise on a repeated key: an m:1 join would silently multiply rows."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{list(keys)} isn't unique: {twice[0].asDict()}")
    return df


def must(value: Column, condition: Column, message: str) -> Column:
    """``value``, failing the job where ``condition`` doesn't hold."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("int"))


def assert_no_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    bad = [c for c, n in null_counts(df, columns).first().asDict().items() if n]
    if bad:
        raise ValueError(f"nulls in {bad}")
    return df


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.select(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns or df.columns))


def assert_same_columns(a: DataFrame, b: DataFrame, *, ordered: bool = True) -> None:
    x, y = list(a.columns), list(b.columns)
    if (x != y) if ordered else (set(x) != set(y)):
        raise ValueError(f"columns differ: only left {sorted(set(x) - set(y))}, only right {sorted(set(y) - set(x))}")


def column_report(df: DataFrame, expected: Sequence[str], ids: Sequence[str] = ("id", "fraud")) -> dict:
    """What differs from the expected features; ids and the label aren't features."""
    own = [c for c in df.columns if c not in ids]
    return {"missing": sorted(set(expected) - set(own)), "extra": sorted(set(own) - set(expected)), "ordered": [c for c in own if c in expected] == [c for c in expected if c in own]}


def split_columns(df: DataFrame, label: str = "fraud", id_col: str = "id") -> tuple[list[str], DataFrame]:
    """Feature names (numbers only, never ids) and the frame with label and id kept apart."""
    require_columns(df, [label, id_col])
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [c for c, t in df.dtypes if t in numeric and c not in (label, id_col)], df


def drop_incomplete(df: DataFrame, columns: Sequence[str], condition: Column | None = None) -> DataFrame:
    """The rows that meet a condition and have no null in ``columns``."""
    return require_columns(df if condition is None else df.where(condition), columns).na.drop(subset=list(columns))


def shape_report(df: DataFrame) -> DataFrame:
    """``column, type, nulls, rows`` of each column; one aggregation."""
    one = df.agg(F.count(F.lit(1)).alias("__rows"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"__n{i}") for i, c in enumerate(df.columns)))
    rows = (F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"__n{i}").alias("nulls"), F.col("__rows").alias("rows")) for i, (c, t) in enumerate(df.dtypes))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def column_listing(df: DataFrame) -> str:
    """The columns with their types as an HTML list."""
    return "<ol>" + "".join(f"<li>{escape(c)}: {escape(t)}</li>" for c, t in df.dtypes) + "</ol>"
