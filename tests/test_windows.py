"""Window features: hand-computed micro-cases, invariants and brute force."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import windows as W

START = dt.datetime(2024, 1, 1)


def log(spark, values, seconds=None, entity=None):
    """One row per value: id, entity e, date, tsec, v."""
    seconds = seconds or range(len(values))
    rows = [(i, entity[i] if entity else 1, START + dt.timedelta(seconds=s), s, v) for i, (v, s) in enumerate(zip(values, seconds))]
    kind = "string" if isinstance(values[0], str) else "double"
    return spark.createDataFrame(rows, f"id long, e long, date timestamp_ntz, tsec long, v {kind}")


def column(df, expression):
    return [r[0] for r in df.select("id", expression.alias("x")).orderBy("id").select("x").collect()]


LETTERS = list("abbcaab")


def test_trailing_count_ties(spark):
    assert column(log(spark, [1.0] * 5, [0, 0, 3600, 3601, 3601]), W.trailing_count("e")) == [1, 2, 3, 2, 3]


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: W.matches_last("v", 5, "e"), [0, 0, 1, 0, 1, 2, 2]),
        (lambda: W.changes_before("v", "e"), [4, 4, 4, 3, 3, 3, 2]),
        (lambda: W.prior_count("v", "e"), [0, 0, 1, 0, 1, 2, 2]),
        (lambda: W.first_seen("v", "e"), [1, 1, 0, 1, 0, 0, 0]),
    ],
)
def test_letters(spark, make, want):
    assert column(log(spark, LETTERS), make()) == want


def test_changes_in(spark):
    df = W.changes_in(log(spark, LETTERS), "v", "e", "n")
    assert [r.n for r in df.orderBy("id").collect()] == [1, 2, 2, 3, 4, 3, 3]


def test_numbers(spark):
    df = log(spark, [1.0, 3.0, 5.0, 7.0])
    assert column(df, W.past_mean("v", "e")) == [1, 1, 2, 3]
    assert np.allclose(column(df, W.whole_zscore("v", "e")), [-1.161895, -0.387298, 0.387298, 1.161895], atol=1e-6)
    assert column(log(spark, [1.0, 0.0, 1.0, 1.0, 0.0]), W.sum_last("v", 3, "e")) == [0, 1, 1, 2, 2]
    assert column(log(spark, [5.0]), W.whole_zscore("v", "e")) == [0]
    assert column(log(spark, [5.0]), W.whole_zscore("v", "e", spread_default=None)) == [None]


def test_nulls_count_as_changes_but_never_match(spark):
    df = log(spark, ["a", "a", "b"]).withColumn("v", F.when(F.col("id") == 1, None).otherwise(F.col("v")))
    assert column(df, W.changed("v", "e")) == [1, 1, 1]
    assert column(df, W.matches_last("v", 2, "e")) == [0, 0, 0]


def test_brute_force(spark):
    r = np.random.default_rng(1)
    n = 400
    entity, seconds, v = r.integers(0, 4, n).tolist(), sorted(r.integers(0, 40000, n).tolist()), r.normal(size=n).round(3).tolist()
    df = log(spark, v, seconds, entity)
    counts, q = column(df, W.trailing_count("e")), column(df, W.rolling_quantile("v", 0.95, "e"))
    for i in range(n):
        own = [j for j in range(i + 1) if entity[j] == entity[i]]
        assert counts[i] == sum(seconds[j] >= seconds[i] - 3600 for j in own)
        before = [v[j] for j in own[:-1]][-50:]
        assert (q[i] is None) == (len(before) < 10)
        if q[i] is not None:
            assert abs(q[i] - np.quantile(before, 0.95)) < 1e-9


def test_later_rows_and_input_order_change_nothing(spark):
    v = [1.0, 4.0, 2.0, 8.0, 5.0, 7.0]
    make = lambda: W.past_mean("v", "e") + W.sum_last("v", 3, "e") + W.past_zscore("v", "e")
    whole = column(log(spark, v), make())
    assert np.allclose(column(log(spark, v).where("id < 4"), make()), whole[:4])
    assert np.allclose(column(log(spark, v).orderBy(F.rand(3)).repartition(3), make()), whole)
