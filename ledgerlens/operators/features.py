"""The two model tables and the exploratory features, as window projections over the clean log."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import windows as W
from ledgerlens.operators.validate import exact_columns, require_columns

#: The columns of the two model tables.
STAGE1 = (
    "log_abs_amount high_amount amount_vs_client_avg_diff amount_deviation has_error err_bad_cvv err_bad_card_number err_bad_expiration "
    "card_error_last1 client_error_last1 card_fraud_last1 client_fraud_last1 card_fraud_last3 tx_hour tx_month hour_cos is_highrisk_weekday "
    "seconds_since_prev_tx card_velocity_spike_ratio mcc_highrisk_90 card_mcc_is_new client_mcc_is_new card_merchant_is_new "
    "client_merchant_is_new merchant_is_new_x_has_error"
).split()
STAGE2 = (
    "card_fraud_last3 client_fraud_last3 amount_deviation client_merchant_is_new card_merchant_is_new mccnew_x_velocity dev_x_mccnew "
    "client_mcc_repeat_cnt_last5 card_mcc_change_cnt_last5 merchant_change_cnt_last5 client_tx_1h_avg_prev card_velocity_spike_ratio "
    "tx_hour hour_sin hour_cos current_age log_yearly_income"
).split()


def with_velocity(df: DataFrame, entity: str, short: str) -> DataFrame:
    """``<short>_tx_1h``, the mean of it so far, and their ratio."""
    a = df.withColumn(f"{short}_tx_1h", W.trailing_count(entity))
    b = a.withColumn(f"{short}_tx_1h_avg_prev", W.past_mean(f"{short}_tx_1h", entity))
    return b.withColumn(f"{short}_velocity_spike_ratio", S.ratio(F.col(f"{short}_tx_1h"), F.col(f"{short}_tx_1h_avg_prev")))


def stage1_features(tx: DataFrame, artifacts: Mapping) -> DataFrame:
    """``id``, ``fraud`` and the 25 features of the first stage. Client windows first, then card windows: two exchanges."""
    require_columns(tx, ["id", "fraud", "date", "tsec", "client_id", "card_id", "merchant_id", "mcc", "log_abs_amount", "has_error"])
    client = tx.withColumns(
        {
            "amount_vs_client_avg_diff": F.col("log_abs_amount") - W.past_mean("log_abs_amount", "client_id"),
            "amount_deviation": W.whole_zscore("log_abs_amount", "client_id"),
            "client_error_last1": W.lagged("has_error", 1, "client_id", 0),
            "client_fraud_last1": W.lagged("fraud", 1, "client_id", 0),
            "seconds_since_prev_tx": W.seconds_since_previous("client_id"),
            "client_mcc_is_new": W.first_seen("mcc", "client_id"),
            "client_merchant_is_new": W.first_seen("merchant_id", "client_id"),
        }
    )
    card = with_velocity(client, "card_id", "card").withColumns(
        {
            "card_error_last1": W.lagged("has_error", 1, "card_id", 0),
            "card_fraud_last1": W.lagged("fraud", 1, "card_id", 0),
            "card_fraud_last3": W.sum_last("fraud", 3, "card_id"),
            "card_mcc_is_new": W.first_seen("mcc", "card_id"),
            "card_merchant_is_new": W.first_seen("merchant_id", "card_id"),
        }
    )
    risky = [str(x) for x in artifacts["highrisk_mcc"]]
    out = card.withColumns(
        {
            "high_amount": S.flag(F.col("log_abs_amount") >= artifacts["high_amount_thr"]),
            "hour_cos": S.hour_cos(F.col("tx_hour")),
            "is_highrisk_weekday": S.flag(F.col("weekday").isin(*artifacts["high_risk_days"])),
            "mcc_highrisk_90": S.flag(F.col("mcc").isin(*risky)) if risky else F.lit(0),
            "merchant_is_new_x_has_error": F.col("card_merchant_is_new") * F.col("has_error"),
        }
    )
    return exact_columns(out, ["id", "fraud", *STAGE1])


def stage2_features(tx: DataFrame) -> DataFrame:
    """``id``, the 17 features of the second stage and ``fraud``; the clean semantics (windows never cross clients)."""
    require_columns(tx, ["id", "fraud", "date", "tsec", "client_id", "card_id", "merchant_id", "mcc", "log_abs_amount", "current_age", "log_yearly_income"])
    client = with_velocity(tx, "client_id", "client").withColumns(
        {
            "client_fraud_last3": W.sum_last("fraud", 3, "client_id"),
            "amount_deviation": W.whole_zscore("log_abs_amount", "client_id", spread_default=None),
            "client_merchant_is_new": W.first_seen("merchant_id", "client_id"),
            "client_mcc_is_new": W.first_seen("mcc", "client_id"),
            "client_mcc_repeat_cnt_last5": W.matches_last("mcc", 5, "client_id"),
            "client_avg_amt_prev": W.past_mean("log_abs_amount", "client_id"),
            "client_recent_avg_amt": W.recent_mean("log_abs_amount", "client_id"),
        }
    )
    client = W.changes_in(client, "merchant_id", "client_id", "merchant_change_cnt_last5")
    card = with_velocity(client, "card_id", "card").withColumns(
        {"card_fraud_last3": W.sum_last("fraud", 3, "card_id"), "card_merchant_is_new": W.first_seen("merchant_id", "card_id"), "card_mcc_change_cnt_last5": W.changes_before("mcc", "card_id")}
    )
    recent = F.log1p(S.ratio(F.col("log_abs_amount"), F.coalesce("client_recent_avg_amt", "client_avg_amt_prev")))
    out = card.withColumns({"hour_sin": S.hour_sin(F.col("tx_hour")), "hour_cos": S.hour_cos(F.col("tx_hour")), "mccnew_x_velocity": F.col("client_mcc_is_new") * F.col("client_velocity_spike_ratio"), "dev_x_mccnew": recent * F.col("client_mcc_is_new")})
    return exact_columns(out, ["id", *STAGE2, "fraud"])


def circular_distance(df: DataFrame, entity: str = "client_id", hour: str = "tx_hour") -> DataFrame:
    """Distance on the unit circle between this hour and the mean of the hours before (0 on the first row)."""
    a = df.withColumns({"__sin": S.hour_sin(F.col(hour)), "__cos": S.hour_cos(F.col(hour))})
    b = a.withColumns({"sin_mean_past": W.past_mean("__sin", entity), "cos_mean_past": W.past_mean("__cos", entity)})
    far = F.sqrt(F.pow(F.col("__sin") - F.col("sin_mean_past"), 2) + F.pow(F.col("__cos") - F.col("cos_mean_past"), 2))
    return b.withColumn("hour_circular_distance", far).drop("__sin", "__cos")


def intervals(df: DataFrame, entity: str = "client_id") -> DataFrame:
    """Seconds since the row before, their log, its past mean, ratio to and deviation from it."""
    a = df.withColumn("seconds_since_prev_tx", W.seconds_since_previous(entity)).withColumn("log_interval", F.log1p("seconds_since_prev_tx"))
    b = a.withColumn("client_avg_interval_prev", W.past_mean("log_interval", entity))
    return b.withColumns({"interval_ratio": S.ratio(F.col("log_interval"), F.col("client_avg_interval_prev")), "log_interval_dev": F.col("log_interval") - F.col("client_avg_interval_prev")})


def error_history(df: DataFrame) -> DataFrame:
    """Error counts and their products with history and amount."""
    flags = list(S.ERROR_MESSAGES)
    a = df.withColumns({f"{s}_{n}": e for s, k in (("client", "client_id"), ("card", "card_id")) for n, e in {"error_last1": W.sum_last("has_error", 1, k), "error_last3": W.sum_last("has_error", 3, k), "error_last5": W.sum_last("has_error", 5, k), "fraud_cum_prev": W.past_sum("fraud", k)}.items()})
    b = a.withColumns({f"{s}_has_fraud_history": S.flag(F.col(f"{s}_fraud_cum_prev") > 0) for s in ("client", "card")}).withColumn("error_count", S.row_sum(flags))
    return b.withColumns({"client_hist_x_error": F.col("client_has_fraud_history") * F.col("has_error"), "card_hist_x_error": F.col("card_has_fraud_history") * F.col("card_error_last1"), "error_count_x_amount": F.col("error_count") * F.col("log_abs_amount"), "card_err1_x_amount": F.col("card_error_last1") * F.col("log_abs_amount")})


def amount_windows(df: DataFrame, entity: str = "client_id") -> DataFrame:
    """The amount against the entity's mean so far, its last ten rows and its rolling quantiles."""
    a = df.withColumns({"client_avg_amt_prev": W.past_mean("log_abs_amount", entity), "recent": W.recent_mean("log_abs_amount", entity), "q95": W.rolling_quantile("log_abs_amount", 0.95, entity), "q99": W.rolling_quantile("log_abs_amount", 0.99, entity)})
    b = a.withColumns({"client_recent_avg_amt": F.coalesce("recent", "client_avg_amt_prev"), "client_q95_prev": F.coalesce("q95", "client_avg_amt_prev"), "client_q99_prev": F.coalesce("q99", "client_avg_amt_prev")}).drop("recent", "q95", "q99")
    x = F.col("log_abs_amount")
    return b.withColumns({"amount_vs_client_avg_diff": x - F.col("client_avg_amt_prev"), "amount_vs_client_avg_ratio": S.ratio(x, F.col("client_avg_amt_prev")), "amount_vs_recent_window_avg": S.ratio(x, F.col("client_recent_avg_amt")), "amount_vs_client_quantile_q95": S.ratio(x, F.col("client_q95_prev")), "amt_over_q95": S.flag(x > F.col("client_q95_prev")), "amt_over_q99": S.flag(x > F.col("client_q99_prev"))})


def home_location(df: DataFrame, entity: str = "client_id") -> DataFrame:
    """Mean coordinates of the entity and the distance to them."""
    by = Window.partitionBy(entity)
    a = df.withColumns({"home_lat": F.avg("latitude").over(by), "home_lon": F.avg("longitude").over(by)})
    return a.withColumn("home_km", S.haversine_km(F.col("latitude"), F.col("longitude"), F.col("home_lat"), F.col("home_lon")))
