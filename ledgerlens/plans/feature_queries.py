"""Window and feature queries over the transaction log, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import artifacts as A
from ledgerlens.operators import features as X
from ledgerlens.operators import windows as W
from ledgerlens.plans.testmap import ENRICHED, TX, enriched, transactions

QUERIES, SQL = {}, {}
#: On the test tables categories are few and the label independent, so the risky list has lower bars than in production.
LEAST, TIMES = 50, 1.02


def _r(name: str):
    return F.round(F.col(name), 6).alias(name)


def query(name: str, sql: str, base: str = TX):
    """Register a function of the clean log; ``sql`` follows the base tables."""

    def add(f):
        QUERIES[name], SQL[name] = f, f"WITH {base}{sql if sql.lstrip().startswith(',') else chr(10) + sql}"
        return f

    return add


def log_query(name: str, columns: dict, sql: dict, entity: str | None = None, source=transactions, base: str = TX, table: str = "tx"):
    """A query that adds columns to the log and returns them with the id; float columns are rounded."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = source(spark, sf_dir).withColumns({k: v() for k, v in columns.items()})
        return df.select("id", *(F.round(F.col(c), 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.select(*columns).dtypes))

    QUERIES[name] = run
    SQL[name] = f"WITH {base} SELECT id, " + ", ".join(f"{e} AS {c}" for c, e in sql.items()) + f" FROM {table}"


def over(entity: str, frame: str = "", order: str = "date, id") -> str:
    return f"OVER (PARTITION BY {entity} ORDER BY {order} {frame})"


def before(n: int | None, entity: str) -> str:
    return over(entity, f"ROWS BETWEEN {'UNBOUNDED' if n is None else n} PRECEDING AND 1 PRECEDING")


BOTH = (("client", "client_id"), ("card", "card_id"))
past_mean_sql = lambda c, e: f"coalesce(avg({c}) {before(None, e)}, {c})"
trailing_sql = lambda e: f"(row_number() {over(e)} - count(*) OVER (PARTITION BY {e} ORDER BY tsec RANGE BETWEEN UNBOUNDED PRECEDING AND 3601 PRECEDING))"
matches_sql = lambda c, n, e: "(" + " + ".join(f"CAST(coalesce({c} = lag({c}, {k}) {over(e)}, false) AS INT)" for k in range(1, n + 1)) + ")"
changes_sql = lambda c, e: "(" + " + ".join(f"CAST(coalesce(lag({c}, {k}) {over(e)} <> lag({c}, {k + 1}) {over(e)}, true) AS INT)" for k in range(1, 5)) + ")"
integer = lambda e: f"CAST({e} AS BIGINT)"
rounded = lambda e: f"round({e}, 6)"

log_query("lag_error_last1_3_5", {f"{s}_error_last{n}": (lambda n=n, k=k: W.sum_last("has_error", n, k)) for s, k in BOTH for n in (1, 3, 5)}, {f"{s}_error_last{n}": integer(f"coalesce(sum(has_error) {before(n, k)}, 0)") for s, k in BOTH for n in (1, 3, 5)})
log_query("lagged_values", {f"prev_{n}": (lambda n=n: W.lagged("mcc", n, "client_id")) for n in range(1, 6)}, {f"prev_{n}": f"lag(mcc, {n}) {over('client_id')}" for n in range(1, 6)})
log_query("past_sum", {f"{s}_fraud_cum_prev": (lambda k=k: W.past_sum("fraud", k)) for s, k in BOTH}, {f"{s}_fraud_cum_prev": integer(f"coalesce(sum(fraud) {before(None, k)}, 0)") for s, k in BOTH})
log_query("past_count", {f"{s}_tx_cnt_past": (lambda k=k: W.past_count(k)) for s, k in BOTH}, {f"{s}_tx_cnt_past": f"CAST(row_number() {over(k)} - 1 AS INT)" for s, k in BOTH})
log_query("past_mean_diff", {"amount_vs_client_avg_diff": lambda: F.col("log_abs_amount") - W.past_mean("log_abs_amount", "client_id")}, {"amount_vs_client_avg_diff": rounded(f"log_abs_amount - {past_mean_sql('log_abs_amount', 'client_id')}")})
log_query("fraud_history_last1_3", {f"{s}_fraud_last{n}": (lambda n=n, k=k: W.sum_last("fraud", n, k)) for s, k in BOTH for n in (1, 3)}, {f"{s}_fraud_last{n}": integer(f"coalesce(sum(fraud) {before(n, k)}, 0)") for s, k in BOTH for n in (1, 3)})
for _s, _k in BOTH:
    log_query(f"first_seen_{_s}", {f"{_s}_{c}_is_new": (lambda c=c, k=_k: W.first_seen({"mcc": "mcc", "merchant": "merchant_id"}[c], k)) for c in ("mcc", "merchant")}, {f"{_s}_{c}_is_new": f"CAST(row_number() {over(f'{_k}, {v}')} = 1 AS INT)" for c, v in (("mcc", "mcc"), ("merchant", "merchant_id"))})
log_query("prior_count", {f"{s}_mcc_prior_count": (lambda k=k: W.prior_count("mcc", k)) for s, k in BOTH}, {f"{s}_mcc_prior_count": f"CAST(row_number() {over(f'{k}, mcc')} - 1 AS INT)" for s, k in BOTH})
log_query(
    "mcc_repeat_last3_5",
    {f"{s}_mcc_repeat_cnt_last{n}": (lambda n=n, k=k: W.matches_last("mcc", n, k)) for s, k in BOTH for n in (3, 5)} | {f"{s}_mcc_seen_last{n}": (lambda n=n, k=k: W.seen_last("mcc", n, k)) for s, k in BOTH for n in (3, 5)} | {"client_mcc_repeat_ratio_last5": lambda: W.matches_last("mcc", 5, "client_id") / 5},
    {f"{s}_mcc_repeat_cnt_last{n}": matches_sql("mcc", n, k) for s, k in BOTH for n in (3, 5)} | {f"{s}_mcc_seen_last{n}": f"CAST({matches_sql('mcc', n, k)} > 0 AS INT)" for s, k in BOTH for n in (3, 5)} | {"client_mcc_repeat_ratio_last5": rounded(f"{matches_sql('mcc', 5, 'client_id')} / 5.0")},
)
log_query("mcc_match_last1", {f"{s}_mcc_match_last1": (lambda k=k: W.matches_last("mcc", 1, k)) for s, k in BOTH} | {"client_weekday_match_last1": lambda: W.matches_last("weekday", 1, "client_id"), "client_weekday_is_new": lambda: W.first_seen("weekday", "client_id")}, {f"{s}_mcc_match_last1": matches_sql("mcc", 1, k) for s, k in BOTH} | {"client_weekday_match_last1": matches_sql("weekday", 1, "client_id"), "client_weekday_is_new": f"CAST(row_number() {over('client_id, weekday')} = 1 AS INT)"})
log_query("mcc_change_last5", {f"{s}_mcc_change_cnt_last5": (lambda k=k: W.changes_before("mcc", k)) for s, k in BOTH}, {f"{s}_mcc_change_cnt_last5": changes_sql("mcc", k) for s, k in BOTH})
log_query("recent_avg_10", {"client_recent_avg_amt": lambda: F.coalesce(W.recent_mean("log_abs_amount", "client_id"), W.past_mean("log_abs_amount", "client_id"))}, {"client_recent_avg_amt": rounded(f"coalesce(avg(log_abs_amount) {before(10, 'client_id')}, {past_mean_sql('log_abs_amount', 'client_id')})")})
log_query("trailing_1h_count", {f"{s}_tx_1h": (lambda k=k: W.trailing_count(k)) for s, k in BOTH}, {f"{s}_tx_1h": f"CAST({trailing_sql(k)} AS INT)" for s, k in BOTH})
log_query("rolling_q95_q99", {f"q{int(q * 100)}": (lambda q=q: W.rolling_quantile("log_abs_amount", q, "client_id")) for q in (0.95, 0.99)}, {f"q{int(q * 100)}": rounded(f"CASE WHEN count(log_abs_amount) {before(50, 'client_id')} >= 10 THEN quantile_cont(log_abs_amount, {q}) {before(50, 'client_id')} END") for q in (0.95, 0.99)})
log_query("amount_zscore", {"amount_deviation": lambda: W.whole_zscore("log_abs_amount", "client_id")}, {"amount_deviation": rounded("(log_abs_amount - avg(log_abs_amount) OVER (PARTITION BY client_id)) / (coalesce(stddev_samp(log_abs_amount) OVER (PARTITION BY client_id), 0) + 1e-6)")})
log_query("amount_zscore_asof", {"amount_deviation_asof": lambda: F.when(W.past_count("client_id") >= 2, W.past_zscore("log_abs_amount", "client_id")).otherwise(0.0)}, {"amount_deviation_asof": rounded(f"CASE WHEN row_number() {over('client_id')} > 2 THEN (log_abs_amount - avg(log_abs_amount) {before(None, 'client_id')}) / (stddev_samp(log_abs_amount) {before(None, 'client_id')} + 1e-6) ELSE 0 END")})
log_query("cyclic_hour", {"hour_sin": lambda: S.hour_sin(F.col("tx_hour")), "hour_cos": lambda: S.hour_cos(F.col("tx_hour")), "is_highrisk_weekday": lambda: S.flag(F.col("weekday").isin(0, 4, 6))}, {"hour_sin": rounded("sin(2 * pi() * tx_hour / 24)"), "hour_cos": rounded("cos(2 * pi() * tx_hour / 24)"), "is_highrisk_weekday": "CAST(weekday IN (0, 4, 6) AS INT)"})
log_query("error_flags", {n: (lambda n=n: F.col(n)) for n in ("has_error", *S.ERROR_MESSAGES)} | {"error_count": lambda: S.row_sum(list(S.ERROR_MESSAGES))}, {n: n for n in ("has_error", *S.ERROR_MESSAGES)} | {"error_count": "(" + " + ".join(S.ERROR_MESSAGES) + ")"})
log_query("score_sigmoid", {"probability": lambda: S.sigmoid(F.col("log_abs_amount") - 3)}, {"probability": rounded("1 / (1 + exp(-(log_abs_amount - 3)))")})


@query("merchant_change_last5", f", c AS (SELECT *, CAST(coalesce(merchant_id <> lag(merchant_id) {over('client_id')}, true) AS INT) AS ch FROM tx) SELECT id, CAST(sum(ch) {over('client_id', 'ROWS BETWEEN 4 PRECEDING AND CURRENT ROW')} AS INT) AS merchant_change_cnt_last5 FROM c")
def merchant_change_last5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.changes_in(transactions(spark, sf_dir), "merchant_id", "client_id", "merchant_change_cnt_last5").select("id", "merchant_change_cnt_last5")


INTERVALS = f", a AS (SELECT *, coalesce(tsec - lag(tsec) {over('client_id')}, 0) AS sec FROM tx), b AS (SELECT *, ln(1 + sec) AS li FROM a), c AS (SELECT *, {past_mean_sql('li', 'client_id')} AS av FROM b)"


@query("interval_stats", f"{INTERVALS} SELECT id, CAST(sec AS BIGINT) AS seconds_since_prev_tx, round(li, 6) AS log_interval, round(av, 6) AS client_avg_interval_prev, round(li / (av + 1e-6), 6) AS interval_ratio, round(li - av, 6) AS log_interval_dev FROM c")
def interval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = X.intervals(transactions(spark, sf_dir))
    return df.select("id", "seconds_since_prev_tx", *map(_r, ("log_interval", "client_avg_interval_prev", "interval_ratio", "log_interval_dev")))


def velocity_sql(short: str, entity: str, table: str, name: str) -> str:
    return f"{name}0 AS (SELECT *, CAST({trailing_sql(entity)} AS INT) AS {short}_tx_1h FROM {table}), {name}1 AS (SELECT *, {past_mean_sql(f'{short}_tx_1h', entity)} AS {short}_tx_1h_avg_prev FROM {name}0), {name} AS (SELECT *, {short}_tx_1h / ({short}_tx_1h_avg_prev + 1e-6) AS {short}_velocity_spike_ratio FROM {name}1)"


@query("velocity_spike", f", {velocity_sql('client', 'client_id', 'tx', 'v')}, {velocity_sql('card', 'card_id', 'v', 'w')} SELECT id, client_tx_1h, card_tx_1h, round(client_tx_1h_avg_prev, 6) AS client_tx_1h_avg_prev, round(client_velocity_spike_ratio, 6) AS client_velocity_spike_ratio, round(card_velocity_spike_ratio, 6) AS card_velocity_spike_ratio FROM w")
def velocity_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = X.with_velocity(X.with_velocity(transactions(spark, sf_dir), "client_id", "client"), "card_id", "card")
    return df.select("id", "client_tx_1h", "card_tx_1h", _r("client_tx_1h_avg_prev"), _r("client_velocity_spike_ratio"), _r("card_velocity_spike_ratio"))


HOURS = f", a AS (SELECT *, sin(2 * pi() * tx_hour / 24) AS s, cos(2 * pi() * tx_hour / 24) AS c FROM tx), b AS (SELECT *, {past_mean_sql('s', 'client_id')} AS sp, {past_mean_sql('c', 'client_id')} AS cp FROM a)"


@query("hour_circular_distance", f"{HOURS} SELECT id, round(sp, 6) AS sin_mean_past, round(cp, 6) AS cos_mean_past, round(sqrt((s - sp) * (s - sp) + (c - cp) * (c - cp)), 6) AS hour_circular_distance FROM b")
def hour_circular_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.circular_distance(transactions(spark, sf_dir)).select("id", _r("sin_mean_past"), _r("cos_mean_past"), _r("hour_circular_distance"))


HISTORY = ", h AS (SELECT *, " + ", ".join(f"coalesce(sum(has_error) {before(1, k)}, 0) AS {s}_e1, CAST(coalesce(sum(fraud) {before(None, k)}, 0) > 0 AS INT) AS {s}_hist" for s, k in BOTH) + ", (" + " + ".join(S.ERROR_MESSAGES) + ") AS ec FROM tx)"


@query("error_interactions", f"{HISTORY} SELECT id, client_hist AS client_has_fraud_history, card_hist AS card_has_fraud_history, client_hist * has_error AS client_hist_x_error, CAST(card_hist * card_e1 AS BIGINT) AS card_hist_x_error, ec AS error_count, round(ec * log_abs_amount, 6) AS error_count_x_amount, round(card_e1 * log_abs_amount, 6) AS card_err1_x_amount FROM h")
def error_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = X.error_history(transactions(spark, sf_dir))
    return df.select("id", "client_has_fraud_history", "card_has_fraud_history", "client_hist_x_error", "card_hist_x_error", "error_count", _r("error_count_x_amount"), _r("card_err1_x_amount"))


AMOUNTS = f""", a AS (SELECT *, log_abs_amount AS x, {past_mean_sql('log_abs_amount', 'client_id')} AS av, avg(log_abs_amount) {before(10, 'client_id')} AS rc,
  CASE WHEN count(*) {before(50, 'client_id')} >= 10 THEN quantile_cont(log_abs_amount, 0.95) {before(50, 'client_id')} END AS q5, CASE WHEN count(*) {before(50, 'client_id')} >= 10 THEN quantile_cont(log_abs_amount, 0.99) {before(50, 'client_id')} END AS q9 FROM tx),
b AS (SELECT *, coalesce(rc, av) AS r, coalesce(q5, av) AS p5, coalesce(q9, av) AS p9 FROM a)"""


@query("amount_windows", f"{AMOUNTS} SELECT id, round(x - av, 6) AS amount_vs_client_avg_diff, round(x / (av + 1e-6), 6) AS amount_vs_client_avg_ratio, round(x / (r + 1e-6), 6) AS amount_vs_recent_window_avg, round(x / (p5 + 1e-6), 6) AS amount_vs_client_quantile_q95, CAST(x - p5 > 1e-12 AS INT) AS amt_over_q95, CAST(x - p9 > 1e-12 AS INT) AS amt_over_q99 FROM b")
def amount_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = X.amount_windows(transactions(spark, sf_dir))
    return df.select("id", *map(_r, ("amount_vs_client_avg_diff", "amount_vs_client_avg_ratio", "amount_vs_recent_window_avg", "amount_vs_client_quantile_q95")), "amt_over_q95", "amt_over_q99")


RISKY = f", base AS (SELECT avg(fraud) AS br FROM tx), risky AS (SELECT mcc, count(fraud) AS cnt, avg(fraud) AS rate FROM tx GROUP BY mcc HAVING count(fraud) >= {LEAST} AND avg(fraud) >= {TIMES} * (SELECT br FROM base))"


@query("highrisk_mcc_fit", f"{RISKY} SELECT mcc, cnt, round(rate, 6) AS rate FROM risky")
def highrisk_mcc_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.risky_groups(transactions(spark, sf_dir), least=LEAST, times=TIMES).select("mcc", "cnt", _r("rate"))


@query("highrisk_mcc_apply", f"{RISKY} SELECT id, CAST(mcc IN (SELECT mcc FROM risky) AS INT) AS mcc_highrisk_90 FROM tx")
def highrisk_mcc_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    return A.flag_members(tx, A.risky_groups(tx, least=LEAST, times=TIMES), "mcc_highrisk_90").select("id", "mcc_highrisk_90")


@query("highrisk_mcc_quantile", f", g AS (SELECT mcc, count(fraud) AS cnt, avg(fraud) AS rate FROM tx GROUP BY mcc HAVING count(fraud) >= {LEAST}) SELECT mcc, cnt, round(rate, 6) AS rate FROM g WHERE rate >= (SELECT quantile_cont(rate, 0.8) FROM g)")
def highrisk_mcc_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.risky_by_quantile(transactions(spark, sf_dir), q=0.8, least=LEAST).select("mcc", "cnt", _r("rate"))


HIGH = ", t AS (SELECT quantile_cont(log_abs_amount, 0.9) AS thr FROM tx)"


@query("amount_quantile_flag", f"{HIGH} SELECT id, CAST(log_abs_amount >= thr - 1e-12 AS INT) AS high_amount FROM tx, t")
def amount_quantile_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    (thr,) = A.quantiles(tx, "log_abs_amount", [0.9])
    return A.amount_flag(tx, thr - 1e-12).select("id", "high_amount")


STAGE1_SQL = f"""{RISKY}, {HIGH[2:]}, {velocity_sql('card', 'card_id', 'tx', 'v')}
SELECT id, fraud, round(log_abs_amount, 6) AS log_abs_amount, CAST(log_abs_amount >= thr - 1e-12 AS INT) AS high_amount, round(log_abs_amount - {past_mean_sql('log_abs_amount', 'client_id')}, 6) AS amount_vs_client_avg_diff,
  round((log_abs_amount - avg(log_abs_amount) OVER (PARTITION BY client_id)) / (coalesce(stddev_samp(log_abs_amount) OVER (PARTITION BY client_id), 0) + 1e-6), 6) AS amount_deviation,
  has_error, err_bad_cvv, err_bad_card_number, err_bad_expiration, coalesce(lag(has_error) {over('card_id')}, 0) AS card_error_last1, coalesce(lag(has_error) {over('client_id')}, 0) AS client_error_last1,
  coalesce(lag(fraud) {over('card_id')}, 0) AS card_fraud_last1, coalesce(lag(fraud) {over('client_id')}, 0) AS client_fraud_last1, CAST(coalesce(sum(fraud) {before(3, 'card_id')}, 0) AS BIGINT) AS card_fraud_last3,
  tx_hour, tx_month, round(cos(2 * pi() * tx_hour / 24), 6) AS hour_cos, CAST(weekday IN (0, 4, 6) AS INT) AS is_highrisk_weekday, CAST(coalesce(tsec - lag(tsec) {over('client_id')}, 0) AS BIGINT) AS seconds_since_prev_tx,
  round(card_velocity_spike_ratio, 6) AS card_velocity_spike_ratio, CAST(mcc IN (SELECT mcc FROM risky) AS INT) AS mcc_highrisk_90, CAST(row_number() {over('card_id, mcc')} = 1 AS INT) AS card_mcc_is_new,
  CAST(row_number() {over('client_id, mcc')} = 1 AS INT) AS client_mcc_is_new, CAST(row_number() {over('card_id, merchant_id')} = 1 AS INT) AS card_merchant_is_new, CAST(row_number() {over('client_id, merchant_id')} = 1 AS INT) AS client_merchant_is_new,
  CAST(row_number() {over('card_id, merchant_id')} = 1 AS INT) * has_error AS merchant_is_new_x_has_error
FROM v, t"""
FLOATS = {"log_abs_amount", "amount_vs_client_avg_diff", "amount_deviation", "hour_cos", "hour_sin", "card_velocity_spike_ratio", "client_tx_1h_avg_prev", "mccnew_x_velocity", "dev_x_mccnew", "log_yearly_income"}


@query("stage1_features", STAGE1_SQL)
def stage1_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit the artifacts and build the 25 features."""
    tx = transactions(spark, sf_dir)
    fitted = A.fit(tx, least=LEAST, times=TIMES)
    fitted["high_amount_thr"] -= 1e-12  # the threshold is a value of the data: don't let its last bit decide
    df = X.stage1_features(tx, fitted)
    return df.select(*(_r(c) if c in FLOATS else F.col(c) for c in df.columns))


STAGE2_SQL = f""", {velocity_sql('client', 'client_id', 'en', 'v')}, {velocity_sql('card', 'card_id', 'v', 'w')},
m AS (SELECT *, CAST(coalesce(merchant_id <> lag(merchant_id) {over('client_id')}, true) AS INT) AS ch, CAST(row_number() {over('client_id, mcc')} = 1 AS INT) AS mn,
  ln(1 + log_abs_amount / (coalesce(avg(log_abs_amount) {before(10, 'client_id')}, {past_mean_sql('log_abs_amount', 'client_id')}) + 1e-6)) AS dev FROM w)
SELECT id, CAST(coalesce(sum(fraud) {before(3, 'card_id')}, 0) AS BIGINT) AS card_fraud_last3, CAST(coalesce(sum(fraud) {before(3, 'client_id')}, 0) AS BIGINT) AS client_fraud_last3,
  round((log_abs_amount - avg(log_abs_amount) OVER (PARTITION BY client_id)) / (stddev_samp(log_abs_amount) OVER (PARTITION BY client_id) + 1e-6), 6) AS amount_deviation,
  CAST(row_number() {over('client_id, merchant_id')} = 1 AS INT) AS client_merchant_is_new, CAST(row_number() {over('card_id, merchant_id')} = 1 AS INT) AS card_merchant_is_new,
  round(mn * client_velocity_spike_ratio, 6) AS mccnew_x_velocity, round(dev * mn, 6) AS dev_x_mccnew, {matches_sql('mcc', 5, 'client_id')} AS client_mcc_repeat_cnt_last5, {changes_sql('mcc', 'card_id')} AS card_mcc_change_cnt_last5,
  CAST(sum(ch) {over('client_id', 'ROWS BETWEEN 4 PRECEDING AND CURRENT ROW')} AS INT) AS merchant_change_cnt_last5, round(client_tx_1h_avg_prev, 6) AS client_tx_1h_avg_prev, round(card_velocity_spike_ratio, 6) AS card_velocity_spike_ratio,
  tx_hour, round(sin(2 * pi() * tx_hour / 24), 6) AS hour_sin, round(cos(2 * pi() * tx_hour / 24), 6) AS hour_cos, current_age, round(log_yearly_income, 6) AS log_yearly_income, fraud FROM m"""


@query("stage2_features", STAGE2_SQL, ENRICHED)
def stage2_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrich and build the 17 features."""
    df = X.stage2_features(enriched(spark, sf_dir))
    return df.select(*(_r(c) if c in FLOATS else F.col(c) for c in df.columns))


@query("interactions", f", {velocity_sql('client', 'client_id', 'tx', 'v')} SELECT id, CAST(row_number() {over('client_id, mcc')} = 1 AS INT) * has_error AS mccnew_x_error, CAST(row_number() {over('card_id, merchant_id')} = 1 AS INT) * CAST(row_number() {over('card_id, mcc')} = 1 AS INT) AS merchant_is_new_x_mcc_is_new, round(CAST(row_number() {over('client_id, mcc')} = 1 AS INT) * client_velocity_spike_ratio, 6) AS mccnew_x_velocity FROM v")
def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = X.with_velocity(transactions(spark, sf_dir), "client_id", "client").withColumns({"n": W.first_seen("mcc", "client_id"), "m": W.first_seen("merchant_id", "card_id"), "k": W.first_seen("mcc", "card_id")})
    return df.select("id", (F.col("n") * F.col("has_error")).alias("mccnew_x_error"), (F.col("m") * F.col("k")).alias("merchant_is_new_x_mcc_is_new"), F.round(F.col("n") * F.col("client_velocity_spike_ratio"), 6).alias("mccnew_x_velocity"))


PRODUCTS = f"""{HIGH}, {velocity_sql('client', 'client_id', 'tx', 'v')}, {velocity_sql('card', 'card_id', 'v', 'w')},
a AS (SELECT w.*, CAST(log_abs_amount > thr + 1e-12 AS INT) AS above, CAST(log_abs_amount >= thr - 1e-12 AS INT) AS high, ({' + '.join(S.ERROR_MESSAGES)}) * log_abs_amount AS ea, coalesce(lag(has_error) {over('card_id')}, 0) AS e1,
  CAST(coalesce(sum(fraud) {before(None, 'card_id')}, 0) > 0 AS INT) AS hist, coalesce(avg(log_abs_amount) {before(10, 'client_id')}, {past_mean_sql('log_abs_amount', 'client_id')}) AS rc, CAST(row_number() {over('client_id, mcc')} = 1 AS INT) AS mn FROM w, t)
SELECT id, is_refund * above AS refund_high_amount, CAST(ea >= 2 AS INT) * high AS error_high_amount, CAST(hist * e1 AS BIGINT) AS card_hist_x_error, round(hist * e1 * log_abs_amount, 6) AS card_hist_err_x_amount,
  round(ln(1 + log_abs_amount / (rc + 1e-6)) * mn, 6) AS dev_x_mccnew, round(ln(1 + log_abs_amount / (rc + 1e-6)) * card_velocity_spike_ratio, 6) AS dev_x_velocity, round(ln(1 + log_abs_amount / (rc + 1e-6)) * has_error, 6) AS dev_x_error, coalesce(lag(weekday) {over('client_id')}, -1) AS prev_weekday
FROM a"""


@query("exploratory_products", PRODUCTS)
def exploratory_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of flags, deviations and history, and the weekday before."""
    tx = transactions(spark, sf_dir)
    (thr,) = A.quantiles(tx, "log_abs_amount", [0.9])
    df = X.with_velocity(X.with_velocity(tx, "client_id", "client"), "card_id", "card").withColumns({"e1": W.lagged("has_error", 1, "card_id", 0), "hist": S.flag(W.past_sum("fraud", "card_id") > 0), "rc": F.coalesce(W.recent_mean("log_abs_amount", "client_id"), W.past_mean("log_abs_amount", "client_id")), "mn": W.first_seen("mcc", "client_id"), "prev_weekday": W.lagged("weekday", 1, "client_id", -1)})
    x, dev = F.col("log_abs_amount"), F.log1p(S.ratio(F.col("log_abs_amount"), F.col("rc")))
    return df.select(
        "id", (F.col("is_refund") * S.flag(x > thr + 1e-12)).alias("refund_high_amount"), (S.flag(S.row_sum(list(S.ERROR_MESSAGES)) * x >= 2) * S.flag(x >= thr - 1e-12)).alias("error_high_amount"), (F.col("hist") * F.col("e1")).cast("long").alias("card_hist_x_error"),
        F.round(F.col("hist") * F.col("e1") * x, 6).alias("card_hist_err_x_amount"), F.round(dev * F.col("mn"), 6).alias("dev_x_mccnew"), F.round(dev * F.col("card_velocity_spike_ratio"), 6).alias("dev_x_velocity"), F.round(dev * F.col("has_error"), 6).alias("dev_x_error"), "prev_weekday",
    )


@query("parity_cumsum_leak", f", c AS (SELECT *, CAST(sum(fraud) {over('client_id', 'ROWS UNBOUNDED PRECEDING')} AS BIGINT) AS cs FROM tx) SELECT id, coalesce(lag(cs) OVER (ORDER BY client_id, date, id), 0) AS leaked FROM c")
def parity_cumsum_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The historical definition: the running total is shifted by a row without regard to clients, so a client's first row gets
    the total of the client before. Only the clients' totals (one row each) meet in one window."""
    tx = transactions(spark, sf_dir)
    totals = tx.groupBy("client_id").agg(F.sum("fraud").alias("total"))
    carried = totals.select("client_id", F.coalesce(F.lag("total").over(Window.orderBy("client_id")), F.lit(0)).alias("carried"))
    own = tx.withColumn("mine", F.sum("fraud").over(W.log_of("client_id").rowsBetween(Window.unboundedPreceding, -1)))
    return own.join(carried, "client_id").select("id", F.coalesce("mine", "carried").alias("leaked"))
