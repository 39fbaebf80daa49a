"""Cleaning, joins, aggregates, metrics and analyses, each with its SQL where SQL can express it."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import analysis as N
from ledgerlens.operators import metrics as M
from ledgerlens.operators import models as L
from ledgerlens.operators.cleaning import clean_transactions
from ledgerlens.operators.features import home_location
from ledgerlens.operators.ranking import quantiles
from ledgerlens.operators.validate import assert_unique, null_counts
from ledgerlens.plans import feature_queries as Q
from ledgerlens.plans.testmap import ENRICHED, SCORED, TX, enriched, labels, raw_transactions, scored, table, transactions, users

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None, base: str = TX):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (f"WITH {base}{sql}" if base else sql).strip()
        return f

    return add


def _round(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(F.col(c), 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


@query("tx_schema_clean", " SELECT id, client_id, card_id, merchant_id, mcc, round(amount, 6) AS amount, fraud, has_error, tsec, tx_year, tx_month, tx_day, tx_hour, weekday, is_refund, round(log_abs_amount, 6) AS log_abs_amount FROM tx")
def tx_schema_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(transactions(spark, sf_dir).select("id", "client_id", "card_id", "merchant_id", "mcc", "amount", "fraud", "has_error", "tsec", "tx_year", "tx_month", "tx_day", "tx_hour", "weekday", "is_refund", "log_abs_amount"))


@query("label_inner_join", " SELECT id, fraud, round(amount, 6) AS amount, has_error FROM tx WHERE id % 3 <> 0")
def label_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels cover two of three transactions here: the others vanish."""
    some = labels(spark, sf_dir).where("id % 3 <> 0")
    return _round(clean_transactions(raw_transactions(spark, sf_dir), some).select("id", "fraud", "amount", "has_error"))


@query("enrich_users_left", ", u AS (SELECT c_custkey AS client_id, c_acctbal, c_mktsegment FROM customer) SELECT id, tx.client_id, c_acctbal, c_mktsegment FROM tx LEFT JOIN u ON u.client_id = tx.client_id")
def enrich_users_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = assert_unique(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client_id"), "c_acctbal", "c_mktsegment"), ["client_id"])
    return transactions(spark, sf_dir).join(u, "client_id", "left").select("id", "client_id", "c_acctbal", "c_mktsegment")


_E_INT = "months_to_expire months_from_account has_chip is_credit is_prepaid male cb_Visa cb_Mastercard cb_Amex cb_Discover years_since_pin_change years_to_retirement".split()
_E_FLOAT = "income_ratio_region log_yearly_income amount_income_ratio amount_limit_ratio".split()


@query("enrich_two_key_left", " SELECT id, credit_limit, " + ", ".join(_E_INT) + " FROM en", ENRICHED)
def enrich_two_key_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir).select("id", "credit_limit", *_E_INT)


@query("ratios_logs", " SELECT id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _E_FLOAT) + ", round(ln(1 + income_ratio_region), 6) AS log_income_ratio_region, round(ln(1 + amount_income_ratio), 6) AS log_amount_income_ratio, round(ln(1 + amount_limit_ratio), 6) AS log_amount_limit_ratio FROM en", ENRICHED)
def ratios_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(enriched(spark, sf_dir).select("id", *_E_FLOAT, "log_income_ratio_region", "log_amount_income_ratio", "log_amount_limit_ratio"))


@query("month_diffs", " SELECT id, months_to_expire, months_from_account FROM en", ENRICHED)
def month_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir).select("id", "months_to_expire", "months_from_account")


@query("onehot_brands", " SELECT cb_Visa, cb_Mastercard, cb_Amex, cb_Discover, count(*) AS n FROM en GROUP BY ALL", ENRICHED)
def onehot_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir).groupBy(*(f"cb_{b}" for b in S.BRANDS)).agg(F.count(F.lit(1)).alias("n"))


@query("home_location", ", u AS (SELECT c_custkey AS client_id, c_nationkey % 5 AS g, c_nationkey * 1.5 AS lat, c_nationkey * -2.0 AS lon FROM customer), h AS (SELECT *, avg(lat) OVER (PARTITION BY g) AS hl, avg(lon) OVER (PARTITION BY g) AS ho FROM u) SELECT client_id, round(CAST(hl AS DOUBLE), 6) AS home_lat, round(CAST(ho AS DOUBLE), 6) AS home_lon, round(2 * 6371.0 * asin(sqrt(least(pow(sin(radians(hl - lat) / 2), 2) + cos(radians(lat)) * cos(radians(hl)) * pow(sin(radians(ho - lon) / 2), 2), 1.0))), 6) AS home_km FROM h")
def home_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = users(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 5).alias("g")), "id")
    return _round(home_location(u, "g").select(F.col("id").alias("client_id"), "home_lat", "home_lon", "home_km"))


@query("gate_semi_join", ", t AS (SELECT quantile_cont(score, 0.99) AS thr FROM r) SELECT id, label, score FROM r WHERE id IN (SELECT id FROM r, t WHERE score >= thr - 1e-12)", SCORED)
def gate_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that pass the first stage's threshold, then the rows of the second stage among them."""
    s = scored(spark, sf_dir)
    (thr,) = quantiles(s, "score", [0.99])
    return s.join(M.gate(s, thr - 1e-12), "id", "left_semi")


@query("group_fraud_rates", " SELECT mcc, count(fraud) AS cnt, round(avg(fraud), 6) AS rate FROM tx GROUP BY mcc")
def group_fraud_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(transactions(spark, sf_dir).groupBy("mcc").agg(F.count("fraud").alias("cnt"), F.avg("fraud").alias("rate")))


@query("null_report", " SELECT CAST(count(*) FILTER (errors IS NULL) AS BIGINT) AS errors, CAST(count(*) FILTER (mcc IS NULL) AS BIGINT) AS mcc, CAST(count(*) FILTER (amount IS NULL) AS BIGINT) AS amount FROM tx")
def null_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_counts(raw_transactions(spark, sf_dir), ["errors", "mcc", "amount"])


@query("class_weights", ", c AS (SELECT CAST(sum(label) AS BIGINT) AS pos, CAST(count(*) - sum(label) AS BIGINT) AS neg FROM r) SELECT pos, neg, round(neg / pos, 6) AS weight FROM c", SCORED)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.class_weight(scored(spark, sf_dir)))


_G = ", g AS (SELECT score, CAST(sum(label) AS BIGINT) AS p, count(*) AS n FROM r GROUP BY score), cu AS (SELECT score, p, n, CAST(sum(p) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(n) OVER (ORDER BY score DESC) AS BIGINT) AS al, sum(p) OVER () AS tot, sum(n) OVER () AS nall FROM g)"


@query("rank_metrics", f"{_G} SELECT round(sum((n - p) * (tp - 0.5 * p)) / (max(tot) * (max(nall) - max(tot))), 6) AS auc, round(sum(CAST(p AS DOUBLE) * tp / al) / max(tot), 6) AS prauc, round(max(tot) / max(nall), 6) AS base_rate FROM cu", SCORED)
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.rank_metrics(scored(spark, sf_dir)))


_SHARES = (0.001, 0.002, 0.005, 0.01)


@query(
    "topk_metrics",
    ", o AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rn, count(*) OVER () AS n, sum(label) OVER () AS pos FROM r), s(top_pct) AS (VALUES " + ", ".join(f"(CAST({x} AS DOUBLE))" for x in _SHARES) + "), k AS (SELECT top_pct, CAST(greatest(ceil(max(n) * top_pct), 1) AS BIGINT) AS k, max(n) AS n, max(pos) AS pos FROM o, s GROUP BY top_pct) SELECT top_pct, k, round(sum(label) / k, 6) AS precision, round(sum(label) / max(k.pos), 6) AS recall, round((sum(label) / k) / (max(k.pos) / max(k.n)), 6) AS lift, round(max(k.pos) / max(k.n), 6) AS base_rate FROM k JOIN o ON rn <= k GROUP BY top_pct, k",
    SCORED,
)
def topk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.topk(scored(spark, sf_dir), _SHARES))


_GRID = [round(x, 10) for x in S.grid(0.0002, 0.10, 120)]
_SWEEP = ", s(top_pct) AS (VALUES " + ", ".join(f"(CAST({x!r} AS DOUBLE))" for x in _GRID) + "), q AS (SELECT top_pct, (SELECT quantile_cont(score, " + repr([1 - x for x in _GRID]).replace("[", "[") + ") FROM r)[row_number() OVER (ORDER BY top_pct)] - 1e-12 AS thr FROM s), w AS (SELECT top_pct, round(max(thr), 6) AS threshold, count(*) FILTER (score >= thr) AS alerts, CAST(coalesce(sum(label) FILTER (score >= thr), 0) AS BIGINT) AS tp, CAST(sum(label) AS BIGINT) AS pos FROM q, r GROUP BY top_pct), sw AS (SELECT top_pct, threshold, alerts, tp, alerts - tp AS fp, pos - tp AS fn, round(CASE WHEN alerts > 0 THEN tp / alerts ELSE 0 END, 6) AS precision, round(tp / pos, 6) AS recall FROM w)"


def _swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    cuts = quantiles(s, "score", [1 - x for x in _GRID])
    grid = spark.createDataFrame([(x, c - 1e-12) for x, c in zip(_GRID, cuts)], "top_pct double, threshold double")
    return _round(M.at_thresholds(s, grid).select("top_pct", "threshold", "alerts", "tp", "fp", "fn", "precision", "recall"))


@query("threshold_sweep", f"{_SWEEP} SELECT * FROM sw", SCORED)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _swept(spark, sf_dir)


@query("operating_point", f"{_SWEEP} SELECT top_pct, threshold, precision, recall, CASE WHEN recall >= 0.5 THEN 'best_precision_under_recall' ELSE 'max_recall_in_grid' END AS chosen_by FROM sw ORDER BY (recall >= 0.5) DESC, CASE WHEN recall >= 0.5 THEN precision ELSE recall END DESC, CASE WHEN recall >= 0.5 THEN recall ELSE precision END DESC, threshold, top_pct LIMIT 1", SCORED)
def operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted with the share as the last key, so that equal thresholds don't matter."""
    least = _swept(spark, sf_dir).groupBy("threshold", "alerts", "tp", "fp", "fn", "precision", "recall").agg(F.min("top_pct").alias("top_pct"))
    return M.operating_point(least, 0.5).select("top_pct", "threshold", "precision", "recall", "chosen_by")


@query("fixed_threshold", ", s AS (SELECT CAST(i AS DOUBLE) / 499 AS thr FROM range(500) t(i)), w AS (SELECT thr, count(*) FILTER (score >= thr) AS alerts, sum(label) FILTER (score >= thr) AS tp, sum(label) AS pos FROM s, r GROUP BY thr) SELECT round(thr, 6) AS threshold, round(tp / alerts, 6) AS precision, round(tp / pos, 6) AS recall FROM w WHERE alerts > 0 AND tp / pos >= 0.5 ORDER BY tp / alerts DESC, thr LIMIT 1", SCORED)
def fixed_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.fixed_threshold(scored(spark, sf_dir), 0.5).select("threshold", "precision", "recall"))


@query("pr_point", f"{_G} SELECT score AS threshold, round(tp / al, 6) AS precision, round(tp / tot, 6) AS recall FROM cu WHERE tp / tot >= 0.6 ORDER BY tp / al DESC, score LIMIT 1", SCORED)
def pr_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.pr_point(scored(spark, sf_dir), 0.6))


@query("classification_report", ", c AS (SELECT k.k AS class, count(*) FILTER ((score >= 0.7) = (k.k = 1) AND label = k.k) AS hit, count(*) FILTER ((score >= 0.7) = (k.k = 1)) AS al, count(*) FILTER (label = k.k) AS support, count(*) FILTER ((score >= 0.7) = (label = 1)) / count(*) AS acc FROM r, (VALUES (0), (1)) k(k) GROUP BY k.k) SELECT class, round(CASE WHEN al > 0 THEN hit / al ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN hit / support ELSE 0 END, 6) AS recall, round(CASE WHEN al + support > 0 THEN 2.0 * hit / (al + support) ELSE 0 END, 6) AS f1, support, round(acc, 6) AS accuracy FROM c", SCORED)
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.classification_report(scored(spark, sf_dir).withColumn("predicted", S.flag(F.col("score") >= 0.7))))


@query("top_decile_lift", ", t AS (SELECT quantile_cont(score, 0.9) AS thr FROM r), a AS (SELECT avg(label) FILTER (score >= thr - 1e-12) AS top_rate, avg(label) AS base_rate FROM r, t) SELECT round(top_rate, 6) AS top_rate, round(base_rate, 6) AS base_rate, round(top_rate / base_rate, 6) AS lift FROM a", SCORED)
def top_decile_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.top_decile_lift(scored(spark, sf_dir)).select("top_rate", "base_rate", "lift"))


_C = ("log_abs_amount", "tx_hour", "weekday", "has_error", "is_refund", "merchant_id", "fraud")
_PAIRS = [(a, b) for i, a in enumerate(_C) for b in _C[i + 1 :]]


@query("corr_pairs", " " + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(abs(corr({a}, {b})), 6) AS abs_corr FROM tx" for a, b in _PAIRS))
def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(N.correlation_pairs(transactions(spark, sf_dir), _C, None))


_IMP = "i AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(abs({c})) AS a, avg(abs({c} - 0.5)) AS b FROM tx" for c in _C) + ")"


@query("rank_gap", f", {_IMP}, k AS (SELECT feature, a, CASE WHEN feature = 'weekday' THEN 0 ELSE b END AS b FROM i) SELECT feature, round(a, 6) AS a, round(b, 6) AS b, CAST(rank() OVER (ORDER BY a DESC) AS INT) AS rank_a, CAST(rank() OVER (ORDER BY b DESC) AS INT) AS rank_b, CAST(abs(rank() OVER (ORDER BY a DESC) - rank() OVER (ORDER BY b DESC)) AS INT) AS rank_gap FROM k")
def rank_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two importances side by side; one feature is missing on the right."""
    tx = transactions(spark, sf_dir)
    other = tx.select(*((F.col(c) - 0.5).alias(c) for c in _C if c != "weekday"))
    return _round(N.rank_gap(N.mean_abs(tx, _C), N.mean_abs(other, [c for c in _C if c != "weekday"])))


@query("flagged_share", ", q AS (SELECT quantile_cont(log_abs_amount, [0.8, 0.9, 0.95, 0.99]) AS t FROM tx) " + " UNION ALL ".join(f"SELECT '{n}' AS candidate, round(t[{i}], 6) AS threshold, round(avg(CAST(log_abs_amount >= t[{i}] - 1e-12 AS INT)), 6) AS share FROM tx, q GROUP BY t" for i, n in ((1, "q80"), (2, "q90"), (3, "q95"), (4, "q99"))))
def flagged_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    cuts = quantiles(tx, "log_abs_amount", [0.8, 0.9, 0.95, 0.99])
    return _round(N.flagged_share(tx, {n: c - 1e-12 for n, c in zip(("q80", "q90", "q95", "q99"), cuts)}, "log_abs_amount"))


@query("stratified_split", ", h AS (SELECT id, fraud, row_number() OVER (PARTITION BY fraud ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS rn, count(*) OVER (PARTITION BY fraud) AS n FROM tx) SELECT id, fraud, CAST(rn <= ceil(n * CAST(0.8 AS DOUBLE)) AS INT) AS is_train FROM h")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.stratified_split(transactions(spark, sf_dir), "fraud").select("id", "fraud", "is_train")


@query("chronological_split", " SELECT id, CAST(date < TIMESTAMP '2024-01-20 00:00:00' AS INT) AS is_train FROM tx")
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = N.chronological_split(transactions(spark, sf_dir), "2024-01-20 00:00:00")
    return a.select("id", F.lit(1).alias("is_train")).unionByName(b.select("id", F.lit(0).alias("is_train")))


@query("oversampled", " SELECT fraud, CAST(sum(CASE WHEN fraud = 1 THEN 3 ELSE 1 END) AS BIGINT) AS n FROM tx GROUP BY fraud")
def oversampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.rebalanced(transactions(spark, sf_dir), over=3).groupBy("fraud").agg(F.count(F.lit(1)).alias("n"))


@query("parity_recent_avg", f", l AS (SELECT *, lag(log_abs_amount) {Q.over('client_id')} AS p FROM tx) SELECT id, round(avg(p) OVER (ORDER BY client_id, date, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS recent_avg FROM l")
def parity_recent_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The historical definition, whose ten rows run across clients in (client, date, id) order.

    A frame reaches at most nine rows back, so each client needs only the ten last values of the clients before it. Those
    are carried over from a table of each client's last ten (at most ten rows per client).
    """
    from ledgerlens.operators.windows import lagged

    tx = transactions(spark, sf_dir).withColumn("p", lagged("log_abs_amount", 1, "client_id"))
    last = tx.withColumn("back", F.row_number().over(Window.partitionBy("client_id").orderBy(F.desc("date"), F.desc("id")))).where("back <= 9").groupBy("client_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.negative("back").alias("o"), "p"))), lambda x: x["p"]).alias("tail"))
    # One small row per client: the tails of the nine clients before hold all that a frame can reach.
    before = last.withColumn("carry", F.flatten(F.collect_list("tail").over(Window.orderBy("client_id").rowsBetween(-9, -1)))).select("client_id", F.slice("carry", F.greatest(F.size("carry") - 8, F.lit(1)), 9).alias("carry"))
    w = Window.partitionBy("client_id").orderBy("date", "id")
    own = tx.withColumns({"rn": F.row_number().over(w), "win": F.collect_list(F.struct("p")).over(w.rowsBetween(-9, 0))}).join(before, "client_id", "left")
    missing = F.greatest(F.lit(10) - F.col("rn"), F.lit(0))
    carried = F.slice(F.reverse(F.coalesce("carry", F.array().cast("array<double>"))), F.lit(1), missing)
    values = F.filter(F.concat(F.transform("win", lambda x: x["p"]), carried), lambda x: x.isNotNull())
    mean = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))
    return own.select("id", F.round(mean, 6).alias("recent_avg"))


@query("lineitem_entity_velocity", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER w - count(*) OVER (PARTITION BY o_custkey ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 2592001 PRECEDING) AS n_30d, CAST(row_number() OVER (PARTITION BY o_custkey, p_brand ORDER BY t, l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1 AS INT) AS brand_is_new FROM (SELECT *, CAST(epoch(l_shipdate) AS BIGINT) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) WINDOW w AS (PARTITION BY o_custkey ORDER BY t, l_orderkey, l_linenumber, l_partkey, l_suppkey)", "")
def lineitem_entity_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows on another log with many ties in time: lines shipped in the last 30 days, new brands."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    o, p = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    df = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).withColumn("t", S.epoch_seconds(F.col("l_shipdate").cast("timestamp_ntz")))
    order = ["t", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    older = F.count(F.lit(1)).over(Window.partitionBy("o_custkey").orderBy("t").rangeBetween(Window.unboundedPreceding, -30 * 86400 - 1))
    new = F.row_number().over(Window.partitionBy("o_custkey", "p_brand").orderBy(*order)) == 1
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order)) - older).alias("n_30d"), S.flag(new).alias("brand_is_new"))


_FEATURES = ["log_abs_amount", "amount_vs_client_avg_diff", "amount_deviation", "tx_hour", "seconds_since_prev_tx", "card_mcc_is_new", "client_mcc_is_new"]


def _model_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = N.stratified_split(Q.QUERIES["stage1_features"](spark, sf_dir).select("id", "fraud", *_FEATURES), "fraud")
    train, test = (L.prepared(df.where(F.col("is_train") == k), _FEATURES) for k in (1, 0))
    return train, test


@query("model_logit_scores")
def model_logit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _model_rows(spark, sf_dir)
    return L.score(L.fit_logit(train.cache(), _FEATURES), test)


@query("model_tree_metrics")
def model_tree_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _model_rows(spark, sf_dir)
    return M.rank_metrics(L.score(L.fit_trees(train.cache(), _FEATURES), test))


@query("univariate_logits")
def univariate_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.univariate_logits(transactions(spark, sf_dir).cache(), ["log_abs_amount", "tx_hour", "has_error"])


@query("add_one_lifts")
def add_one_lifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.add_one_lifts(transactions(spark, sf_dir).cache(), ["log_abs_amount"], ["tx_hour", "has_error"])


