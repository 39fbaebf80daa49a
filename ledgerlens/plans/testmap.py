"""The test tables as transactions, users and cards: raw text as the sources have it, and the same rows as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.cleaning import clean_transactions, enrich

TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    error = F.when(F.col("k") % 4 == 0, "Bad CVV").when(F.col("k") % 4 == 1, "Bad Card Number,Insufficient Balance").when(F.col("k") % 4 == 2, "Bad Expiration").otherwise("Technical Glitch")
    amount = F.concat(F.lit("$"), F.when(F.col("k") % 10 == 9, "-").otherwise(""), F.col("value").cast("decimal(12,2)").cast("string"))
    return e.select(
        F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"), F.col("user_id").alias("client_id"), (F.col("user_id") * 2 + F.col("event_id") % 2).alias("card_id"),
        F.col("k").alias("merchant_id"), F.col("event_type").alias("mcc"), amount.alias("amount"), F.when(F.col("event_type") == "error", error).alias("errors"), F.lit("Chip").alias("use_chip"), F.lit("00000").alias("zip"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), (F.get_json_object("props", "$.k").cast("int") >= 95).cast("int").alias("fraud"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean transactions. Labels come from the same rows here, so no join is needed; ``label_inner_join`` has it."""
    raw = raw_transactions(spark, sf_dir)
    return clean_transactions(raw.withColumn("fraud", (F.col("merchant_id") >= 95).cast("int")), None)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = lambda x: x.cast("string")
    money = lambda x: F.concat(F.lit("$"), x.cast("string"))
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), (20 + k % 60).cast("int").alias("current_age"), text(60 + k % 12).alias("retirement_age"), (2000 - k % 60).cast("int").alias("birth_year"), (1 + k % 12).cast("int").alias("birth_month"),
        F.when(k % 2 == 0, "Male").otherwise("Female").alias("gender"), F.col("c_name").alias("address"), (F.col("c_nationkey") * 1.5).alias("latitude"), (F.col("c_nationkey") * -2.0).alias("longitude"),
        money(10000 + k * 7).alias("per_capita_income"), money(20000 + k * 13).alias("yearly_income"), money(k * 3).alias("total_debt"), (k % 5).cast("int").alias("num_credit_cards"),
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    i = F.col("client_id") * 2 + F.col("j")
    month = lambda m, y: F.concat(F.lpad(m.cast("string"), 2, "0"), F.lit("/"), y.cast("string"))
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n + 1).cast("int"))
    return c.select(
        i.alias("id"), "client_id", pick([" visa", "MASTERCARD", "Amex ", "discover"], i % 4).alias("card_brand"), pick(["Debit", "Credit", "Debit (Prepaid)"], i % 3).alias("card_type"), F.lit("0000").alias("card_number"),
        month(1 + i % 12, 2023 + i % 4).alias("expires"), F.lit("000").alias("cvv"), F.when(i % 3 == 0, "NO").otherwise("YES").alias("has_chip"), F.concat(F.lit("$"), (i % 10 * 1000).cast("string")).alias("credit_limit"),
        month(1 + i % 12, 2010 + i % 16).alias("acct_open_date"), (2005 + i % 21).cast("int").alias("year_pin_last_changed"), F.lit("No").alias("card_on_dark_web"),
    )


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(transactions(spark, sf_dir), users(spark, sf_dir), cards(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed score with ties and some skill: (id, label, score)."""
    t = transactions(spark, sf_dir)
    return t.select("id", F.col("fraud").alias("label"), F.round((F.col("id") * 37 % 800) / 1000 + 0.2 * F.col("fraud"), 3).alias("score"))


TX = """
tx AS (
  SELECT *, CAST(CASE WHEN errors IS NULL THEN 0 ELSE 1 END AS INT) AS has_error, CAST(floor(epoch(date)) AS BIGINT) AS tsec,
         CAST(year(date) AS INT) AS tx_year, CAST(month(date) AS INT) AS tx_month, CAST(day(date) AS INT) AS tx_day, CAST(hour(date) AS INT) AS tx_hour, CAST(isodow(date) - 1 AS INT) AS weekday,
         CAST(amount < 0 AS INT) AS is_refund, ln(1 + abs(amount)) AS log_abs_amount,
         CAST(coalesce(contains(errors, 'Bad Card Number'), false) AS INT) AS err_bad_card_number, CAST(coalesce(contains(errors, 'Bad Expiration'), false) AS INT) AS err_bad_expiration,
         CAST(coalesce(contains(errors, 'Bad CVV'), false) AS INT) AS err_bad_cvv, CAST(coalesce(contains(errors, 'Bad PIN'), false) AS INT) AS err_bad_pin, CAST(coalesce(contains(errors, 'Bad Zipcode'), false) AS INT) AS err_bad_zipcode,
         CAST(coalesce(contains(errors, 'Insufficient Balance'), false) AS INT) AS err_insufficient_balance, CAST(coalesce(contains(errors, 'Technical Glitch'), false) AS INT) AS err_technical_glitch
  FROM (
    SELECT event_id AS id, date_trunc('second', ts) AS date, user_id AS client_id, user_id * 2 + event_id % 2 AS card_id, k AS merchant_id, event_type AS mcc,
           CASE WHEN k % 10 = 9 THEN -value ELSE value END AS amount, CAST(k >= 95 AS INT) AS fraud,
           CASE WHEN event_type = 'error' THEN CASE k % 4 WHEN 0 THEN 'Bad CVV' WHEN 1 THEN 'Bad Card Number,Insufficient Balance' WHEN 2 THEN 'Bad Expiration' ELSE 'Technical Glitch' END END AS errors
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
  )
)"""

ENRICHED = (
    TX
    + """,
u AS (
  SELECT c_custkey AS client_id, CAST(20 + c_custkey % 60 AS INT) AS current_age, CAST(greatest(60 + c_custkey % 12 - (20 + c_custkey % 60), 0) AS INT) AS years_to_retirement, CAST(c_custkey % 2 = 0 AS INT) AS male,
         CAST(10000 + c_custkey * 7 AS DOUBLE) AS per_capita_income, CAST(20000 + c_custkey * 13 AS DOUBLE) AS yearly_income, CAST(c_custkey * 3 AS DOUBLE) AS total_debt, CAST(c_custkey % 5 AS INT) AS num_credit_cards
  FROM customer
), k AS (
  SELECT i AS card_id, client_id, i % 4 AS brand, i % 3 AS type, (2023 + i % 4) * 12 + 1 + i % 12 AS expires, (2010 + i % 16) * 12 + 1 + i % 12 AS opened, CAST(i % 3 <> 0 AS INT) AS has_chip,
         CAST(i % 10 * 1000 AS DOUBLE) AS credit_limit, 2005 + i % 21 AS pin
  FROM (SELECT c_custkey AS client_id, c_custkey * 2 + j AS i FROM customer, (VALUES (0), (1)) v(j))
), en AS (
  SELECT *, yearly_income / (per_capita_income + 1e-6) AS income_ratio_region, ln(1 + yearly_income) AS log_yearly_income, abs(amount) / (yearly_income + 1e-6) AS amount_income_ratio, abs(amount) / (credit_limit + 1e-6) AS amount_limit_ratio
  FROM (
    SELECT tx.*, u.* EXCLUDE (client_id), k.credit_limit, k.has_chip, CAST(expires - (year(date) * 12 + month(date)) AS INT) AS months_to_expire, CAST(year(date) * 12 + month(date) - opened AS INT) AS months_from_account,
           CAST(type = 1 AS INT) AS is_credit, CAST(type = 2 AS INT) AS is_prepaid, CAST(brand = 0 AS INT) AS cb_Visa, CAST(brand = 1 AS INT) AS cb_Mastercard, CAST(brand = 2 AS INT) AS cb_Amex, CAST(brand = 3 AS INT) AS cb_Discover,
           CAST(greatest(year(date) - pin, 0) AS INT) AS years_since_pin_change
    FROM tx LEFT JOIN u USING (client_id) LEFT JOIN k ON k.card_id = tx.card_id AND k.client_id = tx.client_id
  ) WHERE months_to_expire >= 0 AND months_from_account >= 0 AND credit_limit > 0
)"""
)

SCORED = TX + ",\nr AS (SELECT id, fraud AS label, round((id * 37 % 800) / 1000 + 0.2 * fraud, 3) AS score FROM tx)"
