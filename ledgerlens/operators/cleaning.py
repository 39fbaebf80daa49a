"""Raw transactions, users and cards as typed tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators.validate import assert_unique, must, require_columns


@dataclass(frozen=True)
class CleanConfig:
    date_format: str = S.DATE_FORMAT
    drop: tuple[str, ...] = ("merchant_state", "zip", "merchant_city", "use_chip")


def clean_transactions(raw: DataFrame, labels: DataFrame | None, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Typed, labelled transactions: the inner join drops those without a label; an unparseable date fails the job.

    ``amount`` loses its ``$``; one flag per error message; the category becomes text (``<NA>`` where it is no number or
    missing, unless it is a name already); calendar parts and log1p(abs(amount)) are added.
    """
    require_columns(raw, ["id", "date", "amount", "errors", "mcc"])
    df = raw if labels is None else raw.join(labels.select("id", F.col("fraud").cast("int").alias("fraud")), "id")
    parsed = S.parsed_date(F.col("date"), cfg.date_format)
    a = df.drop(*cfg.drop).withColumns({"amount": S.currency(F.col("amount")), "has_error": F.col("errors").isNotNull().cast("int"), **{n: S.contains_flag(F.col("errors"), m) for n, m in S.ERROR_MESSAGES.items()}})
    b = a.drop("errors").withColumn("date", F.coalesce(parsed, F.raise_error(F.lit("a date doesn't parse")).cast("timestamp_ntz")))
    c = b.withColumns({"tsec": S.epoch_seconds(F.col("date")), "tx_year": F.year("date"), "tx_month": F.month("date"), "tx_day": F.dayofmonth("date"), "tx_hour": F.hour("date"), "weekday": S.weekday(F.col("date"))})
    return c.withColumns({"is_refund": S.flag(F.col("amount") < 0), "log_abs_amount": F.log1p(F.abs("amount")), "mcc": F.coalesce(F.col("mcc").cast("string"), F.lit("<NA>"))})


def numeric_mcc(df: DataFrame) -> DataFrame:
    """Categories that should be numbers: other text becomes ``<NA>``."""
    return df.withColumn("mcc", F.coalesce(F.col("mcc").try_cast("long").cast("string"), F.lit("<NA>")))


def enrich(tx: DataFrame, users: DataFrame, cards: DataFrame) -> DataFrame:
    """Transactions with their users' and cards' attributes (m:1 left joins; repeated keys on the right raise).

    A card that isn't found fails the job, as does text that is no month. Expired cards, cards without a limit and
    transactions before the account's month are filtered. Join strategy: left to the planner, by size.
    """
    u = users.withColumnRenamed("id", "client_id") if "client_id" not in users.columns else users
    k = cards.withColumnRenamed("id", "card_id") if "card_id" not in cards.columns else cards
    require_columns(tx, ["id", "date", "client_id", "card_id", "amount"])
    assert_unique(u, ["client_id"])
    assert_unique(k, ["card_id", "client_id"])
    df = tx.join(u, "client_id", "left").join(k, ["card_id", "client_id"], "left")
    months = {n: must(S.parsed_month(F.col(n)), S.parsed_month(F.col(n)).isNotNull(), f"{n} is missing or no MM/YYYY") for n in ("expires", "acct_open_date")}
    now = S.month_index(F.col("date"))
    a = df.withColumns({"months_to_expire": months["expires"] - now, "months_from_account": now - months["acct_open_date"]}).where("months_to_expire >= 0 AND months_from_account >= 0")
    # The limit is checked, too: else the filter on it could drop a row without a card before its months are looked at.
    limit = must(S.currency(F.col("credit_limit")), F.col("credit_limit").isNotNull(), "a card is missing (expires has no MM/YYYY)")
    b = a.withColumns({c: S.currency(F.col(c)) for c in ("total_debt", "yearly_income", "per_capita_income")} | {"credit_limit": limit}).where("credit_limit > 0")
    chip = F.when(F.col("has_chip") == "YES", 1).when(F.col("has_chip") == "NO", 0).otherwise(F.raise_error(F.lit("has_chip is neither YES nor NO")).cast("int"))
    brand = F.initcap(F.trim("card_brand"))
    c = b.withColumns(
        {
            "has_chip": chip,
            "is_credit": S.contains_flag(F.upper("card_type"), "CREDIT"),
            "is_prepaid": S.contains_flag(F.upper("card_type"), "PREPAID"),
            "male": S.flag(F.col("gender") == "Male"),
            **{f"cb_{x}": S.flag(brand == x) for x in S.BRANDS},
            "years_since_pin_change": S.clipped(F.year("date") - F.col("year_pin_last_changed")).cast("int"),
            "years_to_retirement": S.clipped(S.number_or_null(F.col("retirement_age")) - S.number_or_null(F.col("current_age").cast("string"))).cast("int"),
            "income_ratio_region": S.ratio(F.col("yearly_income"), F.col("per_capita_income")),
            "log_yearly_income": F.log1p("yearly_income"),
            "abs_amount": F.abs("amount"),
        }
    )
    d = c.withColumns({"amount_income_ratio": S.ratio(F.col("abs_amount"), F.col("yearly_income")), "amount_limit_ratio": S.ratio(F.col("abs_amount"), F.col("credit_limit")), "log_income_ratio_region": F.log1p("income_ratio_region")})
    e = d.withColumns({"log_amount_income_ratio": F.log1p("amount_income_ratio"), "log_amount_limit_ratio": F.log1p("amount_limit_ratio")})
    return e.drop("cvv", "card_on_dark_web", "expires", "acct_open_date", "card_type", "gender", "birth_month", "birth_year", "card_number", "card_brand", "retirement_age", "latitude", "longitude", "address")
