"""Column helpers: cleaning, calendar arithmetic, ratios. Pure functions of columns; nothing here needs a UDF."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
DATE_FORMAT, MONTH_FORMAT = "yyyy-MM-dd HH:mm:ss", "MM/yyyy"
#: The error messages that a transaction may carry, by flag name; and the card brands.
ERROR_MESSAGES = {
    "err_bad_card_number": "Bad Card Number",
    "err_bad_expiration": "Bad Expiration",
    "err_bad_cvv": "Bad CVV",
    "err_bad_pin": "Bad PIN",
    "err_bad_zipcode": "Bad Zipcode",
    "err_insufficient_balance": "Insufficient Balance",
    "err_technical_glitch": "Technical Glitch",
}
BRANDS = ("Visa", "Mastercard", "Amex", "Discover")


def flag(condition: Column) -> Column:
    """A condition as 1 or 0; unknown counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def currency(text: Column) -> Column:
    """``$-12.34`` as a number; text that is none fails the job (ANSI cast)."""
    return F.replace(text, F.lit("$"), F.lit("")).cast("double")


def number_or_null(text: Column) -> Column:
    return text.try_cast("double")


def contains_flag(text: Column, part: str) -> Column:
    return flag(text.contains(part))


def parsed_date(text: Column, fmt: str = DATE_FORMAT) -> Column:
    """Text as a timestamp without zone; null where it doesn't parse."""
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def parsed_month(text: Column) -> Column:
    """``MM/YYYY`` as year * 12 + month; null where it doesn't parse."""
    month, year = F.try_element_at(F.split(text, "/"), F.lit(1)).try_cast("int"), F.try_element_at(F.split(text, "/"), F.lit(2)).try_cast("int")
    return F.when(text.rlike(r"^[0-9]{1,2}/[0-9]{4}$") & month.between(1, 12), year * 12 + month)


def month_index(date: Column) -> Column:
    """Months are compared as year * 12 + month, never as fractions."""
    return F.year(date) * 12 + F.month(date)


def epoch_seconds(date: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.datediff(date.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(date) * 3600 + F.minute(date) * 60 + F.second(date)


def weekday(date: Column) -> Column:
    """Monday is 0."""
    return F.weekday(date)


def ratio(a: Column, b: Column, eps: float = EPS) -> Column:
    return a / (b + F.lit(eps))


def clipped(x: Column, least: float = 0) -> Column:
    """Values below ``least`` become it; null stays null."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(least)))


def finite(x: Column) -> Column:
    """Null, NaN and infinities become 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == math.inf), 0.0).otherwise(x)


def hour_sin(hour: Column) -> Column:
    return F.sin(hour * (2 * math.pi / 24))


def hour_cos(hour: Column) -> Column:
    return F.cos(hour * (2 * math.pi / 24))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the sphere in km."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def row_sum(columns: Sequence[str]) -> Column:
    out = F.lit(0)
    for c in columns:
        out = out + F.col(c)
    return out


def known_or(text: Column, other: str = "UNK") -> Column:
    return F.coalesce(text, F.lit(other))


def grid(first: float, last: float, n: int) -> list[float]:
    """n evenly spaced numbers, both ends included."""
    return [first + (last - first) * i / (n - 1) for i in range(n)] if n > 1 else [first]
