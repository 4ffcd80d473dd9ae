"""Text to typed values, and session-calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCHANGE_ZONE = "Asia/Ho_Chi_Minh"
# The accepted date spellings, tried in this order.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
)
CLOSE_HOUR = 17


def parse_instant(text: Column) -> Column:
    """First matching spelling as a UTC instant; NULL when none matches."""
    trimmed = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(fmt)) for fmt in DATE_FORMATS])


def parse_trading_date(text: Column) -> Column:
    """Zone-less text is UTC; the trading date is the exchange-local day."""
    return F.to_date(F.from_utc_timestamp(parse_instant(text), EXCHANGE_ZONE))


def coerce_numeric(value: Column) -> Column:
    """Non-numeric text and NaN become NULL."""
    return F.nanvl(F.trim(value.cast("string")).try_cast("double"), F.lit(None).cast("double"))


def parse_flag(value: Column) -> Column:
    """true/false in any case; anything else is NULL so that a guard can count it."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def eligible_session(instant: Column) -> Column:
    """Latest finished weekday session at a UTC instant."""
    local = F.from_utc_timestamp(instant, EXCHANGE_ZONE)
    day = F.when(F.hour(local) >= CLOSE_HOUR, F.to_date(local)).otherwise(F.date_sub(F.to_date(local), 1))
    return F.date_sub(day, F.greatest(F.weekday(day) - F.lit(4), F.lit(0)))


def next_open_session(day: Column, open_weekdays: Column, closed: Column | None = None, horizon: int = 31) -> Column:
    """The first later day whose weekday (0 is Monday) is open and which is not among the ``closed`` dates.

    NULL if the next ``horizon`` days hold none.
    """
    later = F.sequence(F.date_add(day, 1), F.date_add(day, horizon))
    shut = F.coalesce(closed, F.array().cast("array<date>")) if closed is not None else F.array().cast("array<date>")
    return F.get(F.filter(later, lambda d: F.array_contains(open_weekdays, F.weekday(d)) & ~F.array_contains(shut, d)), 0)
