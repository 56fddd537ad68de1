"""Scalar functions of the panel: session time, clipping, rounding, text, periods."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A session's minutes of the day, 9:30 to 11:30 and 13:00 to 15:00.
MORNING, NOON, AFTERNOON, CLOSE = 570, 690, 780, 900


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def trading_minutes_elapsed(ts: Column) -> Column:
    """Minutes of the session gone by, 0 to 240, seconds as their part of a minute; 240 for a null time."""
    m, part = minute_of_day(ts), F.second(ts) / F.lit(60.0)
    gone = F.when(m < MORNING, 0.0).when(m < NOON, m - MORNING + part).when(m < AFTERNOON, 120.0).when(m < CLOSE, m - AFTERNOON + 120 + part).otherwise(240.0)
    return F.coalesce(F.when(ts.isNotNull(), gone), F.lit(240.0))


def session_phase(ts: Column) -> Column:
    m = minute_of_day(ts)
    return F.when(m < MORNING, "preopen").when(m <= NOON, "morning").when(m < AFTERNOON, "lunch").when(m <= CLOSE, "afternoon").otherwise("close")


def continuous_trading(ts: Column) -> Column:
    """A weekday's minute in one of the two sessions."""
    m = minute_of_day(ts)
    return (F.weekday(ts) < 5) & (m.between(MORNING, NOON) | m.between(AFTERNOON, CLOSE))


def intraday_volume_ratio(ratio: Column, ts: Column) -> Column:
    """A partial day's volume ratio scaled to the whole session."""
    return ratio * F.lit(240.0) / F.greatest(trading_minutes_elapsed(ts), F.lit(1.0))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def half_up(c: Column, digits: int = 2) -> Column:
    """Half up on positive numbers, as cents are rounded."""
    scale = 10**digits
    return F.floor(c * scale + 0.5) / F.lit(float(scale))


def half_even(c: Column, digits: int = 2) -> Column:
    return F.bround(c, digits)


def period_offset(day: Column, n: int, unit: str) -> Column:
    """``n`` units before a day, a month being 30 and a year 365 days."""
    return F.date_sub(day, n * {"day": 1, "month": 30, "year": 365}[unit])


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def any_true(*flags: Column) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return out


def all_true(*flags: Column) -> Column:
    out = F.lit(True)
    for f in flags:
        out = out & F.coalesce(f, F.lit(False))
    return out
