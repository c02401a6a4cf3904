"""Time on a per-stay clock: decimal hours since midnight of the admission day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_US = 3.6e9


def hours_between(a: Column, b: Column) -> Column:
    """Hours from ``a`` to ``b`` as a double, to the microsecond."""
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(HOUR_US)


def days_between(a: Column, b: Column) -> Column:
    """Whole days from date ``a`` to date ``b``."""
    return F.datediff(b, a)


def midnight(ts: Column) -> Column:
    """Start of the day of ``ts``; stays zone-free where ``date_trunc`` would not."""
    return F.to_date(ts).cast("timestamp_ntz")


def time_dec(ts: Column) -> Column:
    return hours_between(midnight(ts), ts)


def floor_div(x: Column, width: float) -> Column:
    """Floor division, also right for negative ``x``."""
    return F.floor(x / F.lit(float(width)))


def modulo(x: Column, width: float) -> Column:
    """Non-negative remainder."""
    return F.pmod(x, F.lit(float(width)))


def icu_day(time_seq: Column) -> Column:
    return floor_div(time_seq, 24)


def clock_hour(time_seq: Column) -> Column:
    return modulo(time_seq, 24)


def add_clock(df: DataFrame, columns: dict[str, str], origin: str) -> DataFrame:
    """Add hours since midnight of ``origin``: ``columns`` maps new name to timestamp column."""
    zero = midnight(F.col(origin))
    return df.withColumns({new: hours_between(zero, F.col(ts)) for new, ts in columns.items()})


def measurement_clock(df: DataFrame, ts: str, origin: str) -> DataFrame:
    """time_dec, time_hbin, time_seq, time_icudays for a point event."""
    seq = hours_between(midnight(F.col(origin)), F.col(ts))
    return df.withColumns({
        "time_dec": time_dec(F.col(ts)),
        "time_hbin": F.floor(time_dec(F.col(ts))),
        "time_seq": seq,
        "time_icudays": icu_day(seq),
    })


def age_at(ts: Column, anchor_year: Column, anchor_age: Column) -> Column:
    """Age in the year of ``ts`` from a known age in an anchor year."""
    return F.year(ts) - anchor_year + anchor_age
