"""Clock, session and calendar expressions over UTC times."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..series import TIME

#: Sessions in UTC minutes of the day, the later one of an overlap last.
SESSIONS = {"new_york": (14 * 60 + 30, 21 * 60), "london": (8 * 60, 16 * 60 + 30), "asia": (23 * 60, 7 * 60)}


def minute(t: str = TIME) -> Column:
    return F.hour(t) * 60 + F.minute(t)


def _inside(m: Column, span: tuple[int, int]) -> Column:
    lo, hi = span
    return (m >= lo) & (m < hi) if lo < hi else (m >= lo) | (m < hi)


def cyclical(t: str = TIME) -> dict[str, Column]:
    out = {}
    for name, value, n in (("hour", F.hour(t), 24), ("minute", F.minute(t), 60), ("dayofweek", F.weekday(t), 7)):
        x = value * (2 * math.pi / n)
        out |= {f"{name}_sin": F.sin(x), f"{name}_cos": F.cos(x)}
    h = F.hour(t)
    return out | {"session_asia": (h < 8).cast("int"), "session_london": ((h >= 8) & (h < 16)).cast("int"), "session_ny": (h >= 16).cast("int")}


def session(t: str = TIME, first_wins: bool = False) -> Column:
    """The session of a time, or null: of an overlap the later one in SESSIONS, or the first."""
    names = list(SESSIONS) if first_wins else list(SESSIONS)[::-1]
    return F.coalesce(*[F.when(_inside(minute(t), SESSIONS[s]), F.lit(s)) for s in names])


def session_id(t: str = TIME, outside: str = "outside") -> Column:
    return F.coalesce(session(t), F.lit(outside))


def session_flags(t: str = TIME) -> dict[str, Column]:
    return {f"is_{s}": _inside(minute(t), span).cast("int") for s, span in SESSIONS.items()}


def overlap_flags(t: str = TIME) -> dict[str, Column]:
    """The second one wraps: 8:00 to 7:00 is all but an hour."""
    return {"london_ny": _inside(minute(t), (14 * 60 + 30, 16 * 60 + 30)).cast("int"), "asia_london": _inside(minute(t), (8 * 60, 7 * 60)).cast("int")}


def in_sessions(df: DataFrame, include: list[str] | None = None, exclude: list[str] = (), t: str = TIME) -> DataFrame:
    active = [s for s in (include or SESSIONS) if s not in exclude]
    cond = F.lit(False)
    for s in active:
        cond = cond | _inside(minute(t), SESSIONS[s])
    return df.where(cond)


def session_stats(df: DataFrame, t: str = TIME) -> DataFrame:
    g = df.groupBy(session_id(t).alias("session")).agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("first_time"), F.max(t).alias("last_time"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return g.crossJoin(F.broadcast(total)).select("session", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"), "first_time", "last_time")  # one row


def _chicago(t: str | Column) -> Column:
    return F.from_utc_timestamp(F.col(t).cast("timestamp") if isinstance(t, str) else t.cast("timestamp"), "America/Chicago")


def market_closed(t: str | Column = TIME) -> Column:
    """Friday from 16:00, Saturday, Sunday before 17:00, and the hour from 16:00 daily, in Chicago."""
    local = _chicago(t)
    d, h = F.weekday(local), F.hour(local)
    return ((d == 4) & (h >= 16)) | (d == 5) | ((d == 6) & (h < 17)) | (h == 16)


def expected_gap(start: str, end: str) -> Column:
    """Friday evening to Sunday or Monday, or the daily pause, in Chicago."""
    s, e = _chicago(start), _chicago(end)
    weekend = (F.weekday(s) == 4) & (F.hour(s) >= 16) & F.weekday(e).isin(6, 0)
    daily = (F.to_date(s) == F.to_date(e)) & (F.hour(s) <= 16) & (F.hour(e) >= 17)
    return weekend | daily


def dst(t: str = TIME, zone: str = "America/New_York", standard_hours: int = -5) -> dict[str, Column]:
    """Daylight time by the zone's offset; its changes are the second Sunday of March and the first of November."""
    ts = F.col(t).cast("timestamp")
    offset = F.unix_seconds(F.from_utc_timestamp(ts, zone)) - F.unix_seconds(ts)
    day = F.to_date(F.from_utc_timestamp(ts, zone))
    spring = F.next_day(F.date_add(F.make_date(F.year(day), F.lit(3), F.lit(7)), 0), "Sun")
    autumn = F.next_day(F.date_sub(F.make_date(F.year(day), F.lit(11), F.lit(1)), 1), "Sun")
    return {"is_dst": (offset > standard_hours * 3600).cast("int"), "is_dst_transition": ((day == spring) | (day == autumn)).cast("int")}


def day_type(t: str, holidays: DataFrame) -> tuple[Column, DataFrame]:
    """(type of a day, holidays ready to join): weekend before holiday before early_close before regular. holidays: day, kind."""
    h = holidays.select(F.col("day").alias("_day"), F.col("kind").alias("_kind"))
    return F.when(F.weekday(t) >= 5, "weekend").otherwise(F.coalesce("_kind", F.lit("regular"))), h


def with_day_type(df: DataFrame, holidays: DataFrame, t: str = TIME) -> DataFrame:
    kind, h = day_type(t, holidays)
    return df.join(h, F.to_date(t) == F.col("_day"), "left").withColumn("day_type", kind).drop("_day", "_kind")


def trading_days(df: DataFrame, holidays: DataFrame) -> DataFrame:
    """Trading days from the first to the last time of df."""
    days = df.agg(F.explode(F.sequence(F.to_date(F.min(TIME)), F.to_date(F.max(TIME)))).alias("day"))
    closed = holidays.where("kind = 'holiday'").select("day")
    return days.where(F.weekday("day") < 5).join(closed, "day", "left_anti")
