"""Sessions, formations and trades on a calendar; sessions has (calendar_id, session_date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.filter("calendar_id is not null and session_date is not null").select("calendar_id", "session_date").distinct()


def month_ends(sessions: DataFrame, start: Column | None = None, end: Column | None = None, only_month: int | None = None) -> DataFrame:
    """The last session of each month over the whole calendar, then those in start..end, and in one month of the year."""
    ends = sessions.groupBy("calendar_id", F.trunc("session_date", "month").alias("month")).agg(F.max("session_date").alias("session_date"))
    if start is not None:
        ends = ends.filter((F.col("session_date") >= start) & (F.col("session_date") <= end))
    return ends if only_month is None else ends.filter(F.month("session_date") == only_month)


def formation_plan(sessions: DataFrame, delay: int) -> DataFrame:
    """Each month's last session as formation with the session `delay` later as trade; null if the calendar ends before.
    A calendar has one row a day at most, so its window stays small."""
    w = Window.partitionBy("calendar_id").orderBy("session_date")
    later = sessions.withColumn("trade_date", F.lead("session_date", delay).over(w)).withColumn("next", F.lead("session_date").over(w))
    last = F.col("next").isNull() | (F.trunc("next", "month") != F.trunc("session_date", "month"))
    return later.filter(last).select("calendar_id", F.col("session_date").alias("formation_date"), "trade_date")


def missing_months(sessions: DataFrame) -> DataFrame:
    """Months between a calendar's first and last session without any."""
    by = sessions.groupBy("calendar_id").agg(F.trunc(F.min("session_date"), "month").alias("a"), F.trunc(F.max("session_date"), "month").alias("b"))
    spine = by.select("calendar_id", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return spine.join(sessions.select("calendar_id", F.trunc("session_date", "month").alias("month")), ["calendar_id", "month"], "left_anti")


def day_gaps(sessions: DataFrame, more_than: int = 4) -> DataFrame:
    """Successive sessions more than so many days apart."""
    w = Window.partitionBy("calendar_id").orderBy("session_date")
    return sessions.select("calendar_id", F.lag("session_date").over(w).alias("previous_date"), "session_date").withColumn("days", F.date_diff("session_date", "previous_date")).filter(F.col("days") > more_than)


def active_vintages(formations: DataFrame, holding_months: int) -> DataFrame:
    """(calendar_id, month, formation_date): which formations are held in each month, holding_months of them at a time."""
    month = F.trunc("formation_date", "month")
    return formations.select("calendar_id", F.explode(F.sequence(F.add_months(month, 1), F.add_months(month, holding_months), F.expr("interval 1 month"))).alias("month"), "formation_date")
