"""Loading tables, and column helpers that hold whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970-01-01T00:00Z of a timestamp column; one without zone means UTC."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        if df.sparkSession.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z"):  # the cheaper way
            return F.unix_micros(F.col(f"`{name}`").cast("timestamp"))
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(F.col(f"`{name}`").cast("timestamp"))


def need(df: DataFrame, *names: str) -> None:
    """Raises for columns that a table lacks, before any job runs."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
