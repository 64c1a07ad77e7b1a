"""Document-sized inputs with closed schemas: JSON bundles, chart files, factor archives, filings, paged texts.

Bulk files are read by Spark with a fixed schema; only single documents are opened on the driver.
"""

from __future__ import annotations

import io
import json
import math
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = "security_id string, concept string, period_start date, period_end date, value string, unit string, available_at timestamp, source_id string, revision int"
MEMBERSHIP = "security_id string, event_id string, included boolean, effective_at timestamp, available_at timestamp"
QUOTES = "source_id string, security_id string, observed_at timestamp, available_at timestamp, price_usd string, adjustment string, currency string, phase string"
ACTIONS = "security_id string, action_id string, kind string, available_at timestamp, effective_at timestamp, pay_at timestamp, old_shares string, new_shares string, cash_per_share string"
GRANTS = "source_id string, security_id string, available_at timestamp, valid_from timestamp, valid_through timestamp, maximum_short_shares string, annual_borrow_bps int, permission string"
INTERVALS = "source_id string, series_id string, start_at timestamp, end_at timestamp, available_at timestamp, cumulative_return string"
SENTINELS = (-99.99, -999.0)
DEEPEST, MOST_BYTES = 16, 32_768


def strict_json(text: str, most_bytes: int = MOST_BYTES) -> object:
    """A JSON document without repeated members, numbers that are not finite, or more than DEEPEST levels."""
    if len(text.encode("utf-8")) > most_bytes:
        raise ValueError("size")

    def members(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated member")
        return dict(pairs)

    def refuse(_: str) -> float:
        raise ValueError("not finite")

    def finite(token: str) -> float:
        if not math.isfinite(x := float(token)):
            raise ValueError("not finite")
        return x

    value = json.loads(text, object_pairs_hook=members, parse_constant=refuse, parse_float=finite)

    def depth(v: object) -> int:
        inner: Iterable = v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
        return 1 + max(map(depth, inner), default=0) if isinstance(v, (dict, list)) else 0

    if depth(value) > DEEPEST:
        raise ValueError("depth")
    return value


def _tables(spark: SparkSession, path: str, **parts: str) -> dict[str, DataFrame]:
    schema = ", ".join(f"{name} array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>" for name, kind in parts.items())
    whole = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return {name: whole.select(F.explode(name).alias("r")).select("r.*") for name in parts}


def monthly_source(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return _tables(spark, path, facts=FACTS, membership=MEMBERSHIP)


def raw_market(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return _tables(spark, path, quotes=QUOTES, actions=ACTIONS, borrow_grants=GRANTS)


def interval_returns(spark: SparkSession, path: str) -> DataFrame:
    return _tables(spark, path, rows=INTERVALS)["rows"]


def chart_panel(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, date, month, price) of chart files: parallel arrays of seconds and adjusted closes."""
    schema = "chart struct<result:array<struct<meta:struct<symbol:string>,timestamp:array<bigint>,indicators:struct<adjclose:array<struct<adjclose:array<double>>>>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("chart.result").alias("r"))
    points = rows.select(F.col("r.meta.symbol").alias("symbol"), F.explode(F.arrays_zip(F.col("r.timestamp").alias("t"), F.col("r.indicators.adjclose")[0]["adjclose"].alias("p"))).alias("x"))
    date = F.to_date(F.timestamp_seconds("x.t"))
    return points.select("symbol", date.alias("date"), F.date_format(date, "yyyy-MM").alias("month"), F.col("x.p").alias("price"))


def panel_violations(panel: DataFrame) -> DataFrame:
    """Dates that not every symbol has, and prices that are not positive and finite: (reason, symbol, date)."""
    symbols = panel.select("symbol").distinct().count()
    bad = panel.filter(F.col("price").isNull() | ~(F.col("price") > 0) | (F.col("price") == float("inf"))).select(F.lit("price").alias("reason"), "symbol", "date")
    gaps = panel.groupBy("date").agg(F.count_distinct("symbol").alias("n")).filter(F.col("n") != symbols)
    return bad.unionByName(gaps.select(F.lit("calendar").alias("reason"), F.lit(None).cast("string").alias("symbol"), "date"))


def factor_archive(spark: SparkSession, data: bytes) -> DataFrame:
    """(date, factor, value) of a daily factor archive: a single CSV member, header found by its empty first cell, percents
    made fractions; sentinels and dates that do not rise are refused."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        (member,) = z.namelist()
        lines = z.read(member).decode("utf-8", "strict").splitlines()
    at = next(i for i, line in enumerate(lines) if line.startswith(",") and line.count(",") >= 1)
    names, rows, last = [c.strip() for c in lines[at].split(",")[1:]], [], ""
    for line in lines[at + 1 :]:
        cells = [c.strip() for c in line.split(",")]
        if not (len(cells) == len(names) + 1 and len(cells[0]) == 8 and cells[0].isdigit()):
            break
        values = [float(c) for c in cells[1:]]
        if any(v in SENTINELS for v in values) or cells[0] <= last:
            raise ValueError(f"line of {cells[0]}")
        last = cells[0]
        rows += [(cells[0], n, v / 100) for n, v in zip(names, values, strict=True)]
    return spark.createDataFrame(rows, "day string, factor string, value double").select(F.to_date("day", "yyyyMMdd").alias("date"), "factor", "value")


def company_concept(spark: SparkSession, path: str, unit: str, security_id: str) -> DataFrame:
    """Facts of a company-concept filing in one unit, known from the day after they were filed."""
    kind = "array<struct<start:date,end:date,val:string,accn:string,fy:int,fp:string,form:string,filed:date>>"
    whole = spark.read.schema(f"tag string, units map<string,{kind}>").option("multiLine", True).json(path)
    rows = whole.select("tag", F.explode(F.col("units")[unit]).alias("r"))
    return rows.select(
        F.lit(security_id).alias("security_id"), F.col("tag").alias("concept"), F.col("r.start").alias("period_start"), F.col("r.end").alias("period_end"), F.col("r.val").alias("value"),
        F.lit(unit).alias("unit"), F.date_add("r.filed", 1).cast("timestamp").alias("available_at"), F.col("r.accn").alias("source_id"), F.lit(0).alias("revision"),
    )


def pages(texts: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, page, text) of texts with form feeds between pages, numbered from 1."""
    out = texts.select("doc_id", F.posexplode(F.split("text", "\f")).alias("page", "text")).withColumn("page", F.col("page") + 1)
    return out if wanted is None else out.filter(F.col("page").isin(wanted))


def write_panel(panel: DataFrame, path: str, partitions: int) -> None:
    """Writes a new Parquet table by year, and reads it back to compare."""
    out = panel.withColumn("year", F.year("date"))
    out.repartition(partitions, "symbol").write.mode("errorifexists").partitionBy("year").parquet(path)
    back = panel.sparkSession.read.parquet(path).select(*panel.columns)
    if not panel.exceptAll(back).isEmpty() or not back.exceptAll(panel).isEmpty():
        raise RuntimeError("what was read back differs")


def write_ndjson(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("errorifexists").text(path)
