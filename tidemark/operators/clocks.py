"""Problem 5: written timestamps of mixed forms and zones as UTC instants.

A text's shape mask has 9 for each digit and a for each letter, and every other character as it is, so all texts of one
mask have their fields at the same places. Each distinct mask is compiled to a parser once per process; the parser reads
the fields of all texts of its mask at once from a matrix of code points. Local times become instants through transition
tables of one release of the zone data, which the driver sends to all workers.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.zones import Release, release
from tidemark.tables import need

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH_NUMBER = {m: i + 1 for i, m in enumerate(MONTHS)} | {m[:3]: i + 1 for i, m in enumerate(MONTHS)} | {"sept": 9}
WEEKDAYS = {"mon", "tue", "wed", "thu", "fri", "sat", "sun", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"}
UNIVERSAL = {"Z", "UTC", "GMT", "UT"}
SMALL_CLOCKS = 100_000
NONE = np.iinfo(np.int64).min

#: The mask of a date with a time of day. Every a is a letter and every 9 a digit of the text.
_DATE = "|".join(
    (
        r"(?P<y1>9999)(?P<s1>[-/.])(?P<m1>9{1,2})(?P=s1)(?P<d1>9{1,2})",
        r"(?P<y2>9999)(?P<m2>99)(?P<d2>99)",
        r"(?P<p>9{1,2})(?P<s2>[-/.])(?P<q>9{1,2})(?P=s2)(?P<y3>9999)",
        r"(?:(?P<w1>a{3,9}),? )?(?P<d4>9{1,2})(?P<s3>[- ])(?P<n4>a{3,9})(?P=s3)(?P<y4>9999)",
        r"(?:(?P<w2>a{3,9}),? )?(?P<n5>a{3,9})\.? (?P<d5>9{1,2}),? (?P<y5>9999)",
    )
)
_TIME = r"(?P<h>9{1,2}):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?|(?P<h2>99)(?P<mi2>99)(?P<sc2>99)?(?:[.,](?P<f2>9+))?"
_ZONE = r"(?P<o>[+-]9{1,2}(?::?99)?(?::99)?)(?: ?\[(?P<z1>[a/_+\-9]+)\])?|\[(?P<z2>[a/_+\-9]+)\]|(?P<z3>a+(?:[/_+\-]+[a9]+)*)"
SHAPE = re.compile(rf"(?:{_DATE})(?:(?P<t>a)|,? +|)(?:{_TIME})(?: ?(?P<ap>aa(?![a/])|a\.a\.))?(?: ?(?:{_ZONE}))?")
COUNT = re.compile(r"(?P<c>9{9,19})(?:\.(?P<cf>9+))?")
#: Digits of a bare count since 1970 and its units per second.
UNITS = {9: 1, 10: 1, 11: 1, 12: 1000, 13: 1000, 15: 10**6, 16: 10**6, 17: 10**6, 18: 10**9, 19: 10**9}

#: Blanks in a row and digits of a fraction beyond those that can change a reading; no other field has as many digits.
_SURPLUS = re.compile(r"(?<=  ) +|(?<=[.,][0-9]{20})[0-9]+")
LONG = 128

_MASK = {**{c: "9" for c in "0123456789"}, **{c: "a" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}}
_TABLE = str.maketrans(_MASK)


def shape_mask(text: str) -> str:
    return text.translate(_TABLE)


def _number(points: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(points), dtype=np.int64)
    for i in range(*span):
        out = out * 10 + (points[:, i].astype(np.int64) - 48)
    return out


def _words(points: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    width = span[1] - span[0]
    return np.ascontiguousarray(points[:, span[0] : span[1]]).view(f"U{width}").ravel()


def _by_word(words: np.ndarray, meaning: Callable[[str], int]) -> np.ndarray:
    distinct, inverse = np.unique(words, return_inverse=True)
    return np.array([meaning(str(w)) for w in distinct], dtype=np.int64)[inverse]


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01 in the Gregorian calendar, and which dates are real."""
    real = (m >= 1) & (m <= 12) & (d >= 1) & (y >= 1)
    ms = np.where(real, m, 1)
    month = (np.where(real, y, 1970) - 1970) * 12 + ms - 1
    first = month.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    following = (month + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return first + d - 1, real & (d <= following - first)


@lru_cache(maxsize=65536)
def parser(mask: str) -> Callable | None:
    """The parser of a mask, or None if texts of this mask denote no instant. It takes the matrix of code points, the
    zone of each text's clock, and whether that clock writes the day before the month (1, 0, or -1 if unknown)."""
    counted = COUNT.fullmatch(mask)
    shaped = SHAPE.fullmatch(mask)
    if counted and not (len(mask) in (12, 14) and shaped):
        return _count_parser(counted)
    if shaped is None or (mask.isdigit() and len(mask) not in (12, 14)):
        return None
    span = {k: shaped.span(k) for k, v in shaped.groupdict().items() if v is not None}
    first = lambda *names: next((span[n] for n in names if n in span), None)

    def parse(points: np.ndarray, zones: np.ndarray, day_first: np.ndarray, data: Release) -> np.ndarray:
        fields = lambda *names: _number(points, first(*names))
        year, ok = fields("y1", "y2", "y3", "y4", "y5"), np.ones(len(points), bool)
        if "p" in span:
            a, b = fields("p"), fields("q")
            day, month = np.where(day_first == 0, b, a), np.where(day_first == 0, a, b)
        else:
            day = fields("d1", "d2", "d4", "d5")
            named = first("n4", "n5")
            month = fields("m1", "m2") if named is None else _by_word(_words(points, named), lambda w: MONTH_NUMBER.get(w.lower(), 0))
        weekday = first("w1", "w2")
        if weekday:
            ok &= _by_word(_words(points, weekday), lambda w: w.lower() in WEEKDAYS).astype(bool)
        if "t" in span:
            ok &= np.isin(points[:, span["t"][0]], (ord("T"), ord("t")))
        hour, minute = fields("h", "h2"), fields("mi", "mi2")
        second = fields("s", "sc2") if first("s", "sc2") else np.zeros(len(points), np.int64)
        part = first("f", "f2")
        micro = np.zeros(len(points), np.int64)
        if part:
            micro = _number(points, (part[0], min(part[1], part[0] + 6))) * 10 ** max(0, 6 - (part[1] - part[0]))
        local_zone = zones
        if "ap" in span:
            half = _by_word(_words(points, span["ap"]), lambda w: {"am": 0, "pm": 12}.get(w.lower().replace(".", ""), -1))
            zone_word = half < 0  # two letters that are no half of the day are an abbreviation
            if zone_word.any():
                if "z3" in span or "o" in span or len(mask[slice(*span["ap"])]) != 2:
                    ok &= ~zone_word
                else:
                    local = parse_local(day, month, year, hour, minute, second, ok)
                    named = _zoned(local, _words(points, span["ap"]), zones, ok.copy(), data)
                    ok_half = ok & ~zone_word & (hour >= 1) & (hour <= 12)
                    local12 = parse_local(day, month, year, hour % 12 + np.maximum(half, 0), minute, second, ok_half)
                    plain = _in_zones(local12, zones, ok_half, data)
                    return np.where(zone_word, _micro(named, micro), _micro(plain, micro))
            ok &= (hour >= 1) & (hour <= 12)
            hour = hour % 12 + np.maximum(half, 0)
        local = parse_local(day, month, year, hour, minute, second, ok)
        if "o" in span:
            a, b = span["o"]
            digits = [i for i in range(a + 1, b) if mask[i] == "9"]
            lead = len(mask[a + 1 : b].split(":")[0]) if ":" in mask[a:b] else (len(digits) - 2 if len(digits) > 2 else len(digits))
            hours = _number(points[:, digits], (0, lead))
            minutes = _number(points[:, digits], (lead, min(lead + 2, len(digits))))
            ok &= (hours <= 18) & (minutes <= 59)
            sign = np.where(points[:, a] == ord("-"), -1, 1)
            return _micro(np.where(ok, local - sign * (hours * 3600 + minutes * 60), NONE), micro)
        word = first("z1", "z2", "z3")
        if word:
            return _micro(_zoned(local, _words(points, word), local_zone, ok, data), micro)
        return _micro(_in_zones(local, local_zone, ok, data), micro)

    def parse_local(day, month, year, hour, minute, second, ok):
        days, real = _days(year, month, day)
        ok &= real & (hour <= 23) & (minute <= 59) & (second <= 59)
        return days * 86_400 + hour * 3600 + minute * 60 + second

    return parse


def _micro(seconds: np.ndarray, micro: np.ndarray) -> np.ndarray:
    return np.where(seconds == NONE, NONE, np.where(seconds == NONE, 0, seconds) * 10**6 + micro)


def _count_parser(match: re.Match) -> Callable | None:
    digits = match.span("c")
    unit = UNITS.get(digits[1])
    part = match.span("cf")
    if unit is None or (part[0] >= 0 and unit != 1):
        return None

    def parse(points: np.ndarray, zones: np.ndarray, day_first: np.ndarray, data: Release) -> np.ndarray:
        if unit == 10**9:  # the last three digits are cut off, which also keeps 19 digits within 64 bits
            return _number(points, (0, digits[1] - 3))
        out = _number(points, digits) * (10**6 // unit)
        if part[0] >= 0:
            out += _number(points, (part[0], min(part[1], part[0] + 6))) * 10 ** max(0, 6 - (part[1] - part[0]))
        return out

    return parse


def _in_zones(local: np.ndarray, zones: np.ndarray, ok: np.ndarray, data: Release) -> np.ndarray:
    out = np.full(len(local), NONE)
    codes, names = pd.factorize(zones)
    for code, name in enumerate(names):
        table = data.table(name) if isinstance(name, str) else None
        mine = ok & (codes == code)
        if table is not None:
            out[mine] = table.to_utc(local[mine])
    return out


def _zoned(local: np.ndarray, words: np.ndarray, zones: np.ndarray, ok: np.ndarray, data: Release) -> np.ndarray:
    """A zone name or an abbreviation in the text; an abbreviation is read as the clock's zone uses it."""
    out = np.full(len(local), NONE)
    codes, pairs = pd.factorize(pd.MultiIndex.from_arrays([words, zones]))
    for code, (word, zone) in enumerate(pairs):
        mine = ok & (codes == code)
        if not mine.any():
            continue
        own = data.table(zone) if isinstance(zone, str) else None
        named = own.named_to_utc(word.upper(), local[mine]) if own is not None else None
        if named is None and word.upper() in UNIVERSAL:
            named = local[mine]
        if named is None and ("/" in word or word in ("UTC", "GMT")):
            table = data.table(word)
            named = None if table is None else table.to_utc(local[mine])
        if named is not None:
            out[mine] = named
    return out


def parse_instants(texts: pd.Series, zones: pd.Series, day_first: pd.Series, data: Release | None = None) -> np.ndarray:
    """Microseconds of each text, NONE where it denotes no instant; by this machine's release if none is given."""
    data = data or release()
    stripped = np.array([t.strip() if isinstance(t, str) else "" for t in texts], dtype=object)
    stripped[:] = [_SURPLUS.sub("", t) if len(t) > LONG else t for t in stripped]
    zone_names, orders = zones.to_numpy(dtype=object), day_first.fillna(-1).to_numpy(dtype=np.int64)
    out = np.full(len(stripped), NONE)
    codes, masks = pd.factorize(np.array([shape_mask(t) for t in stripped], dtype=object))
    order = np.argsort(codes, kind="stable")
    cuts = np.searchsorted(codes[order], np.arange(len(masks) + 1))
    for i, mask in enumerate(masks):
        parse = (parser if len(mask) <= LONG else parser.__wrapped__)(mask) if mask else None  # long masks are not kept
        if parse is None:
            continue
        rows = order[cuts[i] : cuts[i + 1]]
        points = np.array(stripped[rows].tolist(), dtype=f"U{len(mask)}").view(np.uint32).reshape(len(rows), len(mask))
        out[rows] = parse(points, zone_names[rows], orders[rows], data)
    return out


def clock_orders(written: DataFrame, clocks: DataFrame) -> DataFrame:
    """Each clock (clock, zone) with day_first, learnt from all its numeric dates (clock, text): true if more of them can
    only be read day first than only month first; null if nothing tells, which is read as day first."""
    parts = lambda i: F.regexp_extract("text", r"^\s*([0-9]{1,2})[-/.]([0-9]{1,2})[-/.][0-9]{4}(?![0-9])", i)
    a, b = F.expr("try_cast(a as int)"), F.expr("try_cast(b as int)")
    seen = written.select("clock", parts(1).alias("a"), parts(2).alias("b")).filter("a <> ''")
    votes = seen.groupBy("clock").agg(F.sum(((a > 12) & (a <= 31) & (b <= 12)).cast("int") - ((b > 12) & (b <= 31) & (a <= 12)).cast("int")).alias("vote"))
    known = clocks.filter("clock is not null").groupBy("clock").agg(F.min("zone").alias("zone"))
    return known.join(votes, "clock", "left").select("clock", "zone", F.when(F.col("vote") != 0, (F.col("vote") > 0).cast("int")).alias("day_first"))


def to_instants(written: DataFrame, clocks: DataFrame) -> DataFrame:
    """written (clock, text, other columns..) with instant_us, the microseconds since 1970-01-01T00:00Z that text denotes,
    and zone_version, the release of the zone data; clocks has (clock, zone).

    An instant is a real date with a time of day, or a bare count of seconds, milli-, micro- or nanoseconds since 1970. An
    offset, zone name or abbreviation in the text decides, else the clock's zone. Twice occurring local times mean the
    first, skipped ones are read with the offset before. instant_us is null for null, empty and blank texts, dates or
    times alone, impossible dates and other texts, and for local times of a clock that
    is null or not in clocks. Rows are kept as they are, repeated ones too; columns of clocks never clash with them.
    """
    need(written, "clock", "text")
    need(clocks, "clock", "zone")
    orders = clock_orders(written, clocks).select(F.col("clock").alias("_clock"), F.col("zone").alias("_zone"), F.col("day_first").alias("_day_first"))
    if clocks.limit(SMALL_CLOCKS + 1).count() <= SMALL_CLOCKS:  # one row for each clock: broadcast within this bound only
        orders = F.broadcast(orders)
    joined = written.join(orders, written["clock"] == orders["_clock"], "left")
    shared = written.sparkSession.sparkContext.broadcast(release())  # some 600 small files

    def instants(texts: pd.Series, zones: pd.Series, day_first: pd.Series) -> pd.Series:
        out = parse_instants(texts, zones, day_first, shared.value)
        return pd.Series(out, dtype="Int64").mask(out == NONE)

    found: Column = F.pandas_udf(instants, T.LongType())("text", "_zone", "_day_first")
    return joined.withColumn("instant_us", found).drop("_clock", "_zone", "_day_first").withColumn("zone_version", F.lit(release().version))
