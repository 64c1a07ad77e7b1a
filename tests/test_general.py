"""The general problems on small fixtures: nulls, ties, repeated rows, empty tables, clashing columns, brute force."""

import random
import zoneinfo
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.zones import release
from tidemark.operators.asof import as_known_at
from tidemark.operators.clocks import NONE, parse_instants, parser, shape_mask, to_instants
from tidemark.operators.deliveries import Conflict, SeenLedger, pack_bits, repeated_deliveries, unpack_bits
from tidemark.operators.history import FOREVER, bitemporal_ledger, current_history
from tidemark.operators.intervals import continuous_periods, merge_lists
from tidemark.operators.spikes import exact_median, flag_readings, grouped_median
from tidemark.timeshard import plan_shards

T0 = datetime(2024, 1, 1)


def at(n):
    return None if n is None else T0 + timedelta(seconds=n)


def us(n):
    return int((T0 - datetime(1970, 1, 1)).total_seconds() + n) * 10**6


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


GRANTS = "security_id string, kind string, `from` timestamp_ntz, `through` timestamp_ntz, key string, _shard int, begins int"


def grants(spark, data):
    return spark.createDataFrame([(k, "x", at(a), at(b), "clash", 9, 9) for k, a, b in data], GRANTS)


def test_periods_and_gaps(spark):
    df = grants(spark, [("A", 0, 10), ("A", 10, 20), ("A", 5, 7), ("A", 30, 40), ("A", 30, 40), ("A", 50, 50), ("A", 60, None), ("A", None, 3), (None, 0, 5), ("B", 9, 3), ("C", 1, 2)])
    assert rows(continuous_periods(df, "security_id", "from", "through")) == sorted([("A", "period", us(0), us(20)), ("A", "gap", us(20), us(30)), ("A", "period", us(30), us(40)), ("C", "period", us(1), us(2))], key=str)
    assert continuous_periods(df.limit(0), "security_id", "from", "through").count() == 0
    with pytest.raises(ValueError):
        continuous_periods(df, "security_id", "from", "nothing")


@pytest.mark.parametrize("target", [None, 2, 17])
def test_periods_against_points(spark, target):
    rng = random.Random(5)
    data = [(rng.choice("AAAB"), a := rng.randrange(400), a + rng.choice((1, 2, 3, 90))) for _ in range(150)]
    got = {r for r in rows(continuous_periods(grants(spark, data), "security_id", "from", "through", target)) if r[1] == "period"}
    want = set()
    for key in "AB":
        covered = sorted({p for k, a, b in data if k == key for p in range(2 * a, 2 * b + 1)})
        start = covered[0]
        for p, q in zip(covered, [*covered[1:], None]):
            if q != p + 1:
                want.add((key, "period", us(start // 2), us(p // 2)))
                start = q
    assert got == want


def test_lists_of_each_owner_are_merged():
    owner, a, b = merge_lists(np.array([0, 0, 0, 0, 3, 3]), np.array([1, 8, 2, 9, 1, 4]), np.array([5, 9, 3, 12, 2, 6]))
    assert list(zip(owner, a, b)) == [(0, 1, 5), (0, 8, 12), (3, 1, 2), (3, 4, 6)]


@pytest.mark.parametrize("target", [None, 3])
def test_known_at_against_brute_force(spark, target):
    rng = random.Random(3)
    facts = [(rng.choice(["A", "B", None]), rng.choice("xy"), rng.choice([None, 1, 2, 3]), rng.choice([None, *range(20)]), rng.choice([None, 0, 1]), rng.choice(["a", "ab", "b", "", "ü"]), 7) for _ in range(120)]
    events = [(i, rng.choice(["A", "B", "C", None]), rng.choice("xy"), rng.choice([None, *range(22)])) for i in range(60)]
    f = spark.createDataFrame(facts + facts[:9], "security string, concept string, period int, known bigint, revision int, source string, id int")
    e = spark.createDataFrame(events, "id int, security string, concept string, t bigint")
    out = as_known_at(e, f, ["security", "concept"], F.col("t"), F.col("known"), [F.col("period"), F.col("known"), F.col("revision")], "source", target)
    got = {r["event"]["id"]: (r["known"]["rank0"], r["known"]["rank1"], r["known"]["rank2"], r["known"]["pick"]) for r in out.collect()}
    want = {}
    low = lambda v: (-1 if v is None else v)
    for i, s, c, t in events:
        mine = [x for x in facts if None not in (s, t, x[3]) and x[0] == s and x[1] == c and x[3] <= t]
        if mine:
            best = max((low(x[2]), x[3], low(x[4])) for x in mine)
            chosen = [x for x in mine if (low(x[2]), x[3], low(x[4])) == best]
            want[i] = (chosen[0][2], chosen[0][3], chosen[0][4], min(x[5] for x in chosen))
    assert got == want
    assert as_known_at(e.limit(0), f, ["security", "concept"], F.col("t"), F.col("known"), [F.col("period")], "source").count() == 0


HISTORY = "security_id string, symbol string, exchange string, a timestamp_ntz, b timestamp_ntz, known timestamp_ntz, source string, valid_from int"


def ledger_of(spark, data, target=None):
    df = spark.createDataFrame([(k, s, x, at(a), at(b), at(r), src, 1) for k, s, x, a, b, r, src in data], HISTORY)
    return bitemporal_ledger(df, "security_id", {"symbol": F.upper(F.trim("symbol")), "exchange": F.col("exchange")}, "a", "b", "known", "source", target)


def test_ledger_keeps_what_it_supersedes(spark):
    data = [("A", "x", "E", 0, None, 0, "1"), ("A", " X ", "E", 10, None, 10, "2"), ("A", "y", "E", 20, 30, 25, "3"), ("A", "z", "E", 20, 40, 26, "4"), ("A", None, "E", 50, None, 1, "5"), ("A", "q", "E", 60, 60, 1, "6"), ("A", "z", "E", 20, 40, 26, "4")]
    ledger, plan = ledger_of(spark, data)
    kept = {(r["source"], r["status"], r["valid_from"], r["valid_to"], r["recorded_to"]) for r in ledger.collect()}
    assert ("3", "superseded", us(20), us(30), us(26)) in kept
    assert ("2", "current", us(10), us(20), None) in kept
    assert ("1", "split", us(10), FOREVER, us(10)) in kept and ("2", "split", us(20), FOREVER, us(25)) in kept
    assert {s for s, status, *_ in kept if status == "void"} == {"5", "6"}
    now = rows(current_history(ledger, plan, ["symbol", "exchange"]))
    assert now == [("A", "X", "E", us(0), us(20)), ("A", "Z", "E", us(20), us(40))]


@pytest.mark.parametrize("target", [None, 2, 9])
def test_history_against_instants(spark, target):
    rng = random.Random(11)
    data = [(rng.choice("AAB"), rng.choice(["p", "q", None]), rng.choice(["E", None]), a := rng.choice([None, *range(60)]), None if rng.random() < 0.3 or a is None else a + rng.randrange(0, 9), rng.choice([None, *range(9)]), str(i)) for i in range(90)]
    ledger, plan = ledger_of(spark, data + data[:5], target)
    got = set()
    for k, s, x, a, b in rows(current_history(ledger, plan, ["symbol", "exchange"])):
        got |= {(k, i, s, x) for i in range(100) if a <= us(i) < b}
    want = set()
    for key in "AB":
        best = {}
        for k, s, x, a, b, r, src in data:
            if k == key and s is not None and a is not None and (b is None or b > a):
                best[a] = max(best.get(a, ((-1, ""), 0)), ((-1 if r is None else r, src), (s.upper(), x, b)), key=lambda v: v[0])
        for i in range(100):
            ruling = [a for a in best if a <= i]
            if ruling and ((b := best[max(ruling)][1][2]) is None or b > i):
                want.add((key, i, *best[max(ruling)][1][:2]))
    assert got == want
    assert ledger_of(spark, [])[0].count() == 0


@pytest.mark.parametrize("target", [None, 2, 6])
@pytest.mark.parametrize("shape", ["mixed", "rising", "falling"])
def test_one_row_rules_at_every_instant_of_both_times(spark, target, shape):
    """Against what is believed by the rules of the rows recorded by then, looked up for each pair of instants."""
    rng = random.Random(f"{shape}{target}")
    data = []
    for i in range(60):
        a = rng.randrange(40)
        recorded = {"mixed": rng.choice([None, *range(12)]), "rising": a // 2, "falling": 40 - a}[shape]
        data.append((rng.choice("AAAB"), rng.choice("pq"), rng.choice(["E", None]), a, rng.choice([None, a + rng.randrange(1, 25)]), recorded, str(i)))
    ledger, _ = ledger_of(spark, data + data[:4], target)
    pieces = ledger.filter("status <> 'void'").collect()
    assert len({(r["key"], r["source"], r["valid_from"], r["recorded_to"]) for r in pieces}) == len(pieces)
    for key in "AB":
        mine = [r for r in data if r[0] == key]
        own = [r for r in pieces if r["key"] == key]
        for now in range(-1, 43):
            known = [r for r in mine if r[5] is None or r[5] <= now]
            for v in range(-1, 68, 3):
                started = [r for r in known if r[3] <= v]
                ruling = max(started, key=lambda r: (r[3], -1 if r[5] is None else r[5], r[6]), default=None)
                want = [] if ruling is None or (ruling[4] is not None and ruling[4] <= v) else [ruling[6]]
                held = [r["source"] for r in own if r["valid_from"] <= us(v) < r["valid_to"] and (r["recorded_from"] is None or r["recorded_from"] <= us(now)) and (r["recorded_to"] is None or r["recorded_to"] > us(now))]
                assert held == want, (key, now, v)


def readings(spark, values, key="S"):
    return spark.createDataFrame([(key, at(i), f"{key}{i}", v, "clash", 1) for i, v in enumerate(values)], "security string, at timestamp_ntz, id string, price string, kind string, x int")


def test_readings(spark):
    base = ["100", "100.5", "100", " 101 ", "100.2"]
    values = [*base, "300", "100.1", "100.4", None, "", "n/a", "NaN", "-5", "0", "100", *["99.9"] * 12, "100.1", "20", "21", "20.5", "100", "99.7"]
    df = readings(spark, values)
    got = {(r["reading_id"], r["kind"]) for r in flag_readings(df.union(df.limit(7)), "security", "at", "id", "price").collect()}
    assert {i for i, k in got if k == "impossible"} == {"S12", "S13"}
    assert {i for i, k in got if k == "stuck"} == {f"S{i}" for i in range(16, 27)}
    assert {i for i, k in got if k == "spike"} == {"S5", "S28", "S29", "S30"}
    assert flag_readings(df.limit(0), "security", "at", "id", "price").count() == 0
    assert flag_readings(readings(spark, ["5"] * 4), "security", "at", "id", "price").count() == 0


def test_exact_median(spark):
    rng = random.Random(2)
    data = [(k, rng.choice([rng.random(), 0.25, 1e-7, 900.0])) for k in "abc" for _ in range(rng.choice([1, 40, 41]))]
    got = dict(map(tuple, exact_median(spark.createDataFrame(data, "key string, v double"), "key", "v").collect()))
    near = grouped_median(np.array([v for _, v in data]), np.array(["abc".index(k) for k, _ in data]), 4)
    for i, k in enumerate("abc"):
        want = float(np.median([v for x, v in data if x == k]))
        assert got[k] == pytest.approx(want, rel=1e-12) and near[i] == pytest.approx(want, rel=1e-12)
    assert np.isnan(near[3])


@pytest.mark.parametrize("target", [None, 30])
def test_rolling_filter_against_plain_loops(spark, target):
    rng = random.Random(6)
    values = [100.0]
    for _ in range(150):
        values.append(round(values[-1] * (1 + rng.choice([0, 0.001, -0.002, 0.003])), 4))
    for i in (20, 70, 71, 110):
        values[i] = round(values[i] * rng.choice([0.5, 1.9]), 4)
    df = readings(spark, [str(v) for v in values])
    got = {r["reading_id"] for r in flag_readings(df, "security", "at", "id", "price", 8.0, target_rows=target, rule="plain", half=4).filter("kind = 'spike'").collect()}
    lx = np.log(values)
    typical = np.median([abs(b - a) for a, b in zip(lx, lx[1:]) if a != b])
    want = set()
    for i in range(len(lx)):
        window = lx[max(0, i - 4) : i + 5]
        mad = np.median(np.abs(window - np.median(window)))
        if abs(lx[i] - np.median(window)) > 8.0 * 1.4826 * (mad or typical):
            want.add(f"S{i}")
    assert got == want and {"S20", "S70", "S71", "S110"} <= got


def instant(text, zone="Europe/Berlin", order=1):
    got = int(parse_instants(pd.Series([text]), pd.Series([zone]), pd.Series([order]))[0])
    return None if got == NONE else got


@pytest.mark.parametrize(
    ("text", "zone", "order", "want"),
    [
        ("2021-10-31 02:30:00", "Europe/Berlin", 1, "2021-10-31T00:30:00"), ("2021-10-31 02:30:00 CET", "Europe/Berlin", 1, "2021-10-31T01:30:00"),
        ("2021-03-28 02:30", "Europe/Berlin", 1, "2021-03-28T01:30:00"), ("3/4/2021 5:06:07 PM", "America/New_York", 0, "2021-03-04T22:06:07"),
        ("3/4/2021 05:06:07", "Asia/Tokyo", 1, "2021-04-02T20:06:07"), ("04.03.2021 05:06:07", "UTC", 1, "2021-03-04T05:06:07"), ("20210304T050607Z", "Asia/Tokyo", 1, "2021-03-04T05:06:07"),
        ("20210304050607", "Asia/Kolkata", 1, "2021-03-03T23:36:07"), ("March 4, 2021, 12:06:07 a.m.", "UTC", 1, "2021-03-04T00:06:07"), ("Thu, 04 Mar 2021 05:06:07 -0330", "UTC", 1, "2021-03-04T08:36:07"),
        ("2021-03-04T05:06:07+12:45[Pacific/Chatham]", "UTC", 1, "2021-03-03T16:21:07"), ("2021-03-04 05:06:07 -03", "America/Sao_Paulo", 1, "2021-03-04T08:06:07"), ("2021-03-04 05:06:07 Asia/Tokyo", "UTC", 1, "2021-03-03T20:06:07"),
        ("1614834367", "UTC", 1, "2021-03-04T05:06:07"), ("1614834367000", "UTC", 1, "2021-03-04T05:06:07"), ("1614834367000000999", "UTC", 1, "2021-03-04T05:06:07"), ("  2021-03-04 05:06:07,9 ", "UTC", 1, "2021-03-04T05:06:07.9"),
        ("2021-03-04t05:06:07z", "Asia/Tokyo", 1, "2021-03-04T05:06:07"), ("IST", "UTC", 1, None), ("2021-02-29 01:00:00", "UTC", 1, None), ("2021-13-56T00:61:00Z", "UTC", 1, None), ("2021-03-04", "UTC", 1, None), ("05:06", "UTC", 1, None),
        ("n/a", "UTC", 1, None), ("", "UTC", 1, None), (" ", "UTC", 1, None), (None, "UTC", 1, None), ("2021-03-04 05:06:07 XYZ", "UTC", 1, None), ("2021-03-04 05:06:07", None, 1, None), ("13:00:00 PM 1/1/2021", "UTC", 1, None), ("x" * 5000, "UTC", 1, None),
    ],
)
def test_instants(text, zone, order, want):
    expected = None if want is None else int(np.datetime64(want, "us").astype(np.int64))
    assert instant(text, zone, order) == expected


def test_closing_rules_hold_for_ever():
    assert instant("2150-07-01 10:00", "America/New_York") == int(np.datetime64("2150-07-01T14:00", "us").astype(np.int64))
    zones = ("America/New_York", "Europe/Berlin", "Africa/Casablanca", "Australia/Lord_Howe", "Asia/Kolkata", "Pacific/Apia", "America/Nuuk")
    rng = random.Random(1)
    for name in zones:
        zone = zoneinfo.ZoneInfo(name)
        at = [datetime(rng.choice([1850, 1890, 1921, 1945, 1983, 2024, 2037, 2085, 2099, 2100, 2101, 2499, 2500, 2501, 3333, 9000]), rng.randrange(1, 13), rng.randrange(1, 29), rng.randrange(24), rng.randrange(60)) for _ in range(400)]
        at += [datetime(y, 1, 1) for y in (2100, 2500, 2900)] + [datetime(y, 12, 31, 23, 59) for y in (2099, 2499, 2899)]
        local = np.array([(t - datetime(1970, 1, 1)) // timedelta(seconds=1) for t in at])
        want = [int(s - t.replace(tzinfo=zone).utcoffset().total_seconds()) for s, t in zip(local.tolist(), at)]
        assert release().table(name).to_utc(local).tolist() == want, name


def test_masks_are_parsed_once():
    assert shape_mask("2021-03-04T05:06") == "9999-99-99a99:99"
    assert parser("9999-99-99a99:99") is parser("9999-99-99a99:99")


def test_order_of_day_and_month_is_learnt(spark):
    written = spark.createDataFrame([("a", "13/02/2021 00:00:00", 1), ("a", "03/02/2021 00:00:00", 2), ("b", "02/13/2021 00:00:00", 3), ("b", "03/02/2021 00:00:00", 4), ("c", "03/02/2021 00:00:00", 5), (None, "2021-01-01 00:00:00", 6), ("zz", "2021-01-01 00:00:00Z", 7)], "clock string, text string, zone int")
    clocks = spark.createDataFrame([("a", "UTC"), ("b", "UTC"), ("c", "UTC")], "clock string, zone string")
    got = {r["zone"]: r["instant_us"] for r in to_instants(written, clocks).collect()}
    day = lambda s: int(np.datetime64(s, "us").astype(np.int64))
    assert got == {1: day("2021-02-13"), 2: day("2021-02-03"), 3: day("2021-02-13"), 4: day("2021-03-02"), 5: day("2021-02-03"), 6: None, 7: day("2021-01-01")}
    assert to_instants(written.limit(0), clocks).count() == 0


DELIVERIES = "delivery_id bigint, received_at timestamp_ntz, event_id string, payload string, key string, shard int"


def deliveries(spark, data):
    return spark.createDataFrame([(i, at(t), e, p, "clash", 1) for i, t, e, p in data], DELIVERIES)


def test_repeated_deliveries(spark, tmp_path):
    data = [
        (1, 5, " AB\t", '{"a":1,"b":"x"}'), (2, 4, "ab", '{ "b":"x", "a":1 }'), (3, 4, "AB", '{"a":1,"b":"X"}'), (4, 0, None, '{"event_id":"Ab","a":1}'), (5, None, "ab", None),
        (6, 0, "  ", '{"event_id":"q"}'), (7, 0, "q", '{"event_id":"q"}'), (8, 0, None, "no json"), (9, 0, None, None), (7, 0, "q", '{"event_id":"q"}'), (10, 1, "r", "broken {"), (11, 2, "r", "broken {"),
    ]
    for hot in (1_000_000, 1):
        got = {r["delivery_id"]: (r["kept_id"], r["kind"]) for r in repeated_deliveries(deliveries(spark, data), "delivery_id", "received_at", "event_id", "payload", hot_rows=hot).collect()}
        assert got == {1: (4, "differs"), 2: (4, "differs"), 3: (4, "differs"), 5: (4, "differs"), 7: (6, "same"), 11: (10, "same")}
    assert repeated_deliveries(deliveries(spark, []), "delivery_id", "received_at", "event_id", "payload").count() == 0


def test_ledger_remembers_over_batches(spark, tmp_path):
    ledger = SeenLedger(spark, f"file://{tmp_path}/seen", 3)
    first = [(i, i, f"e{i % 7}", "{}") for i in range(20)]
    later = [(100 + i, -i, f"e{i}", "{}") for i in range(10)]
    assert repeated_deliveries(deliveries(spark, first), "delivery_id", "received_at", "event_id", "payload", ledger).count() == 13
    got = {r["delivery_id"]: r["kept_id"] for r in repeated_deliveries(deliveries(spark, later), "delivery_id", "received_at", "event_id", "payload", ledger).collect()}
    assert got == {100 + i: i for i in range(7)}
    codes = ledger.admitted().collect()
    assert len(codes) == 10 and len({(r["shard"], r["code"]) for r in codes}) == 10
    assert len(ledger.versions()) == 2


def messages(spark, data):
    return spark.createDataFrame([(k, t, i, bytes(p, "utf-8")) for k, t, i, p in data], "key string, received_us bigint, delivery_id bigint, digest binary")


def test_bits_decide_over_batches(spark, tmp_path):
    ledger = SeenLedger(spark, f"file://{tmp_path}/seen", 2)
    rng, seen = random.Random(8), {}
    for batch in range(11):  # goes past a compaction
        data = [(f"k{rng.randrange(60)}", rng.choice([None, *range(5)]), batch * 100 + i, rng.choice("xy")) for i in range(40)]
        came = ledger.admit(messages(spark, data + data[:3]))
        got = {(r["key"], r["delivery_id"], r["kept_id"], r["kind"]) for r in came.repeats.collect()}
        kept, want = set(), set()
        for k, t, i, p in sorted(data, key=lambda m: (m[1] is None, m[1] or 0, m[2])):
            if k not in seen:
                seen[k] = (i, p)
                kept.add((k, i))
            else:
                want.add((k, i, seen[k][0], "same" if seen[k][1] == p else "differs"))
        assert got == want and {(r["key"], r["delivery_id"]) for r in came.admitted.collect()} == kept
    assert {(r["key"], r["delivery_id"]) for r in ledger.admitted().collect()} == {(k, i) for k, (i, _) in seen.items()}
    assert any(c["kind"] == "base" for c in ledger.commits()) and len(ledger.versions()) < 11
    ledger.vacuum()
    assert ledger.admitted().count() == len(seen)


def test_of_two_writers_one_is_refused(spark, tmp_path, monkeypatch):
    one, two = (SeenLedger(spark, f"file://{tmp_path}/seen", 2) for _ in range(2))
    stale = two.commits()
    one.admit(messages(spark, [("a", 1, 1, "x"), ("b", 1, 2, "x")]))
    with monkeypatch.context() as m:
        m.setattr(two, "commits", lambda: stale)
        with pytest.raises(Conflict):
            two.admit(messages(spark, [("a", 2, 3, "x"), ("c", 2, 4, "x")]))
    assert {r["key"] for r in one.admitted().collect()} == {"a", "b"}
    came = two.admit(messages(spark, [("a", 2, 3, "x"), ("c", 2, 4, "x")]))
    assert [tuple(r) for r in came.repeats.collect()] == [("a", 3, 1, "same")] and [r["key"] for r in came.admitted.collect()] == ["c"]
    assert {r["key"] for r in one.admitted().collect()} == {"a", "b", "c"}


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    ledger = SeenLedger(spark, f"file://{tmp_path}/seen", 2)
    rows_of = lambda came: (sorted(map(tuple, came.admitted.select("key", "delivery_id").collect())), sorted(map(tuple, came.repeats.collect())))
    first = rows_of(ledger.admit(messages(spark, [("a", 1, 1, "x"), ("a", 2, 2, "y")]), "s:0"))
    assert rows_of(ledger.admit(messages(spark, [("a", 1, 1, "x"), ("a", 2, 2, "y")]), "s:0")) == first == ([("a", 1)], [("a", 2, 1, "differs")])
    assert len(ledger.versions()) == 1


def test_hot_identifiers_go_beside_their_shard(spark):
    data = [(i, i % 50, "hot" if i % 3 else f"e{i % 40}", f'{{"a":{i % 4}}}') for i in range(600)]
    run = lambda n: {tuple(r) for r in repeated_deliveries(deliveries(spark, data), "delivery_id", "received_at", "event_id", "payload", hot_rows=n).collect()}
    assert run(100) == run(10_000) and len(run(100)) == 600 - 1 - len({i % 40 for i in range(0, 600, 3)})


def test_bitmaps():
    bits = np.array([1, 0, 1, 1] * 9, dtype=bool)
    assert (unpack_bits(pack_bits(bits), 40)[:36] == bits).all() and not unpack_bits(None, 5).any()


def test_shards_are_bounded_and_ordered(spark):
    df = spark.createDataFrame([("hot", i % 300) for i in range(900)] + [("cold", 1)], "k string, t bigint")
    plan = plan_shards(df, ["k"], "t", 50, least_rows=20)
    assert plan.hot == 1
    counted = plan.assign(df).filter("k = 'hot'").groupBy("_shard").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).orderBy("_shard").collect()
    assert 10 <= len(counted) <= 19 and all(r["n"] >= 20 for r in counted)
    assert all(x["b"] < y["a"] for x, y in zip(counted, counted[1:]))
