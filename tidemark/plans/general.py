"""The queries of problems 1, 2, 3, 5, 6 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.asof import as_known_at
from tidemark.operators.clocks import to_instants
from tidemark.operators.deliveries import repeated_deliveries
from tidemark.operators.history import FOREVER, bitemporal_ledger, current_history
from tidemark.operators.intervals import continuous_periods
from tidemark.operators.spikes import flag_readings
from tidemark.tables import load, micros


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuous_periods(load(spark, sf_dir, "borrow_grants"), "security_id", "valid_from", "valid_through").withColumnRenamed("key", "security_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, formations = load(spark, sf_dir, "facts"), load(spark, sf_dir, "formations")
    facts = facts.withColumn("known_us", micros(facts, "available_at"))
    rank = [F.col("period_end"), F.col("known_us"), F.col("revision")]
    known = as_known_at(formations, facts, ["security_id", "concept"], micros(formations, "formation_at"), F.col("known_us"), rank, "source_id")
    return known.select("event.formation_id", F.col("known.pick").alias("source_id")).distinct()


def _history(spark: SparkSession, sf_dir: str):
    symbol = F.upper(F.regexp_replace("symbol", r"^\s+|\s+$", ""))
    values = {"symbol": symbol, "exchange": F.col("exchange")}
    return bitemporal_ledger(load(spark, sf_dir, "security_history"), "security_id", values, "effective_from", "effective_to", "available_at", "source_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, plan = _history(spark, sf_dir)
    rows = current_history(ledger, plan, ["symbol", "exchange"])
    return rows.select(F.col("key").alias("security_id"), "symbol", "exchange", F.col("valid_from").alias("from_us"), F.when(F.col("valid_to") == FOREVER, -1).otherwise(F.col("valid_to")).alias("to_us"))


def p3_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, _ = _history(spark, sf_dir)
    return ledger.drop("_shard").withColumnRenamed("key", "security_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions, feed = load(spark, sf_dir, "sessions"), load(spark, sf_dir, "source_feed")
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("opens_at", "closes_at")]))
    written = sessions.select(F.lit("sessions").alias("tab"), F.col("session_no").alias("row_no"), "clock", fields.alias("x")).select("tab", "row_no", "clock", "x.field", "x.text")
    written = written.unionByName(feed.select(F.lit("source_feed").alias("tab"), F.col("feed_row").alias("row_no"), "clock", F.lit("available_at").alias("field"), F.col("available_at").alias("text")))
    found = to_instants(written, load(spark, sf_dir, "clock_zones")).filter("instant_us is not null")
    return found.select("tab", "row_no", "field", "instant_us").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_readings(load(spark, sf_dir, "quotes"), "security_id", "observed_at", "source_id", "price_usd").select(F.col("reading_id").alias("source_id"), "kind")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_deliveries(load(spark, sf_dir, "quote_events"), "delivery_id", "received_at", "event_id", "payload").select("delivery_id", "kind")


SQL = {
    "p1_found": """
        with g as (select security_id, epoch_us(valid_from) a, epoch_us(valid_through) b from borrow_grants
                   where security_id is not null and valid_from < valid_through),
        m as (select *, max(b) over (partition by security_id order by a, b rows between unbounded preceding and 1 preceding) reach from g),
        s as (select *, sum(case when reach >= a then 0 else 1 end) over (partition by security_id order by a, b rows unbounded preceding) seq from m),
        p as (select security_id, seq, min(a) a, max(b) b from s group by all)
        select security_id, 'period' kind, a from_us, b through_us from p
        union all
        select * from (select security_id, 'gap' kind, b from_us, lead(a) over (partition by security_id order by a) through_us from p) where through_us is not null""",
    "p2_found": """
        select distinct formation_id, source_id from (
          select m.formation_id, m.formation_at, f.source_id,
                 row_number() over (partition by m.formation_id, m.formation_at, m.security_id, m.concept
                   order by f.period_end desc nulls last, f.available_at desc, f.revision desc nulls last, f.source_id) rn
          from formations m join facts f on m.security_id = f.security_id and m.concept = f.concept and f.available_at <= m.formation_at)
        where rn = 1""",
    "p3_found": """
        with r as (select security_id, upper(trim(symbol, chr(32) || chr(9) || chr(10) || chr(13))) symbol, exchange, epoch_us(effective_from) a,
                          coalesce(epoch_us(effective_to), 9223372036854775807) b, available_at, source_id
                   from security_history
                   where security_id is not null and symbol is not null and effective_from is not null and (effective_to is null or effective_to > effective_from)),
        one as (select * from r qualify row_number() over (partition by security_id, a order by available_at desc nulls last, source_id desc nulls last) = 1),
        cut as (select *, least(b, coalesce(lead(a) over (partition by security_id order by a), b)) till from one),
        mark as (select *, case when lag(till) over w = a and lag(symbol) over w = symbol and lag(exchange) over w is not distinct from exchange then 0 else 1 end fresh
                 from cut window w as (partition by security_id order by a)),
        run as (select *, sum(fresh) over (partition by security_id order by a rows unbounded preceding) n from mark)
        select security_id, any_value(symbol) symbol, any_value(exchange) exchange, min(a) from_us,
               case when max(till) = 9223372036854775807 then -1 else max(till) end to_us from run group by security_id, n""",
    # no sweep: each row's neighbours are looked for among all rows of its key
    "p3_ledger": """
        with r as (select distinct security_id k, upper(trim(symbol, chr(32) || chr(9) || chr(10) || chr(13))) symbol, exchange, source_id s, epoch_us(effective_from) a,
                          coalesce(epoch_us(effective_to), 9223372036854775807) b, epoch_us(available_at) r from security_history),
        v as (select *, coalesce(k is null or symbol is null or a is null or b <= a, false) void from r),
        g as (select *, row_number() over (partition by k order by r nulls first, s nulls first, symbol, exchange nulls first, b, a) o from v where not void),
        p as (select j.k, j.o, arg_max(i.o, (i.a, i.o)) po from g j join g i on i.k = j.k and i.o < j.o and i.a <= j.a group by 1, 2),
        c as (select j.k, j.o, min(i.a) ct from g j join g i on i.k = j.k and i.o < j.o and i.a > j.a group by 1, 2),
        n as (select k, a, max(o) o, lead(a) over (partition by k order by a) na from g group by 1, 2),
        l as (select g.k, symbol, exchange, s, g.a, least(b, coalesce(na, b)) b, r, null till, 'current' status from g join n on n.k = g.k and n.o = g.o
              union all select j.k, i.symbol, i.exchange, i.s, j.a, least(i.b, coalesce(ct, i.b)), i.r, coalesce(j.r, -9223372036854775808),
                case when i.r is not distinct from j.r then 'preempted' when i.a = j.a then 'superseded' else 'split' end
                from g j join p on p.k = j.k and p.o = j.o join g i on i.k = p.k and i.o = p.po left join c on c.k = j.k and c.o = j.o where i.b > j.a
              union all select k, symbol, exchange, s, a, nullif(b, 9223372036854775807), r, null, 'void' from v where void)
        select k security_id, symbol, exchange, s source, a valid_from, b valid_to, r recorded_from, till recorded_to, status from l""",
    "p6_found": """
        with q as (select distinct security_id s, observed_at t, source_id id, try_cast(trim(price_usd, chr(32) || chr(9) || chr(10) || chr(13)) as double) x from quotes),
        n as (select * from q where s is not null and t is not null and x is not null and isfinite(x)),
        g as (select *, ln(x) l, lag(x) over w p, lag(ln(x)) over w m1, lag(ln(x), 2) over w m2, lag(ln(x), 3) over w m3,
                     lead(ln(x)) over w p1, lead(ln(x), 2) over w p2, lead(ln(x), 3) over w p3
              from n where x > 0 window w as (partition by s order by t, id)),
        r as (select *, sum(case when p = x then 0 else 1 end) over (partition by s order by t, id rows unbounded preceding) run from g),
        c as (select *, count(*) over (partition by s, run) len from r),
        z as (select s, median(abs(l - m1)) scale from g where p <> x group by s),
        d as (select c.id, 14 * scale k, l, m1, m2, m3, p1, p2, p3 from c join z using (s)),
        f as (select id from d where
             (m1 is not null and p1 is not null and (l - greatest(m1, p1) > k or least(m1, p1) - l > k))
          or (m1 is not null and p2 is not null and (least(l, p1) - greatest(m1, p2) > k or least(m1, p2) - greatest(l, p1) > k))
          or (m2 is not null and p1 is not null and (least(m1, l) - greatest(m2, p1) > k or least(m2, p1) - greatest(m1, l) > k))
          or (m1 is not null and p3 is not null and (least(l, p1, p2) - greatest(m1, p3) > k or least(m1, p3) - greatest(l, p1, p2) > k))
          or (m2 is not null and p2 is not null and (least(m1, l, p1) - greatest(m2, p2) > k or least(m2, p2) - greatest(m1, l, p1) > k))
          or (m3 is not null and p1 is not null and (least(m2, m1, l) - greatest(m3, p1) > k or least(m3, p1) - greatest(m2, m1, l) > k)))
        select id source_id, 'impossible' kind from n where x <= 0
        union all select id, 'stuck' from c where len >= 10 and p = x
        union all select id, 'spike' from f""",
    "p7_found": """
        with d as (select delivery_id, received_at, payload,
                     coalesce(nullif(lower(trim(event_id, chr(32) || chr(9) || chr(10) || chr(13))), ''), lower(trim(payload ->> '$.event_id'))) k,
                     [payload ->> ('$.quote.' || f) for f in ['adjustment', 'available_at', 'currency', 'observed_at', 'phase', 'price_usd', 'security_id', 'source_id']]
                     || [payload ->> ('$.' || f) for f in ['event_id', 'schema_version', 'source_sha256']] body from quote_events),
        n as (select *, row_number() over w rn, first_value(body) over w kept from d where k is not null window w as (partition by k order by received_at nulls last, delivery_id))
        select delivery_id, case when body = kept then 'same' else 'differs' end kind from n where rn > 1""",
}

QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_ledger": p3_ledger, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found}
