"""What a decision, a selection or a schedule must satisfy: each check is a table of what violates it.

`require_none` turns any of these tables into a refusal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.pit import FACT_KEY


class Refused(ValueError):
    pass


def require_none(violations: DataFrame, code: str) -> None:
    """Raises Refused if there is any violation."""
    if not violations.isEmpty():
        raise Refused(code)


def flagged(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row with `reason` for each check that holds of a row; a check that is null does not."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return rows.withColumn("reason", F.explode(found))


def decision_times(decisions: DataFrame) -> DataFrame:
    """Decisions (.., formation_at, trade_at) without both clocks, or not formed strictly before they are traded."""
    unknown = F.col("formation_at").isNull() | F.col("trade_at").isNull()
    return flagged(decisions, {"clock_missing": unknown, "not_before_trade": F.col("formation_at") >= F.col("trade_at")})


def economic_cutoff(formation: Column, lag_months: int) -> Column:
    """The day so many civil months before the formation's, or the last of that month where it has no such day."""
    return F.add_months(formation.cast("date"), -lag_months)


def content_conflicts(facts: DataFrame, at: Column) -> DataFrame:
    """Over all facts known by then, superseded ones too: `content` where one (key, source, revision) differs in any column, and
    `value` where one (key, available_at, revision) has several values, compared as exact decimals."""
    known = facts.filter(F.col("available_at") <= at)
    rest = [c for c in facts.columns if c not in (*FACT_KEY, "source_id", "revision")]
    number = F.coalesce(F.expr("try_cast(value as decimal(38, 12))").cast("string"), F.concat(F.lit("text:"), F.col("value")))
    kinds = (("content", "source_id", F.count_distinct(F.struct(*rest))), ("value", "available_at", F.count_distinct(number)))
    parts = [known.groupBy(*FACT_KEY, by, "revision").agg(n.alias("n")).filter("n > 1").select(F.lit(kind).alias("kind"), *FACT_KEY, "revision", "n") for kind, by, n in kinds]
    return parts[0].unionByName(parts[1])


def membership_violations(membership: DataFrame) -> DataFrame:
    """(reason, security_id, n): `event` where one (security, event) differs in any column, `included` where one (security,
    effective_at, available_at) is told both ways."""
    rest = [c for c in membership.columns if c not in ("security_id", "event_id")]
    event = membership.groupBy("security_id", "event_id").agg(F.count_distinct(F.struct(*rest)).alias("n")).filter("n > 1")
    both = membership.groupBy("security_id", "effective_at", "available_at").agg(F.count_distinct("included").alias("n")).filter("n > 1")
    return event.select(F.lit("event").alias("reason"), "security_id", "n").unionByName(both.select(F.lit("included").alias("reason"), "security_id", "n"))


def usable_signals(values: DataFrame, bindings: dict[str, int]) -> DataFrame:
    """(security_id, usable, incomplete): a signal is usable only if every binding has its whole history. values has (security_id,
    concept, month, value) with one row for each requested month; bindings tells how many months each concept needs."""
    wanted = F.coalesce(*[F.when(F.col("concept") == c, F.lit(n)) for c, n in bindings.items()])
    by = values.filter(F.col("concept").isin(*bindings)).groupBy("security_id", "concept").agg(F.count("value").alias("n")).withColumn("whole", F.col("n") >= wanted)
    out = by.groupBy("security_id").agg(F.count(F.when(F.col("whole"), 1)).alias("w"))
    return out.select("security_id", (F.col("w") == len(bindings)).alias("usable"), (F.lit(len(bindings)) - F.col("w")).alias("incomplete"))


def value_violations(values: DataFrame, returns: list[str], capitalizations: list[str]) -> DataFrame:
    """values (concept, value, ..) that cannot be: a simple return below -1, a capitalization not above zero, no number."""
    x = F.expr("try_cast(value as decimal(38, 12))")
    checks = {"return_below_minus_one": F.col("concept").isin(*returns) & (x < -1), "capitalization_not_positive": F.col("concept").isin(*capitalizations) & (x <= 0)}
    return flagged(values, checks | {"no_number": F.col("value").isNotNull() & F.col("concept").isin(*returns, *capitalizations) & x.isNull()})


def required_marks(requests: DataFrame, quotes: DataFrame) -> DataFrame:
    """requests (request_id, security_id, at, phase, required) with the price quoted at exactly that instant in that phase and
    known by then, and status: marked, unmarked, or refused where it was required and is not there."""
    known = quotes.filter(F.col("available_at") <= F.col("observed_at")).groupBy("security_id", F.col("observed_at").alias("at"), "phase").agg(F.min(F.struct("source_id", "price_usd")).alias("q"))
    out = requests.join(known, ["security_id", "at", "phase"], "left")
    status = F.when(F.col("q.price_usd").isNotNull(), "marked").when(F.col("required"), "refused").otherwise("unmarked")
    return out.select("request_id", "security_id", "at", "phase", "q.source_id", "q.price_usd", status.alias("status"))


def covering_loans(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """requests (request_id, security_id, t, quantity below zero) with status by how many grants (source_id, security_id, known_us,
    from_us, through_us, amount) hold t, were known by then and cover the whole short position: missing, covered or ambiguous.

    Grants are cut at the instants at which one begins or ends to stretches within which what is active does not change, so
    requests meet one stretch each and not every grant of their security."""
    live = grants.withColumn("from_us", F.greatest("from_us", "known_us")).filter("from_us <= through_us").dropDuplicates(["source_id", "security_id", "from_us", "through_us", "amount"])
    points = live.select("security_id", F.explode(F.array(F.col("from_us"), F.col("through_us") + 1)).alias("b")).distinct()
    w = Window.partitionBy("security_id").orderBy("b")
    stretches = points.withColumn("e", F.lead("b").over(w)).filter("e is not null")
    active = stretches.join(live, "security_id").filter("from_us <= b and through_us >= e - 1").groupBy("security_id", "b").agg(F.sort_array(F.collect_list("amount"), asc=False).alias("amounts"))
    line = points.join(active, ["security_id", "b"], "left").select("security_id", F.col("b").alias("t"), F.lit(0).alias("turn"), F.coalesce("amounts", F.array().cast("array<bigint>")).alias("amounts"))
    asks = requests.select("security_id", "t", F.lit(1).alias("turn"), "request_id", "quantity")
    along = Window.partitionBy("security_id").orderBy("t", "turn").rowsBetween(Window.unboundedPreceding, 0)
    met = line.unionByName(asks, allowMissingColumns=True).withColumn("now", F.last("amounts", ignorenulls=True).over(along)).filter("turn = 1")
    n = F.coalesce(F.size(F.filter("now", lambda a: a >= -F.col("quantity"))), F.lit(0))
    n = F.when(F.col("now").isNull(), 0).otherwise(n)
    return met.select("request_id", "security_id", n.alias("n"), F.when(n == 1, "covered").when(n == 0, "missing").otherwise("ambiguous").alias("status"))


def required_start(bindings: DataFrame, first_formation: Column) -> DataFrame:
    """(dataset, starts_on): the earliest day each dataset must cover for bindings (dataset, lag_months, history_months)."""
    months = F.col("lag_months") + F.col("history_months") - 1
    return bindings.groupBy("dataset").agg(F.min(F.trunc(F.add_months(first_formation.cast("date"), -months), "month")).alias("starts_on"))


def coverage_gaps(required: DataFrame, coverage: DataFrame) -> DataFrame:
    """Datasets of required (dataset, starts_on) that coverage (dataset, first_day) does not reach back to: (dataset, days)."""
    both = required.join(coverage, "dataset", "left")
    return both.filter(F.col("first_day").isNull() | (F.col("first_day") > F.col("starts_on"))).select("dataset", F.date_diff("first_day", "starts_on").alias("days"))


def session_violations(sessions: DataFrame) -> DataFrame:
    """(calendar_id, session_date, reason) of sessions (calendar_id, session_date, opens_us, closes_us): not opened before closed,
    other days (by UTC) of opening and closing, several sessions a day, and one that opens before the last has closed."""
    day = lambda c: F.floor(F.col(c) / 86_400_000_000)
    w = Window.partitionBy("calendar_id").orderBy("session_date", "opens_us")
    rows = sessions.distinct().withColumn("n", F.count("*").over(Window.partitionBy("calendar_id", "session_date"))).withColumn("last_close", F.lag("closes_us").over(w))
    checks = {"not_open_before_close": F.col("opens_us") >= F.col("closes_us"), "other_day": day("opens_us") != day("closes_us"), "repeated_day": F.col("n") > 1, "overlaps_last": F.col("opens_us") < F.col("last_close")}
    return flagged(rows, checks).select("calendar_id", "session_date", "reason").distinct()


def known_calendars(formations: DataFrame, calendars: DataFrame) -> DataFrame:
    """Formations (calendar_id, formed_us) of a calendar (calendar_id, known_us) that was not known when they were formed."""
    first = calendars.groupBy("calendar_id").agg(F.min("known_us").alias("known_us"))
    out = formations.join(first, "calendar_id", "left")
    return out.filter(F.col("known_us").isNull() | (F.col("known_us") > F.col("formed_us"))).select("calendar_id", "formed_us", "known_us")


def execution_schedule(plan: DataFrame, sessions: DataFrame, start: Column, end: Column) -> DataFrame:
    """plan (calendar_id, formation_date, trade_date) of formations from start to end with action: trade, skipped where the
    calendar's last session up to end comes before the trade, and the sample's first and last session."""
    inside = sessions.filter(F.col("session_date").between(start, end)).groupBy("calendar_id").agg(F.min("session_date").alias("first_session"), F.max("session_date").alias("last_session"))
    rows = plan.filter(F.col("formation_date").between(start, end)).join(inside, "calendar_id")
    begins = F.min("formation_date").over(Window.partitionBy("calendar_id"))
    action = F.when(F.col("trade_date").isNull() | (F.col("trade_date") > F.col("last_session")), "skipped").otherwise("trade")
    return rows.withColumn("action", action).withColumn("sample_begins", begins == F.col("first_session"))


def partition_violations(weighted: DataFrame, k: int, within: float = 1e-9) -> DataFrame:
    """(formation, reason) of weighted (formation, security_id, bucket, weight): a name twice, bucket sizes that differ by more than
    one or grow upwards, and sleeves that do not add up to one and minus one."""
    names = weighted.groupBy("formation", "security_id").count().groupBy("formation").agg(F.max("count").alias("most"))
    sizes = weighted.groupBy("formation", "bucket").agg(F.count("*").alias("n")).groupBy("formation").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"))
    sums = weighted.groupBy("formation").agg(F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)).alias("long"), F.sum(F.when(F.col("weight") < 0, F.col("weight")).otherwise(0.0)).alias("short"))
    n = F.transform("b", lambda x: x["n"])
    fair = (F.size("b") == k) & (F.array_max(n) - F.array_min(n) <= 1) & (n == F.sort_array(n, asc=False))
    rows = names.join(sizes, "formation").join(sums, "formation")
    return flagged(rows, {"name_twice": F.col("most") > 1, "bucket_sizes": ~fair, "long_total": F.abs(F.col("long") - 1) > within, "short_total": F.abs(F.col("short") + 1) > within}).select("formation", "reason")


def portfolio_targets(weighted: DataFrame, spec_sha256: str) -> DataFrame:
    """weighted (formation, security_id, weight) with portfolio_id, the digest of the specification, the formation and all names
    with their weights in order: equal targets have equal identities, and nothing else has."""
    entry = F.concat_ws("=", "security_id", F.format_string("%.12f", "weight"))
    ids = weighted.groupBy("formation").agg(F.sha2(F.concat_ws("|", F.lit(spec_sha256), F.col("formation").cast("string"), F.array_join(F.sort_array(F.collect_list(entry)), ",")), 256).alias("portfolio_id"))
    return weighted.join(ids, "formation")


def component_disagreements(components: DataFrame) -> DataFrame:
    """(environment or binding, n): what the components (part, environment, binding, definition) of a hybrid must share and do not,
    one environment, and one definition for each binding."""
    world = components.agg(F.count_distinct("environment").alias("n")).filter("n > 1").select(F.lit("environment").alias("what"), "n")
    named = components.groupBy("binding").agg(F.count_distinct("definition").alias("n")).filter("n > 1").select(F.concat(F.lit("binding:"), "binding").alias("what"), "n")
    return world.unionByName(named)


def solvency(path: DataFrame) -> DataFrame:
    """(series, at, reason) of values (series, at, nav): unknown_nav, and nonpositive_nav before the series' last value."""
    last = F.max("at").over(Window.partitionBy("series"))
    return flagged(path.withColumn("_last", last), {"unknown_nav": F.col("nav").isNull(), "nonpositive_nav": (F.col("nav") <= 0) & (F.col("at") < F.col("_last"))}).select("series", "at", "reason")


def rebalance(rows: DataFrame, cost: float) -> DataFrame:
    """(batch, nav, turnover, fees, long, short, status) of whole-share targets: rows (batch, security_id, weight, old_shares, price)
    and nav_before, of which each name's target is sized at the post-fee root, cut toward zero, and paid for as traded.

    What is held and not targeted is sold. status is refused_sleeve where rounding leaves no long or no short side,
    refused_exposure where a side is larger than what is left, else sized; nothing is searched to repair it."""
    amount = lambda c: F.col(c) * F.col("price")
    target = F.when(F.col("price") > 0, F.coalesce("weight", F.lit(0.0)) * F.col("root") / F.col("price"))
    shares = F.when(target >= 0, F.floor(target)).otherwise(F.ceil(target)).cast("bigint")
    sized = rows.withColumn("shares", shares).withColumn("trade", F.col("shares") - F.coalesce("old_shares", F.lit(0)))
    by = sized.groupBy("batch").agg(
        F.max("nav_before").alias("before"), F.sum(F.abs(amount("trade"))).alias("turnover"), F.sum(F.when(F.col("shares") > 0, amount("shares")).otherwise(0.0)).alias("long"),
        (-F.sum(F.when(F.col("shares") < 0, amount("shares")).otherwise(0.0))).alias("short"),
    )
    nav = F.col("before") - F.col("turnover") * cost
    status = F.when((nav <= 0) | (F.greatest("long", "short") > nav), "refused_exposure").when((F.col("long") == 0) | (F.col("short") == 0), "refused_sleeve").otherwise("sized")
    return by.select("batch", nav.alias("nav"), "turnover", (F.col("turnover") * cost).alias("fees"), "long", "short", status.alias("status"))


def trades(targets: DataFrame, held: DataFrame, roots: DataFrame) -> DataFrame:
    """(batch, security_id, target, trade) of targets (batch, security_id, weight) at roots (batch, root) against what is held (batch,
    security_id, old): what is held and no target is sold whole."""
    both = targets.join(held, ["batch", "security_id"], "full").join(roots, "batch")
    target = F.coalesce("weight", F.lit(0.0)) * F.col("root")
    return both.select("batch", "security_id", target.alias("target"), (target - F.coalesce("old", F.lit(0.0))).alias("trade"))
