"""Clock times, entry gates, exits and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = ("long call", "short call", "long put", "short put", "call spread", "put spread", "strangle", "straddle")


def local_time(ts: Column, zone: str = "America/New_York") -> Column:
    return F.from_utc_timestamp(ts, zone)


def calendar(spark, first: str, last: str, times: dict[str, str], closed: tuple[str, ...] = ()) -> DataFrame:
    """day, event, fire_ts: each clock time on each day but closed ones; both ends belong to it."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS day")
    if closed:
        days = days.where(~F.col("day").cast("string").isin(*closed))
    events = F.explode(F.array(*[F.struct(F.lit(name).alias("event"), F.lit(at).alias("at")) for name, at in times.items()]))
    return days.select("day", events.alias("e")).select("day", "e.event", F.to_timestamp_ntz(F.concat_ws(" ", F.col("day").cast("string"), F.col("e.at")), F.lit("yyyy-MM-dd HH:mm")).alias("fire_ts"))


def minutes_after(opening: Column, minutes: int) -> Column:
    return opening + F.expr(f"INTERVAL {minutes} MINUTES")


def in_window(ts: Column, first: str, last: str) -> Column:
    """Whether the clock time is between the two, to the minute, both included."""
    return F.date_format(ts, "HH:mm").between(first, last)


def calm_days(rows: DataFrame, day: str, value: str, most: float) -> DataFrame:
    """Days whose greatest value isn't above the bound."""
    return rows.groupBy(day).agg(F.max(value).alias("high")).where(F.col("high") <= most)


def volatile_days(rows: DataFrame, day: str, value: str, above: float) -> DataFrame:
    """Days with a value above the bound."""
    return rows.groupBy(day).agg(F.max(value).alias("high")).where(F.col("high") > above)


def one_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def gate(done: Column, invested: Column, can_trade: Column, cached: Column, contract: Column | None = None) -> Column:
    """What becomes of an entry: the first reason against it, or enter. contract, where it is told, is the one to trade."""
    out = F.when(done, "done").when(invested, "invested").when(~can_trade, "not allowed").when(F.coalesce(cached, F.lit(0)) == 0, "empty cache")
    return (out if contract is None else out.when(contract.isNull(), "no contract")).otherwise("enter")


def orders(held: Column, wanted: Column, limit: Column) -> Column:
    """kind, quantity of the order from a position to another: market, or limit where there is a limit price; null if none is needed."""
    quantity = wanted - held
    return F.when(quantity != 0, F.struct(F.when(limit.isNull(), "market").otherwise("limit").alias("kind"), quantity.alias("quantity")))


def first_exit(rows: DataFrame, keys: list[str], ts: str, conditions: dict[str, Column]) -> DataFrame:
    """keys, exit_ts, reason: the first moment at which any condition holds; of several at once the first named. Rows without one have nulls."""
    times = rows.groupBy(*keys).agg(*[F.min(F.when(c, F.col(ts))).alias(f"__{n}") for n, c in conditions.items()])
    names = list(conditions)
    least = F.least(*[F.col(f"__{n}") for n in names]) if len(names) > 1 else F.col(f"__{names[0]}")
    reason = F.lit(None).cast("string")
    for n in reversed(names):
        reason = F.when(F.col(f"__{n}") == least, n).otherwise(reason)
    return times.select(*keys, least.alias("exit_ts"), reason.alias("reason"))


def positions(fills: DataFrame, keys: list[str], quantity: Column) -> DataFrame:
    """Signed sum of fills."""
    return fills.groupBy(*keys).agg(F.sum(quantity).alias("quantity"))


def running_position(keys: list[str], order: list[str], quantity: Column) -> Column:
    return F.sum(quantity).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def closing_orders(held: DataFrame, tag: str = "End of day") -> DataFrame:
    """Orders that close every open position."""
    return held.where("quantity <> 0").withColumn("quantity", -F.col("quantity")).withColumn("tag", F.lit(tag))


def valid_spec(strategy: Column, conditions: Column, known: tuple[str, ...] = STRATEGIES, filters: Column | None = None, exit_time: Column | None = None, latest: str = "15:50") -> Column:
    """Whether a strategy is a known one with two conditions at most, and, where these are told, one filter at most and an exit (HH:mm) before the latest."""
    ok = strategy.isin(*known) & (F.coalesce(F.size(conditions), F.lit(0)) <= 2)
    if filters is not None:
        ok = ok & (F.coalesce(F.size(filters), F.lit(0)) <= 1)
    return ok if exit_time is None else ok & (exit_time < latest)


def strike_target(method: Column, price: Column, share: Column) -> Column:
    """Price at which a strike is looked for: the price itself, or a share of it away (a positive share above)."""
    return F.when(method == "ATM", price).when(method == "OTM", price * (1 + share))


def between_days(ts: Column, first: str, last: str) -> Column:
    """Whether ts is on one of the days from first to last, both included; a plain range, which scans and partitions can use."""
    return (ts >= F.lit(first).cast("timestamp_ntz")) & (ts < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz"))
