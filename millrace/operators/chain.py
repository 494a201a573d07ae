"""Option chains: filters of contracts in snapshots, nearest picks, cached snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_day(expiry: Column, ts: Column) -> Column:
    return F.to_date(expiry) == F.to_date(ts)


def out_of_the_money(right: Column, strike: Column, price: Column, share: float = 0.0) -> Column:
    """Strictly beyond the price, or beyond a share of it."""
    return ((right == "Put") & (strike < price * F.lit(1 - share))) | ((right == "Call") & (strike > price * F.lit(1 + share)))


def with_fallback(contracts: DataFrame, snapshot: list[str], delta: Column, fallback: Column) -> DataFrame:
    """The contracts with a delta of snapshots that have any; of the others those that pass the fallback."""
    some = F.max(delta.isNotNull()).over(Window.partitionBy(*snapshot))
    return contracts.withColumn("__some", some).where(F.when(F.col("__some"), delta.isNotNull()).otherwise(fallback)).drop("__some")


def strike_band(contracts: DataFrame, snapshot: list[str], strike: str, price: Column, most: int = 50) -> DataFrame:
    """Up to so many strikes on each side of the price (equal ones below), nearest first; a strike may have several contracts."""
    w = Window.partitionBy(*snapshot, "__above").orderBy(F.abs(F.col(strike) - price), strike)
    return contracts.withColumn("__above", F.col(strike) > price).withColumn("__n", F.dense_rank().over(w)).where(F.col("__n") <= most).drop("__above", "__n")


def nearest(rows: DataFrame, groups: list[str], value: str, target: Column, ties: list[str]) -> DataFrame:
    """The row of each group whose value is nearest to the target; ties go to the smaller value, then by the tie columns. Null values never win."""
    rest = [c for c in rows.columns if c not in groups]
    order = F.struct(F.abs(F.col(value) - target), F.col(value), *[F.col(c) for c in ties])
    return rows.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*groups, "r.*")


def class_counts(contracts: DataFrame, snapshot: list[str], right: Column, delta: Column) -> DataFrame:
    return contracts.groupBy(*snapshot).agg(F.count("*").alias("contracts"), F.count_if(right == "Put").alias("puts"), F.count_if(right == "Call").alias("calls"), F.count_if(delta.isNotNull()).alias("with_delta"))


def no_trade_cause(contracts: Column, with_delta: Column, matching: Column) -> Column:
    """Why a snapshot gave no trade."""
    return F.when(F.coalesce(contracts, F.lit(0)) == 0, "empty chain").when(with_delta == 0, "no deltas").when(matching == 0, "no match").otherwise("tradable")


def last_non_empty(day: list[str], ts: list[str], snapshot: Column) -> Column:
    """The last snapshot of the day so far that holds anything."""
    return F.last(snapshot, ignorenulls=True).over(Window.partitionBy(*day).orderBy(*ts).rowsBetween(Window.unboundedPreceding, 0))


def as_of(fires: DataFrame, snapshots: DataFrame, keys: list[str], fire_ts: str, ts: str, ties: list[str]) -> DataFrame:
    """fires with the last row of snapshots of the same keys that isn't later; fires without one, and those with a null key or time, have nulls.

    Both go by time in one pass for each key, a day being one of the keys, which bounds a key's rows: a shuffle and a sort, no pairs.
    """
    rest = [c for c in snapshots.columns if c not in keys]
    fire, snap = F.struct(*fires.columns), F.struct(*rest)
    tie = F.struct(*[F.col(c) for c in ties])
    usable = snapshots.where(F.col(ts).isNotNull()).dropna(subset=keys)
    right = usable.select(*keys, F.col(ts).alias("__t"), F.lit(0).alias("__fire"), tie.alias("__tie"), snap.alias("__s"))
    kinds = dict((f.name, f.dataType) for f in right.schema)
    left = fires.select(*keys, F.col(fire_ts).alias("__t"), F.lit(1).alias("__fire"), F.lit(None).cast(kinds["__tie"]).alias("__tie"), F.lit(None).cast(kinds["__s"]).alias("__s"), fire.alias("__f"))
    w = Window.partitionBy(*keys).orderBy("__t", "__fire", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("__s", F.last("__s", ignorenulls=True).over(w))
    return both.where("__fire = 1").select("__f.*", *[F.col(f"__s.{c}").alias(c) for c in rest])


def expires_within(expiry: Column, ts: Column, first: int = 0, last: int = 0) -> Column:
    """Whether a contract expires so many days after ts, both ends included."""
    return F.datediff(expiry, ts).between(first, last)


def pick(contracts: DataFrame, groups: list[str], method: Column, strike: str, price: Column, share: Column, delta: Column, target: Column, ties: list[str]) -> DataFrame:
    """Of each group the contract that a strike method asks for: at the price (ATM), a share beyond it (OTM), or (delta) of the nearest absolute delta.

    A group of the delta method in which no contract has a delta goes by the share. Ties go to the lower strike, then by the tie columns.
    """
    rest = [c for c in contracts.columns if c not in groups]
    by_delta = F.when(method == "delta", F.abs(F.abs(delta) - target))
    by_strike = F.abs(F.col(strike) - F.when(method == "ATM", price).otherwise(price * (1 + share)))
    order = F.struct(by_delta.isNull(), F.coalesce(by_delta, by_strike), F.col(strike), *[F.col(c) for c in ties])
    return contracts.where(F.col(strike).isNotNull()).groupBy(*groups).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*groups, "r.*")
