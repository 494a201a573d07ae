"""Sizes, bands, fees and profits."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Moneyness (share of the price) up to which a band's delta range holds; the cut-offs lie between the three known points and are parameters.
DELTA_BANDS = ((0.02, "at the money"), (0.04, "0.25-0.30"), (0.06, "0.15-0.20"), (0.08, "0.10-0.15"))


def third(quantity: Column) -> Column:
    """A third of a position, one at least."""
    return F.greatest(F.lit(1), F.floor(quantity / 3))


def risk_capped(equity: Column, risk_per_contract: Column, share: float = 0.02) -> Column:
    """Contracts whose risk stays within a share of equity; null where a contract's risk is 0 or null."""
    return F.floor(F.try_divide(equity * F.lit(share), risk_per_contract))


def delta_band(distance: Column, bands: tuple[tuple[float, str], ...] = DELTA_BANDS) -> Column:
    """Delta range by distance from the money; null for a null distance."""
    out = F.when(distance.isNull(), None)
    for most, label in bands:
        out = out.when(distance <= most, label)
    return out.otherwise("below 0.10")


def fee(kind: Column, quantity: Column, rate: float = 0.65, per_contract: bool = False, charged: str = "IndexOption") -> Column:
    """The flat fee of an order, or of each of its contracts, for one security type; 0 for the others."""
    return F.when(kind == charged, F.lit(rate) * (F.abs(quantity) if per_contract else F.lit(1))).otherwise(F.lit(0.0))


def profit_percent(price: Column, average: Column, quantity: Column) -> Column:
    """Unrealised profit of a position in relation to its average price."""
    return F.try_divide(price - average, average) * F.signum(quantity)


def running_equity(keys: list[str], order: list[str], flow: Column, cash: float = 100_000.0) -> Column:
    """Cash at the start and all flows so far."""
    return F.lit(cash) + F.sum(flow).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def margin_allows(margin: Column, equity: Column, least: float = 0.0) -> Column:
    """Whether an order's margin is at least a share of the equity (0: every order will do), and no more than it."""
    return F.coalesce((margin >= equity * F.lit(least)) & (margin <= equity), F.lit(False))
