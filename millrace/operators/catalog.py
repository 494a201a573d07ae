"""Tool catalogs: allow-lists, cards, unknown names, last entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def allow_list(spark, names: list[str]) -> DataFrame:
    """ord, name."""
    rows = ", ".join(f"({i}, '{n.replace(chr(39), chr(39) * 2)}')" for i, n in enumerate(names))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(ord, name)")


def allowed(listed: DataFrame, catalog: DataFrame) -> DataFrame:
    """The listed names that the catalog has; repeats in the list stay, and ord tells its order."""
    return listed.join(catalog.select("name"), "name", "left_semi").select("ord", "name")


def cards(listed: DataFrame, catalog: DataFrame) -> DataFrame:
    """ord, name, description, input_schema of listed names, nulls as an empty text and an empty object."""
    c = catalog.select("name", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("input_schema", F.lit("{}")).alias("input_schema"))
    return listed.join(c, "name").select("ord", "name", "description", "input_schema")


def refused(calls: DataFrame, listed: DataFrame) -> DataFrame:
    """calls whose name isn't listed, with the names that are, in order."""
    names = listed.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ", ").alias("available"))
    return calls.join(listed.select("name"), "name", "left_anti").crossJoin(F.broadcast(names))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns; partial aggregation, no window."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")
