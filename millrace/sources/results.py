"""Results of runs: the record's defaults, its JSON form, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Field, type, default; none is null.
FIELDS = (
    ("project_name", "string", ""),
    ("project_id", "string", ""),
    ("compile_ok", "boolean", False),
    ("compile_id", "string", ""),
    ("compile_errors", "array<string>", None),
    ("backtest_ok", "boolean", False),
    ("backtest_id", "string", ""),
    ("trades", "int", 0),
    ("notes", "string", ""),
)


def with_defaults(rows: DataFrame) -> DataFrame:
    """rows with all fields, missing and null ones at their defaults."""
    for name, kind, default in FIELDS:
        value = F.array().cast(kind) if kind.startswith("array") else F.lit(default).cast(kind)
        rows = rows.withColumn(name, F.coalesce(F.col(name).cast(kind), value) if name in rows.columns else value)
    return rows


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.title() for x in rest)


def to_wire() -> Column:
    """The JSON text of a row of with_defaults(), in camel case, nulls included."""
    return F.to_json(F.struct(*[F.col(name).alias(camel(name)) for name, _, _ in FIELDS]), {"ignoreNullFields": "false"})


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A line of JSON for each record."""
    r = with_defaults(rows)
    r.select(to_wire().alias("value")).write.mode(mode).text(path)
