"""Recorded tool responses and tool catalogs. Live connections are out of scope: calls are recorded elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx

#: Texts are kept as they are, other values as JSON.
FIELDS = {"run": "string", "seq": "bigint", "tool": "string", "arguments": "string", "response": "string"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """run, seq, tool, arguments, response of the objects, one a line, in a folder's jsonl files, wherever Spark can read it. Other lines are passed over."""
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(path).where(jsonx.kind(F.col("value")) == "object")
    return lines.select(jsonx.parsed(F.col("value")).alias("v")).select(*[F.try_variant_get("v", f"$.{name}", kind).alias(name) for name, kind in FIELDS.items()])


def flattened(rows: DataFrame, failed: str = "response is null") -> DataFrame:
    """rows with ok and text: a null response is a failed call, an empty one an empty text."""
    return rows.withColumn("ok", F.col("response").isNotNull()).withColumn("text", F.coalesce("response", F.lit(failed)))


def tool_catalog(spark: SparkSession, path: str) -> DataFrame:
    """ord, name, description, input_schema of a JSON file of tools; missing texts are empty, missing schemas {}; of equal names the last counts.

    Entries go by their own ord; where they have none, by file name and place in the file.
    """
    rows = spark.read.schema("ord bigint, name string, description string, input_schema string").json(path)
    rows = rows.select("*", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    last = rows.groupBy("name").agg(F.max_by(F.struct(F.coalesce("ord", "line").alias("ord"), "description", "input_schema"), F.struct("ord", "file_path", "file_block_start", "line")).alias("r"))
    return last.select("r.ord", "name", F.coalesce("r.description", F.lit("")).alias("description"), F.coalesce("r.input_schema", F.lit("{}")).alias("input_schema"))
