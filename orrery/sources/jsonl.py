"""JSON and JSON-lines evidence, with loud errors for what isn't as declared."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ReplayError


def read_object(path: str | Path) -> dict:
    try:
        value = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise ReplayError(f"{path} can't be read as JSON") from e
    if not isinstance(value, dict):
        raise ReplayError(f"{path} holds no JSON object")
    return value


def write_report(report: dict, path: str | Path | None = None) -> str:
    """The report as stable JSON, also written where a path is given."""
    text = json.dumps(report, indent=2, sort_keys=True) + "\n"
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8", newline="\n")
    return text


def read_lines(spark: SparkSession, path: str, schema: T.StructType, exact: bool = False) -> DataFrame:
    """Rows of JSON lines, blank ones skipped. Every other line must be an object of these types, and with ``exact`` it
    must have these keys and no others: Spark's JSON source alone would let both pass."""
    lines = spark.read.text(path).filter(F.length(F.trim(F.translate("value", "\r\t\f\v", "    "))) > 0)
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("row"), F.json_object_keys("value").alias("keys"))
    bad = F.col("keys").isNull() | F.col("row").isNull()
    for f in schema.fields:  # a value that doesn't fit its type is read as null
        bad |= F.array_contains("keys", f.name) & F.col("row").getField(f.name).isNull() & F.get_json_object("value", f"$.{f.name}").isNotNull()
    if exact:
        bad |= F.coalesce(F.array_sort("keys") != F.array(*[F.lit(n) for n in sorted(schema.names)]), F.lit(True))
    worst = parsed.filter(bad).select("value").limit(1).collect()
    if worst:
        raise ReplayError(f"{path} has a line that isn't as declared: {worst[0]['value'][:200]}")
    return parsed.select("row.*")
