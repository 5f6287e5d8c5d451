"""Embedding caches: the contract report of the first layout, verified matrices from the second, and asset inventories."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ReplayError
from ..functions import integrity
from ..functions import vectors as V
from . import arrays, sqlite

# Fixed names of the stored layouts.
CONTRACT_COLUMNS = ("contract_sha256", "schema_version", "provider", "model", "base_url", "truncate", "normalization", "stored_dtype")
CACHE_TABLE = "embeddings_v2"
CACHE_KEYS = ("stable_key", "source_sha256", "extraction_fingerprint_sha256")
DEFAULT_CACHE = ".writer/benchmarks/embedding-cache.sqlite3"


def contract_report(contracts: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Each contract with its number of embeddings and their least and largest dimension (0 and null without any)."""
    counted = embeddings.groupBy("contract_sha256").agg(F.count("text_sha256").alias("rows"), F.min("dimension").alias("minimum_dimension"), F.max("dimension").alias("maximum_dimension"))
    joined = contracts.select(*CONTRACT_COLUMNS).join(counted, "contract_sha256", "left")
    return joined.select(*[F.col(c).cast("boolean").alias(c) if c == "truncate" else c for c in CONTRACT_COLUMNS], F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "minimum_dimension", "maximum_dimension").orderBy("model", "contract_sha256")


def inspect_cache(spark: SparkSession, path: str | Path) -> dict:
    tables = sqlite.require_tables(path, "embedding_contracts", "embeddings")
    embeddings = sqlite.read_table(spark, path, "embeddings")
    contracts = [r.asDict() for r in contract_report(sqlite.read_table(spark, path, "embedding_contracts"), embeddings).collect()]
    return {"path": str(path), "size_bytes": Path(path).stat().st_size, "tables": tables, "contracts": contracts, "contract_count": len(contracts), "embedding_rows": embeddings.count()}


def inventory(spark: SparkSession, root: str | Path, cache_db: str | Path | None = None) -> dict:
    """Report on the SQLite cache and all NumPy files below a local folder."""
    if not Path(root).is_dir():
        raise ReplayError(f"there is no folder {root}")
    database = Path(cache_db) if cache_db is not None else Path(root) / DEFAULT_CACHE
    found: dict[str, list] = {"npz": [], "npy": []}
    files = arrays.inspect_arrays(spark, str(root)).collect() if any(p for p in Path(root).rglob("*.np[yz]")) else []
    for r in files:
        item = {"path": r["path"].removeprefix("file:"), "size_bytes": r["size_bytes"]}
        if r["inspection_error"]:
            item["inspection_error"] = r["inspection_error"]
        elif r["path"].endswith(".npz"):
            item |= {"classification": r["classification"], "skipped_values": [s.asDict() for s in r["skipped_values"]]}
            item |= {k: {n: json.loads(v) for n, v in r[k].items()} for k in ("arrays", "small_values")}
        else:
            item |= json.loads(r["arrays"][""])
        found[r["path"][-3:]].append(item)
    report: dict = {"root": str(root), "sqlite": inspect_cache(spark, database) if database.is_file() else None}
    for kind, items in found.items():
        report |= {kind: items, f"{kind}_count": len(items), f"{kind}_error_count": sum("inspection_error" in i for i in items)}
    return report


def float32_vector(payload: Column) -> Column:
    """ARRAY<FLOAT> of little-endian single-precision bytes; null where their number doesn't fit."""

    @F.pandas_udf("array<float>")
    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: np.frombuffer(b, "<f4") if b is not None and len(b) % 4 == 0 else None)

    return decode(payload)


def cached_rows(manifest: DataFrame, cache: DataFrame, fingerprint: str, dimensions: int) -> DataFrame:
    """Each manifest row (ordinal, stable_key, source_sha256) with its vector and ``fault``, null where all is well.

    One join on the three keys; every check is a column."""
    own = cache.filter(F.col("extraction_fingerprint_sha256") == fingerprint).drop("extraction_fingerprint_sha256").withColumn("found", F.lit(True))
    rows = manifest.select("ordinal", "stable_key", "source_sha256").join(own, ["stable_key", "source_sha256"], "left")
    rows = rows.withColumn("vector", float32_vector(F.col("embedding")))
    sound = (F.size("vector") == dimensions) & V.is_finite(F.col("vector"))
    fault = (
        F.when(F.col("found").isNull(), "missing")
        .when((F.col("dtype") != "float32") | (F.col("dimensions") != dimensions), "shape or dtype")
        .when(F.sha2("embedding", 256) != F.col("payload_sha256"), "payload hash")
        .when(~F.coalesce(sound, F.lit(False)), "vector")
        .when(integrity.row_array_sha256(F.col("embedding"), "float32", dimensions) != F.col("array_sha256"), "array hash")
    )
    return rows.select("ordinal", "stable_key", "vector", fault.alias("fault"))


def verified_rows(rows: DataFrame, dimensions: int, expected_sha256: str, where: str) -> int:
    """The number of rows, after the hash of their matrix in manifest order is checked. Such a hash needs all bytes in order,
    so one task takes it, over chunks that others have sorted; the driver gets the hash."""
    bad = rows.filter("fault IS NOT NULL").orderBy("ordinal").limit(5).collect()
    if bad:
        lost = [r["stable_key"] for r in bad if r["fault"] == "missing"]
        raise ReplayError(f"{where} lacks rows, the first are {lost}" if lost else f"{where}: {bad[0]['fault']} of {bad[0]['stable_key']}")
    n = rows.count()
    header = integrity.array_header("float32", (n, dimensions))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = b.column("vector").flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
                yield pa.RecordBatch.from_arrays([b.column("ordinal").slice(0, 1), pa.array([raw], pa.binary())], ["ordinal", "raw"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256(header)
        for b in batches:
            for raw in b.column("raw"):
                digest.update(raw.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], ["sha"])

    ordered = rows.select("ordinal", "vector").repartitionByRange("ordinal").sortWithinPartitions("ordinal")
    found = ordered.mapInArrow(chunks, "ordinal long, raw binary").repartition(1).sortWithinPartitions("ordinal").mapInArrow(hashed, "sha string").collect()
    if (found[0]["sha"] if found else hashlib.sha256(header).hexdigest()) != expected_sha256:
        raise ReplayError(f"{where}: the matrix doesn't have the recorded hash")
    return n
