"""Headers of NumPy files: what arrays a folder of .npy and .npz files holds, without loading or unpickling them.

Files are read through Spark's binaryFile source. One that can't be inspected becomes a row with its error, and the scan
goes on.
"""

from __future__ import annotations

import ast
import io
import json
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ReplayError

# Fixed values of the NPY format and of benchmark snapshots.
MAGIC = b"\x93NUMPY"
MOST_HEADER_BYTES = 10_000_000
SMALL_ELEMENTS = 16
SNAPSHOT_KEYS = frozenset(("texts", "embeddings", "model", "dataset_sha256"))

SCHEMA = "path string, size_bytes long, classification string, arrays map<string, string>, small_values map<string, string>, skipped_values array<struct<key: string, reason: string>>, inspection_error string"


def has_objects(descr) -> bool:
    """Whether a dtype descriptor names Python objects anywhere."""
    if isinstance(descr, str):
        return descr.lstrip("<>=|")[:1] == "O" if descr[:1] in "<>=|" else descr[:1] == "O"
    if isinstance(descr, dict):
        return any(map(has_objects, descr.values()))
    if isinstance(descr, tuple) and len(descr) > 1 and isinstance(descr[0], str | tuple):
        return has_objects(descr[1])  # a field: name, type and maybe shape
    return isinstance(descr, list | tuple) and any(map(has_objects, descr))


def plain(value):
    """A descriptor as JSON has it."""
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    return value if value is None or isinstance(value, str | int | float | bool) else repr(value)


def plain_scalar(value):
    if isinstance(value, np.generic):
        value = value.item()
    if isinstance(value, bytes):
        return value.decode("utf-8", errors="replace")
    return value if value is None or isinstance(value, str | int | float | bool) else str(value)


def read_header(stream, source: str) -> dict:
    """An NPY header as a dictionary; the dtype is described even if this NumPy doesn't know it."""

    def take(n: int, what: str) -> bytes:
        got = stream.read(n)
        if len(got) != n:
            raise ReplayError(f"{source}: the {what} ends early")
        return got

    if stream.read(len(MAGIC)) != MAGIC:
        raise ReplayError(f"{source} doesn't begin as an NPY file")
    version = tuple(take(2, "version"))
    if version not in ((1, 0), (2, 0), (3, 0)):
        raise ReplayError(f"{source}: unknown NPY version {version}")
    size = int.from_bytes(take(2 if version == (1, 0) else 4, "header length"), "little")
    if not 0 < size <= MOST_HEADER_BYTES:
        raise ReplayError(f"{source}: header length {size} is out of range")
    raw = take(size, "header")
    try:
        header = ast.literal_eval(raw.decode("utf-8" if version == (3, 0) else "latin1").strip())
    except (SyntaxError, ValueError) as e:
        raise ReplayError(f"{source}: the header is no literal") from e
    if not isinstance(header, dict):
        raise ReplayError(f"{source}: the header is no dictionary")
    shape, order, descr = header.get("shape"), header.get("fortran_order"), header.get("descr")
    if not isinstance(shape, tuple) or not all(isinstance(n, int) and n >= 0 for n in shape):
        raise ReplayError(f"{source}: bad shape {shape!r}")
    if not isinstance(order, bool):
        raise ReplayError(f"{source}: bad fortran_order")
    if descr is None:
        raise ReplayError(f"{source}: no descr")
    found = {"npy_version": list(version), "shape": list(shape), "dtype_descriptor": plain(descr), "dtype_supported": True, "fortran_order": order, "contains_objects": has_objects(descr)}
    try:
        found["dtype"] = str(np.dtype(descr))
    except (TypeError, ValueError) as e:
        found |= {"dtype_supported": False, "dtype": descr if isinstance(descr, str) else repr(descr), "dtype_error": str(e)}
    return found


def inspect_archive(content: bytes, source: str) -> dict:
    """Arrays of an NPZ file, and the values of small ones."""
    arrays, values, skipped = {}, {}, []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for member in sorted(m for m in z.namelist() if m.endswith(".npy")):
            with z.open(member) as f:
                arrays[member.removesuffix(".npy")] = read_header(f, f"{source}!{member}")
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        for key, a in arrays.items():
            if key == "embeddings" or int(np.prod(a["shape"], dtype=np.int64)) > SMALL_ELEMENTS:
                continue
            reason = "object_dtype_requires_pickle" if a["contains_objects"] else None if a["dtype_supported"] else "dtype_not_supported_by_local_numpy"
            if not reason:
                try:
                    v = z[key]
                    values[key] = plain_scalar(v.item()) if v.shape == () else [plain_scalar(x) for x in v.ravel().tolist()]
                except (TypeError, ValueError) as e:
                    reason = f"array_value_unavailable: {e}"
            if reason:
                skipped.append({"key": key, "reason": reason})
    return {"classification": "benchmark_embedding_snapshot" if SNAPSHOT_KEYS <= set(arrays) else "generic_npz", "arrays": arrays, "small_values": values, "skipped_values": skipped}


def _inspect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path, size, content in zip(frame["path"], frame["length"], frame["content"], strict=True):
            row = {"path": path, "size_bytes": size, "classification": None, "arrays": None, "small_values": None, "skipped_values": None, "inspection_error": None}
            try:
                if path.endswith(".npz"):
                    got = inspect_archive(bytes(content), path)
                    row |= got | {k: {n: json.dumps(v) for n, v in got[k].items()} for k in ("arrays", "small_values")}
                else:
                    row |= {"classification": "npy", "arrays": {"": json.dumps(read_header(io.BytesIO(bytes(content)), path))}}
            except (OSError, TypeError, ValueError, zipfile.BadZipFile) as e:
                row["inspection_error"] = f"{type(e).__name__}: {e}"
            rows.append(row)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("path", "size_bytes", "classification", "arrays", "small_values", "skipped_values", "inspection_error")])


def inspect_arrays(spark: SparkSession, root: str) -> DataFrame:
    """A row per .npz and .npy file below ``root``, sorted by path; array headers and values are JSON strings."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.np[yz]").load(root)
    return files.select("path", "length", "content").mapInPandas(_inspect, SCHEMA).orderBy("path")


def error_counts(found: DataFrame) -> DataFrame:
    kind = F.substring_index("path", ".", -1).alias("kind")
    return found.groupBy(kind).agg(F.count("*").alias("files"), F.count_if(F.col("inspection_error").isNotNull()).alias("errors"))
