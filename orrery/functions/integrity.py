"""Content hashes: as columns where Spark has the bytes, on the driver for small stored evidence."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ReplayError


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def text_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def text_matches(text: Column, expected: Column) -> Column:
    """A text's hash is as expected, or its hash with line feeds for CR LF is."""
    return (text_sha256(text) == expected) | (text_sha256(F.replace(text, F.lit("\r\n"), F.lit("\n"))) == expected)


def array_header(dtype: str, shape) -> bytes:
    return json.dumps({"dtype": dtype, "shape": [int(n) for n in shape]}, sort_keys=True, separators=(",", ":")).encode()


def row_array_sha256(payload: Column, dtype: str, dimensions: int) -> Column:
    """Hash of a one-dimensional array whose bytes are ``payload``."""
    return F.sha2(F.concat(F.lit(array_header(dtype, [dimensions])), payload), 256)


def array_sha256(value: np.ndarray) -> str:
    value = np.ascontiguousarray(value)
    return hashlib.sha256(array_header(str(value.dtype), value.shape) + value.tobytes()).hexdigest()


def parameter_sha256(value) -> str:
    return array_sha256(np.asarray(value, dtype=np.float64))


def stream_sha256(path: str | Path, opener=open) -> str:
    digest = hashlib.sha256()
    with opener(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def check_text_file(path: str | Path, expected: str) -> None:
    raw = Path(path).read_bytes()
    if expected not in (hashlib.sha256(raw).hexdigest(), hashlib.sha256(raw.replace(b"\r\n", b"\n")).hexdigest()):
        raise ReplayError(f"{path} does not have the recorded hash")


def canonical_json_sha256(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
