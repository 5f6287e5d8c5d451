"""Shared pieces of the training-data operators: storage between stages and byte-level text helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.tables import read_parquet, spread

#: Bytes of text that one vectorised step looks at; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Rows in an Arrow batch; keeps batches of long texts small.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(read_parquet(spark, sf_dir, name))


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``; in local mode, where that may be unset, one of
    our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    has = spark.sparkContext._jsc.sc().getCheckpointDir()
    if has.isDefined():
        return has.get()
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if app not in _own_dirs:
        _own_dirs[app] = f"file://{tempfile.mkdtemp(prefix='orrery-')}"
    return _own_dirs[app]


def stored(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: the lineage ends there, and any
    executor may be lost afterwards. Row groups are small, so that later scans split evenly."""
    path = f"{_stored_dir(spark)}/{uuid.uuid4().hex}"
    for paths in _recorders:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _stored_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/orrery/{spark.sparkContext.applicationId}"


_recorders: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that are stored meanwhile."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders[:] = [p for p in _recorders if p is not paths]


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Delete what this application has stored, once no table that is made of it is read any more."""
    discard(spark, [_stored_dir(spark)])


def checkpointed(df: DataFrame, spark: SparkSession) -> DataFrame:
    """A reliable checkpoint: the partitions, and the rows' order in them, stay as they are."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def numbered(spark: SparkSession, rows: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """``rows`` (stored) with a number that follows the order of ids, nulls last, and its column's name."""
    number = "row"
    while number in rows.columns:
        number += "_"
    ordered = rows.orderBy(F.col(key).cast("long").asc_nulls_last(), F.xxhash64(text), F.monotonically_increasing_id())
    return stored(ordered.withColumn(number, F.monotonically_increasing_id()), spark), number


def unclear(ids: DataFrame) -> bool:
    """Whether ids (one column) are null or repeated anywhere."""
    return bool(ids.toDF("id").groupBy("id").count().filter("id IS NULL OR count > 1").limit(1).count())


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """What every operator that runs Python on executors begins with: the sources are there, and batches are small."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class Texts:
    """Some rows' texts as one byte array. ``data`` ends with PAD zero bytes; ``at[i]:at[i + 1]`` is row i's span,
    whose last byte (if ``gap``) is a line feed that isn't part of the text."""

    PAD = 16

    def __init__(self, data: np.ndarray, at: np.ndarray, lo: int, hi: int, gap: int):
        self.data, self.at, self.lo, self.hi, self.gap = data, at, lo, hi, gap

    @property
    def n(self) -> int:
        return int(self.at[-1])


def steps(column: pa.Array, gap: int = 1, most: int = STEP_BYTES) -> Iterator[Texts]:
    """Split a string column (nulls count as empty) into Texts of at most ``most`` bytes, or one row."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    raw = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n, lo + most)
        own = offsets[lo : hi + 1] - offsets[lo]
        at = own + gap * np.arange(hi - lo + 1)
        data = np.full(int(at[-1]) + Texts.PAD, 10, np.uint8)
        data[at[-1] :] = 0
        src = raw[offsets[lo] : offsets[hi]]
        if gap and hi - lo > 1:
            keep = np.ones(int(at[-1]), bool)
            keep[at[1:] - 1] = False
            data[: at[-1]][keep] = src
        else:
            data[: len(src)] = src
        yield Texts(data, at, lo, hi, gap)
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTERS = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0..n of the hash's base, or of its inverse, modulo 2**64."""
    name = "inverse" if inverse else "base"
    have = _powers.get(name)
    if have is None or len(have) <= n:
        grown = np.full(max(n + 1, STEP_BYTES + 4096), _INVERSE if inverse else _BASE, np.uint64)
        grown[0] = 1
        have = np.multiply.accumulate(grown)
        if n < 16 * STEP_BYTES:
            _powers[name] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``codes[s:e]`` for many spans at once, by prefix sums of a polynomial."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes))[: len(codes)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(len(codes), inverse=True)[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def word_spans(t: Texts, is_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words before it (rows + 1 numbers).
    Needs a gap of 1; words are runs of bytes other than white space, or of ``is_word`` bytes."""
    inside = np.zeros(t.n + 2, np.int8)
    inside[1:-1] = ~_SPACE[t.data[: t.n]] if is_word is None else is_word[t.data[: t.n]]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, ends, np.searchsorted(starts, t.at)


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(t: Texts, lowered: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased), and for each row the number of words before it."""
    starts, ends, rows = word_spans(t)
    data = t.data[: t.n]
    return span_hashes(_LETTERS[lower(data) if lowered else data], starts, ends), rows


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` hashed words; of the whole sequence where it is shorter (none if empty)."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w, m = min(width, n), max(1, n - width + 1)
    total = np.full(m, w * 0xA0761D6478BD642F % 2**64, np.uint64)
    for i in range(w):
        total = (total ^ words[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return mix(total)
