"""Ranking by Chebyshev distance in relation space, optionally within a pool of the nearest by cosine."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CoordinateError
from ..functions import vectors as V
from .projection import Projection

HIT_SCHEMA = "rank int, index long, relation_distance double, cosine_distance double"
#: Bytes of sources that go to all tasks at once in ``search_many``; more take further scans of the targets.
SENT_BYTES = 64 << 20
#: Targets that a task ranks together, and distances that it holds at a time.
TARGET_ROWS, DISTANCES = 16_384, 1 << 21


def _whole(name: str, value) -> None:
    if not isinstance(value, int) or isinstance(value, bool):
        raise CoordinateError(f"{name} must be a whole number")


def _checked(targets: DataFrame, dimensions: int, exclude: int | None) -> int:
    """Rows of ``targets`` (index, e), after checking them all, the excluded one included."""
    s = targets.agg(
        F.count("*").alias("n"),
        F.count_if(~V.is_finite(F.col("e")) | (F.size("e") != dimensions)).alias("bad"),
        F.count_if(~F.coalesce(F.exists("e", lambda x: x != 0), F.lit(False))).alias("zero"),
        F.count_if(F.col("index") == F.lit(exclude)).alias("excluded"),
        F.count_if(F.col("index").isNull()).alias("unnamed"),
    ).head()
    if not s["n"]:
        return 0
    if s["unnamed"]:
        raise CoordinateError("each row needs an index")
    if s["bad"]:
        raise CoordinateError("targets must be finite and have the projection's dimensions")
    if exclude is not None and not s["excluded"]:
        raise CoordinateError("the excluded index isn't among the targets")
    if s["zero"]:
        raise CoordinateError("cosine distance needs vectors with a norm above zero")
    return s["n"] - s["excluded"]


def search(
    projection: Projection,
    source: Sequence[float],
    targets: DataFrame,
    *,
    k: int = 10,
    candidate_pool: int | None = None,
    exclude_index: int | None = None,
    index: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """The k targets nearest to one source: rank, index, relation_distance, cosine_distance.

    A scan and a top-k without shuffle of the table; the vectors of the source are literals. The pool is a subquery, so
    coordinates are taken of pooled rows only. Ties go to the smaller cosine distance, then to the smaller index.
    """
    spark = targets.sparkSession
    source = np.asarray(source, dtype=np.float64)
    if source.ndim != 1 or len(source) != projection.dimensions:
        raise CoordinateError("source, targets and projection must have the same dimensions")
    if not np.isfinite(source).all():
        raise CoordinateError("the source must be finite")
    _whole("k", k)
    if k <= 0:
        raise CoordinateError("k must be above zero")
    rows = targets.select(F.col(index).cast("long").alias("index"), F.col(embedding).cast("array<double>").alias("e"))
    available = _checked(rows, len(source), exclude_index)
    if not available:
        return spark.createDataFrame([], HIT_SCHEMA)
    if not source.any():
        raise CoordinateError("cosine distance needs vectors with a norm above zero")
    if candidate_pool is not None:
        _whole("the candidate pool", candidate_pool)
        if candidate_pool < min(k, available):
            raise CoordinateError("the candidate pool must hold k rows")
    if exclude_index is not None:
        rows = rows.filter(F.col("index") != exclude_index)
    rows = rows.withColumn("cosine_distance", V.cosine_distance(F.col("e"), V.vector(source)))
    if candidate_pool is not None:
        rows = rows.orderBy("cosine_distance", "index").limit(candidate_pool)
    here = projection.coefficients @ source + projection.intercept
    rows = rows.withColumn("relation_distance", V.chebyshev(projection.column(F.col("e")), V.vector(here)))
    order = ["relation_distance", "cosine_distance", "index"]
    hits = rows.select("index", "relation_distance", "cosine_distance").orderBy(*order).limit(k)
    return hits.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "index", "relation_distance", "cosine_distance")


def _distances(sources: np.ndarray, targets: np.ndarray, projection: Projection) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and relation distances, a row per source."""
    size = np.linalg.norm(sources, axis=1)[:, None] * np.linalg.norm(targets, axis=1)[None, :]
    cosine = 1.0 - np.clip(sources @ targets.T / size, -1.0, 1.0)
    a, b = sources @ projection.coefficients.T, targets @ projection.coefficients.T
    relation = np.zeros(cosine.shape)
    for r in range(projection.relations):  # one relation at a time: no cube of sources, targets and relations
        np.maximum(relation, np.abs(a[:, r, None] - b[None, :, r]), out=relation)
    return cosine, relation


def _best(order: tuple[np.ndarray, ...], most: int) -> np.ndarray:
    """Places of the ``most`` least of (last, ..., first) keys, as ``lexsort`` has them; only what can be among them is sorted."""
    first = order[-1]
    if len(first) <= most:
        return np.lexsort(order)
    near = np.flatnonzero(first <= first[np.argpartition(first, most - 1)[most - 1]])
    return near[np.lexsort(tuple(k[near] for k in order))][:most]


def _scanned(rows: DataFrame, ids: np.ndarray, x: np.ndarray, projection: Projection, most: int, pooled: bool, exclude_self: bool) -> DataFrame:
    """For each of some sources and each lot of targets, the targets that can still count."""

    def lot(target: np.ndarray, e: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, DISTANCES // len(target))
        for lo in range(0, len(ids), step):
            cosine, relation = _distances(x[lo : lo + step], e, projection)
            out: list[list[np.ndarray]] = [[], [], [], []]
            for me, c, r in zip(ids[lo : lo + step], cosine, relation, strict=True):
                best = _best((target, c) if pooled else (target, c, r), most + exclude_self)
                best = best[target[best] != me][:most] if exclude_self else best
                for to, v in zip(out, (np.full(len(best), me), target[best], r[best], c[best]), strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["source", "index", "relation_distance", "cosine_distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            if b.num_rows:
                held.append((b.column("index").to_numpy(), b.column("e").flatten().to_numpy().reshape(b.num_rows, -1)))
            if sum(len(t) for t, _ in held) >= TARGET_ROWS:
                yield from lot(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held = []
        if held:
            yield from lot(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return rows.mapInArrow(run, "source long, index long, relation_distance double, cosine_distance double")


def search_many(
    projection: Projection,
    sources: DataFrame,
    targets: DataFrame,
    *,
    k: int = 10,
    candidate_pool: int | None = None,
    exclude_self: bool = True,
    index: str = "vec_id",
    embedding: str = "embedding",
    sent_bytes: int = SENT_BYTES,
) -> DataFrame:
    """``search`` for each source: source, rank, index, relation_distance, cosine_distance. Indexes of sources must differ.

    Sources come in one pass and go to all tasks, in as many lots as their size asks for; each lot is one scan of the
    targets. A task keeps, per lot of targets and source, no more rows than can still count (the pool, or k), so the one
    shuffle is bounded by those. Every source meets every target: the result is exact, and the work is their product.
    """
    _whole("k", k)
    if k <= 0:
        raise CoordinateError("k must be above zero")
    if candidate_pool is not None:
        _whole("the candidate pool", candidate_pool)
        if candidate_pool < k:
            raise CoordinateError("the candidate pool must hold k rows")
    spark = targets.sparkSession
    rows = targets.select(F.col(index).cast("long").alias("index"), F.col(embedding).cast("array<double>").alias("e"))
    asked = sources.select(F.col(index).cast("long").alias("index"), F.col(embedding).cast("array<double>").alias("e"))
    for part in (rows, asked):
        _checked(part, projection.dimensions, None)
    if asked.groupBy("index").count().filter("count > 1").limit(1).count():
        raise CoordinateError("the sources' indexes repeat")
    most, lot = candidate_pool or k, max(1, sent_bytes // (8 * projection.dimensions))
    parts, own = [], asked.toLocalIterator(prefetchPartitions=True)
    while page := list(itertools.islice(own, lot)):
        ids, x = np.array([r["index"] for r in page], np.int64), np.array([r["e"] for r in page], np.float64)
        parts.append(_scanned(rows, ids, x, projection, most, candidate_pool is not None, exclude_self))
    if not parts:
        return spark.createDataFrame([], "source long, " + HIT_SCHEMA)
    found = functools.reduce(DataFrame.unionByName, parts)
    by = Window.partitionBy("source")
    if candidate_pool:
        found = found.withColumn("n", F.row_number().over(by.orderBy("cosine_distance", "index"))).filter(F.col("n") <= candidate_pool)
    order = by.orderBy("relation_distance", "cosine_distance", "index")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select("source", F.col("rank").cast("int").alias("rank"), "index", "relation_distance", "cosine_distance")
