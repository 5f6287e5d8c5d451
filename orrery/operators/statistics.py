"""Exact order statistics and moments of columns, without gathering a column anywhere."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many rows Spark's exact percentile, which holds a column's distinct values, is used directly.
DIRECT_ROWS = 5_000_000
#: Partial sums meet in so many tasks before they come to the driver.
MERGE_TASKS = 16


def percentiles(df: DataFrame, columns: Sequence[Column], shares: Sequence[float], direct_rows: int = DIRECT_ROWS, rows: int | None = None) -> list[list[float]]:
    """For each column its exact, linearly interpolated percentiles; nulls don't count.

    Larger tables are narrowed down: approximate percentiles bracket each wanted rank, one pass counts what lies below
    and within the brackets, and so on until a bracket holds few enough values to be sorted.
    """
    named = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    counts = named.agg(*[F.count(c).alias(c) for c in named.columns]).head()
    if max(counts, default=0) <= direct_rows:
        row = named.agg(*[F.percentile(c, list(shares)).alias(c) for c in named.columns]).head()
        return [list(row[c]) if row[c] is not None else [None] * len(shares) for c in named.columns]
    return [[_ranked(named, c, counts[c], s, direct_rows) for s in shares] for c in named.columns]


def _ranked(named: DataFrame, c: str, n: int, share: float, direct_rows: int) -> float | None:
    """The value at position share * (n - 1) of the sorted column."""
    if not n:
        return None
    at = share * (n - 1)
    low, high, below = float("-inf"), float("inf"), 0
    while True:
        inside = named.filter(F.col(c).between(low, high))
        size = inside.count()
        if size <= direct_rows or low == high:
            break
        mid = (at - below) / max(1, size - 1)
        a, b = (min(1.0, max(0.0, mid + d)) for d in (-0.01, 0.01))
        new_low, new_high = inside.agg(F.percentile_approx(c, [a, b], 10_000)).head()[0]
        if (new_low, new_high) == (low, high):
            break
        low, high = new_low, new_high
        below = named.filter(F.col(c) < low).count()
    if low == high:
        return low
    share = (at - below) / max(1, size - 1)
    if 0 <= share <= 1 and size <= direct_rows:
        return inside.agg(F.percentile(c, share)).head()[0]
    return named.agg(F.percentile(c, at / max(1, n - 1))).head()[0]  # the bracket missed the rank


def robust_scale(df: DataFrame, columns: Sequence[Column], minimum: float = 1.0, rows: int | None = None) -> tuple[list[float], list[float]]:
    """Medians, and interquartile ranges of at least ``minimum``."""
    found = percentiles(df, columns, (0.5, 0.25, 0.75), rows=rows)
    return [m for m, _, _ in found], [max(b - a, minimum) for _, a, b in found]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def cross_products(df: DataFrame, x: str, y: str, width: int, x_mean=None, y_mean=None) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, sum of [x, y], centred Gram matrix of x, centred cross product of x and y) for array columns x and y.

    Every task sums its batches by matrix products, some tasks add those sums up in a fixed order, and the driver adds
    theirs: what reaches it depends on the number of dimensions only.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            a, c = _matrix(b.column(0)), _matrix(b.column(1))
            sums = np.concatenate([a.sum(axis=0), c.sum(axis=0)])
            if x_mean is not None:
                a, c = a - x_mean, c - y_mean
                sums = np.concatenate([sums, (a.T @ a).ravel(), (a.T @ c).ravel()])
            n, total = n + b.num_rows, sums if total is None else total + sums
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            for m, sums in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = sums.values.to_numpy()
                n, total = n + m, own.copy() if total is None else total + own
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "sums"])

    schema = "n long, sums array<double>"
    parts = df.select(x, y).mapInArrow(partial, schema).withColumn("part", F.spark_partition_id())
    parts = parts.repartition(MERGE_TASKS, "part").sortWithinPartitions("part").select("n", "sums").mapInArrow(merge, schema)
    rows = sorted(((r["n"], r["sums"]) for r in parts.collect()), key=lambda r: (r[0], r[1][0]))
    if not rows:
        return 0, np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0))
    total = np.sum([np.array(s) for _, s in rows], axis=0)
    n = sum(m for m, _ in rows)
    if x_mean is None:
        return n, total, np.zeros((0, 0)), np.zeros((0, 0))
    d, r = width, len(y_mean)
    return n, total[: d + r], total[d + r : d + r + d * d].reshape(d, d), total[d + r + d * d :].reshape(d, r)


def _kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: nothing can make these rows be dealt anew."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="orrery-"))
    return df.checkpoint(eager=True)


def running_sum(rows: DataFrame, order: Sequence[str], value: Column, into: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before, in the order of columns that have no ties.

    Ranges of the order are summed one by one, each from where those before it end; so no task sees all rows, and what
    reaches the driver is a sum for each partition. The ranges' bounds come from a sample, which is another one in every plan
    of a larger table: so rows are dealt once and kept, or sums would belong to other ranges than the rows they are added to."""
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = {"part": "part", "own": "own", "before": "before"}
    for k in names:
        while names[k] in (*rows.columns, into):
            names[k] += "_"
    part, own, before = names.values()
    ranged = rows.withColumn(own, value.cast("long")).repartitionByRange(n, *order).withColumn(part, F.spark_partition_id())
    ranged = _kept(ranged)
    sums = sorted((r[part], r["n"]) for r in ranged.groupBy(part).agg(F.sum(own).alias("n")).collect())
    totals = np.concatenate([[0], np.cumsum([x for _, x in sums])[:-1]]) if sums else []
    starts = spark.createDataFrame([(int(p), int(t)) for (p, _), t in zip(sums, totals, strict=True)], f"{part} int, {before} long")
    here = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn(into, F.coalesce(F.sum(own).over(here), F.lit(0)))
    return inside.join(F.broadcast(starts), part).withColumn(into, (F.col(into) + F.col(before)).cast("long")).drop(part, own, before)
