"""A ridge projection from embeddings to robust-scaled relation coordinates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CoordinateError
from ..functions import vectors as V
from .statistics import cross_products, robust_scale

_VECTOR = T.ArrayType(T.DoubleType())
SCHEMA = T.StructType(
    [
        T.StructField("coefficients", T.ArrayType(_VECTOR)),
        T.StructField("intercept", _VECTOR),
        T.StructField("relation_median", _VECTOR),
        T.StructField("relation_scale", _VECTOR),
        T.StructField("embedding_mean", _VECTOR),
        T.StructField("alpha", T.DoubleType()),
        T.StructField("relation_names", T.ArrayType(T.StringType())),
    ]
)


def checked_names(names: Sequence[str] | None, n: int) -> tuple[str, ...]:
    """``n`` relation names; by default relation_0, relation_1, ..."""
    if names is None:
        return tuple(f"relation_{i}" for i in range(n))
    found = tuple(map(str, names))
    if len(found) != n:
        raise CoordinateError("each relation coordinate needs a name")
    if "" in found:
        raise CoordinateError("a relation name is empty")
    if len(set(found)) < n:
        raise CoordinateError("relation names repeat")
    return found


@dataclass(frozen=True)
class Projection:
    """coefficients: a row per relation. The other vectors have a value per relation, embedding_mean one per dimension."""

    coefficients: np.ndarray
    intercept: np.ndarray
    relation_median: np.ndarray
    relation_scale: np.ndarray
    embedding_mean: np.ndarray
    alpha: float
    relation_names: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        for name in ("coefficients", "intercept", "relation_median", "relation_scale", "embedding_mean"):
            value = np.asarray(getattr(self, name), dtype=np.float64)
            if not np.isfinite(value).all():
                raise CoordinateError(f"{name} must be finite")
            object.__setattr__(self, name, value)
        if self.coefficients.ndim != 2:
            raise CoordinateError("coefficients must have two dimensions")
        r, d = self.coefficients.shape
        if any(v.shape != (r,) for v in (self.intercept, self.relation_median, self.relation_scale)) or self.embedding_mean.shape != (d,):
            raise CoordinateError("the parts of a projection differ in dimensions")
        names = tuple(map(str, self.relation_names))
        if len(names) != r or len(set(names)) != r:
            raise CoordinateError("relation names must be as many as relations, and differ")
        object.__setattr__(self, "relation_names", names)
        if (self.relation_scale <= 0).any():
            raise CoordinateError("scales must be above zero")
        if not math.isfinite(self.alpha) or self.alpha < 0:
            raise CoordinateError("alpha must be finite and not negative")

    @property
    def dimensions(self) -> int:
        return self.coefficients.shape[1]

    @property
    def relations(self) -> int:
        return self.coefficients.shape[0]

    @classmethod
    def fit(
        cls,
        rows: DataFrame,
        embedding: str = "embedding",
        relation: str = "relation",
        *,
        alpha: float = 1.0,
        relation_names: Sequence[str] | None = None,
        minimum_relation_scale: float = 1.0,
    ) -> Projection:
        """Ridge regression, one shared alpha and a free intercept, of coordinates scaled by median and quartile range."""
        if not math.isfinite(alpha) or alpha < 0:
            raise CoordinateError("alpha must be finite and not negative")
        if not math.isfinite(minimum_relation_scale) or minimum_relation_scale <= 0:
            raise CoordinateError("the least scale must be finite and above zero")
        rows = rows.select(F.col(embedding).cast("array<double>").alias("x"), F.col(relation).cast("array<double>").alias("y"))
        s = rows.agg(
            F.count("*").alias("n"),
            *[f(F.size(c)).alias(f"{a}_{c}") for c in "xy" for a, f in (("lo", F.min), ("hi", F.max))],
            F.count_if(~(V.is_finite(F.col("x")) & V.is_finite(F.col("y")))).alias("bad"),
        ).head()
        if s["n"] < 2:
            raise CoordinateError("a fit needs two rows at least")
        if s["bad"]:
            raise CoordinateError("every row needs a finite embedding and finite coordinates")
        if s["lo_x"] != s["hi_x"] or s["lo_y"] != s["hi_y"] or not s["hi_x"] or not s["hi_y"]:
            raise CoordinateError("rows differ in dimensions")
        d, r = s["hi_x"], s["hi_y"]
        names = checked_names(relation_names, r)
        median, scale = (np.array(v) for v in robust_scale(rows, [F.get("y", F.lit(i)) for i in range(r)], minimum_relation_scale, rows=s["n"]))
        n, sums, _, _ = cross_products(rows, "x", "y", d)
        x_mean, y_mean = sums[:d] / n, sums[d:] / n
        _, _, gram, cross = cross_products(rows, "x", "y", d, x_mean, y_mean)
        # scaling the coordinates scales their means and products: no pass over scaled rows is needed
        weights = solve(gram, cross / scale, alpha)
        return cls(weights.T, (y_mean - median) / scale - x_mean @ weights, median, scale, x_mean, float(alpha), names)

    def column(self, embedding: Column) -> Column:
        """Relation coordinates as built-in expressions; for wide embeddings or many rows see ``project``."""
        return V.projected(embedding, self.coefficients.tolist(), self.intercept.tolist())

    def project(self, rows: DataFrame, embedding: str = "embedding", into: str = "relation") -> DataFrame:
        """``rows`` with their coordinates in ``into``, by matrix products over Arrow batches. Works on streams as well."""
        w, b, d, at = self.coefficients.T, self.intercept, self.dimensions, rows.columns.index(embedding)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                if batch.num_rows:
                    column = batch.column(at)
                    sizes = np.diff(column.offsets.to_numpy())
                    if column.null_count or (sizes != d).any():
                        raise CoordinateError("embeddings don't have the projection's dimensions")
                    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                    if not np.isfinite(x).all():
                        raise CoordinateError("embeddings must be finite")
                    found = (x @ w + b).tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], [*batch.schema.names, into])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(into, _VECTOR)]))

    def unscaled(self, relation: Column) -> Column:
        return V.unscaled(relation, self.relation_median.tolist(), self.relation_scale.tolist())

    def scaled(self, values: Column) -> Column:
        return V.scaled(values, self.relation_median.tolist(), self.relation_scale.tolist())

    def save(self, spark: SparkSession, path: str) -> None:
        parts = (self.coefficients, self.intercept, self.relation_median, self.relation_scale, self.embedding_mean)
        row = (*[p.tolist() for p in parts], float(self.alpha), list(self.relation_names))
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Projection:
        rows = spark.read.schema(SCHEMA).parquet(path).take(2)
        if len(rows) != 1 or any(v is None for v in rows[0]):
            raise CoordinateError("a stored projection is one complete row")
        r = rows[0]
        return cls(*[np.asarray(r[n], np.float64) for n in SCHEMA.names[:5]], r["alpha"], tuple(r["relation_names"]))

    def save_archive(self, path: str) -> None:
        """As a NumPy archive without pickles, coefficients a row per dimension."""
        np.savez_compressed(
            path, coefficients=self.coefficients.T, intercept=self.intercept, relation_median=self.relation_median, relation_scale=self.relation_scale,
            embedding_mean=self.embedding_mean, alpha=np.array([self.alpha]), relation_names=np.array(self.relation_names, dtype=np.str_),
        )

    @classmethod
    def load_archive(cls, path: str) -> Projection:
        with np.load(path, allow_pickle=False) as z:
            if z["alpha"].shape != (1,):
                raise CoordinateError("alpha must be one number")
            parts = [z[n].astype(np.float64) for n in SCHEMA.names[:5]]
            return cls(parts[0].T, *parts[1:], float(z["alpha"][0]), tuple(z["relation_names"].tolist()))


def solve(gram: np.ndarray, cross: np.ndarray, alpha: float) -> np.ndarray:
    """Weights (a row per dimension) of the ridge normal equations; by pseudo-inverse where they are singular."""
    a = gram + alpha * np.eye(len(gram))
    try:
        return np.linalg.solve(a, cross)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a) @ cross
