"""Comparison of two candidate functions with a query: by cosine, by predicted and by measured relation distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CoordinateError
from ..functions import vectors as V
from ..functions.code_structure import NAMES, structure_column
from .projection import Projection

MOST_SOURCE_CHARS = 12_000
METHODS = ("cosine", "predicted", "measured")


def stable_rank(order: str, *ties: str, by: tuple[str, ...] = ()):
    """1, 2, ... in order, of equals in the order of ``ties``; no ranks are shared."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(order, *ties))


def winner(a, b):
    return F.when(a <= b, "A").otherwise("B")


def source_fault(source):
    """Why a source can't be compared; null if it can."""
    text = F.trim(F.translate(source, "\t\r\n\f\v", "     "))
    return F.when(source.isNull() | (text == ""), "empty").when(F.length(source) > MOST_SOURCE_CHARS, "too long")


def compare_relations(projection: Projection, rows: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """(ranking, coordinates, verdict) of three rows (name, source, embedding) named Query, Candidate A and Candidate B.

    The embeddings come from any encoder; sources are parsed, never run."""
    checked = rows.select("name", F.col("embedding").cast("array<double>").alias("e"), source_fault(F.col("source")).alias("fault"), structure_column(F.col("source")).alias("s"))
    checked = checked.withColumn("fault", F.coalesce("fault", "s.error")).cache()
    bad = checked.filter("fault IS NOT NULL").orderBy("name").limit(1).collect()
    if bad:
        raise CoordinateError(f"{bad[0]['name']}: {bad[0]['fault']}")
    if {r["name"] for r in checked.select("name").collect()} != {"Query", "Candidate A", "Candidate B"} or checked.count() != 3:
        raise CoordinateError("rows are Query, Candidate A and Candidate B")
    true = F.array(*[F.col(f"s.{n}") for n in NAMES])
    all_ = checked.select("name", "e", true.alias("true_raw"), projection.column(F.col("e")).alias("predicted"))
    all_ = all_.withColumn("predicted_raw", projection.unscaled(F.col("predicted"))).withColumn("true", projection.scaled(F.col("true_raw")))
    coordinates = all_.select("name", *[F.bround(F.get(c, F.lit(i)), 3).alias(f"{p}_{n}") for i, n in enumerate(NAMES) for p, c in (("true", "true_raw"), ("predicted", "predicted_raw"))])
    query = all_.filter("name = 'Query'").select(*[F.col(c).alias(f"q_{c}") for c in ("e", "predicted", "true")])
    pairs = all_.filter("name <> 'Query'").crossJoin(F.broadcast(query))  # two rows and one
    far = pairs.select("name", V.cosine_distance(F.col("e"), F.col("q_e")).alias("cosine"), V.chebyshev(F.col("predicted"), F.col("q_predicted")).alias("predicted"), V.chebyshev(F.col("true"), F.col("q_true")).alias("measured"))
    ranking = far.select("name", *[x for m in METHODS for x in (F.bround(m, 6).alias(m), stable_rank(m, "name").alias(f"{m}_rank"))])
    d = {r["name"]: r for r in far.collect()}
    a, b = d["Candidate A"], d["Candidate B"]
    verdict = {m: "A" if a[m] <= b[m] else "B" for m in METHODS}
    verdict["prediction_agrees"] = verdict["predicted"] == verdict["measured"]
    verdict["cosine_differs"] = verdict["cosine"] != verdict["predicted"]
    return ranking, coordinates, verdict
