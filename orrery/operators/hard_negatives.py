"""Ordering of hard negatives: for each query, how often a method ranks the closer of two candidates first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .statistics import running_sum

# Fixed names and threshold of the published decision.
METHODS = ("raw_cosine", "raw_euclidean", "token_length", "true_oracle", "predicted_executor")
RAW_METHODS = METHODS[:2]
THRESHOLD = 0.10


def method_distances(q: str, c: str) -> dict[str, Column]:
    """Distances between structs ``q`` and ``c`` with embedding, tokens, true and predicted."""
    col = lambda side, name: F.col(f"{side}.{name}")
    both = lambda name: (col(c, name), col(q, name))
    return dict(
        zip(
            METHODS,
            (V.cosine_distance_eps(*both("embedding")), V.euclidean(*both("embedding")), V.token_distance(*both("tokens")), V.chebyshev(*both("true")), V.chebyshev(*both("predicted"))),
            strict=True,
        )
    )


def preference(closer: Column, farther: Column) -> Column:
    """1 if the closer candidate is nearer, 0 if it isn't, half for a tie."""
    return F.when(closer == farther, 0.5).when(closer < farther, 1.0).otherwise(0.0)


def query_scores(pairs: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row per query: query_index, pairs, and each method's mean preference (null without pairs).

    pairs: query_index, closer_index, farther_index. queries and candidates: index, embedding, tokens, true, predicted.
    Distances are taken once for each distinct (query, candidate), then looked up for both sides of a pair; so vectors are
    joined to that list and not to the pairs, and only numbers are shuffled after it.
    """
    side = F.struct("embedding", "tokens", "true", "predicted")
    closer, farther = (pairs.select("query_index", F.col(c).alias("candidate")) for c in ("closer_index", "farther_index"))
    met = closer.unionByName(farther).distinct()
    met = met.join(queries.select(F.col("index").alias("query_index"), side.alias("q")), "query_index").join(candidates.select(F.col("index").alias("candidate"), side.alias("c")), "candidate")
    far = met.select("query_index", "candidate", F.struct(*[d.alias(m) for m, d in method_distances("q", "c").items()]).alias("d"))
    near = far.select("query_index", F.col("candidate").alias("closer_index"), F.col("d").alias("near"))
    away = far.select("query_index", F.col("candidate").alias("farther_index"), F.col("d").alias("away"))
    joined = pairs.join(near, ["query_index", "closer_index"]).join(away, ["query_index", "farther_index"])
    scores = joined.groupBy("query_index").agg(F.count("*").alias("pairs"), *[F.avg(preference(F.col(f"near.{m}"), F.col(f"away.{m}"))).alias(m) for m in METHODS])
    return queries.select(F.col("index").alias("query_index")).join(scores, "query_index", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))


def decision(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row: mean scores of queries with pairs (each query counts once), and whether the gap reaches the threshold."""
    means = scores.agg(
        F.create_map(*[x for m in METHODS for x in (F.lit(m), F.avg(F.when(F.col("pairs") > 0, F.col(m))))]).alias("query_equal_weighted_accuracy"),
        F.count_if(F.col("pairs") > 0).alias("queries_with_pairs"),
        F.count_if(F.col("pairs") == 0).alias("queries_without_pairs"),
    )
    of = lambda m: F.col("query_equal_weighted_accuracy")[m]
    best = F.greatest(*[of(m) for m in RAW_METHODS])
    gap = of("predicted_executor") - best
    ties = F.array_compact(F.array(*[F.when(of(m) == best, F.lit(m)) for m in RAW_METHODS]))
    return means.select(
        "*", best.alias("raw_best"), ties.alias("raw_best_methods"), gap.alias("gap"), F.lit(threshold).alias("threshold"),
        F.when(gap >= threshold, "REAL_PREMISE_SUPPORTED").otherwise("REAL_PREMISE_FAILED").alias("outcome"),
        F.lit(False).alias("inconclusive_band"), F.lit(False).alias("secondary_metric_override"),
    )


def offsets(counts: DataFrame) -> DataFrame:
    """Where each query's pairs start in the stream of all pairs: counts of the queries before it, summed."""
    return running_sum(counts, ["query_index"], F.col("pair_count"), "offset")


def misplaced_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs whose pair_order isn't their place, from 0, among their query's pairs."""
    place = F.row_number().over(Window.partitionBy("query_index").orderBy("pair_order")) - 1
    return pairs.withColumn("place", place).filter("place <> pair_order").drop("place")
