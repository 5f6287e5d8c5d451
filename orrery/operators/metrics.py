"""Binary classification metrics as aggregates; scores ``p`` in [0, 1], labels ``y`` 0 or 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .statistics import running_sum

EPSILON = 2.220446049250313e-16


def rates(rows: DataFrame) -> DataFrame:
    """One row: accuracy, balanced_accuracy, f1, log_loss of columns y and p, in one pass; predictions are p >= 0.5."""
    hit = (F.col("p") >= 0.5).cast("int")
    tp, fp = F.sum(F.col("y") * hit), F.sum((1 - F.col("y")) * hit)
    pos, neg = F.sum(F.col("y")), F.sum(1 - F.col("y"))
    inside = F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), F.col("p")))
    return rows.agg(
        ((tp + neg - fp) / F.count("*")).alias("accuracy"),
        ((F.try_divide(tp, pos) + F.try_divide(neg - fp, neg)) / 2).alias("balanced_accuracy"),
        F.coalesce(F.try_divide(2.0 * tp, tp + fp + pos), F.lit(0.0)).alias("f1"),
        (-F.avg(F.col("y") * F.ln(inside) + (1 - F.col("y")) * F.ln(1 - inside))).alias("log_loss"),
    )


def binary_metrics(rows: DataFrame) -> DataFrame:
    """``rates``, and roc_auc before the last."""
    return rates(rows).crossJoin(F.broadcast(roc_auc(rows))).select("accuracy", "balanced_accuracy", "f1", "roc_auc", "log_loss")


def roc_auc(rows: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs that the scores order rightly, ties counting half. Rows are summed per distinct
    score before the running sum over scores."""
    per = rows.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    per = running_sum(per, ["p"], F.col("neg"), "before")
    per = per.withColumn("won", F.col("pos") * (F.col("before") + F.col("neg") / 2.0))
    return per.agg(F.try_divide(F.sum("won"), F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def best_alpha(scores: DataFrame) -> DataFrame:
    """Of (name, alpha, score) rows each name's highest score; of equal scores the smallest alpha."""
    return scores.groupBy("name").agg(F.max(F.struct("score", (-F.col("alpha")).alias("a"))).alias("b")).select("name", (-F.col("b.a")).alias("alpha"), F.col("b.score").alias("score"))
