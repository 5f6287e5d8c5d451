"""Pair classification over frozen embeddings: five feature sets of text pairs, and a control with shuffled labels."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ReplayError
from ..functions import integrity
from ..functions import vectors as V
from ..sources import jsonl
from ..sources.arrays import SNAPSHOT_KEYS
from .metrics import binary_metrics, rates
from .statistics import MERGE_TASKS, running_sum

# Fixed values of the benchmark.
SPLITS = ("train", "validation", "test")
FEATURES = ("Cosine only", "Absolute difference", "Elementwise product", "Residual only", "Full pair")
ALPHAS = (1e-5, 1e-4, 1e-3, 1e-2)
SHUFFLED = "Shuffled labels"
PAIR_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("example_id", "split", "left", "right")] + [T.StructField("label", T.IntegerType())])


@dataclass(frozen=True)
class PairScore:
    name: str
    selected_alpha: float
    validation_balanced_accuracy: float | None
    accuracy: float
    balanced_accuracy: float
    f1: float
    roc_auc: float
    log_loss: float


def load_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(rows of text and embedding, facts) of a snapshot archive."""
    if not Path(path).is_file():
        raise ReplayError(f"there is no snapshot at {path}")
    with np.load(path, allow_pickle=False) as z:
        if lost := sorted(SNAPSHOT_KEYS - set(z.files)):
            raise ReplayError(f"the snapshot lacks {', '.join(lost)}")
        texts = [str(t) for t in z["texts"].tolist()]
        x, model, sha = np.asarray(z["embeddings"], np.float64), str(z["model"].item()), str(z["dataset_sha256"].item())
    if not texts or len(set(texts)) != len(texts):
        raise ReplayError("a snapshot's texts must be there, and differ")
    if x.ndim != 2 or len(x) != len(texts) or not x.shape[1] or not np.isfinite(x).all():
        raise ReplayError("a snapshot's embeddings must be a finite matrix with a row per text")
    if not model or len(sha) != 64:
        raise ReplayError("a snapshot's model or dataset hash is missing")
    rows = spark.createDataFrame([(t, v.tolist()) for t, v in zip(texts, x, strict=True)], "text string, embedding array<double>")
    return rows, {"model": model, "dataset_sha256": sha, "embedding_dimension": x.shape[1], "unique_texts": len(texts)}


def load_manifests(spark: SparkSession, folder: str) -> tuple[DataFrame, dict, str]:
    """(pairs of all splits, metadata, hash of the metadata), checked against the recorded hashes and counts."""
    metadata = jsonl.read_object(Path(folder) / "metadata.json")
    if not isinstance(metadata.get("splits"), dict):
        raise ReplayError("the metadata has no splits")
    parts = None
    for split in SPLITS:
        path, recorded = Path(folder) / f"{split}.jsonl", metadata["splits"].get(split)
        if not isinstance(recorded, dict) or not path.is_file():
            raise ReplayError(f"split {split} is missing")
        if integrity.stream_sha256(path) != str(recorded.get("sha256", "")):
            raise ReplayError(f"the hash of split {split} has changed")
        rows = jsonl.read_lines(spark, str(path), PAIR_SCHEMA, exact=True).withColumn("file_split", F.lit(split))
        parts = rows if parts is None else parts.unionByName(rows)
    parts = parts.cache()
    blank = lambda c: F.coalesce(F.trim(F.translate(c, "\t\n\r\f\v", "     ")) == "", F.lit(True))
    bad = parts.filter(F.coalesce(F.col("split") != F.col("file_split"), F.lit(True)) | ~F.coalesce(F.col("label").isin(0, 1), F.lit(False)) | blank("left") | blank("right") | F.col("example_id").isNull())
    if bad.limit(1).count():
        raise ReplayError("a pair has another split, no binary label, a blank text or no id")
    if parts.groupBy("example_id").count().filter("count > 1").limit(1).count():
        raise ReplayError("example ids repeat")
    counts = {r["split"]: r for r in parts.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")).collect()}
    for split in SPLITS:
        n = counts[split]["n"] if split in counts else 0
        if n != int(metadata["splits"][split].get("rows", -1)) or counts[split]["labels"] != 2:
            raise ReplayError(f"split {split} doesn't have the recorded rows, or not both labels")
    return parts.drop("file_split"), metadata, integrity.canonical_json_sha256(metadata)


def missing_texts(pairs: DataFrame, snapshot: DataFrame) -> DataFrame:
    texts = pairs.select(F.col("left").alias("text")).union(pairs.select("right")).distinct()
    return texts.join(snapshot.select("text"), "text", "left_anti")


def pair_table(pairs: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Pairs with their features: example_id, split, y, and an ARRAY<FLOAT> for each feature set."""
    unit = snapshot.select("text", V.l2_normalized(F.col("embedding")).alias("e"))
    joined = pairs.join(unit.select(F.col("text").alias("left"), F.col("e").alias("l")), "left").join(unit.select(F.col("text").alias("right"), F.col("e").alias("r")), "right")
    return joined.select("example_id", "split", F.col("label").alias("y"), *[c.alias(n) for n, c in V.pair_features(F.col("l"), F.col("r")).items()])


def few_tasks(rows: DataFrame) -> DataFrame:
    """``rows`` in no more partitions than keep all cores busy. A fit makes a dozen passes or more, and every task of each
    tells the driver some kilobytes: so their number must not follow the table."""
    return rows.coalesce(max(MERGE_TASKS, rows.sparkSession.sparkContext.defaultParallelism))


class PairModel:
    """Standardised features (population deviation, 1 where it is 0), then logistic regression with an L2 penalty alpha."""

    def __init__(self, rows: DataFrame, feature: str, alpha: float):
        rows = few_tasks(rows)
        at = F.posexplode(feature).alias("i", "v")
        stats = sorted(rows.select(at).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect())
        self.feature, self.mean, self.scale = feature, [r["m"] for r in stats], [r["s"] or 1.0 for r in stats]
        learner = LogisticRegression(regParam=alpha, elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-8, labelCol="y")
        self.model = learner.fit(self._vectors(rows))

    def _vectors(self, rows: DataFrame) -> DataFrame:
        return rows.select("y", array_to_vector(V.scaled(F.col(self.feature).cast("array<double>"), self.mean, self.scale)).alias("features"))

    def scores(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(self._vectors(rows)).select("y", vector_to_array("probability")[1].alias("p"))


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with their labels permuted: a seeded hash orders the labels, which are dealt to rows in order of id."""
    hashed = rows.select("y", "example_id", F.xxhash64("example_id", F.lit(seed)).alias("h"))
    labels = running_sum(hashed, ["h", "example_id"], F.lit(1), "n").select("y", "n")
    return running_sum(rows.drop("y"), ["example_id"], F.lit(1), "n").join(labels, "n").drop("n")


def evaluate(table: DataFrame, seed: int) -> list[PairScore]:
    """For each feature set the penalty with the best validation accuracy (of equals the least), fitted on train and
    validation, scored on test; then the control."""
    kept = table.cache()
    table = few_tasks(kept)
    train, validation, test = (table.filter(F.col("split") == s) for s in SPLITS)
    both = table.filter(F.col("split") != "test")

    def score(name: str, alpha: float, valid: float | None, model: PairModel) -> PairScore:
        return PairScore(name, alpha, valid, **binary_metrics(model.scores(test)).head().asDict())

    found = []
    for name in FEATURES:
        tried = [(rates(PairModel(train, name, a).scores(validation)).head()["balanced_accuracy"], -a) for a in ALPHAS]
        valid, alpha = max(tried)
        found.append(score(name, -alpha, valid, PairModel(both, name, -alpha)))
    alpha = found[-1].selected_alpha
    found.append(score(SHUFFLED, alpha, None, PairModel(shuffled(both, seed), FEATURES[-1], alpha)))
    kept.unpersist()
    return found


def replay_pairs(spark: SparkSession, snapshot: str, manifest_dir: str, seed: int = 118) -> dict:
    rows, facts = load_snapshot(spark, snapshot)
    pairs, metadata, sha = load_manifests(spark, manifest_dir)
    if facts.pop("dataset_sha256") != sha:
        raise ReplayError("the snapshot was made from other manifests")
    lost = missing_texts(pairs, rows)
    if n := lost.count():
        raise ReplayError(f"the snapshot lacks {n} texts, such as {[r['text'] for r in lost.orderBy('text').limit(3).collect()]}")
    scores = {s.name: asdict(s) for s in evaluate(pair_table(pairs, rows), seed)}
    return facts | {
        "status": "PAIR_BENCHMARK_REPLAY_COMPLETE", "snapshot": snapshot, "manifest_dir": manifest_dir, "manifest_sha256": sha, "seed": seed,
        "benchmark": metadata.get("benchmark"), "resolved_revision": metadata.get("resolved_revision"),
        "split_rows": {r["split"]: r["count"] for r in pairs.groupBy("split").count().collect()}, "scores": scores,
        "primary_comparison": {"full_pair_minus_cosine_balanced_accuracy": scores["Full pair"]["balanced_accuracy"] - scores["Cosine only"]["balanced_accuracy"]},
    }
