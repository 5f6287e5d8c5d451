"""Registered queries over the driver's tables.

Roles: ``embeddings`` are the vectors; a vector's relation coordinates are the characters, words and distinct words of the
document of the same id; splits go by id modulo 5 (0-2 train, 3 validation, 4 test); a document's words stand for tokens.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import integrity
from ..functions import vectors as V
from ..functions.code_structure import NAMES, structure_column
from ..operators import hard_negatives, metrics, pair_benchmark
from ..operators.compare import stable_rank, winner
from ..operators.projection import Projection
from ..operators.search import search, search_many
from ..operators.statistics import cross_products, percentiles, robust_scale, running_sum
from ..sources.caches import contract_report
from ..sources.tables import read_parquet as read
from ..sources.tables import spread

RELATIONS = 3
PLACES = 6


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


def planar(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the first two dimensions."""
    return embeddings(spark, sf).select("vec_id", F.slice("embedding", 1, 2).alias("embedding"))


def words(text: str = "text") -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def coordinates(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(read(spark, sf, "documents").select("doc_id", "n_chars", "text")).select("doc_id", "n_chars", words().alias("w"))
    return docs.select("doc_id", F.array(F.col("n_chars").cast("double"), F.size("w").cast("double"), F.size(F.array_distinct("w")).cast("double")).alias("relation"))


def vector_of(rows: DataFrame, vec_id: int) -> list[float]:
    return list(rows.filter(F.col("vec_id") == vec_id).head()["embedding"])


def r(c: Column | str, places: int = PLACES) -> Column:
    return F.round(c, places) + F.lit(0.0)  # no negative zeros


def _distance(function):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = embeddings(spark, sf)
        return rows.select("vec_id", r(function(F.col("embedding"), V.vector(vector_of(rows, 0)))).alias("distance"))

    return query


def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Means per label, as single values differ between engines in their last single-precision bits."""
    rows = embeddings(spark, sf).select("label", V.l2_normalized(F.transform("embedding", lambda x: x * 3)).cast("array<double>").alias("e"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), r(F.avg(V.total(F.col("e"))), 4).alias("total"), r(F.avg(F.get("e", F.lit(0))), 4).alias("first"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = embeddings(spark, sf)
    left = rows.select(F.col("vec_id").alias("a"), V.l2_normalized(F.col("embedding")).alias("l"), F.col("label").alias("la"))
    right = rows.select((F.col("vec_id") - 1).alias("a"), V.l2_normalized(F.col("embedding")).alias("r"), F.col("label").alias("lb"))
    return left.join(right, "a").select("a", (F.col("la") == F.col("lb")).cast("int").alias("y"), *[c.alias(n) for n, c in V.pair_features(F.col("l"), F.col("r")).items()])


def pair_features(spark: SparkSession, sf: str) -> DataFrame:
    mean = lambda n: r(F.avg(V.total(F.col(n).cast("array<double>"))), 4)
    names = dict(zip(("cosine", "absolute", "product", "residual", "full"), pair_benchmark.FEATURES, strict=True))
    return _pairs(spark, sf).groupBy("y").agg(F.count("*").alias("n"), *[mean(f).alias(n) for n, f in names.items()], F.max(F.size("Full pair")).alias("width"))


def _columns() -> list[Column]:
    return [F.get("relation", F.lit(i)) for i in range(RELATIONS)]


def robust_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = percentiles(coordinates(spark, sf), _columns(), (0.25, 0.5, 0.75))
    rows = [(i, q25, q50, q75, max(q75 - q25, 1.0)) for i, (q25, q50, q75) in enumerate(found)]
    return spark.createDataFrame(rows, "relation int, q25 double, median double, q75 double, scale double")


def robust_scaled(spark: SparkSession, sf: str) -> DataFrame:
    rows = coordinates(spark, sf)
    median, scale = robust_scale(rows, _columns())
    z = rows.select("doc_id", "relation", V.scaled(F.col("relation"), median, scale).alias("z"))
    back = V.unscaled(F.col("z"), median, scale)
    return z.select("doc_id", *[r(F.get("z", F.lit(i))).alias(f"z{i}") for i in range(RELATIONS)], *[r(F.get(back, F.lit(i)), 3).alias(f"c{i}") for i in range(RELATIONS)])


def training(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings(spark, sf).join(coordinates(spark, sf).withColumnRenamed("doc_id", "vec_id"), "vec_id")


def _moments(spark: SparkSession, sf: str):
    rows = training(spark, sf)
    d = rows.select(F.size("embedding")).head()[0]
    n, sums, _, _ = cross_products(rows, "embedding", "relation", d)
    _, _, gram, cross = cross_products(rows, "embedding", "relation", d, sums[:d] / n, sums[d:] / n)
    return gram, cross


def gram_matrix(spark: SparkSession, sf: str) -> DataFrame:
    gram, _ = _moments(spark, sf)
    return spark.createDataFrame([(i, j, round(float(v), PLACES)) for (i, j), v in np.ndenumerate(gram)], "i int, j int, value double")


def cross_product(spark: SparkSession, sf: str) -> DataFrame:
    _, cross = _moments(spark, sf)
    return spark.createDataFrame([(i, j, round(float(v), 3)) for (i, j), v in np.ndenumerate(cross)], "i int, j int, value double")


def planar_model(spark: SparkSession, sf: str) -> Projection:
    characters = read(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.array(F.col("n_chars").cast("double")).alias("relation"))
    return Projection.fit(planar(spark, sf).join(characters, "vec_id"), alpha=1.0, relation_names=["characters"])


def ridge_fit_2d(spark: SparkSession, sf: str) -> DataFrame:
    p = planar_model(spark, sf)
    row = [float(v) for v in (*p.coefficients[0], p.intercept[0], p.relation_median[0], p.relation_scale[0])]
    return spark.createDataFrame([[round(v, PLACES) for v in row]], "w1 double, w2 double, b double, median double, scale double")


def ridge_fit_residual(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the fitted coefficients of all dimensions solve the normal equations."""
    rows = training(spark, sf)
    p = Projection.fit(rows, alpha=1.0)
    d = p.dimensions
    z = rows.select("embedding", p.scaled(F.col("relation")).alias("z"))
    n, sums, _, _ = cross_products(z, "embedding", "z", d)
    _, _, gram, cross = cross_products(z, "embedding", "z", d, sums[:d] / n, sums[d:] / n)
    off = np.abs((gram + np.eye(d)) @ p.coefficients.T - cross).max()
    return spark.createDataFrame([(d, RELATIONS, bool(off < 1e-8))], "dimensions int, relations int, solved boolean")


def fixed_projection(d: int) -> Projection:
    w = [[math.sin((i + 1) * (j + 1)) for i in range(d)] for j in range(RELATIONS)]
    return Projection(w, [0.5 * j for j in range(RELATIONS)], [0.0] * RELATIONS, [1.0] * RELATIONS, [0.0] * d, 1.0, tuple("abc"))


def project(spark: SparkSession, sf: str) -> DataFrame:
    rows = embeddings(spark, sf)
    found = fixed_projection(rows.select(F.size("embedding")).head()[0]).project(rows.select("vec_id", "embedding"))
    return found.select("vec_id", *[r(F.get("relation", F.lit(i))).alias(f"r{i}") for i in range(RELATIONS)])


def project_independent(spark: SparkSession, sf: str) -> DataFrame:
    rows = embeddings(spark, sf)
    p = fixed_projection(rows.select(F.size("embedding")).head()[0])
    return rows.select("vec_id", *[r(V.dot(F.col("embedding"), V.vector(p.coefficients[i])) + float(p.intercept[i])).alias(f"r{i}") for i in range(RELATIONS)])


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select(*[c for c in hits.columns if not c.endswith("distance")], r("relation_distance").alias("relation_distance"), r("cosine_distance").alias("cosine_distance"))


def _search(**options):
    """All dimensions, by a projection whose coefficients SQL can work out."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = embeddings(spark, sf)
        source = vector_of(rows, 0)
        return _hits(search(fixed_projection(len(source)), source, rows, k=10, **options))

    return query


def search_multi_source(spark: SparkSession, sf: str) -> DataFrame:
    rows = embeddings(spark, sf)
    p = fixed_projection(rows.select(F.size("embedding")).head()[0])
    return _hits(search_many(p, rows.filter("vec_id % 20 = 0"), rows, k=5, candidate_pool=40))


def whole_model(spark: SparkSession, sf: str) -> Projection:
    """Fitted to all three relations on all dimensions."""
    return Projection.fit(training(spark, sf), alpha=1.0, relation_names=["characters", "words", "distinct_words"])


def ridge_fit_whole(spark: SparkSession, sf: str) -> DataFrame:
    p = whole_model(spark, sf)
    values = zip(p.coefficients, p.intercept, p.relation_median, p.relation_scale, strict=True)
    rows = [(i, [round(float(v), PLACES) for v in w], *[round(float(v), PLACES) for v in rest]) for i, (w, *rest) in enumerate(values)]
    return spark.createDataFrame(rows, "relation int, w array<double>, b double, median double, scale double")


def _search_whole(**options):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = embeddings(spark, sf)
        return _hits(search(whole_model(spark, sf), vector_of(rows, 0), rows, k=10, **options))

    return query


def search_whole_multi_source(spark: SparkSession, sf: str) -> DataFrame:
    rows = embeddings(spark, sf)
    return _hits(search_many(whole_model(spark, sf), rows.filter("vec_id % 20 = 0"), rows, k=5, candidate_pool=40))


def coordinate_search_true(spark: SparkSession, sf: str) -> DataFrame:
    rows = coordinates(spark, sf)
    median, scale = robust_scale(rows, _columns())
    z = rows.select("doc_id", V.scaled(F.col("relation"), median, scale).alias("z"))
    source = V.vector(z.filter("doc_id = 0").head()["z"])
    far = z.filter("doc_id <> 0").select("doc_id", V.chebyshev(F.col("z"), source).alias("distance"))
    top = far.orderBy("distance", "doc_id").limit(20)
    return top.select("doc_id", r("distance").alias("distance"), F.row_number().over(Window.orderBy("distance", "doc_id")).alias("rank"))


def _sides(spark: SparkSession, sf: str) -> DataFrame:
    rows = training(spark, sf)
    median, scale = robust_scale(rows.filter("vec_id % 5 < 3"), _columns())
    p = fixed_projection(rows.select(F.size("embedding")).head()[0])
    return p.project(rows.select("vec_id", "embedding", F.get("relation", F.lit(1)).cast("long").alias("tokens"), V.scaled(F.col("relation"), median, scale).alias("true")), into="predicted").withColumnRenamed("vec_id", "index")


def _dealt(total: int):
    na, nb = (F.col("query_index") * 7 + F.col("pair_order") * 13) % total + 1, (F.col("query_index") * 11 + F.col("pair_order") * 17 + 1) % total + 1
    return lambda asked: asked.withColumn("na", na).withColumn("nb", nb)


def hard_pairs(sides: DataFrame, deal=None) -> DataFrame:
    """Up to four pairs of train rows per test row, ordered by their true distance from it; ``deal`` adds the places (na, nb)
    of a pair's rows among the train rows."""
    train = running_sum(sides.filter("index % 5 < 3").select("index", "true"), ["index"], F.lit(1), "n").select(F.col("n") + 1, "index", "true").toDF("n", "index", "true")
    deal = deal or _dealt(sides.filter("index % 5 < 3").count())
    asked = sides.filter("index % 5 = 4").select(F.col("index").alias("query_index"), F.col("true").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pair_order"))
    asked = deal(asked).filter("na <> nb AND (query_index % 10 <> 9 OR pair_order < 2)")
    both = asked.join(train.toDF("na", "a", "ta"), "na").join(train.toDF("nb", "b", "tb"), "nb")
    first = F.struct(V.chebyshev(F.col("ta"), F.col("q")), F.col("a")) <= F.struct(V.chebyshev(F.col("tb"), F.col("q")), F.col("b"))
    return both.select("query_index", "pair_order", F.when(first, F.col("a")).otherwise(F.col("b")).alias("closer_index"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("farther_index"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    sides = _sides(spark, sf).cache()
    return hard_negatives.query_scores(hard_pairs(sides), sides.filter("index % 5 = 4"), sides.filter("index % 5 < 3"))


def hard_negative_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).select("query_index", "pairs", *[r(m).alias(m) for m in hard_negatives.METHODS])


def hard_negative_decision(spark: SparkSession, sf: str) -> DataFrame:
    d = hard_negatives.decision(_scores(spark, sf))
    means = [r(F.col("query_equal_weighted_accuracy")[m]).alias(m) for m in hard_negatives.METHODS]
    return d.select(*means, "queries_with_pairs", "queries_without_pairs", r("raw_best").alias("raw_best"), F.concat_ws(",", "raw_best_methods").alias("raw_best_methods"), r("gap").alias("gap"), "threshold", "outcome")


def pair_prefix_offsets(spark: SparkSession, sf: str) -> DataFrame:
    counts = hard_pairs(_sides(spark, sf).cache()).groupBy("query_index").agg(F.count("*").alias("pair_count"))
    return hard_negatives.offsets(counts)


def ranks_and_winner(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "source", "n_chars", F.size(words()).alias("n_words"))
    return docs.select("doc_id", stable_rank("n_chars", "doc_id", by=("source",)).alias("rank"), winner(F.col("n_chars"), F.col("n_words") * 6).alias("winner"))


def manifest_join(spark: SparkSession, sf: str) -> DataFrame:
    labels, docs = read(spark, sf, "labels"), read(spark, sf, "documents")
    pairs = labels.select("doc_id", (F.col("doc_id") + 1).alias("other"), "quality")
    side = docs.select("doc_id", F.col("n_chars").alias("n"))
    return pairs.join(side.toDF("doc_id", "left_chars"), "doc_id").join(side.toDF("other", "right_chars"), "other").select("doc_id", "other", "quality", "left_chars", "right_chars")


def manifest_missing(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_anti")


def split_overlap(spark: SparkSession, sf: str) -> DataFrame:
    e, label = read(spark, sf, "embeddings").select("vec_id"), read(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"))
    return e.intersect(label)


def union_train_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "embeddings").select("vec_id", "label", F.when(F.col("vec_id") % 5 < 3, "train").when(F.col("vec_id") % 5 == 3, "validation").otherwise("test").alias("split"))
    both = rows.filter("split = 'train'").unionByName(rows.filter("split = 'validation'"))
    return both.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("label").alias("labels"))


def contract_report_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    contracts = docs.groupBy("lang", "source").agg(F.count("*").alias("n")).select(
        F.concat_ws("/", "lang", "source").alias("contract_sha256"), F.lit(1).cast("long").alias("schema_version"), F.lit("p").alias("provider"), F.col("lang").alias("model"), F.lit("u").alias("base_url"),
        (F.length("source") % 2).cast("long").alias("truncate"), F.lit("none").alias("normalization"), F.lit("float32").alias("stored_dtype"))
    cached = docs.join(read(spark, sf, "labels").filter("toxic = 1"), "doc_id").select(F.concat_ws("/", "lang", "source").alias("contract_sha256"), F.col("doc_id").alias("text_sha256"), F.col("n_chars").alias("dimension"))
    return contract_report(contracts, cached).select("contract_sha256", "model", "truncate", "rows", "minimum_dimension", "maximum_dimension")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "n_chars")
    return read(spark, sf, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), ((F.col("n_chars") * 37 + F.col("doc_id") * 11 + F.col("quality") * 41) % 101 / 100.0).alias("p"))


def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.binary_metrics(_scored(spark, sf))
    return found.select(*[r(c).alias(c) for c in found.columns])


def alpha_select(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scored(spark, sf)
    alphas = F.explode(F.array(*[F.lit(a) for a in pair_benchmark.ALPHAS])).alias("alpha")
    scores = rows.select(F.concat(F.lit("m"), (F.col("doc_id") % 4).cast("string")).alias("name"), alphas, "y", "p").groupBy("name", "alpha").agg(F.avg(((F.col("p") >= F.round(F.lit(0.4) + F.col("alpha") * 20, 1)).cast("int") == F.col("y")).cast("double")).alias("score"))
    return metrics.best_alpha(scores.withColumn("score", F.round("score", 2))).select("name", "alpha", "score")


def hashes(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return docs.select("doc_id", integrity.text_sha256(F.col("text")).alias("text_sha256"), integrity.row_array_sha256(F.col("text").cast("binary"), "uint8", 5).alias("array_sha256"))


#: name, source, and the three measures worked out by hand; null where the source can't be measured.
SNIPPETS = (
    ("guarded", "def f(v):\n    if v and helper(v):\n        return client.send(v)\n    return helper(v)\n", (3, 1, 2)),
    ("nested", "def f(v):\n    def g(x):\n        if x:\n            return h(x)\n    return g(v)\n", (1, 0, 1)),
    ("elif", "def f(a, b):\n    if a:\n        g()\n    elif b:\n        h()\n    else:\n        k()\n", (3, 1, 3)),
    ("else_if", "def f(a, b):\n    if a:\n        g()\n    else:\n        if b:\n            h()\n", (3, 2, 2)),
    ("comprehension", "def f(a):\n    return [p(x) for x in q(a) if x and r(x)]\n", (4, 1, 3)),
    ("two_generators", "def f(a):\n    return {y for x in a for y in x}\n", (3, 2, 0)),
    ("match", "def f(a):\n    match a:\n        case 1:\n            return g()\n        case 2:\n            return h()\n        case _:\n            return None\n", (3, 1, 2)),
    ("try", "def f():\n    try:\n        g()\n    except A:\n        h()\n    except B:\n        pass\n", (3, 1, 2)),
    ("dynamic", "def f(a, b):\n    return a[0]() + b()()\n", (1, 0, 2)),
    ("ternary", "def f(a, x):\n    return g() if a else x.g()\n", (2, 0, 1)),
    ("async", "async def f(a):\n    async with a as b:\n        async for c in b:\n            await c.go()\n", (2, 2, 1)),
    ("lambda", "def f(a):\n    return map(lambda x: h(x) if x else 0, a)\n", (1, 0, 1)),
    ("while", "def f(a):\n    while a:\n        g()\n    else:\n        h()\n", (2, 1, 2)),
    ("none", "x = 1\n", (None, None, None)),
    ("two", "def f(): pass\ndef g(): pass\n", (None, None, None)),
    ("broken", "def f(:\n", (None, None, None)),
)


def python_structure(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(n, s) for n, s, _ in SNIPPETS], "name string, source string")
    measured = rows.select("name", structure_column(F.col("source")).alias("s"))
    return measured.select("name", *[F.col(f"s.{n}").alias(n) for n in NAMES], F.col("s.error").isNotNull().alias("failed"))


def pair_benchmark_query(spark: SparkSession, sf: str) -> DataFrame:
    table = _pairs(spark, sf).withColumn("split", F.when(F.col("a") % 5 < 3, "train").when(F.col("a") % 5 == 3, "validation").otherwise("test"))
    scores = pair_benchmark.evaluate(table.withColumn("example_id", F.col("a").cast("string")), 118)
    return spark.createDataFrame([tuple(vars(s).values()) for s in scores], "name string, selected_alpha double, validation_balanced_accuracy double, accuracy double, balanced_accuracy double, f1 double, roc_auc double, log_loss double")


def mean_pooling(spark: SparkSession, sf: str) -> DataFrame:
    """Masked means of neighbouring vectors, which stand for the token states of a text."""
    rows = embeddings(spark, sf).select((F.col("vec_id") / 4).cast("long").alias("g"), F.struct("vec_id", "embedding").alias("t"))
    grouped = rows.groupBy("g").agg(F.array_sort(F.collect_list("t")).alias("t"))
    pooled = V.mean_pooled(F.col("t.embedding"), F.transform("t.vec_id", lambda i: (i % 3 != 0).cast("double")))
    return grouped.select("g", r(V.total(pooled)).alias("total"), r(F.get(pooled, F.lit(0))).alias("first"))


QUERIES = {
    "cosine_distance": _distance(V.cosine_distance),
    "cosine_distance_eps": _distance(V.cosine_distance_eps),
    "euclidean": _distance(V.euclidean),
    "chebyshev": _distance(V.chebyshev),
    "l2_normalize": l2_normalize,
    "pair_features": pair_features,
    "robust_stats": robust_stats,
    "robust_scale": robust_scaled,
    "gram_matrix": gram_matrix,
    "cross_product": cross_product,
    "ridge_fit_2d": ridge_fit_2d,
    "ridge_fit_residual": ridge_fit_residual,
    "project": project,
    "project_independent": project_independent,
    "search_topk": _search(),
    "search_exclude": _search(exclude_index=0),
    "search_candidate_pool": _search(exclude_index=0, candidate_pool=100),
    "search_multi_source": search_multi_source,
    "coordinate_search_true": coordinate_search_true,
    "hard_negative_scores": hard_negative_scores,
    "hard_negative_decision": hard_negative_decision,
    "pair_prefix_offsets": pair_prefix_offsets,
    "ranks_and_winner": ranks_and_winner,
    "manifest_join": manifest_join,
    "manifest_missing": manifest_missing,
    "split_overlap": split_overlap,
    "union_train_validation": union_train_validation,
    "contract_report": contract_report_query,
    "binary_metrics": binary_metrics,
    "alpha_select": alpha_select,
    "hashes": hashes,
    "python_structure": python_structure,
    "pair_benchmark": pair_benchmark_query,
    "mean_pooling": mean_pooling,
}
#: Fits and searches on whole embeddings: they have no closed SQL and are tested by brute force.
WHOLE = {
    "ridge_fit_whole": ridge_fit_whole,
    "search_whole_topk": _search_whole(),
    "search_whole_exclude": _search_whole(exclude_index=0),
    "search_whole_candidate_pool": _search_whole(exclude_index=0, candidate_pool=100),
    "search_whole_multi_source": search_whole_multi_source,
}
