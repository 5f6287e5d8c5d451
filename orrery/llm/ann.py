"""Approximate nearest neighbours by an inverted multi-index.

The halves of a vector are quantised separately, by centroids that are fitted on a bounded sample, about the square root
of the table's rows for each half; a pair of centroids is a cell, and every vector is an entry of one. A query sums its
inner products with the centroids of the halves. A heap walks the pairs from the largest sum down until their cells hold
FIRST entries, which are reranked exactly. The k-th best of them bounds what else can matter: by the covariances of
centroids and of residuals, entries that reach that score have sums about a regression value, and the walk goes on to
the cells whose sum is no more than SPREADS deviations below it; as all of those are reranked, it takes them row by row.
So few cells are visited where vectors cluster, and many where they don't; the rule is the same for every size of the
table, and aims at a share of neighbours instead of a number of entries.

Entries are dealt out in shards of about SHARD_ROWS, a large cell (copies of one vector, say) in several shards. A
shard's entries come first and its queries stream past them, so neither side is ever gathered as a whole.

Defined cases: vectors that are null, zero, hold a null or non-finite component, or differ in length from the most
common length take no part, as do rows without id; rows that repeat an id count once, with their least vector; fewer
candidates than k give shorter lists; equal scores are ranked by id; an empty table gives no rows; other columns aren't
read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, table

K = 20
#: Centroids of each half at most; the sample they are fitted on has at most SAMPLE_ROWS vectors.
MOST_CENTROIDS = 1_024
SAMPLE_ROWS = 20_000
FIRST = 1_000
#: 1.5 leaves out one in 15 of normally distributed sums.
SPREADS = 1.5
SHARD_ROWS = 4_096
#: Queries whose visits are written at a time.
VISITORS = 64


def _fit(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centroids of the rows of x, by Lloyd's rounds from a random start."""
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=k)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c**2).sum(axis=1), axis=1)


class Index:
    """Centroids of both halves, the residuals' covariance, and how many entries and shards each cell has."""

    def __init__(self, sample: np.ndarray, centroids: int):
        rng = np.random.default_rng(7)
        self.half = (sample.shape[1] + 1) // 2
        self.c = [_fit(h, centroids, rng) for h in (sample[:, : self.half], sample[:, self.half :])]
        cell = self.cells(sample)
        coarse = np.hstack([self.c[0][cell // len(self.c[1])], self.c[1][cell % len(self.c[1])]])
        rest = sample - coarse
        self.mean, self.rest_cov = coarse.mean(axis=0), rest.T @ rest / len(rest)
        self.cov = (coarse - self.mean).T @ (coarse - self.mean) / len(rest)
        self.count = self.shard = self.shards = None

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x[:, : self.half], self.c[0]) * len(self.c[1]) + _nearest(x[:, self.half :], self.c[1])

    def place(self, counts: dict[int, int]) -> None:
        """Number the shards: neighbouring cells share one, a large cell has several."""
        n = len(self.c[0]) * len(self.c[1])
        self.count = np.zeros(n, np.int64)
        self.count[list(counts)] = list(counts.values())
        self.shard, self.shards = np.zeros(n, np.int64), np.maximum(1, -(-self.count // SHARD_ROWS))
        now, room = 0, SHARD_ROWS
        for i in range(n):
            if self.count[i] > room:
                now, room = now + 1, SHARD_ROWS
            self.shard[i] = now
            room -= self.count[i]
            if self.shards[i] > 1:
                now, room = now + int(self.shards[i]), SHARD_ROWS

    def halves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of q's halves with the centroids; a cell's sum is one of each."""
        return self.c[0] @ q[: self.half], self.c[1] @ q[self.half :]

    def walk(self, q: np.ndarray, least: int) -> tuple[np.ndarray, float]:
        """Cells by the sum of their centroids' inner products with q, largest first, until they hold ``least`` entries, and
        the smallest sum among them; further cells of that very sum belong to them."""
        a, b = self.halves(q)
        i_of, j_of = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        heap, found, have, last = [(-(a[i_of[0]] + b[j_of[0]]), 0, 0)], [], 0, float("-inf")
        while heap and (have < least or -heap[0][0] >= last):
            top, i, j = heapq.heappop(heap)
            last = -top
            cell = int(i_of[i]) * len(b) + int(j_of[j])
            if self.count[cell]:
                found.append(cell)
                have += self.count[cell]
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[i_of[i]] + b[j_of[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i_of[i + 1]] + b[j_of[0]]), i + 1, 0))
        return np.array(found, np.int64), last

    def least(self, q: np.ndarray, bound: float) -> float:
        """The sum that entries of a score of ``bound`` or more are likely to reach."""
        own, rest, mean = q @ self.cov @ q, q @ self.rest_cov @ q, q @ self.mean
        both = own + rest
        least = mean + own / both * (bound - mean) - SPREADS * np.sqrt(own * rest / both) if both > 0 else float("-inf")
        return float(least) if np.isfinite(least) else float("-inf")

    def beyond(self, q: np.ndarray, least: float) -> np.ndarray:
        """All cells with entries whose sum is ``least`` or more: of each centroid of one half, in order, those of the other
        that reach it, until none does."""
        a, b = self.halves(q)
        i_of, j_of = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        slack = 1e-9 * (1 + abs(least)) if np.isfinite(least) else 0.0  # differences round otherwise than the sums do
        upto = np.searchsorted(-b[j_of], a[i_of] - least + slack, side="right")
        rows = int(np.searchsorted(-upto, 0, side="left"))  # as sums fall, so do the numbers that reach the least
        found = np.concatenate([i * len(b) + j_of[:n] for i, n in zip(i_of[:rows], upto, strict=False)]) if rows else np.zeros(0, np.int64)
        return found[(self.count[found] > 0) & (a[found // len(b)] + b[found % len(b)] >= least)]

    def shards_of(self, cells: np.ndarray) -> np.ndarray:
        """The shards that hold these cells' entries."""
        first, n = self.shard[cells], self.shards[cells]
        return np.unique(np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum())))


def _vectors(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _rerank(batches: Iterator[pa.RecordBatch], index: Index, k: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by shard, its entries first: each query's k best entries of the cells that it visits there, whose sums
    are ``low`` or more and below ``high``, but for those below its bound, which k others already exceed."""
    shard, parts, entries = None, [], None
    for b in batches:
        shards, is_query = b.column("shard").to_numpy(), b.column("is_query").to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero((shards[1:] != shards[:-1]) | (is_query[1:] != is_query[:-1])) + 1), len(shards)] if len(shards) else []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            part = b.slice(lo, hi - lo)
            if shards[lo] != shard:
                shard, parts, entries = shards[lo], [], None
            if not is_query[lo]:
                parts.append((part.column("id").to_numpy(), part.column("cell").to_numpy(), _vectors(part.column("vector"))))
                continue
            if entries is None and parts:
                ids, cell, x = (np.concatenate(c) for c in zip(*parts, strict=True))
                order = np.lexsort((ids, cell))
                entries = ids[order], np.ascontiguousarray(x[order]), *np.unique(cell[order], return_inverse=True)
            if entries is None:
                continue
            ids, x, cells, of = entries
            q = _vectors(part.column("vector"))
            out: list[list[np.ndarray]] = [[], [], []]
            rough = q @ x.T
            for i, (me, low, high, bound) in enumerate(zip(*[part.column(c).to_pylist() for c in ("id", "low", "high", "bound")], strict=True)):
                a, c = index.halves(q[i])
                sums = a[cells // len(c)] + c[cells % len(c)]
                pick = np.flatnonzero(((sums >= low) & (sums < high))[of] & (ids != me))
                if len(pick) > k:  # what can't be among the k best needs no exact score
                    s = rough[i, pick]
                    pick = pick[s >= np.partition(s, -k)[-k] - 1e-9 * (1 + np.abs(s).max())]
                score = (x[pick] * q[i]).sum(axis=1)
                pick, score = pick[score >= bound], score[score >= bound]
                best = np.lexsort((ids[pick], -score))[:k]
                out[0].append(np.full(len(best), me))
                out[1].append(ids[pick][best])
                out[2].append(score[best])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"])


def nearest(spark: SparkSession, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", is_query: str = "vec_id % 20 = 0", k: int = K, centroids: int | None = None, first: int = FIRST) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found; ``is_query`` is SQL over ``vec_id``."""
    small_batches(spark, 1000)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = stored(rows, spark)
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not size:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == size[0]["d"])
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").collect()])
    index = Index(sample, centroids or max(2, min(MOST_CENTROIDS, math.isqrt(size[0]["count"]))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(index.cells(x).astype(np.int64)), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "cell", "vector"])

    entries = stored(rows.mapInArrow(assign, "id long, cell long, vector binary"), spark)
    index.place({r["cell"]: r["count"] for r in entries.groupBy("cell").count().collect()})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, salt = b.column("cell").to_numpy(), b.column("salt").to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(index.shard[cell] + salt % index.shards[cell])], ["id", "cell", "vector", "shard"])

    dealt = entries.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(1 << 40))).mapInArrow(deal, "id long, cell long, vector binary, shard long")
    dealt = dealt.selectExpr("shard", "false AS is_query", "id", "cell", "vector", *[f"cast(null AS double) AS {c}" for c in ("low", "high", "bound")])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shards where a query's cells lie: the first visit's without a bound, else those that go on from them."""
        for b in batches:
            for lo in range(0, b.num_rows, VISITORS):
                part, shards, row, limits = b.slice(lo, VISITORS), [], [], []
                for i, (raw, bound) in enumerate(zip(*[part.column(c).to_pylist() for c in ("vector", "bound")], strict=True)):
                    q = np.frombuffer(raw, np.float64)
                    cells, last = index.walk(q, first)
                    low, high = (last, float("inf")) if bound is None else (index.least(q, bound), last)
                    own = index.shards_of(cells if bound is None else index.beyond(q, low)) if low < high else np.zeros(0, np.int64)
                    shards.append(own)
                    row.append(np.full(len(own), i))
                    limits.append((low, high, float("-inf") if bound is None else bound))
                row = np.concatenate(row)
                columns = [pa.array(np.concatenate(shards)), *[part.column(c).take(pa.array(row)) for c in ("id", "vector")], *[pa.array(np.array(c)[row]) for c in zip(*limits, strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "id", "vector", "low", "high", "bound"])

    def search(queries: DataFrame) -> DataFrame:
        asked = queries.mapInArrow(visit, "shard long, id long, vector binary, low double, high double, bound double")
        both = dealt.unionByName(asked.selectExpr("shard", "true AS is_query", "id", "cast(null AS long) AS cell", "vector", "low", "high", "bound"))
        both = both.repartition("shard").sortWithinPartitions("shard", "is_query")
        return both.mapInArrow(lambda it: _rerank(it, index, k), "query_id long, vec_id long, score double")

    queries = entries.filter(F.expr(is_query.replace("vec_id", "id"))).select("id", "vector", F.lit(None).cast("double").alias("bound"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found_first = stored(search(queries).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), spark)
    bound = found_first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("bound"))
    more = search(queries.drop("bound").join(bound.withColumnRenamed("query_id", "id"), "id", "left").select("id", "vector", F.coalesce("bound", F.lit(float("-inf"))).alias("bound")))
    found = found_first.select("query_id", "vec_id", "score").unionByName(more).dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_multi_index_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, table(spark, sf_dir, "embeddings"))
