"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, scaled by its quality weight: -ln(u) / weight, smallest first. Within a source
documents stand in the order of their keys, and prefix sums of their sizes fill the source's budget: complete epochs
take every document, and what is left of the budget goes to the first documents of the order, the last of them in part.

A source may hold most rows, so no task gets a source as a whole: rows are range-partitioned by (source, key), each
partition reports a sum per source that it holds (partitions + sources rows in all), and the running sums start there.

Defined cases: a null or empty text has size 0 and is taken 0 words; a null source is a source of its own, last in
order; a null or non-positive quality weight counts as the least weight; equal keys are ordered by id and size, and
rows equal in these are interchangeable; a source without words has target 0; an empty table gives no rows; over
MOST_SOURCES sources are an error. Columns other than those named are carried along untouched by ``mix_documents``.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, checkpointed, mix, numbered, small_batches, steps, stored, table, unclear, word_spans

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_EPOCHS = 2.0
SEED = 20240501
#: Sources whose sizes and targets the driver plans: a row each, and one for each that goes on in another partition.
MOST_SOURCES = 200_000
#: Quality weights lie between this and 1.
LEAST_WEIGHT = 0.05


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> list[float]:
    """Split ``share`` of all sizes by weights (repeating); what exceeds ``most`` times a source's size is shared
    again by weight among the others, until no target exceeds it."""
    limit = [most * s for s in sizes]
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    budget, full, found = share * sum(sizes), set(), [0.0] * len(sizes)
    while len(full) < len(sizes):
        open_ = [i for i in range(len(sizes)) if i not in full]
        rest = budget - sum(limit[i] for i in full)
        total = sum(weight[i] for i in open_)
        found = [limit[i] if i in full else rest * weight[i] / total for i in range(len(sizes))]
        over = {i for i in open_ if found[i] > limit[i]}
        if not over:
            break
        full |= over
        found = [limit[i] if i in full else x for i, x in enumerate(found)]
    return found


def _quality(t: Texts, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A weight from the share of letters (bytes that are ASCII letters or not ASCII) among a text's non-space bytes."""
    data = t.data[: t.n]
    letter = ((data | 32) - np.uint8(97) < 26) | (data >= 128)
    sums = np.concatenate([[0], np.cumsum(letter)])
    solid = np.concatenate([[0], np.cumsum(ends - starts)])
    per = sums[t.at[1:]] - sums[t.at[:-1]]
    return np.maximum(LEAST_WEIGHT, (per / np.maximum(solid[rows[1:]] - solid[rows[:-1]], 1)) ** 2)


def _features(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in steps(b.column("text")):
            starts, ends, rows = word_spans(t)
            size = np.diff(rows)
            key = b.column("doc_id").slice(t.lo, t.hi - t.lo)
            ids = key.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            u = (mix(mix(ids + np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(seed)) >> np.uint64(11)).astype(np.float64)
            u = (u + 0.5) / 2.0**53
            own = b.column("weight").slice(t.lo, t.hi - t.lo).to_numpy(zero_copy_only=False).astype(np.float64)
            weight = np.where(np.isnan(own), _quality(t, starts, ends, rows), np.maximum(own, LEAST_WEIGHT))
            yield pa.RecordBatch.from_arrays(
                [key, b.column("source").slice(t.lo, t.hi - t.lo), pa.array(size.astype(np.int64)), pa.array(-np.log(u) / weight)],
                ["doc_id", "source", "size", "key"],
            )


def mix_sources(
    spark: SparkSession,
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight: str | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, source, size, key, source_size, target, taken. ``weight`` names a column of
    quality weights; without it they come from the texts."""
    small_batches(spark)
    quality = F.col(weight).cast("double") if weight else F.lit(None).cast("double")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"), F.coalesce(quality, F.lit(LEAST_WEIGHT) if weight else quality).alias("weight"))
    found = stored(rows.mapInArrow(lambda it: _features(it, seed), "doc_id long, source string, size long, key double"), spark)

    if found.select("source").distinct().limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"targets are planned for {MOST_SOURCES} sources at most")
    per_source = [(r["source"], r["size"]) for r in found.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    per_source.sort(key=lambda x: (x[0] is None, x[0] or ""))
    size_of = dict(per_source)
    target_of = dict(zip(size_of, targets(list(size_of.values()), weights, share, most), strict=True))

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["source", "key", "doc_id", "size"]
    ordered = checkpointed(found.repartitionByRange(n, *order).sortWithinPartitions(*order), spark)
    sums = ordered.groupBy(F.spark_partition_id().alias("part"), "source").agg(F.sum("size").alias("size")).collect()
    before: dict[tuple[int, str | None], int] = {}
    run: dict[str | None, int] = {}
    for r in sorted(sums, key=lambda r: r["part"]):
        before[r["part"], r["source"]] = run.get(r["source"], 0)
        run[r["source"]] = run.get(r["source"], 0) + r["size"]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), {}
        for b in batches:
            size, names = b.column("size").to_numpy(), b.column("source")
            taken, total, target = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), np.zeros(len(size))
            codes = names.dictionary_encode(null_encoding="encode")
            index = codes.indices.to_numpy()
            for i, name in enumerate(codes.dictionary.to_pylist()):
                mine = index == i
                begun = at.get(name, before[part, name])
                upto = begun + np.cumsum(size[mine])
                at[name] = int(upto[-1])
                whole = size_of[name]
                epochs = int(target_of[name] // whole) if whole else 0
                budget = round(target_of[name] - epochs * whole) if whole else 0
                taken[mine] = epochs * size[mine] + np.clip(budget - (upto - size[mine]), 0, size[mine])
                total[mine], target[mine] = whole, target_of[name]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total), pa.array(target), pa.array(taken)], [*b.schema.names, "source_size", "target", "taken"])

    return ordered.mapInArrow(take, "doc_id long, source string, size long, key double, source_size long, target double, taken long")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def mix_documents(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` as the mix takes them: a document stands once for each time it is taken, its text cut after the last
    word taken where that is part of it; documents that aren't taken are gone. Where ids are null or repeated, rows are
    documents of their own, told apart by a number that follows the order of ids."""
    rows, number = numbered(spark, docs, key, text) if unclear(docs.select(F.col(key).cast("long"))) else (docs, key)
    taken = mix_sources(spark, rows, number, text, source, **options).filter("taken > 0").select("doc_id", "size", "taken")
    names, at = docs.columns, docs.columns.index(text)
    own = rows.select(rows[number].cast("long").alias("doc_id"), F.struct(*[rows[c] for c in names]).alias("row"))

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = b.column("row").flatten()
            row, texts = [], []
            for i, (body, size, left) in enumerate(zip(columns[at].to_pylist(), *[b.column(c).to_pylist() for c in ("size", "taken")], strict=True)):
                while left > 0:
                    row.append(i)
                    texts.append(body if left >= size else _first_words(body, left))
                    left -= size
            out = [c.take(pa.array(row, pa.int64())) for c in columns]
            yield pa.RecordBatch.from_arrays([*out[:at], pa.array(texts, pa.string()), *out[at + 1 :]], names)

    return own.join(taken, "doc_id").select("row", "size", "taken").mapInArrow(copies, docs.schema)


def _first_words(text: str, n: int) -> str:
    """``text`` up to the end of its n-th word."""
    words = re.finditer(r"[^\x20\x09-\x0D]+", text)
    return text[: next(itertools.islice(words, n - 1, None)).end()]
