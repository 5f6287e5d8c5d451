"""Best-fit packing of documents into sequences, improved by swaps.

What is packed are lengths, and there are at most ``capacity`` of those. So the packing is planned on their histogram
(a table of that bounded size) as bin patterns with multiplicities: best fit in decreasing order, then a local search
that drains the emptiest underfull bins into others by moves and exchanges, as long as the sum of squared fills grows,
until they are gone. Each piece then finds its sequence by its rank among the pieces of its length, so no task ever holds
more than a slice of the pieces.

Defined cases: a null or empty text is the closing id alone; a text longer than a sequence is cut so that all of its
pieces but the first are full; pieces of equal length are interchangeable, and rank by partition, id, piece, start and
hash; repeated rows are packed as separate documents; an empty table gives no pieces; only
the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import small_batches, stored, table

CAPACITY = 1024
CLOSING_ID = 2

Pattern = tuple[int, ...]


def best_fit(histogram: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """Best fit in decreasing order of length, for all pieces of a length at once."""
    rooms: dict[int, dict[Pattern, int]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = next((r for r in range(length, capacity) if rooms.get(r)), capacity)
            each = room // length
            if room < capacity:
                pattern, bins = next(iter(rooms[room].items()))
            else:
                pattern, bins = (), -(-left // each)
            used = min(bins, left // each)
            if not used:  # the last bin gets fewer
                used, each = 1, left
            if room < capacity:
                if bins == used:
                    del rooms[room][pattern]
                else:
                    rooms[room][pattern] = bins - used
            grown, rest = pattern + (length,) * each, room - each * length
            into = rooms.setdefault(rest, {})
            into[grown] = into.get(grown, 0) + used
            left -= used * each
    return {p: n for r in rooms.values() for p, n in r.items()}


class _Underfull:
    """Underfull patterns by what they can give back: for each sum z of ``taken`` of their pieces, the rooms of those that
    hold such pieces. Lists are bounded by the capacity, whatever the number of patterns."""

    def __init__(self, capacity: int, taken: int):
        self.capacity, self.taken = capacity, taken
        self.patterns: dict[tuple[int, int], dict[Pattern, None]] = {}
        self.has = np.zeros((capacity + 1, capacity + 1), bool)
        self.none = 2 * capacity + 1
        self.next = np.full((capacity + 1, capacity + 1), self.none, np.int32)
        self.stale: set[int] = set()

    def gives(self, pattern: Pattern) -> set[int]:
        """Sums of one piece (or of none: a move), or of two."""
        if self.taken == 1:
            return {0, *pattern}
        many = [x for i, x in enumerate(pattern) if pattern[:i].count(x) < 2]
        return {many[i] + many[j] for i in range(len(many)) for j in range(i)}

    def add(self, pattern: Pattern) -> None:
        room = self.capacity - sum(pattern)
        for z in self.gives(pattern):
            own = self.patterns.setdefault((z, room), {})
            own[pattern] = None
            if not self.has[z, room]:
                self.has[z, room] = True
                self.stale.add(z)

    def remove(self, pattern: Pattern) -> None:
        room = self.capacity - sum(pattern)
        for z in self.gives(pattern):
            own = self.patterns[z, room]
            del own[pattern]
            if not own:
                del self.patterns[z, room]
                self.has[z, room] = False
                self.stale.add(z)

    def best(self, size: int, least: int) -> tuple[int, int, int]:
        """(room left, z, room) of the fullest bin that taking ``size`` for z can make, z from ``least`` up to size - 1;
        of equals the one that gains most."""
        if self.stale:
            rows = np.array(sorted(self.stale))
            room = np.where(self.has[rows], np.arange(self.capacity + 1, dtype=np.int32), self.none)
            self.next[rows] = np.minimum.accumulate(room[:, ::-1], axis=1)[:, ::-1]
            self.stale.clear()
        z = np.arange(least, size)
        if not len(z):
            return self.none, 0, 0
        room = self.next[z, size - z]
        left = room - (size - z)
        i = int(np.argmin(left))
        return (int(left[i]), int(z[i]), int(room[i])) if room[i] < self.none else (self.none, 0, 0)


def local_search(bins: dict[Pattern, int], capacity: int) -> dict[Pattern, int]:
    """Empty underfull bins: the emptiest one gives pieces to others, by the move, exchange of one for one, of two for one
    or of one for two that leaves the least room in the other, as long as the sum of squared fills grows by it.

    Bins of one pattern take a step together. The sum strictly grows, so the search ends: when no underfull bin has a
    step left, or when the pieces could not fill fewer bins.
    """
    bins = dict(bins)
    least = -(-sum(sum(p) * n for p, n in bins.items()) // capacity)
    ones, twos = _Underfull(capacity, 1), _Underfull(capacity, 2)
    queue: list[tuple[int, Pattern]] = []
    count = sum(bins.values())

    def show(pattern: Pattern) -> None:
        if sum(pattern) < capacity:
            ones.add(pattern)
            twos.add(pattern)

    def hide(pattern: Pattern) -> None:
        if sum(pattern) < capacity:
            ones.remove(pattern)
            twos.remove(pattern)

    def change(pattern: Pattern, n: int) -> None:
        if not pattern:
            return
        before = bins.get(pattern, 0)
        bins[pattern] = before + n
        if not bins[pattern]:
            del bins[pattern]
            hide(pattern)
        elif not before:
            show(pattern)
            if sum(pattern) < capacity:
                heapq.heappush(queue, (sum(pattern), pattern))

    def step(low: Pattern) -> bool:
        nonlocal count
        alone = bins[low] == 1
        if alone:
            hide(low)
        outs = {x + y: (x, y) for i, x in enumerate(low) if low[:i].count(x) < 2 for y in {*low[i + 1 :]}} | {x: (x,) for x in low}
        found = [(ones.best(size, len(out) - 1), size, out, ones) for size, out in outs.items()]
        found += [(twos.best(x, 1), x, (x,), twos) for x in set(low)]
        (left, z, room), size, out, table = min(found, key=lambda f: (f[0][0], f[0][1] - f[1], f[2]), default=((ones.none, 0, 0), 0, (), ones))
        high = next(iter(table.patterns[z, room])) if left < capacity - sum(low) else None
        if alone:
            show(low)
        if high is None:
            return False
        back = () if not z else (z,) if table is ones else _pair(high, z)
        n = bins[low] // 2 if high == low else min(bins[low], bins[high])
        new_low, new_high = list(low), list(high)
        for x in out:
            new_low.remove(x)
        for y in back:
            new_high.remove(y)
        new_low, new_high = (tuple(sorted(p, reverse=True)) for p in (new_low + list(back), new_high + list(out)))
        change(low, -n)
        change(high, -n)
        change(new_low, n)
        change(new_high, n)
        count -= 0 if new_low else n
        return True

    for p in list(bins):
        show(p)
    moved = True
    while moved:  # what found no step may find one among the bins as they are after others' steps
        moved = False
        queue[:] = sorted((sum(p), p) for p in bins if sum(p) < capacity)
        while queue and count > least:
            _, low = heapq.heappop(queue)
            while low in bins and count > least and step(low):
                moved = True
                if queue and queue[0][0] < sum(low):
                    if low in bins:
                        heapq.heappush(queue, (sum(low), low))
                    break
    return bins


def _pair(pattern: Pattern, total: int) -> Pattern:
    """Two pieces of this sum."""
    for i, x in enumerate(pattern):
        if total - x in pattern[i + 1 :]:
            return x, total - x
    raise ValueError(total)


def _pieces(batches: Iterator[pa.RecordBatch], ranks: str, capacity: int, closing: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = np.append(tokens.ids(ranks, text or ""), np.uint32(closing)).astype("<u4")
            start = 0
            for piece in range(-(-len(found) // capacity)):
                end = start + ((len(found) - 1) % capacity + 1 if not piece else capacity)
                out.append((key, piece, start, end - start, zlib.crc32(found[start:end].tobytes())))
                start = end
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def pack(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None, capacity: int = CAPACITY, closing: int = CLOSING_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. ``ranks``: vocabulary file."""
    ranks = ranks or tokens.ranks_path()
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = rows.mapInArrow(lambda it: _pieces(it, ranks, capacity, closing), "doc_id long, piece int, start long, length long, ids_crc32 long")
    found = stored(found.withColumn("part", F.spark_partition_id()), spark)

    counts = stored(found.groupBy("length", "part").agg(F.count("*").alias("n")), spark)
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    bins = local_search(best_fit(histogram, capacity), capacity)
    runs, at, base = [], dict.fromkeys(histogram, 0), 0
    for pattern, n in sorted(bins.items()):
        offset = 0
        for length in pattern:
            runs.append((length, at[length], at[length] + n, base - at[length], offset))
            at[length] += n
            offset += length
        base += n
    runs_by_length: dict[int, list] = {}
    for length, *rest in runs:
        runs_by_length.setdefault(length, []).append(rest)
    lookup = {k: np.array(v, np.int64) for k, v in runs_by_length.items()}

    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = found.withColumn("rank", F.row_number().over(order)).join(before, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") - 1 + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length):
                mine, run = np.flatnonzero(length == one), lookup[int(one)]
                i = np.searchsorted(run[:, 0], rank[mine], side="right") - 1
                seq[mine], off[mine] = run[i, 2] + rank[mine], run[i, 3]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
