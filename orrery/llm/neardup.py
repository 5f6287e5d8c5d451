"""Near-duplicates by a multi-index Hamming join of MinHash signatures, confirmed on full shingle sets.

A document is the set of its 5-word shingles; two are linked if the sets' Jaccard similarity is 0.75 or more.

1. Equal sets are one node, so copies never meet each other again.
2. A node's signature has 64 symbols of 16 bits (b-bit MinHash). At similarity 0.75 a symbol differs with probability
   1/4, so two linked nodes differ in more than 33 of 64 with probability of about 1e-6, and in far fewer cases above
   that similarity. The join finds *all* pairs at signature distance <= 33: split into 17 chunks, some chunk of such a
   pair has at most one error, and for each chunk every node enumerates the keys that leave one symbol out.
3. Keys of one node are dropped. Those of a few nodes give pairs, those of many give memberships, and the nodes of such
   a key are joined by scanning (``components.scan``), which emits at most one link per node and never all pairs. A key
   of more nodes than a task should hold links them all to one of them: more candidates than needed, and none lost.
4. Components of those links only collect candidates: within each one, links are confirmed on full shingle sets, again
   by scanning. Components with very many shingles are scanned in rounds over all executors instead of in one task.

Hot keys: a task's nodes that share a key often are linked to one of them before the shuffle, which alone goes on, so a
key that a third of all nodes have reaches its task as one row per many thousand nodes.

Defined cases: null and empty texts have no shingles and are linked with nothing; fewer than five words are one
shingle; every row is a document, so rows that repeat an id, or have none, are told apart: each gets its own text's
component, named by the smallest id in it (null if none has one); equal rows that repeat an id are all kept by the
query, as ids decide there, and the filter keeps one of them; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, numbered, shingle_hashes, small_batches, steps, stored, table, unclear, word_hashes
from .components import components, scan

WIDTH = 5
PERCENT = 75
SYMBOLS = 64
CHUNKS = 17
DISTANCE = 33
#: Up to so many nodes of a key are paired directly.
PAIRED = 8
#: Nodes of a key that one task scans. Those of a larger key are all linked as candidates, without looking at distances.
KEY_NODES = 50_000
#: Shingles of a candidate component that one task confirms; larger ones are confirmed in rounds by all tasks.
TASK_SHINGLES = 4_000_000
#: Members that one round scans, and shingles of them: what a round sends to all tasks is bounded by these (and one text).
ROUND_MEMBERS, ROUND_SHINGLES = 4_096, 4_000_000
#: Nodes that a task looks at for keys which many of them share, and how many share a key that is thinned out there.
LOCAL_NODES, LOCAL_SHARED = 16_384, 24

_rng = np.random.default_rng(8_2024)
_XOR = _rng.integers(0, 2**32, SYMBOLS, dtype=np.uint32)
_ODD = _rng.integers(0, 2**32, SYMBOLS, dtype=np.uint32) | np.uint32(1)


def _key_columns() -> list[list[int]]:
    """Symbols of each key: a chunk without one of its symbols."""
    cuts = np.linspace(0, SYMBOLS, CHUNKS + 1).round().astype(int)
    return [[s for s in range(a, b) if s != out] for a, b in zip(cuts[:-1], cuts[1:], strict=True) for out in range(a, b)]


KEYS = _key_columns()


def _sets(texts) -> Iterator[tuple[object, list[np.ndarray]]]:
    for t in steps(texts):
        words, rows = word_hashes(t)
        yield t, [np.unique(shingle_hashes(words[a:b], WIDTH)) for a, b in zip(rows[:-1], rows[1:], strict=True)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of SYMBOLS uint16; sets must not be empty."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    v = np.empty_like(x)
    for i in range(SYMBOLS):
        np.bitwise_xor(x, _XOR[i], out=v)
        np.multiply(v, _ODD[i], out=v)
        out[:, i] = (np.minimum.reduceat(v, at) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t, sets in _sets(b.column("text")):
            n = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(n)
            s1, s2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            sig: list = [None] * len(sets)
            if len(some):
                for i in some:
                    s1[i], s2[i] = _digest(sets[i])
                for i, row in zip(some, signatures([sets[i] for i in some]), strict=True):
                    sig[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(t.lo, t.hi - t.lo), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(sig, pa.binary())],
                ["doc_id", "n_shingles", "s1", "s2", "sig"],
            )


def _matrix(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), np.uint16).reshape(len(sigs), SYMBOLS)


def _keys_of(sig: np.ndarray) -> np.ndarray:
    """Keys of signatures (uint64 symbols): all nodes' first keys, then all second ones, and so on."""
    keys = []
    for i, cols in enumerate(KEYS):
        h = np.full(len(sig), i, np.uint64)
        for c in cols:
            h = (h << np.uint64(16)) ^ sig[:, c]
        keys.append(mix(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i)))
    return np.concatenate(keys)


def _keys(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(key, node, to): a node's keys, ``to`` null. Of the ``least`` or more nodes at hand that share a key, only one
    keeps it; the others get a row (any key, node, to) that links them to it."""
    sigs: list[np.ndarray] = []
    nodes: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        sig, node = np.concatenate(sigs).astype(np.uint64), np.concatenate(nodes)
        key, own = _keys_of(sig), np.tile(node, len(KEYS))
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        size = np.diff(np.append(at, len(key)))
        shared = np.flatnonzero(size >= least)
        gone = np.zeros(len(key), bool)
        if len(shared):
            rows = [order[at[i] : at[i] + size[i]] for i in shared]
            gone[np.concatenate([r[1:] for r in rows])] = True
            links = np.unique(np.concatenate([np.stack([own[r[1:]], np.full(len(r) - 1, own[r[0]])], axis=1) for r in rows]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 0]), pa.array(links[:, 1])], ["key", "node", "to"])
        key, own = key[~gone].view(np.int64), own[~gone]
        for lo in range(0, len(key), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(own[part]), pa.nulls(len(key[part]), pa.int64())], ["key", "node", "to"])

    have = 0
    for b in batches:
        if b.num_rows:
            sigs.append(_matrix(b.column("sig")))
            nodes.append(b.column("node").to_numpy())
            have += b.num_rows
        if have >= LOCAL_NODES:
            yield from flush()
            sigs.clear()
            nodes.clear()
            have = 0
    if have:
        yield from flush()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: pairs (a, b) of keys with a few nodes, and memberships (a, null, key) of keys with more;
    rows with ``to`` become links (a, b) with ``many`` null. Only the nodes of a key that a batch leaves open are held, and
    no more than PAIRED of them."""
    held_key, held, many = None, np.zeros(0, np.int64), False

    def pairs_of(key, node, at, size):
        a, b = [], []
        for n in range(2, PAIRED + 1):
            first = at[size == n]
            for i in range(n):
                for j in range(i):
                    a.append(node[first + i])
                    b.append(node[first + j])
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2

    def out(a, b, key_a, key):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([a, key_a])), pa.array(np.concatenate([b, np.zeros(len(key_a), np.int64)])), pa.array(np.concatenate([np.zeros(len(a), np.int64), key])), pa.array(np.arange(len(a) + len(key_a)) >= len(a))],
            ["a", "b", "key", "many"],
        )

    none = np.zeros(0, np.int64)
    for batch in batches:
        linked = batch.filter(batch.column("to").is_valid())
        if linked.num_rows:
            yield pa.RecordBatch.from_arrays([linked.column("node"), linked.column("to"), linked.column("key"), pa.nulls(linked.num_rows, pa.bool_())], ["a", "b", "key", "many"])
            batch = batch.filter(batch.column("to").is_null())
        key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
        if not len(key):
            continue
        if many and key[0] == held_key:  # the open key goes on
            end = int(np.searchsorted(key != held_key, True)) if key[-1] != held_key else len(key)
            yield out(none, none, node[:end], key[:end])
            key, node = key[end:], node[end:]
            if not len(key):
                continue
            held = none
        if len(held) and not many:
            key, node = np.concatenate([np.full(len(held), held_key), key]), np.concatenate([held, node])
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(at, len(key)))
        held_key, held, many = key[at[-1]], node[at[-1] :], size[-1] > PAIRED
        if not many:
            at, size = at[:-1], size[:-1]
        large = np.repeat(size > PAIRED, size)
        large = np.concatenate([large, np.zeros(len(key) - len(large), bool)])
        yield out(*pairs_of(key, node, at, size), node[large], key[large])
        if many:
            held = none
    if len(held) and not many:
        yield out(*pairs_of(None, held, np.array([0]), np.array([len(held)])), none, none)


def _groups(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.Table]:
    """Rows that are sorted by a column, one table for each of its values."""
    open_: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(name).to_numpy()
        at = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if open_ and open_[-1].column(name)[0].as_py() != key[lo]:
                yield pa.Table.from_batches(open_)
                open_ = []
            open_.append(b.slice(lo, hi - lo))
    if open_:
        yield pa.Table.from_batches(open_)


def _span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _groups(batches, "key"):
        node, sig = t.column("node").to_numpy(), _matrix(t.column("sig").combine_chunks())
        label = scan(len(node), lambda i, sig=sig: (sig != sig[i]).sum(axis=1) <= DISTANCE)
        mine = np.flatnonzero(label != np.arange(len(node)))
        if len(mine):
            yield pa.RecordBatch.from_arrays([pa.array(node[mine]), pa.array(node[label[mine]])], ["a", "b"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            near = (_matrix(b.column("sig_a")) != _matrix(b.column("sig_b"))).sum(axis=1) <= DISTANCE
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(near))


def signature_links(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Links (a, b) whose components hold those of all pairs at signature distance <= DISTANCE. nodes: node, sig."""
    least = LOCAL_SHARED
    found = nodes.select("node", "sig").mapInArrow(lambda it: _keys(it, least), "key long, node long, to long").repartition("key").sortWithinPartitions("key")
    found = stored(found.mapInArrow(_meet, "a long, b long, key long, many boolean"), spark)
    near_by = found.filter("many IS NULL").select("a", "b")
    sig = nodes.select("node", "sig")
    pairs = found.filter("not many").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").mapInArrow(_near, "a long, b long")
    many = found.filter("many").select("key", F.col("a").alias("node"))
    sizes = many.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    large = stored(sizes.filter(F.col("n") > KEY_NODES).select("key", "first"), spark)
    stars = None
    if large.limit(1).count():
        stars = many.join(large, "key").select(F.col("node").alias("a"), F.col("first").alias("b"))
        many = many.join(large, "key", "left_anti")
    groups = many.join(sig, "node").repartition("key").sortWithinPartitions("key", "node")
    links = pairs.unionByName(groups.mapInArrow(_span, "a long, b long")).unionByName(near_by)
    return links if stars is None else links.unionByName(stars)


def _digest(shingles: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that tell sets apart, as two numbers."""
    return mix(shingles).sum(dtype=np.uint64), mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t, sets in _sets(b.column("text")):
            rest = [b.column(c).slice(t.lo, t.hi - t.lo) for c in ("group", "node")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([s.tobytes() for s in sets], pa.binary())], ["group", "node", "shingles"])


def _similar(inter: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
    return 100 * inter >= PERCENT * (n + m - inter)


def _confirmed(sets: list[np.ndarray]) -> np.ndarray:
    """Components of sets by their exact similarity."""
    n = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.concatenate([[0], np.cumsum(n)])
    mark = np.zeros(int(ids.max()) + 1, bool)

    def linked(i: int) -> np.ndarray:
        mark[ids[at[i] : at[i + 1]]] = True
        inter = np.add.reduceat(mark[ids], at[:-1], dtype=np.int64)
        mark[ids[at[i] : at[i + 1]]] = False
        return _similar(inter, n, n[i])

    return scan(len(sets), linked)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _groups(batches, "group"):
        node = t.column("node").to_numpy()
        label = _confirmed([np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[label])], ["node", "label"])


def _in_rounds(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(node, label) for the members of very large candidate components: rows (group, node, shingles).

    A round picks members that weren't scanned and aren't in their component's largest confirmed group, as many as
    ROUND_MEMBERS and ROUND_SHINGLES allow, and links those among each other; they go to all tasks, which compare all
    members of their components with them and link each to one of every group of picked ones that it is similar to. As
    in ``scan``, a component is done once no two of its confirmed groups have members left to scan.
    """
    rows = stored(rows.dropDuplicates(["node"]).withColumn("n", F.octet_length("shingles") / 8), spark)
    state = stored(rows.select("group", "node", F.col("n").cast("long").alias("n"), F.col("node").alias("label"), F.lit(False).alias("scanned")), spark)
    while True:
        groups = state.groupBy("group", "label").agg(F.count_if(~F.col("scanned")).alias("left"))
        open_ = groups.filter("left > 0").groupBy("group").agg(F.count("*").alias("n"), F.max(F.struct("left", "label")).alias("top")).filter("n > 1")
        open_ = open_.select("group", F.col("top.label").alias("largest"))
        chosen = state.filter("not scanned").join(open_, "group").filter("label <> largest")
        now = chosen.select("group", "node", "n").orderBy("group", "node").limit(ROUND_MEMBERS).collect()
        if not now:
            return state.select("node", "label")
        total = np.cumsum([r["n"] for r in now])
        now = now[: max(1, int(np.searchsorted(total, ROUND_SHINGLES, side="right")))]
        picked = spark.createDataFrame([(r["group"], r["node"]) for r in now], "group long, node long")
        own: dict[int, tuple[list, list]] = {}
        for r in rows.join(F.broadcast(picked), ["group", "node"], "left_semi").collect():
            at = own.setdefault(r["group"], ([], []))
            at[0].append(r["node"])
            at[1].append(np.frombuffer(r["shingles"], np.uint64))
        links, sent_rows = [], {}
        for group, (nodes, sets) in own.items():
            label = _confirmed(sets)
            links += [(nodes[i], nodes[j]) for i, j in enumerate(label.tolist()) if i != j]
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            values = np.concatenate(sets)
            order = np.argsort(values, kind="stable")
            sent_rows[group] = np.array(nodes), label, np.array([len(s) for s in sets]), values[order], owner[order]
        sent = spark.sparkContext.broadcast(sent_rows)

        def compare(batches, sent=sent):
            for b in batches:
                found = []
                for group, node, raw in zip(*[b.column(c).to_pylist() for c in ("group", "node", "shingles")], strict=True):
                    s = np.frombuffer(raw, np.uint64)
                    nodes, label, n, values, owner = sent.value[group]
                    lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
                    some = hi > lo
                    lo, many = lo[some], (hi - lo)[some]
                    place = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                    near = np.unique(label[_similar(np.bincount(owner[place], minlength=len(n)), n, len(s))])
                    found += [(node, int(x)) for x in nodes[near] if x != node]
                a, c = list(zip(*found, strict=True)) or ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

        near = rows.filter(F.col("group").isin(list(own))).select("group", "node", "shingles").mapInArrow(compare, "a long, b long")
        near = near.unionByName(spark.createDataFrame(links, "a long, b long"))
        label = state.select("node", "label")
        links_ = near.join(label.toDF("a", "la"), "a").join(label.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        roots = components(spark, links_).toDF("label", "root")
        seen = F.broadcast(picked.select("node", F.lit(True).alias("seen")))
        state = stored(
            state.join(roots, "label", "left")
            .join(seen, "node", "left")
            .select("group", "node", "n", F.coalesce("root", "label").alias("label"), (F.col("scanned") | F.coalesce("seen", F.lit(False))).alias("scanned")),
            spark,
        )
        sent.unpersist()


def near_duplicates(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    small_batches(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = _described(spark, docs)
    if not unclear(found.select("doc_id")):
        return _labelled(spark, docs, found, task_shingles)
    rows, number = numbered(spark, docs, "doc_id", "text")
    ids = rows.select(F.col(number).alias("n"), "doc_id")
    by_number = rows.select(F.col(number).alias("doc_id"), "text")
    out = _labelled(spark, by_number, _described(spark, by_number), task_shingles).withColumnsRenamed({"doc_id": "n", "component_id": "root"})
    out = out.join(ids, "n").join(ids.toDF("root", "component_id"), "root")
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _described(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return stored(docs.mapInArrow(_describe, "doc_id long, n_shingles long, s1 long, s2 long, sig binary"), spark)


def _labelled(spark: SparkSession, docs: DataFrame, found: DataFrame, task_shingles: int) -> DataFrame:
    """``near_duplicates`` of documents whose ids are given and differ."""
    some = found.filter("n_shingles > 0")
    nodes = some.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n"), F.min("sig").alias("sig"))
    nodes = stored(nodes, spark)

    links = signature_links(spark, nodes)
    group = stored(components(spark, links).withColumnRenamed("root", "group"), spark)
    sizes = group.join(nodes.select("node", "n"), "node").groupBy("group").agg(F.sum("n").alias("total"))
    candidates = group.join(sizes, "group").withColumnRenamed("node", "doc_id")
    candidates = docs.join(candidates, "doc_id").withColumnRenamed("doc_id", "node")
    one = _sets_of(candidates.filter(F.col("total") <= task_shingles)).repartition("group").sortWithinPartitions("group", "node")
    labels = one.mapInArrow(_confirm, "node long, label long")
    if sizes.filter(F.col("total") > task_shingles).limit(1).count():
        labels = labels.unionByName(_in_rounds(spark, _sets_of(candidates.filter(F.col("total") > task_shingles))))
    of_set = nodes.join(labels, "node", "left").select("s1", "s2", F.coalesce("label", "node").alias("label"))
    out = some.select("doc_id", "n_shingles", "s1", "s2").join(of_set, ["s1", "s2"]).select("doc_id", "n_shingles", F.col("label").alias("component_id"))
    rest = found.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _sets_of(candidates: DataFrame) -> DataFrame:
    return candidates.select("group", "node", "text").mapInArrow(_shingles, "group long, node long, shingles binary")


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates. Where ids are null or repeated, rows are told apart by a
    number that follows the order of ids, nulls last."""
    rows, number = numbered(spark, docs, key, text) if unclear(docs.select(F.col(key).cast("long"))) else (docs, key)
    gone = near_duplicates(spark, rows, number, text).filter(~F.col("kept")).select(F.col("doc_id").alias(number))
    return rows.join(gone, number, "left_anti").select(*docs.columns)


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


SQL_OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r.y)::BIGINT AS component_id, d.doc_id = min(r.y) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.x = d.doc_id GROUP BY d.doc_id, n.n
"""
