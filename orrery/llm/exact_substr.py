"""Exact repeated-substring removal with suffix arrays.

Every byte goes that lies in a 200-byte string which also starts at another place, in any document.

1. Each 200-byte window picks an anchor, its 64-byte substring of least hash (the leftmost of equals). Windows of equal
   content pick anchors of equal content, so only windows with the same anchor need to meet. Neighbouring windows that
   share an anchor form a piece: one row with hashes of its anchor and of its content, and no text.
2. Rows are dealt out by anchor, those of an anchor that a task has often by anchor and salt, so no anchor's rows meet in
   one task. Anchors that occur once are dropped; pieces of equal content become a class, of which one text a salt is
   fetched, so that thousands of copies count as a few texts from here on.
3. An anchor's only class has several members, so all of it is repeated. Texts of other classes, again dealt out by
   anchor, are joined to shard strings of a few hundred KB. Each shard's suffix array is made by induced sorting, then its
   permuted common prefixes: a window is repeated if its suffix shares 200 bytes with a neighbour in the array, or if its
   class has several members.
4. The repeated windows of a class go back to all members' documents, where they are merged to spans.

An anchor whose texts don't fit a shard is settled by 128-bit fingerprints of its windows, grouped by Spark; that is
the exact way for such anchors, whatever their number of texts.

Defined cases: a null text is empty; texts under 200 bytes lose nothing; repeated rows are documents of their own (and
so each other's repeats); an empty table gives no rows; other columns aren't read, and the filter keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, mix, powers, small_batches, steps, stored, table
from .suffix_array import permuted_lcp, suffix_array

LENGTH = 200
ANCHOR = 64
#: Bytes that a shard string is filled up to, and that one anchor's texts may have in it.
SHARD_BYTES = 1 << 20
ANCHOR_BYTES = 4 << 20
#: Pieces that a task looks at for anchors which many of them share, how many are too many, and over how many salts the
#: pieces of such an anchor are dealt.
LOCAL_PIECES, LOCAL_SHARED, SALTS = 65_536, 8, 64


def _grams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of mixed 8-byte words, by which spans of 8 bytes or more are hashed, and the anchors' hashes."""
    n = t.n
    words = np.zeros(n, np.uint64)
    for k in range(8):
        m = (n + t.PAD - k) // 8
        own = np.frombuffer(t.data[k : k + 8 * m].tobytes(), "<u8")
        words[k::8] = own[: len(words[k::8])]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(words) * powers(n)[:n], out=sums[1:])
    m = max(0, n - ANCHOR + 1)
    wide = ANCHOR - 7
    hashes = mix((sums[wide : wide + m] - sums[:m]) * powers(n, inverse=True)[:m])
    return sums, hashes


def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes, where its least one (by the upper 32 bits, then leftmost) is."""
    n = len(hashes)
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    m = -(-n // width)
    padded = np.full(m * width, np.uint64(2**64 - 1))
    padded[:n] = key
    blocks = padded.reshape(m, width)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return (np.minimum(left[:count], right[width - 1 : width - 1 + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "th", "h", "c", "start", "windows", "times"]
    for b in batches:
        for t in steps(b.column("text"), most=1 << 19):
            if t.n < LENGTH:
                continue
            sums, hashes = _grams(t)
            width = LENGTH - ANCHOR + 1
            if len(hashes) < width:
                continue
            anchor = _least(hashes, width)
            row = np.repeat(np.arange(len(t.at) - 1), np.diff(t.at))[: len(anchor)]
            inside = np.arange(len(anchor)) + LENGTH <= t.at[row + 1] - t.gap
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
            first = np.flatnonzero(new & inside)
            if not len(first):
                continue
            ends = np.flatnonzero(inside & ~np.append(inside[1:] & ~new[1:], False))
            windows = ends - first + 1
            stop = ends + LENGTH - 7
            c = mix((sums[stop] - sums[first]) * powers(t.n, inverse=True)[first] ^ windows.astype(np.uint64))
            h = hashes[anchor[first]]
            # a run of equal pieces side by side (long repeats of a short period) is one row
            again = np.zeros(len(first), bool)
            again[1:] = (c[1:] == c[:-1]) & (h[1:] == h[:-1]) & (first[1:] == ends[:-1] + 1) & (row[first[1:]] == row[first[:-1]])
            lead = np.flatnonzero(~again)
            times = np.diff(np.append(lead, len(first)))
            own = row[first[lead]]
            take = pa.array(own + t.lo)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(take), b.column("th").take(take), *[pa.array(x.view(np.int64)) for x in (h[lead], c[lead])]]
                + [pa.array(x.astype(np.int64)) for x in (first[lead] - t.at[own], windows[lead], times)],
                names,
            )


def _salted(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pieces with a salt, 0 but for anchors that ``least`` or more of the pieces at hand have: theirs are dealt out. Of
    such an anchor a row without windows goes to salt 0, as pieces elsewhere must know that it isn't theirs alone."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        h = t.column("h").to_numpy()
        anchors, own, n = np.unique(h, return_inverse=True, return_counts=True)
        salt = np.where(n[own] >= least, 1 + np.arange(len(h)) % SALTS, 0)
        yield pa.RecordBatch.from_arrays([*t.columns, pa.array(salt, pa.int32())], [*t.schema.names, "salt"])
        hot = anchors[n >= least]
        if len(hot):
            none = pa.array(np.zeros(len(hot), np.int64))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(hot), pa.int64()), none, pa.array(hot), none, none, none, none, none.cast(pa.int32())], [*t.schema.names, "salt"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= LOCAL_PIECES:
            yield from flush()
            held = []
    if sum(x.num_rows for x in held):
        yield from flush()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by h, salt and c: those whose h has more than one piece, with ``first`` for the first row of each
    class and ``many`` if the class has several pieces under its salt. A row is held back until its successor is known."""
    held: pa.RecordBatch | None = None
    key = ("h", "salt", "c", "windows")

    def emit(b: pa.RecordBatch, before, after) -> pa.RecordBatch:
        h, salt, c, windows, times = (b.column(x).to_numpy() for x in (*key, "times"))
        hb, cb, ha, ca = (np.zeros(len(h), bool) for _ in range(4))
        hb[1:] = (h[1:] == h[:-1]) & (salt[1:] == salt[:-1])
        cb[1:] = hb[1:] & (c[1:] == c[:-1]) & (windows[1:] > 0) & (windows[:-1] > 0)
        ha[:-1], ca[:-1] = hb[1:], cb[1:]
        for x, other, hs, cs in ((0, before, hb, cb), (-1, after, ha, ca)):
            if other is not None:
                hs[x] = (h[x], salt[x]) == other[:2]
                cs[x] = hs[x] and c[x] == other[2] and windows[x] > 0 and other[3] > 0
        keep = (hb | ha | (times > 1) | (salt > 0)) & (windows > 0)
        out = pa.RecordBatch.from_arrays([*b.columns, pa.array(~cb), pa.array(cb | ca | (times > 1))], [*b.schema.names, "first", "many"])
        return out.filter(pa.array(keep))

    before = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            yield emit(held, before, tuple(b.column(x)[0].as_py() for x in key))
            before = tuple(held.column(x)[-1].as_py() for x in key)
        held = b
    if held is not None:
        yield emit(held, before, None)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the pieces listed for each document."""
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for text, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True):
            raw = (text or "").encode()
            for w in wanted:
                for to, v in zip(out, (w["h"], w["c"], w["many"], w["large"], raw[w["start"] : w["start"] + w["windows"] + LENGTH - 1]), strict=True):
                    to.append(v)
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["h", "c", "many", "large", "text"])


def repeated_windows(texts: list[bytes], many: list[bool]) -> list[np.ndarray]:
    """For each text, whether each of its windows occurs again among the texts (or, if ``many``, in copies of it)."""
    size = np.array([len(x) for x in texts])
    at = np.concatenate([[0], np.cumsum(size + 1)])
    t = np.ones(int(at[-1]) + 1, np.uint16)  # 1 divides the texts, 0 ends the string
    inside = np.ones(len(t), bool)
    inside[at[1:] - 1] = inside[-1] = False
    t[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 2
    t[-1] = 0
    phi, lcp = permuted_lcp(t, suffix_array(t, 258))
    hit = np.zeros(len(t), bool)
    own = np.flatnonzero(lcp >= LENGTH)
    hit[own] = True
    hit[phi[own]] = True
    return [np.ones(n - LENGTH + 1, bool) if m else hit[a : a + n - LENGTH + 1] for a, n, m in zip(at[:-1], size, many, strict=True)]


def _spans(flags: np.ndarray) -> list[int]:
    """Runs of true flags as from, to, from, to, ..."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge).tolist()


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        found = repeated_windows([r[3] for r in rows], [r[2] for r in rows])
        out = [(r[0], r[1], _spans(f)) for r, f in zip(rows, found, strict=True) if f.any()]
        h, c, spans = list(zip(*out, strict=True)) or ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(spans, pa.list_(pa.int32()))], ["h", "c", "spans"])

    for b in batches:
        for r in zip(*[b.column(x).to_pylist() for x in ("h", "c", "many", "text")], strict=True):
            if size >= shard_bytes and rows[-1][0] != r[0]:
                yield flush()
                rows, size = [], 0
            rows.append(r)
            size += len(r[3]) + 1
    if rows:
        yield flush()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in zip(*[b.column(x).to_pylist() for x in ("h", "c", "many", "text")], strict=True):
            n = len(r[3]) - LENGTH + 1
            prints = [hashlib.blake2b(r[3][i : i + LENGTH], digest_size=16).digest() for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0]] * n, pa.int64()), pa.array([r[1]] * n, pa.int64()), pa.array([r[2]] * n, pa.bool_()), pa.array(range(n), pa.int32()), pa.array(prints, pa.binary())],
                ["h", "c", "many", "i", "print"],
            )


def _merge(spans) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint maximal (starts, ends) of the union of spans."""
    if not len(spans):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = (np.array(x, np.int64) for x in zip(*spans, strict=True))
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(end)) - 1]


def repeated_spans(spark: SparkSession, docs: DataFrame, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(doc_id, th, spans): for documents (doc_id, th, text) with repeats, byte spans that cover them. Documents are told
    apart by doc_id and th, a hash of the text; rows equal in both get one result that holds for each."""
    least, shard_bytes = LOCAL_SHARED, SHARD_BYTES
    found = docs.mapInArrow(lambda it: _salted(_pieces(it), least), "doc_id long, th long, h long, c long, start long, windows long, times long, salt int")
    found = found.repartition("h", "salt").sortWithinPartitions("h", "salt", "c", "doc_id", "start")
    found = stored(found.mapInArrow(_repeated, "doc_id long, th long, h long, c long, start long, windows long, times long, salt int, first boolean, many boolean"), spark)

    classes = found.filter("first")
    anchors = classes.groupBy("h").agg((F.min("c") == F.max("c")).alias("alone"), (F.sum(F.col("windows") + LENGTH) > anchor_bytes).alias("large"))
    classes = stored(classes.join(anchors, "h"), spark)
    # the only class of an anchor has several members, and no window stands twice in one text: it would have two anchors
    spans = classes.filter("alone").select("h", "c", F.array(F.lit(0), F.col("windows").cast("int")).alias("spans"))
    wanted = classes.filter("not alone").groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "c", "many", "large", "start", "windows")).alias("wanted"))
    texts = docs.join(wanted, _same(docs, wanted)).select("text", "wanted").mapInArrow(_texts, "h long, c long, many boolean, large boolean, text binary")
    any_large = classes.filter("large and not alone").limit(1).count()
    if any_large:
        texts = stored(texts, spark)
    small = texts.filter("not large").repartition("h").sortWithinPartitions("h", "c")
    spans = spans.unionByName(small.mapInArrow(lambda it: _shards(it, shard_bytes), "h long, c long, spans array<int>"))
    if any_large:
        prints = texts.filter("large").mapInArrow(_fingerprints, "h long, c long, many boolean, i int, print binary")
        seen = prints.groupBy("h", "print").agg(F.count("*").alias("n"))
        hit = prints.join(seen, ["h", "print"]).filter("many or n > 1").groupBy("h", "c").agg(F.flatten(F.collect_list(F.array(F.col("i"), F.col("i") + 1))).alias("spans"))
        spans = spans.unionByName(hit)
    # a class that came under several salts has several rows, which are equal: all its windows are repeated. Its members
    # find them under their own salts
    spans = spans.groupBy("h", "c").agg(F.first("spans").alias("spans")).join(classes.select("h", "c", "salt"), ["h", "c"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, th, a, z = [], [], [], []
            for d, t, start, windows, times, own in zip(*[b.column(x).to_pylist() for x in ("doc_id", "th", "start", "windows", "times", "spans")], strict=True):
                if times > 1:  # each of these pieces is repeated as a whole
                    own, windows, times = [0, windows * times], 0, 1
                for lo, hi in zip(own[::2], own[1::2], strict=True):
                    doc.append(d)
                    th.append(t)
                    a.append(start + lo)
                    z.append(start + hi - 1 + LENGTH)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, th, a, z)], ["doc_id", "th", "a", "z"])

    at = found.join(spans, ["h", "c", "salt"]).mapInArrow(places, "doc_id long, th long, a long, z long")
    return at.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "z")).alias("spans"))


def _same(docs: DataFrame, other: DataFrame):
    return docs["doc_id"].eqNullSafe(other["doc_id"]) & (docs["th"] == other["th"])


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    text_col = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), text_col.alias("text"))


def _apply(raw: bytes, spans) -> tuple[bytes, int, int]:
    a, z = _merge([(s["a"], s["z"]) for s in spans or []])
    kept, at = [], 0
    for lo, hi in zip(a, z, strict=True):
        kept.append(raw[at:lo])
        at = hi
    kept.append(raw[at:])
    return b"".join(kept), int((z - a).sum()), len(a)


def removed(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    small_batches(spark)
    keyed = _keyed(docs, key, text)
    spans = repeated_spans(spark, keyed, anchor_bytes)
    joined = keyed.join(spans, _same(keyed, spans), "left").select(keyed["doc_id"], keyed["text"], spans["spans"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = text.encode()
                kept, gone, n = _apply(raw, spans)
                rows.append((len(raw), gone, n, hashlib.sha256(kept).hexdigest()))
            n, gone, k, sha = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, gone, k)], pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with what is left of the texts; a character that loses some of its bytes goes, and a null text stays null."""
    small_batches(spark)
    names, at = docs.columns, docs.columns.index(text)
    spans = repeated_spans(spark, _keyed(docs, key, text)).toDF("doc_id", "th", "spans")
    own = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs[key].cast("long").alias("id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("hash"))
    joined = own.join(spans, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("th")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = b.column("row").flatten()
            texts = [t if not s else _apply(t.encode(), s)[0].decode(errors="ignore") for t, s in zip(columns[at].to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns[:at], pa.array(texts, pa.string()), *columns[at + 1 :]], names)

    return joined.select("row", "spans").mapInArrow(cut, docs.schema)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(spark, table(spark, sf_dir, "documents"))


SQL_OP9 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 400)) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS p FROM d)),
r AS (SELECT doc_id, p FROM w QUALIFY count(*) OVER (PARTITION BY s) > 1),
n AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200, true) AS new FROM r),
g AS (SELECT doc_id, p, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM n),
x AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS z FROM g GROUP BY doc_id, g),
e AS (SELECT doc_id, a, z FROM x UNION ALL SELECT doc_id, len(h) // 2, len(h) // 2 FROM d),
k AS (SELECT e.doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY e.doc_id ORDER BY a, z), 0) AS before, h FROM e JOIN d ON d.doc_id = e.doc_id)
SELECT doc_id, max(len(h) // 2)::BIGINT AS n_bytes, sum(z - a)::BIGINT AS n_removed, (count(*) - 1)::BIGINT AS n_spans,
  sha256(from_hex(string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a, z))) AS kept_sha256
FROM k GROUP BY doc_id
"""
