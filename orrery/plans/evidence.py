"""Queries over stored files: the driver's tables are written in the formats that the sources read, and read back.

SQLite databases, NumPy files, JSON lines, reports, pair manifests and a whole tree of stored evidence. The files lie in a
folder that the executors can open: below ``spark.checkpoint.dir``, or in local mode in a temporary one.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import ExitStack, closing
from itertools import groupby
from pathlib import Path
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArtifactError, CoordinateError, ReplayError
from ..functions import integrity
from ..functions import vectors as V
from ..functions.code_structure import NAMES
from ..operators import hard_negatives, pair_benchmark
from ..operators.compare import compare_relations
from ..operators.projection import Projection
from ..operators.search import search
from ..operators.statistics import running_sum
from ..sources import arrays, caches, jsonl, sqlite
from ..sources.tables import read_parquet as read
from ..streaming.project import start_projection
from . import queries as Q
from . import replay

FINGERPRINT = "5e" * 32


def folder(spark: SparkSession) -> Path:
    """A new folder that driver and executors can open as local files."""
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://").removeprefix("file:")
    if shared.startswith("/"):
        path = Path(shared) / f"orrery-files-{uuid.uuid4().hex}"
        path.mkdir(parents=True)
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("stored files need a shared local folder in spark.checkpoint.dir")
    return Path(tempfile.mkdtemp(prefix="orrery-files-"))


def float32(values) -> bytes:
    return np.asarray(values, "<f4").tobytes()


def write_cache(path: Path, docs: Iterable, vectors: Iterable) -> Path:
    """A cache in both layouts: contracts with their embeddings, and embeddings by key. A few of the latter are spoilt."""
    with closing(sqlite3.connect(path)) as c:
        c.execute("CREATE TABLE embedding_contracts (contract_sha256 TEXT, schema_version INTEGER, provider TEXT, model TEXT, base_url TEXT, truncate INTEGER, normalization TEXT, stored_dtype TEXT)")
        c.execute("CREATE TABLE embeddings (contract_sha256 TEXT, text_sha256 TEXT, dimension INTEGER, vector BLOB)")
        c.execute(f"CREATE TABLE {caches.CACHE_TABLE} (stable_key TEXT, source_sha256 TEXT, extraction_fingerprint_sha256 TEXT, dtype TEXT, dimensions INTEGER, embedding BLOB, payload_sha256 TEXT, array_sha256 TEXT)")
        c.executemany("INSERT INTO embedding_contracts VALUES (?, 1, 'p', ?, 'u', ?, 'none', 'float32')", ((r["contract"], r["contract"][:2], len(r["contract"]) % 2) for r in docs))
        for r in vectors:
            i, raw = r["vec_id"], float32(r["embedding"])
            n = len(raw) // 4
            c.execute("INSERT INTO embeddings VALUES (?, ?, ?, ?)", (r["contract"], f"t{i}", n, raw))
            kept = raw[:-4] + raw[:4] if i % 7 == 1 else raw
            sha = hashlib.sha256(raw).hexdigest()
            dtype = "float64" if i % 11 == 3 else "float32"
            array = "0" * 64 if i % 13 == 5 else integrity.array_sha256(np.frombuffer(raw, "<f4"))
            if i % 17 != 6:
                c.execute(f"INSERT INTO {caches.CACHE_TABLE} VALUES (?, ?, ?, ?, ?, ?, ?, ?)", (f"row-{i}", f"source-{i}", FINGERPRINT, dtype, n, kept, sha, array))
        c.commit()
    return path


def cache(spark: SparkSession, sf: str) -> Path:
    docs = read(spark, sf, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("contract"))
    vectors = Q.embeddings(spark, sf).join(docs, F.col("vec_id") == F.col("doc_id")).select("vec_id", "embedding", "contract")
    return write_cache(folder(spark) / "cache.sqlite3", docs.select("contract").distinct().toLocalIterator(), vectors.toLocalIterator())


def sqlite_tables(spark: SparkSession, sf: str) -> DataFrame:
    path = cache(spark, sf)
    names = sqlite.require_tables(path, "embedding_contracts", "embeddings")
    parts = [sqlite.read_table(spark, path, n, 100).agg(F.lit(i).cast("int").alias("place"), F.lit(n).alias("name"), F.count("*").alias("rows")) for i, n in enumerate(names)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sqlite_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored vector, decoded from its bytes."""
    rows = sqlite.read_table(spark, cache(spark, sf), "embeddings", 100).withColumn("v", caches.float32_vector(F.col("vector")).cast("array<double>"))
    return rows.select("text_sha256", "contract_sha256", "dimension", Q.r(V.total(F.col("v"))).alias("total"), Q.r(F.get("v", F.lit(0))).alias("first"))


def cache_contracts(spark: SparkSession, sf: str) -> DataFrame:
    report = caches.inspect_cache(spark, cache(spark, sf))
    rows = [(i, c["contract_sha256"], c["model"], c["truncate"], c["rows"], c["minimum_dimension"], c["maximum_dimension"], report["embedding_rows"], report["contract_count"]) for i, c in enumerate(report["contracts"])]
    return spark.createDataFrame(rows, "place long, contract_sha256 string, model string, truncate boolean, rows long, minimum_dimension long, maximum_dimension long, embedding_rows long, contract_count long")


def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest of all vectors against a cache of which some rows are missing or spoilt."""
    path = cache(spark, sf)
    manifest = read(spark, sf, "embeddings").select(F.col("vec_id").alias("ordinal"), F.concat(F.lit("row-"), "vec_id").alias("stable_key"), F.concat(F.lit("source-"), "vec_id").alias("source_sha256"))
    d = Q.embeddings(spark, sf).select(F.size("embedding")).head()[0]
    rows = caches.cached_rows(manifest, sqlite.read_table(spark, path, caches.CACHE_TABLE, 100), FINGERPRINT, d)
    return rows.select("ordinal", "stable_key", "fault", F.when(F.col("fault").isNull(), Q.r(V.total(F.col("vector").cast("array<double>")))).alias("total"))


def write_arrays(spark: SparkSession, sf: str) -> Path:
    """Files of every kind that an inventory meets, for each label: a matrix, a snapshot, a plain archive and a broken one."""
    root = folder(spark)
    labels = sorted(r["label"] for r in read(spark, sf, "embeddings").select("label").distinct().collect())
    for label in labels:
        own = Q.embeddings(spark, sf).filter(F.col("label") == label).orderBy("vec_id").select("vec_id", "embedding").toLocalIterator()
        ids, x = (list(c) for c in zip(*own, strict=True))
        at = root / f"label-{label}"
        at.mkdir()
        x = np.array(x, np.float32)
        np.save(at / "matrix.npy", x)
        np.savez(at / "snapshot.npz", texts=np.array([f"text {i}" for i in ids]), embeddings=x, model=np.array(f"model-{label}"), dataset_sha256=np.array("a" * 64))
        np.savez(at / "plain.npz", rows=np.array(len(ids)), ids=np.array(ids[:3]), objects=np.array([{}, None], dtype=object))
        (at / ("broken.npz" if label % 2 else "broken.npy")).write_bytes(b"\x93NUMPY" if label % 3 else b"nothing")
    return root


def array_inventory(spark: SparkSession, sf: str) -> DataFrame:
    found = arrays.inspect_arrays(spark, str(write_arrays(spark, sf)))
    parts = F.split("path", "/")
    matrix = F.coalesce(F.try_element_at("arrays", F.lit("")), F.try_element_at("arrays", F.lit("embeddings")))
    return found.select(
        F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file"), "classification", F.size(F.map_keys("arrays")).alias("arrays"),
        F.get_json_object(matrix, "$.shape").alias("shape"), F.get_json_object(matrix, "$.dtype").alias("dtype"), F.try_element_at("small_values", F.lit("model")).alias("model"),
        F.try_element_at("small_values", F.lit("rows")).alias("rows"), F.try_element_at("small_values", F.lit("ids")).alias("ids"), F.get(F.transform("skipped_values", lambda s: s["reason"]), F.lit(0)).alias("skipped"), F.col("inspection_error").isNotNull().alias("failed"),
    )


def array_errors(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.error_counts(arrays.inspect_arrays(spark, str(write_arrays(spark, sf))))


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """The whole report: arrays below a folder, and the cache."""
    root = write_arrays(spark, sf)
    report = caches.inventory(spark, root, cache(spark, sf))
    counts = [report[f"{k}_{n}"] for k in ("npz", "npy") for n in ("count", "error_count")]
    ordered = all([i["path"] for i in report[k]] == sorted(i["path"] for i in report[k]) for k in ("npz", "npy"))
    snapshots = sum(i.get("classification") == "benchmark_embedding_snapshot" for i in report["npz"])
    row = (*counts, snapshots, ordered, report["sqlite"]["embedding_rows"], report["sqlite"]["contract_count"])
    return spark.createDataFrame([row], "npz long, npz_errors long, npy long, npy_errors long, snapshots long, ordered boolean, embedding_rows long, contracts long")


def write_lines(path: Path, rows: Iterable[dict], blank: int = 0) -> str:
    """JSON lines, with a blank one after each ``blank`` rows; the file's hash."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        for i, r in enumerate(rows):
            f.write(json.dumps(r) + "\n")
            if blank and i % blank == 0:
                f.write(" \t\n\n")
    return integrity.stream_sha256(path)


def write_files(rows: DataFrame, at: Path, write: Callable[[BinaryIO, Iterator[pa.RecordBatch]], int]) -> list[Path]:
    """A file of each partition of ``rows``, written by its task; the files in the order of partitions. The driver gets their
    numbers. A task that is tried again replaces its file by the same one."""
    at.mkdir(parents=True, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own = at / f".{part}-{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            n = write(f, batches)
        own.replace(at / f"part-{part:06}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64())], ["part", "n"])

    found = rows.mapInArrow(run, "part int, n long").collect()
    return [at / f"part-{r['part']:06}" for r in sorted(found)]


def as_lines(blank: int = 0) -> Callable[[BinaryIO, Iterator[pa.RecordBatch]], int]:
    """Writes rows as JSON lines, with a blank one after each ``blank`` rows."""

    def write(f: BinaryIO, batches: Iterator[pa.RecordBatch]) -> int:
        i = 0
        for b in batches:
            for r in b.to_pylist():
                f.write(f"{json.dumps(r)}\n".encode())
                if blank and i % blank == 0:
                    f.write(b" \t\n\n")
                i += 1
        return i

    return write


def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as a folder of files of lines, one for each partition."""
    path = folder(spark) / "documents.jsonl"
    write_files(read(spark, sf, "documents").select("doc_id", "lang", "text", "n_chars"), path, as_lines(blank=3))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return jsonl.read_lines(spark, str(path), schema, exact=True).select("doc_id", "lang", "n_chars", integrity.text_sha256(F.col("text")).alias("text_sha256"))


def json_report(spark: SparkSession, sf: str) -> DataFrame:
    """A report that is written and read again, by its sources' order in the file."""
    counts = {f"{r['source']}": r["n"] for r in read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).collect()}
    path = folder(spark) / "sub" / "report.json"
    text = jsonl.write_report({"sources": counts, "total": sum(counts.values())}, path)
    found = jsonl.read_object(path)
    whole = path.read_text(encoding="utf-8") == text and text.endswith("}\n") and text.startswith('{\n  "sources"')
    return spark.createDataFrame([(i, s, n, found["total"], whole) for i, (s, n) in enumerate(found["sources"].items())], "place long, source string, rows long, total long, whole boolean")


def file_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each language and source, with the texts in order of id: tasks write their ranges of the order, and a task
    for each file puts its pieces together."""
    root, pieces = folder(spark), folder(spark)
    docs = read(spark, sf, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    ordered = docs.repartitionByRange("lang", "source", "doc_id").sortWithinPartitions("lang", "source", "doc_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, name, f, found = TaskContext.get().partitionId(), uuid.uuid4().hex, None, None, []
        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                if f is None or name != f"{lang}-{source}.txt":
                    if f:
                        f.close()
                    name = f"{lang}-{source}.txt"
                    f = open(pieces / f"{part}-{len(found)}-{at}", "wb")  # noqa: SIM115
                    found.append((name, part, f.name))
                f.write(text.encode())
        if f:
            f.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["file", "part", "piece"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, own in zip(b.column("file").to_pylist(), b.column("pieces").to_pylist(), strict=True):
                done = pieces / f".{uuid.uuid4().hex}"
                with open(done, "wb") as whole:
                    for piece in own:
                        with open(piece, "rb") as f:
                            shutil.copyfileobj(f, whole, 1 << 20)
                done.replace(root / name)
            yield b.select(["file"])

    written: dict[str, list[str]] = {}
    for r in sorted(ordered.mapInArrow(write, "file string, part long, piece string").collect(), key=lambda r: r["part"]):
        written.setdefault(r["file"], []).append(r["piece"])
    if written:
        spark.createDataFrame(list(written.items()), "file string, pieces array<string>").repartition(len(written), "file").mapInArrow(join, "file string").count()
    shutil.rmtree(pieces)
    found = integrity.file_hashes(spark, str(root), "*.txt")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), "sha256")


def text_hash_match(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with CR LF for line feeds, and some with another letter, against the hashes of the texts as they were."""
    docs = read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stored = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return docs.select("doc_id", integrity.text_matches(stored, integrity.text_sha256(F.col("text"))).alias("matches"), (integrity.text_sha256(stored) == integrity.text_sha256(F.col("text"))).alias("equal"))


def vector_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Array hashes of whole vectors: by column from their bytes, and by the driver's function from the array."""
    rows = Q.embeddings(spark, sf)
    d = rows.select(F.size("embedding")).head()[0]
    raw = rows.select("vec_id", "embedding").toLocalIterator()
    both = spark.createDataFrame(((r["vec_id"], bytearray(float32(r["embedding"])), integrity.array_sha256(np.asarray(r["embedding"], np.float32))) for r in raw), "vec_id long, payload binary, expected string")
    return both.select("vec_id", (integrity.row_array_sha256(F.col("payload"), "float32", d) == F.col("expected")).alias("agrees"), F.octet_length("payload").alias("bytes"))


def projection_files(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinates by a projection that went through a table and an archive."""
    rows, root = Q.embeddings(spark, sf).select("vec_id", "embedding"), folder(spark)
    p = Q.fixed_projection(rows.select(F.size("embedding")).head()[0])
    p.save(spark, f"file://{root}/table")
    p.save_archive(str(root / "p.npz"))
    found = Projection.load(spark, f"file://{root}/table").project(rows, into="a")
    found = Projection.load_archive(str(root / "p.npz")).project(found, into="b")
    return found.select("vec_id", *[Q.r(F.get("a", F.lit(i))).alias(f"r{i}") for i in range(Q.RELATIONS)], (F.col("a") == F.col("b")).alias("equal"))


def stream_projection(spark: SparkSession, sf: str) -> DataFrame:
    """The table as a stream, projected as it arrives."""
    schema = read(spark, sf, "embeddings").select("vec_id", "embedding").schema
    rows = read(spark, sf, "embeddings").select("vec_id", "embedding")
    root = f"file://{folder(spark)}"
    rows.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    stream = stream.withColumn("embedding", F.col("embedding").cast("array<double>"))
    start_projection(Q.fixed_projection(rows.select(F.size("embedding")).head()[0]), stream, f"{root}/out", f"{root}/state").awaitTermination()
    found = spark.read.parquet(f"{root}/out")
    return found.select("vec_id", *[Q.r(F.get("relation", F.lit(i))).alias(f"r{i}") for i in range(Q.RELATIONS)])


def write_manifests(spark: SparkSession, sf: str, root: Path) -> None:
    """A snapshot of all vectors with a text each, and pairs of neighbours that are labelled by whether labels agree."""
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in Q.embeddings(spark, sf).orderBy("vec_id").toLocalIterator()]
    splits, lines = {}, {s: [] for s in pair_benchmark.SPLITS}
    of = lambda i: "train" if i % 5 < 3 else "validation" if i % 5 == 3 else "test"
    for (i, _, a), (j, _, b) in zip(rows[:-1], rows[1:], strict=True):
        lines[of(i)].append({"example_id": f"e{i}", "split": of(i), "left": f"text {i}", "right": f"text {j}", "label": int(a == b)})
    for split, own in lines.items():
        splits[split] = {"sha256": write_lines(root / f"{split}.jsonl", own, blank=50), "rows": len(own)}
    metadata = {"splits": splits, "benchmark": "neighbours"}
    jsonl.write_report(metadata, root / "metadata.json")
    np.savez(root / "snapshot.npz", texts=np.array([f"text {i}" for i, _, _ in rows]), embeddings=np.array([e for _, e, _ in rows], np.float32), model=np.array("m"), dataset_sha256=np.array(integrity.canonical_json_sha256(metadata)))


def pair_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of the manifests with its texts' vectors: the snapshot, the manifests and their checks."""
    root = folder(spark)
    write_manifests(spark, sf, root)
    rows, facts = pair_benchmark.load_snapshot(spark, str(root / "snapshot.npz"))
    pairs, _, sha = pair_benchmark.load_manifests(spark, str(root))
    if facts["dataset_sha256"] != sha or pair_benchmark.missing_texts(pairs, rows).limit(1).count():
        raise ReplayError("the snapshot isn't that of the manifests")
    table = pair_benchmark.pair_table(pairs, rows)
    return table.select("example_id", "split", F.col("y").alias("label"), Q.r(F.get(F.col("Cosine only").cast("array<double>"), F.lit(0)), 4).alias("cosine"), F.lit(facts["unique_texts"]).cast("long").alias("texts"))


def pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Test pairs scored by a logistic model with given weights on standardised features, and its metrics."""
    table = Q._pairs(spark, sf).withColumn("c", F.get(F.col("Cosine only").cast("array<double>"), F.lit(0)))
    train, test = table.filter("a % 5 < 4"), table.filter("a % 5 = 4")
    s = train.agg(F.avg("c").alias("m"), F.stddev_pop("c").alias("s")).head()
    p = 1 / (1 + F.exp(-(0.7 * (F.col("c") - s["m"]) / (s["s"] or 1.0) - 0.2)))
    return Q.metrics.binary_metrics(test.select("y", p.alias("p"))).select(*[Q.r(c, 4).alias(c) for c in ("accuracy", "balanced_accuracy", "f1", "roc_auc", "log_loss")])


def sides(spark: SparkSession, sf: str) -> DataFrame:
    """index, embedding, tokens, values, true, predicted and split of all rows."""
    return Q._sides(spark, sf).join(Q.coordinates(spark, sf).select(F.col("doc_id").alias("index"), F.col("relation").alias("values")), "index")


def whole_pairs(rows: DataFrame) -> DataFrame:
    """Four pairs of different train rows for each test row, or two: powers of two, whose means don't depend on order."""
    n = rows.filter("index % 5 < 3").count()
    first = (F.col("query_index") * 7 + F.col("pair_order") * 13) % n
    return Q.hard_pairs(rows, lambda asked: asked.withColumn("na", first + 1).withColumn("nb", (first + 1 + (F.col("query_index") * 11 + F.col("pair_order") * 17) % (n - 1)) % n + 1))


def put_together(parts: Iterable[Path], path: Path, start: bytes = b"") -> str:
    """One file of ``start`` and the files of ``parts``, which go; its hash."""
    digest = hashlib.sha256(start)
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "wb") as whole:
        whole.write(start)
        for part in parts:
            with open(part, "rb") as f:
                while block := f.read(1 << 20):
                    digest.update(block)
                    whole.write(block)
            part.unlink()
    return digest.hexdigest()


def as_gzip_lines(f: BinaryIO, batches: Iterator[pa.RecordBatch]) -> int:
    with gzip.GzipFile(fileobj=f, mode="wb", filename="", mtime=0) as z:
        return as_lines()(z, batches)


CACHED = pa.schema([("key", pa.string()), ("source", pa.string()), ("dimensions", pa.int64()), ("raw", pa.binary()), ("payload", pa.string()), ("array", pa.string())])


def write_pieces(at: Path, part: int, split: str, batches: Iterable[pa.RecordBatch]) -> int:
    """The rows (index, tokens, values, predicted, vector) of a split that a task has, in each of its files' formats."""
    n, name = 0, f"{split}-{part:06}-"
    own = uuid.uuid4().hex
    with ExitStack() as files:
        selected, primitives, matrix, values, predicted, rows = (files.enter_context(open(at / f".{own}-{k}", "wb")) for k in PIECES)
        cached = files.enter_context(pa.ipc.new_stream(rows, CACHED))
        for b in batches:
            index, vectors, measured = b.column("index").to_pylist(), [np.asarray(v.values.to_numpy(), "<f4") for v in b.column("vector")], b.column("values").to_pylist()
            for i, tokens, v in zip(index, b.column("tokens").to_pylist(), measured, strict=True):
                selected.write(f"{json.dumps({'stable_key': f'row-{i}', 'code_sha256': f'{i:064d}', 'token_count': tokens})}\n".encode())
                primitives.write(f"{json.dumps({'stable_key': f'row-{i}', **dict(zip(replay.NAMES, v, strict=True))})}\n".encode())
            raw = [v.tobytes() for v in vectors]
            matrix.write(b"".join(raw))
            values.write(np.array(measured, "<f8").tobytes())
            predicted.write(np.array(b.column("predicted").to_pylist(), "<f8").tobytes())
            columns = [f"row-{i}" for i in index], [f"{i:064d}" for i in index], [len(v) for v in vectors], raw, [hashlib.sha256(v).hexdigest() for v in raw], [integrity.array_sha256(v) for v in vectors]
            cached.write_batch(pa.record_batch([pa.array(c, t) for c, t in zip(columns, CACHED.types, strict=True)], schema=CACHED))
            n += b.num_rows
    for k in PIECES:
        (at / f".{own}-{k}").replace(at / f"{name}{k}")
    return n


PIECES = ("selected", "primitives", "matrix", "values", "predicted", "cached")


def write_evidence(spark: SparkSession, sf: str, root: Path, dimensions: int | None = None, predictions: Callable[[dict[str, tuple]], dict[str, np.ndarray]] | None = None) -> Path:
    """A tree of stored evidence of all rows, in order of id within their split; returns its cache. ``dimensions`` cuts the
    vectors, for fits that have a closed form; ``predictions`` makes such a fit from each split's matrix and values.

    Tasks write the pieces of each file, and the driver puts them together, as bytes; rows don't go through it, but for those
    of the cache, which SQLite wants from one writer, and which it reads from the pieces batch by batch."""
    number = F.when(F.col("index") % 5 < 3, 0).when(F.col("index") % 5 == 3, 1).otherwise(2)
    rows = sides(spark, sf).withColumn("split", number).cache()
    d = dimensions or rows.select(F.size("embedding")).head()[0]
    pieces = folder(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, parts = TaskContext.get().partitionId(), (b.filter(pc.equal(b.column("split"), s)) for b in batches for s in sorted(set(b.column("split").to_pylist())))
        for s, own in groupby(parts, lambda b: b.column("split")[0].as_py()):
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([part]), pa.array([write_pieces(pieces, part, replay.SPLITS[s], own)])], ["split", "part", "n"])

    ordered = rows.select("split", "index", "tokens", "values", "predicted", F.slice("embedding", 1, d).cast("array<float>").alias("vector")).repartitionByRange("split", "index").sortWithinPartitions("split", "index")
    written = sorted(ordered.mapInArrow(write, "split long, part long, n long").collect())
    sizes = {s: sum(r["n"] for r in written if replay.SPLITS[r["split"]] == s) for s in replay.SPLITS}

    def whole(split: str, kind: str, at: Path | None = None) -> tuple[Path, str]:
        path = at or pieces / f"{split}-{kind}"
        return path, put_together((pieces / f"{split}-{r['part']:06}-{kind}" for r in written if replay.SPLITS[r["split"]] == split), path)

    artifacts, arrays_sha, values = {}, {}, {}
    for split, n in sizes.items():
        a, b = (whole(split, k, root / name.format(split))[1] for k, name in (("selected", replay.SELECTED), ("primitives", replay.PRIMITIVES)))
        artifacts[split] = {"selected_manifest": {"sha256": a, "rows": n}, "primitive_table": {"sha256": b, "rows": n}}
        matrix = whole(split, "matrix")[0]
        arrays_sha[split] = _array_file_sha256(matrix, "float32", (n, d))
        if predictions:
            values[split] = np.fromfile(matrix, "<f4").reshape(n, d).astype(float), np.fromfile(whole(split, "values")[0], "<f8").reshape(n, len(replay.NAMES))

    def record(name: str, content: dict) -> None:
        jsonl.write_report({"status": replay.STATES[name]} | content, root / name)

    record(replay.SELECTION, {"artifacts": artifacts})
    record(replay.EMBEDDINGS, {"splits": {s: {"dimensions": d, "array_sha256": sha, "extraction_fingerprint_sha256": FINGERPRINT} for s, sha in arrays_sha.items()}})
    with closing(sqlite3.connect(root / "cache.sqlite3")) as c:
        c.execute(f"CREATE TABLE {caches.CACHE_TABLE} (stable_key TEXT, source_sha256 TEXT, extraction_fingerprint_sha256 TEXT, dtype TEXT, dimensions INTEGER, embedding BLOB, payload_sha256 TEXT, array_sha256 TEXT)")
        for r in written:
            with open(pieces / f"{replay.SPLITS[r['split']]}-{r['part']:06}-cached", "rb") as f, pa.ipc.open_stream(f) as batches:
                for batch in batches:
                    c.executemany(f"INSERT INTO {caches.CACHE_TABLE} VALUES (?, ?, '{FINGERPRINT}', 'float32', ?, ?, ?, ?)", zip(*(x.to_pylist() for x in batch.columns), strict=True))
        c.commit()
    fitted, hashes = predictions(values) if predictions else {}, {}
    for split, (role, name) in replay.PREDICTIONS.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        if fitted:
            np.save(path, fitted[split])
            sha = integrity.array_sha256(fitted[split])
        else:
            raw = whole(split, "predicted")[0]
            header, shape = io.BytesIO(), (sizes[split], len(replay.NAMES))
            np.lib.format.write_array_header_1_0(header, {"descr": "<f8", "fortran_order": False, "shape": shape})
            sha = _array_file_sha256(raw, "float64", shape)
            put_together([raw], path, header.getvalue())
        hashes[role] = {"file_sha256": integrity.stream_sha256(path), "array_sha256": sha}
    record(replay.PROBES, {"predictions": hashes})
    record(replay.PROBE_BUNDLE, {"contract": {"primitives": {n: {"selected_alpha": 1.0} for n in replay.NAMES}}})
    pairs = whole_pairs(rows).cache()
    places = running_sum(rows.select("split", "index"), ["split", "index"], F.lit(1), "place")
    place = {"train": places.filter("split = 0"), "test": places.filter("split = 2").withColumn("place", F.col("place") - sizes["train"] - sizes["validation"])}
    counted = place["test"].join(pairs.groupBy(F.col("query_index").alias("index")).agg(F.count("*").alias("n")), "index", "left")
    counted = counted.repartitionByRange("place").sortWithinPartitions("place").select(F.coalesce("n", F.lit(0)).alias("selected_pair_count"))
    queries = put_together(write_files(counted, pieces / "queries", as_lines()), root / replay.QUERIES)
    at = lambda s, role: place[s].select(F.col("index").alias(f"{role}_index"), F.col("place").alias(role))
    placed = pairs.join(at("test", "query"), "query_index").join(at("train", "closer"), "closer_index").join(at("train", "farther"), "farther_index")
    keys = [F.concat(F.lit("row-"), f"{role}_index").alias(f"{role}_stable_key") for role in ("query", "closer", "farther")]
    placed = placed.repartitionByRange("query", "pair_order").sortWithinPartitions("query", "pair_order")
    placed = placed.select(F.col("query").alias("query_index"), "pair_order", keys[0], F.col("closer").alias("closer_candidate_index"), F.col("farther").alias("farther_candidate_index"), *keys[1:])
    archive = put_together(write_files(placed, pieces / "pairs", as_gzip_lines), root / replay.PAIRS)
    record(replay.HARD_NEGATIVES, {"artifacts": {"queries": {"file_sha256": queries}, "pairs": {"file_sha256": archive, "uncompressed_file_sha256": integrity.stream_sha256(root / replay.PAIRS, gzip.open)}}})
    scores = hard_negatives.query_scores(pairs, rows.filter("split = 2"), rows.filter("split = 0"))
    record(replay.PUBLISHED, {"scientific_decision": hard_negatives.decision(scores).head().asDict(recursive=True)})
    pairs.unpersist()
    rows.unpersist()
    shutil.rmtree(pieces)
    return root / "cache.sqlite3"


def _array_file_sha256(path: Path, dtype: str, shape: tuple[int, ...]) -> str:
    """As ``integrity.array_sha256``, of the bytes in a file."""
    digest = hashlib.sha256(integrity.array_header(dtype, shape))
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def selection_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The selected rows of all splits, their values scaled by those of train."""
    root = folder(spark)
    write_evidence(spark, sf, root)
    found, _, _ = replay.scaled_by_train(replay.load_selection(spark, root))
    parts = [rows.select(F.lit(s).alias("split"), "ordinal", "stable_key", "tokens", *[Q.r(F.get("true", F.lit(i))).alias(f"z{i}") for i in range(Q.RELATIONS)]) for s, rows in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def stored_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Verified vectors of two caches, which agree, in manifest order."""
    root = folder(spark)
    path = write_evidence(spark, sf, root)
    selection = replay.load_selection(spark, root)
    found, reports = replay.verified_embeddings(spark, root, selection, path, path)
    parts = [rows.select(F.lit(s).alias("split"), "ordinal", F.lit(reports[s]["rows"]).cast("long").alias("rows"), Q.r(V.total(F.col("embedding"))).alias("total")) for s, rows in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def stored_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The archive's pairs after all checks of their places and keys."""
    root = folder(spark)
    write_evidence(spark, sf, root)
    selection = replay.load_selection(spark, root)
    pairs, counts = replay.load_pairs(spark, root, selection["train"], selection["test"])
    return pairs.join(counts, "query_index")


def replayed_decision(spark: SparkSession, sf: str) -> DataFrame:
    """The decision recomputed from stored evidence: selection, two caches, predictions, pairs, and the published one."""
    root = folder(spark)
    path = write_evidence(spark, sf, root)
    report = replay.replay_hard_negatives(spark, str(root), str(path), str(path))
    d = report["scientific_decision"]
    row = (*[round(d["query_equal_weighted_accuracy"][m], Q.PLACES) for m in hard_negatives.METHODS], d["queries_with_pairs"], d["queries_without_pairs"], report["hard_negative_pairs"], d["outcome"], report["published_verification"]["exact_decision_match"])
    return spark.createDataFrame([row], ", ".join(f"{m} double" for m in hard_negatives.METHODS) + ", queries_with_pairs long, queries_without_pairs long, pairs long, outcome string, published boolean")


def exported_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinates of the test rows by the exported archive, refitted on the first two dimensions and verified."""

    def predictions(splits: dict[str, tuple]) -> dict[str, np.ndarray]:
        x, y = splits["train"]
        q25, median, q75 = np.percentile(y, (25, 50, 75), axis=0)
        z, xc = (y - median) / np.maximum(q75 - q25, 1.0), x - x.mean(axis=0)
        w = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ (z - z.mean(axis=0)))
        return {s: splits[s][0] @ w + (z.mean(axis=0) - x.mean(axis=0) @ w) for s in replay.PREDICTIONS}

    root = folder(spark)
    path = write_evidence(spark, sf, root, 2, predictions)
    report = replay.export_projection(spark, str(root), str(path), str(root / "p.npz"))
    rows = Q.training(spark, sf).filter("vec_id % 5 = 4").select("vec_id", F.slice("embedding", 1, 2).alias("embedding"))
    found = Projection.load_archive(str(root / "p.npz")).project(rows)
    verified = report["verification"]["largest_prediction_difference"] <= report["verification"]["tolerance"]
    return found.select("vec_id", *[Q.r(F.get("relation", F.lit(i))).alias(f"r{i}") for i in range(Q.RELATIONS)], F.lit(verified).alias("verified"))


def singular_fit(spark: SparkSession, sf: str) -> DataFrame:
    """A fit without penalty on a dimension that stands twice: the pseudo-inverse shares its weight equally."""
    rows = Q.embeddings(spark, sf).join(read(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "n_chars"), "vec_id")
    rows = rows.select(F.array(F.get("embedding", F.lit(0)), F.get("embedding", F.lit(0))).alias("embedding"), F.array(F.col("n_chars").cast("double")).alias("relation"))
    p = Projection.fit(rows, alpha=0.0)
    return spark.createDataFrame([tuple(round(float(v), 4) for v in (*p.coefficients[0], p.intercept[0]))], "w1 double, w2 double, b double")


def compared_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Three sources with vectors of the table, ranked by cosine, predicted and measured distance."""
    sources = {name: source for name, source, _ in Q.SNIPPETS}
    rows = Q.embeddings(spark, sf).filter("vec_id < 3")
    names = {0: ("Query", "guarded"), 1: ("Candidate A", "try"), 2: ("Candidate B", "lambda")}
    data = [(names[r["vec_id"]][0], sources[names[r["vec_id"]][1]], list(r["embedding"])) for r in rows.collect()]
    p = Q.fixed_projection(len(data[0][2]))
    ranking, _, verdict = compare_relations(p, spark.createDataFrame(data, "name string, source string, embedding array<double>"))
    return ranking.select("name", "cosine_rank", "predicted_rank", "measured_rank", *[Q.r(m).alias(m) for m in ("cosine", "predicted", "measured")], *[F.lit(verdict[m]).alias(f"nearest_by_{m}") for m in ("cosine", "predicted", "measured")])


def _refused(kinds: tuple[type[Exception], ...], run: Callable[[], object]) -> bool:
    try:
        run()
    except kinds:
        return True
    return False


def refusals(spark: SparkSession, sf: str) -> DataFrame:
    """What must be refused: broken projections, fits, searches, manifests, evidence, and whether each is."""
    rows = Q.embeddings(spark, sf)
    d = rows.select(F.size("embedding")).head()[0]
    p, source = Q.fixed_projection(d), Q.vector_of(rows, 0)
    one = {"coefficients": p.coefficients, "intercept": p.intercept, "relation_median": p.relation_median, "relation_scale": p.relation_scale, "embedding_mean": p.embedding_mean, "alpha": 1.0, "relation_names": p.relation_names}
    changed = lambda **other: lambda: Projection(**(one | other))
    trained = Q.training(spark, sf)
    root = folder(spark)
    write_manifests(spark, sf, root)
    evidence = folder(spark)
    path = write_evidence(spark, sf, evidence)

    def spoilt(name: str, at: Path, run: Callable[[], object]) -> Callable[[], object]:
        def go() -> None:
            file = at / name
            kept = file.read_bytes()
            try:
                file.write_bytes(kept[: len(kept) // 2])
                run()
            finally:
                file.write_bytes(kept)

        return go

    replayed = lambda: replay.replay_hard_negatives(spark, str(evidence), str(path), str(path))
    cases: dict[str, Callable[[], object]] = {
        "projection: scale of zero": changed(relation_scale=[0.0, 1.0, 1.0]),
        "projection: infinite coefficient": changed(coefficients=np.full((3, d), np.inf)),
        "projection: names repeat": changed(relation_names=("a", "a", "b")),
        "projection: dimensions differ": changed(embedding_mean=[0.0]),
        "projection: negative alpha": changed(alpha=-1.0),
        "fit: one row": lambda: Projection.fit(trained.limit(1)),
        "fit: negative alpha": lambda: Projection.fit(trained, alpha=-1.0),
        "fit: null coordinate": lambda: Projection.fit(trained.withColumn("relation", F.array(F.lit(None).cast("double")))),
        "fit: too few names": lambda: Projection.fit(trained, relation_names=["a"]),
        "search: k of zero": lambda: search(p, source, rows, k=0),
        "search: pool below k": lambda: search(p, source, rows, k=10, candidate_pool=5),
        "search: unknown row excluded": lambda: search(p, source, rows, exclude_index=-1),
        "search: source of zeros": lambda: search(p, [0.0] * d, rows),
        "search: other dimensions": lambda: search(p, source[:-1], rows),
        "manifest: cut file": spoilt("train.jsonl", root, lambda: pair_benchmark.load_manifests(spark, str(root))),
        "manifest: cut metadata": spoilt("metadata.json", root, lambda: pair_benchmark.load_manifests(spark, str(root))),
        "evidence: cut selection": spoilt(replay.SELECTED.format("train"), evidence, replayed),
        "evidence: cut predictions": spoilt(replay.PREDICTIONS["test"][1], evidence, replayed),
        "evidence: cut pairs": spoilt(replay.PAIRS, evidence, replayed),
        "evidence: no table": lambda: sqlite.require_tables(path, "absent"),
    }
    kinds = (ReplayError, ArtifactError, CoordinateError)
    return spark.createDataFrame([(name, _refused(kinds, run)) for name, run in cases.items()], "case string, refused boolean")


def code_structure_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A function for each document, whose measures follow from the document's number."""
    docs = read(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 4).cast("int").alias("depth"), (F.col("doc_id") % 5).cast("int").alias("calls"))
    level = lambda i: F.concat(F.repeat(F.lit("    "), i), F.lit("if v:\n"))
    ifs = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest("depth", F.lit(1))), lambda i: F.when(F.col("depth") > 0, level(i)).otherwise("")), "")
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.col("calls")), lambda i: F.concat(F.repeat(F.lit("    "), F.col("depth") + 1), F.when(i < F.col("calls"), F.concat(F.lit("g"), i, F.lit("(v)\n"))).otherwise("pass\n"))), "")
    measured = docs.select("doc_id", Q.structure_column(F.concat(F.lit("def f(v):\n"), ifs, body)).alias("s"))
    return measured.select("doc_id", *[F.col(f"s.{n}").alias(n) for n in NAMES])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        sqlite_tables, sqlite_vectors, cache_contracts, cache_lookup, array_inventory, array_errors, inventory, json_lines, json_report, file_hashes, text_hash_match,
        vector_hashes, projection_files, stream_projection, pair_manifests, pair_scores, selection_rows, stored_embeddings, stored_pairs, replayed_decision,
        exported_projection, singular_fit, compared_relations, refusals, code_structure_rows,
    )
}
