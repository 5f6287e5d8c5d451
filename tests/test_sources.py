import json
import sqlite3
import zipfile

import numpy as np
import pytest

from orrery.errors import ReplayError
from orrery.sources import arrays, caches, jsonl, sqlite
from pyspark.sql import types as T


@pytest.fixture
def cache(tmp_path):
    path = tmp_path / "cache.sqlite3"
    c = sqlite3.connect(path)
    c.execute("CREATE TABLE embedding_contracts (contract_sha256 TEXT PRIMARY KEY, schema_version INTEGER, provider TEXT, model TEXT, base_url TEXT, truncate INTEGER, normalization TEXT, stored_dtype TEXT, created_at TEXT)")
    c.execute("CREATE TABLE embeddings (contract_sha256 TEXT, text_sha256 TEXT, text_value TEXT, dimension INTEGER, vector BLOB, created_at TEXT)")
    c.executemany("INSERT INTO embedding_contracts VALUES (?,?,?,?,?,?,?,?,?)", [("b", 1, "p", "demo", "u", 1, "none", "float32", "t"), ("a", 1, "p", "demo", "u", 0, "none", "float32", "t")])
    c.execute("INSERT INTO embeddings VALUES ('b', 't', 'text', 3, ?, 't')", (np.ones(3, np.float32).tobytes(),))
    c.commit()
    c.close()
    return path


def test_sqlite_tables(spark, cache):
    rows = sqlite.read_table(spark, cache, "embedding_contracts", partition_rows=1)
    assert rows.rdd.getNumPartitions() == 2 and rows.count() == 2
    assert [r.model for r in rows.filter("contract_sha256 = 'a'").collect()] == ["demo"]
    with pytest.raises(ReplayError):
        sqlite.table_names(cache.parent / "none")
    with pytest.raises(ReplayError):
        sqlite.require_tables(cache, "other")


def test_contract_report(spark, cache):
    before = cache.read_bytes()
    report = caches.inspect_cache(spark, cache)
    assert report["embedding_rows"] == 1 and report["contract_count"] == 2 and report["tables"] == ["embedding_contracts", "embeddings"]
    a, b = report["contracts"]
    assert (a["contract_sha256"], a["rows"], a["minimum_dimension"], a["truncate"]) == ("a", 0, None, False)
    assert (b["rows"], b["minimum_dimension"], b["maximum_dimension"], b["truncate"]) == (1, 3, 3, True)
    assert cache.read_bytes() == before


def raw_npy(descr: str, data: bytes = b"", version: int = 1) -> bytes:
    header = f"{{'descr': {descr}, 'fortran_order': False, 'shape': (2,), }}".encode() + b"\n"
    return arrays.MAGIC + bytes([version, 0]) + len(header).to_bytes(2 if version == 1 else 4, "little") + header + data


def test_inventory(spark, tmp_path, cache):
    (tmp_path / "sub").mkdir()
    np.save(tmp_path / "sub" / "m.npy", np.zeros((7, 5), np.float32))
    np.savez(tmp_path / "s.npz", texts=np.array(["a", "b"]), embeddings=np.zeros((2, 3)), model=np.array("m"), dataset_sha256=np.array("0" * 64))
    np.savez(tmp_path / "o.npz", objects=np.array([{}, None], dtype=object), n=np.arange(3), big=np.arange(17))
    with zipfile.ZipFile(tmp_path / "q.npz", "w") as z:
        z.writestr("v.npy", raw_npy("'<f16'", b"\0" * 32))
    (tmp_path / "broken.npz").write_bytes(b"no zip")
    (tmp_path / "broken.npy").write_bytes(b"no array")
    report = caches.inventory(spark, tmp_path, cache)
    assert (report["npz_count"], report["npz_error_count"], report["npy_count"], report["npy_error_count"]) == (4, 1, 2, 1)
    npz = {i["path"].rsplit("/")[-1]: i for i in report["npz"]}
    assert npz["s.npz"]["classification"] == "benchmark_embedding_snapshot" and npz["s.npz"]["small_values"]["model"] == "m"
    assert npz["s.npz"]["small_values"]["texts"] == ["a", "b"] and "embeddings" not in npz["s.npz"]["small_values"]
    assert npz["o.npz"]["small_values"] == {"n": [0, 1, 2]} and npz["o.npz"]["skipped_values"] == [{"key": "objects", "reason": "object_dtype_requires_pickle"}]
    assert npz["q.npz"]["arrays"]["v"]["dtype_descriptor"] == "<f16"
    assert "BadZipFile" in npz["broken.npz"]["inspection_error"]
    npy = {i["path"].rsplit("/")[-1]: i for i in report["npy"]}
    assert npy["m.npy"]["shape"] == [7, 5] and npy["m.npy"]["dtype"] == "float32" and "inspection_error" in npy["broken.npy"]
    assert report["sqlite"]["embedding_rows"] == 1 and json.dumps(report)


@pytest.mark.parametrize("content", [b"", arrays.MAGIC, arrays.MAGIC + b"\1", arrays.MAGIC + b"\4\0", arrays.MAGIC + b"\1\0\0\0", arrays.MAGIC + b"\1\0\5\0ab", arrays.MAGIC + b"\1\0\2\0[]", raw_npy("None")])
def test_refused_headers(content):
    import io

    with pytest.raises(ReplayError):
        arrays.read_header(io.BytesIO(content), "x")


def test_header_versions_and_descriptors():
    import io

    for version in (1, 2, 3):
        assert arrays.read_header(io.BytesIO(raw_npy("'<f4'", version=version)), "x")["npy_version"] == [version, 0]
    got = arrays.read_header(io.BytesIO(raw_npy("[('a', '<f4'), ('b', '|O')]")), "x")
    assert got["contains_objects"] and got["dtype_descriptor"] == [["a", "<f4"], ["b", "|O"]]
    assert not arrays.has_objects("<f4") and arrays.has_objects({"a": ["|O"]}) and arrays.has_objects("O")
    unknown = arrays.read_header(io.BytesIO(raw_npy("'<z9'")), "x")
    assert not unknown["dtype_supported"] and unknown["dtype"] == "<z9" and unknown["dtype_error"]


def test_lines(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1, "b": "x"}\n\n  \n{"b": "y", "a": 2}\n')
    assert sorted(map(tuple, jsonl.read_lines(spark, str(path), schema, exact=True).collect())) == [(1, "x"), (2, "y")]
    for line in ("3", "[1]", '{"a": 1}', '{"a": 1, "b": "x", "c": 0}', '{"a": "one", "b": "x"}', "{broken"):
        path.write_text('{"a": 1, "b": "x"}\n' + line + "\n")
        with pytest.raises(ReplayError):
            jsonl.read_lines(spark, str(path), schema, exact=True)
    path.write_text('{"a": 1, "b": "x", "c": 0}\n')
    assert jsonl.read_lines(spark, str(path), schema).count() == 1
    with pytest.raises(ReplayError):
        jsonl.read_object(path.parent / "none.json")
