import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from orrery.llm import exact_substr


def brute(docs):
    seen, raws = collections.Counter(), [(i, (t or "").encode()) for i, t in docs]
    for _, r in raws:
        seen.update(r[p : p + 200] for p in range(len(r) - 199))
    out = []
    for i, r in raws:
        mark = bytearray(len(r))
        for p in range(len(r) - 199):
            if seen[r[p : p + 200]] > 1:
                mark[p : p + 200] = b"\1" * 200
        kept = bytes(b for b, m in zip(r, mark, strict=True) if not m)
        out.append((i, len(r), sum(mark), len([x for x in bytes(mark).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé日") for _ in range(rnd.randrange(1, 9)))
    shared = [" ".join(word() for _ in range(n)) for n in (40, 80, 150)]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rnd.randrange(1, 60))) for _ in range(3)]
        if rnd.random() < 0.6:
            s = rnd.choice(shared)
            parts.insert(1, s[rnd.randrange(0, 40) : len(s) - rnd.randrange(0, 40)])
        docs.append((i, " ".join(parts)))
    return docs + [(100 + i, docs[0][1]) for i in range(5)]


@pytest.mark.parametrize("seed, anchor_bytes, shared", [(1, exact_substr.ANCHOR_BYTES, exact_substr.LOCAL_SHARED), (2, 600, 2), (3, exact_substr.ANCHOR_BYTES, 2)])
def test_brute_force(spark, monkeypatch, seed, anchor_bytes, shared):
    monkeypatch.setattr(exact_substr, "SHARD_BYTES", 5000)
    monkeypatch.setattr(exact_substr, "LOCAL_SHARED", shared)
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(exact_substr.removed(spark, df, anchor_bytes=anchor_bytes)) == brute(docs)


def test_odd_rows(spark):
    long = "x" * 700
    docs = [(1, None), (2, ""), (3, "a" * 199), (4, "a" * 200), (5, "a" * 201), (6, long), (7, "ab" * 300), (8, "abc" * 999 + "z"), (9, "q" + "ab" * 120), (10, "\0" * 250)]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, start int, spans string")
    assert rows(exact_substr.removed(spark, df)) == brute(docs)
    assert rows(exact_substr.removed(spark, df.limit(0))) == []
    unique = [(i, "".join(random.Random(i).choices("abcdefgh ", k=400))) for i in range(3)]
    again = spark.createDataFrame([*unique, unique[0], (None, unique[1][1])], "doc_id long, text string")
    found = {(r.doc_id, r.n_removed) for r in exact_substr.removed(spark, again).collect()}
    assert found == {(0, 400), (1, 400), (2, 0), (None, 400)}


def test_filter_keeps_columns(spark):
    shared = "".join(random.Random(0).choices("abcdefgh ", k=300))
    df = spark.createDataFrame([(1, "é" + shared, "a"), (2, "ĩ" + shared + "tail", "b"), (3, None, "c")], "doc_id long, text string, spans string")
    df = df.withColumns({c: F.lit(1) for c in ("_spans", "th", "row", "id", "hash", "_doc", "_th", "salt")})
    out = exact_substr.remove_repeats(spark, df)
    assert out.columns == df.columns
    assert sorted(tuple(r)[:3] for r in out.collect()) == [(1, "", "a"), (2, "tail", "b"), (3, None, "c")]
