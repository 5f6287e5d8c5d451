import random
import re

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import components, neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, s) in enumerate(sets):
        for b, (_, t) in enumerate(sets[:a]):
            k = len(s & t)
            if k and 100 * k >= 75 * (len(s) + len(t) - k):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(((i, len(s), least.get(find(a)), least.get(find(a)) == i) for a, (i, s) in enumerate(sets)), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randrange(400))
    base = [[word() for _ in range(rnd.randrange(3, 120))] for _ in range(12)]
    passage, docs = [word() for _ in range(40)], []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 5)):
            w[rnd.randrange(len(w))] = word()
        if rnd.random() < 0.3:
            w = passage + [word() for _ in range(rnd.randrange(5, 60))]
        docs.append((i * 7 % 1009, " ".join(w)))
    return docs


@pytest.mark.parametrize("seed, most, nodes, shared", [(1, None, neardup.KEY_NODES, neardup.LOCAL_SHARED), (2, 1500, 12, 3)])
def test_brute_force(spark, monkeypatch, seed, most, nodes, shared):
    """With small bounds, too: large keys and components, keys thinned out before the shuffle, heavy nodes."""
    monkeypatch.setattr(neardup, "KEY_NODES", nodes)
    monkeypatch.setattr(neardup, "ROUND_MEMBERS", 30)
    monkeypatch.setattr(neardup, "ROUND_SHINGLES", 1500)
    monkeypatch.setattr(neardup, "LOCAL_SHARED", shared)
    monkeypatch.setattr(components, "HEAVY", shared)
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = neardup.near_duplicates(spark, df, task_shingles=most or neardup.TASK_SHINGLES)
    assert rows(found) == brute(docs)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (5, "one two three four five"), (6, "One two  three\x0bfour five"), (7, "x " * 30000), (8, "x " * 40000), (9, "é b c d e")]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, node int, key string")
    assert rows(neardup.near_duplicates(spark, df)) == brute(docs)
    assert rows(neardup.near_duplicates(spark, df.limit(0))) == []
    kept = neardup.near_duplicate_filter(spark, df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 7, 9]
    twice = neardup.near_duplicates(spark, df.union(df))
    assert rows(twice) == sorted(brute(docs) * 2, key=str)


def test_repeated_ids_with_other_texts(spark):
    """Rows, not ids, are documents: the query and the filter against brute force over rows."""
    text = lambda w, n=50: " ".join(f"{w}{i}" for i in range(n))
    a, b = text("a"), text("b")
    docs = [(1, a), (2, a + " x"), (2, b)]
    assert rows(neardup.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
    kept = neardup.near_duplicate_filter(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in kept) == [(1, a), (2, b)]
    rnd = random.Random(5)
    docs = [(rnd.choice([None, *range(25)]), t) for _, t in corpus(5, 80)] + [(3, None), (None, ""), (None, "z"), (None, "z")]
    assert rows(neardup.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
    numbered = brute(list(enumerate(t for _, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)))))
    kept = neardup.near_duplicate_filter(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(kept) == sum(r[3] for r in numbered)


def test_hot_keys_are_thinned_out():
    """Nodes that share keys keep one each of them, and what is left still links them all."""
    sig = np.random.default_rng(1).integers(0, 2**16, (300, neardup.SYMBOLS)).astype(np.uint16)
    sig[:200, :32] = sig[0, :32]
    nodes = pa.RecordBatch.from_arrays([pa.array(np.arange(300)), pa.array([s.tobytes() for s in sig])], ["node", "sig"])
    found = pa.Table.from_batches(list(neardup._keys(iter([nodes]), 24))).to_pylist()
    keys = [r for r in found if r["to"] is None]
    assert len(keys) < 64 * 300 - 199 * 20 and {r["node"] for r in found if r["to"] is not None} == set(range(1, 200))


def test_all_pairs_under_the_distance_share_a_key():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**16, neardup.SYMBOLS)
    for _ in range(500):
        b = a.copy()
        at = rng.choice(neardup.SYMBOLS, neardup.DISTANCE, replace=False)
        b[at] ^= 1
        assert any((a[c] == b[c]).all() for c in neardup.KEYS)


def test_signature_distance_of_linked_sets():
    rng, far = np.random.default_rng(4), []
    for _ in range(1500):
        n = int(rng.integers(8, 300))
        x = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        k = -(-75 * 2 * n // 175)
        s = neardup.signatures([np.unique(x[:n]), np.unique(np.concatenate([x[:k], x[n : 2 * n - k]]))])
        far.append(int((s[0] != s[1]).sum()))
    assert max(far) <= neardup.DISTANCE and 13 < np.mean(far) < 17


def test_filter_with_repeated_and_null_ids(spark):
    """Of each group one row stays, whatever the ids; a row's verdict is never another row's."""
    text = lambda w: " ".join(f"{w}{i}" for i in range(30))
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "c"), (3, "c"), (None, "d"), (None, "d"), (None, "b"), (None, "e"), (4, "f")]
    df = spark.createDataFrame([(i, text(w), w) for i, w in rows], "doc_id long, text string, row string")
    found = neardup.near_duplicate_filter(spark, df)
    assert found.columns == df.columns
    assert sorted((r.row, r.doc_id) for r in found.collect()) == [("a", 1), ("b", 2), ("c", 3), ("d", None), ("e", None), ("f", 4)]
