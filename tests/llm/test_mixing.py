import re
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from orrery.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets_fill_the_budget_below_the_limits(sizes):
    found = mixing.targets(sizes)
    assert abs(sum(found) - 1.5 * sum(sizes)) <= 1e-6 * (1 + sum(sizes))
    assert all(t <= 2 * s + 1e-6 for t, s in zip(found, sizes, strict=True))
    free = [(t / mixing.WEIGHTS[i % 3]) for i, (t, s) in enumerate(zip(found, sizes, strict=True)) if t < 2 * s - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * max(free)


def check(docs, rows):
    sizes, by = {}, {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    want = dict(zip(names, mixing.targets([sizes[n] for n in names]), strict=True))
    assert len(rows) == len(docs)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        by[r.source] = by.get(r.source, 0) + r.taken
    assert all(abs(by[n] - want[n]) <= 1 for n in names)
    for n in names:  # the prefix of the keys' order
        own = sorted((r for r in rows if r.source == n and r.size), key=lambda r: r.key)
        extra = [r.taken - r.size * int(want[n] // sizes[n]) for r in own]
        cut = [i for i, (x, r) in enumerate(zip(extra, own, strict=True)) if x < r.size]
        assert not cut or not any(extra[cut[0] + 1 :])


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = mixing.mix_sources(spark, spark.read.parquet(f"{sf}/documents.parquet")).collect()
    check(docs, rows)
    again = mixing.op1_mix_sources(spark, sf).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    sizes = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    assert all(r["size"] == sizes[r.doc_id] for r in rows)


def test_odd_rows(spark):
    docs = [(1, None, None), (2, "", "a"), (3, "one two\x0bthree x", "a"), (4, "w " * 5000, "b"), (5, "x y", None), (5, "x y", None), (6, "q", "c")]
    df = spark.createDataFrame([(i, t, s, 9, 1.0) for i, t, s in docs], "doc_id long, text string, source string, size int, target double")
    check(docs, mixing.mix_sources(spark, df).collect())
    assert mixing.mix_sources(spark, df.limit(0)).collect() == []


def test_heavier_documents_come_first(spark):
    df = spark.createDataFrame([(i, "w " * 10, "s", 0.05 if i % 2 else 1.0) for i in range(400)], "doc_id long, text string, source string, q double")
    rows = mixing.mix_sources(spark, df, weight="q", share=0.5).collect()
    assert sum(r.taken for r in rows if r.doc_id % 2 == 0) > 3 * sum(r.taken for r in rows if r.doc_id % 2)


def test_rows_of_any_kind_are_mixed_as_documents(spark):
    """Nulls, repeated ids and rows, clashing names: each row is taken or not by itself, and other columns stay its own."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(5 + i % 7)), f"s{i % 2}") for i in range(30)]
    rows += [(3, "other text of three", "s1"), (None, "no id at all", "s0"), (None, "no id either", None), (4, None, "s0"), (None, None, None), rows[5], rows[5], (9, "", "s1")]
    names = ["doc_id", "text", "source", "_size", "_nth", "_taken", "size", "taken", "nth", "row"]
    df = spark.createDataFrame([(*r, *[f"{k}-{n}" for n in names[3:]]) for k, r in enumerate(rows)], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    out = mixing.mix_documents(spark, df, share=1.0)
    assert out.columns == names
    counts, total = Counter(), 0
    for r in out.collect():
        k = int(r["row"].split("-")[0])
        assert (r.doc_id, r.source) == (rows[k][0], rows[k][2]) and rows[k][1].startswith(r.text) and all(r[n] == f"{k}-{n}" for n in names[3:])
        counts[k] += 1
        total += len(WORD.findall(r.text))
    assert max(counts.values()) <= 2 and abs(total - sum(len(WORD.findall(t or "")) for _, t, _ in rows)) <= 2
    assert mixing.mix_documents(spark, df.limit(0)).collect() == []
