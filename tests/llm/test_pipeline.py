"""Each stage of the pipeline against a brute-force version on what its predecessor kept."""

import os
from collections import Counter

import duckdb
import pytest
import test_exact_substr
import test_neardup
import test_packing as packed
import test_quality_rules
from test_mixing import WORD

import __spark_entry__
import corpus_pipeline
from orrery.llm import common, mixing, registry


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(common.stored(stage(spark, tables[-1], sf), spark))
    return tables


def texts(df):
    return sorted(map(tuple, df.select("doc_id", "text").collect()))


def test_stages_are_the_named_ones(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for table in stages[1:5]:
        assert table.columns == stages[0].columns and [t for _, t in table.dtypes] == [t for _, t in stages[0].dtypes]


def test_quality(stages):
    assert texts(stages[1]) == [d for d in texts(stages[0]) if test_quality_rules.brute(d[1])[2]]


def test_near_duplicates(stages):
    before = texts(stages[1])
    kept = {i for i, _, _, keep in test_neardup.brute(before) if keep}
    assert texts(stages[2]) == [d for d in before if d[0] in kept]


def test_repeated_substrings(stages):
    want = {r[0]: r for r in test_exact_substr.brute(texts(stages[2]))}
    before = dict(texts(stages[2]))
    for i, text in texts(stages[3]):
        n, gone = want[i][1:3]
        left = len(text.encode())
        assert n - gone - 6 <= left <= n - gone  # broken characters go as a whole
        assert gone or text == before[i]
    assert stages[3].count() == len(before) and stages[3].filter("n_chars <> length(text)").count() == 0


def test_mixing(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    sizes = Counter()
    for r in before.values():
        sizes[r.source] += len(WORD.findall(r.text))
    names = sorted(sizes)
    want = dict(zip(names, mixing.targets([sizes[n] for n in names]), strict=True))
    taken, copies = Counter(), Counter()
    for r in stages[4].collect():
        copies[r.doc_id] += 1
        taken[r.source] += len(WORD.findall(r.text))
        assert before[r.doc_id].text.startswith(r.text)
    assert max(copies.values()) <= 2 and all(abs(taken[n] - want[n]) <= 1 for n in names)


def test_packing(stages):
    docs = Counter(texts(stages[4]))
    rows = stages[5].collect()
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    tok = packed.tokenizer()
    want = Counter()
    for (i, text), n in docs.items():
        want[i] += n * (len(tok.encode(text, add_special_tokens=False).ids) + 1)
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want


def test_run_equals_its_stages(spark, sf, stages):
    rows = lambda df: Counter(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert rows(corpus_pipeline.run(spark, sf)) == rows(stages[5])


def test_registered_queries():
    names = __spark_entry__.queries()
    assert sorted(n.split("_")[0] for n in names if n.startswith("op")) == sorted(f"op{i}" for i in range(1, 11)) and "pipeline" in names
    assert set(registry.SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, sf, name):
    duck = duckdb.connect()
    for f in os.listdir(sf):
        duck.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    got, want = registry.QUERIES[name](spark, sf), duck.sql(registry.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want.project(", ".join(columns)).fetchall()))
