"""Searches for all required sources, and on whole embeddings."""

import re

import numpy as np
import pytest

import __spark_entry__
from orrery import catalog


def test_every_required_source_is_searched_for(spark, sf):
    ids = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    hits = catalog.QUERIES["search_multi_source"](spark, sf).collect()
    assert {r.source for r in hits} == {i for i in ids if i % 20 == 0}
    assert len(hits) == 5 * len({r.source for r in hits})


@pytest.fixture(scope="module")
def brute(spark, sf):
    """Ids, vectors, and the model's (coefficients, intercept, median, scale) solved by NumPy."""
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect())
    texts = {r.doc_id: (r.n_chars, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars", "text").collect()}
    ids, x = np.array([i for i, _ in rows]), np.array([e for _, e in rows], dtype=np.float64)
    has = np.array([i in texts for i in ids])
    split = lambda t: [w for w in re.split("[ \\t\\n\\x0b\\f\\r]+", t) if w]
    y = np.array([(texts[i][0], len(split(texts[i][1])), len(set(split(texts[i][1])))) for i in ids[has]], dtype=np.float64)
    q25, median, q75 = np.percentile(y, (25, 50, 75), axis=0)
    scale = np.maximum(q75 - q25, 1.0)
    a, z = x[has], (y - median) / scale
    u, v = a - a.mean(0), z - z.mean(0)
    w = np.linalg.solve(u.T @ u + np.eye(x.shape[1]), u.T @ v).T
    return ids, x, (w, z.mean(0) - w @ a.mean(0), median, scale)


def nearest(brute, source, k, pool=None, exclude=True):
    ids, x, (w, *_) = brute
    s = x[ids == source][0]
    cosine = 1 - x @ s / (np.linalg.norm(x, axis=1) * np.linalg.norm(s))
    rows = [(float(r), float(c), int(i)) for r, c, i in zip(np.abs((x - s) @ w.T).max(1), cosine, ids, strict=True) if not (exclude and i == source)]
    if pool:
        rows = sorted(rows, key=lambda r: (r[1], r[2]))[:pool]
    return sorted(rows)[:k]


def same(hits, want):
    hits = sorted(hits, key=lambda r: r["rank"])
    assert [r["rank"] for r in hits] == list(range(1, len(want) + 1)) and [r["index"] for r in hits] == [i for _, _, i in want]
    assert np.allclose([(r.relation_distance, r.cosine_distance) for r in hits], [r[:2] for r in want], atol=2e-6)


def test_ridge_fit_has_all_dimensions_and_relations(spark, sf, brute):
    _, x, (w, b, median, scale) = brute
    rows = sorted(catalog.WHOLE["ridge_fit_whole"](spark, sf).collect())
    assert np.array([r.w for r in rows]).shape == (3, x.shape[1]) and x.shape[1] > 2
    assert np.allclose([r.w for r in rows], w, atol=2e-6)
    assert np.allclose([(r.b, r.median, r.scale) for r in rows], np.array([b, median, scale]).T, atol=2e-6)


@pytest.mark.parametrize(("name", "options"), [("topk", {"exclude": False}), ("exclude", {}), ("candidate_pool", {"pool": 100})])
def test_search_on_whole_embeddings(spark, sf, brute, name, options):
    same(catalog.WHOLE[f"search_whole_{name}"](spark, sf).collect(), nearest(brute, 0, 10, **options))


def test_search_of_all_sources_on_whole_embeddings(spark, sf, brute):
    hits = catalog.WHOLE["search_whole_multi_source"](spark, sf).collect()
    asked = [int(i) for i in brute[0] if i % 20 == 0]
    assert sorted({r.source for r in hits}) == asked
    for i in asked:
        same([r for r in hits if r.source == i], nearest(brute, i, 5, pool=40))


def test_entry_searches_whole_embeddings(spark, brute):
    assert set(catalog.WHOLE) <= set(__spark_entry__.queries())
    same(__spark_entry__.entry(spark).collect(), nearest(brute, 0, 10, pool=100))
