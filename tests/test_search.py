import numpy as np
import pytest

from orrery.errors import CoordinateError
from orrery.operators.projection import Projection
from orrery.operators.search import _best, search, search_many

P = Projection([[0.4, 0.0]], [-0.2], [0.5], [2.5], [0.5, 0.0], 1e-10, ("first",))
TARGETS = [(0, [1.0, -1.0]), (1, [2.0, 2.0]), (2, [-1.0, -1.0])]


def rows(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<double>")


def brute(p, source, data, k=10, pool=None, exclude=None):
    s, found = np.array(source), []
    for i, v in data:
        if i == exclude:
            continue
        v = np.array(v)
        cosine = 1 - np.clip(s @ v / np.linalg.norm(s) / np.linalg.norm(v), -1, 1)
        found.append((float(np.max(np.abs(p.coefficients @ (v - s)))), float(cosine), i))
    if pool:
        found = sorted(found, key=lambda r: (r[1], r[2]))[:pool]
    return sorted(found)[:k]


def test_relation_order_differs_from_cosine(spark):
    hits = search(P, [1.0, 1.0], rows(spark, TARGETS)).collect()
    assert [h["index"] for h in hits] == [0, 1, 2] and [h["rank"] for h in hits] == [1, 2, 3]
    assert np.allclose([h.relation_distance for h in hits], [0, 0.4, 0.8], atol=1e-9)
    assert np.allclose([h.cosine_distance for h in hits], [1, 0, 2], atol=1e-9)


def test_pool_and_exclusion(spark):
    assert [h["index"] for h in search(P, [1.0, 1.0], rows(spark, TARGETS), k=1, candidate_pool=2).collect()] == [0]
    data = [(0, [1.0, 1.0]), (1, [1.0, -1.0]), (2, [2.0, 2.0])]
    assert [h["index"] for h in search(P, [1.0, 1.0], rows(spark, data), k=2, exclude_index=0).collect()] == [1, 2]
    assert search(P, [1.0, 1.0], rows(spark, data[:1]), exclude_index=0).collect() == []
    assert search(P, [1.0, 1.0], rows(spark, [])).collect() == []
    assert len(search(P, [1.0, 1.0], rows(spark, TARGETS), k=9, candidate_pool=3).collect()) == 3


@pytest.mark.parametrize("options", [{"k": 0}, {"k": True}, {"k": 2.0}, {"k": 3, "candidate_pool": 2}, {"candidate_pool": True}, {"candidate_pool": 2.5}, {"exclude_index": 7}])
def test_refused_options(spark, options):
    with pytest.raises(CoordinateError):
        search(P, [1.0, 1.0], rows(spark, TARGETS), **options)


@pytest.mark.parametrize("extra", [[0.0, 0.0], [1.0], [1.0, float("nan")], None])
def test_refused_targets(spark, extra):
    with pytest.raises(CoordinateError):
        search(P, [1.0, 1.0], rows(spark, [*TARGETS, (9, extra)]), exclude_index=9)


@pytest.mark.parametrize("source", [[0.0, 0.0], [1.0], [1.0, float("inf")]])
def test_refused_sources(spark, source):
    with pytest.raises(CoordinateError):
        search(P, source, rows(spark, TARGETS))


@pytest.mark.parametrize("pool", [None, 12])
def test_many_sources_and_ties(spark, pool):
    rng = np.random.default_rng(2)
    data = [(int(i) * 3, [float(a) for a in v]) for i, v in enumerate(rng.integers(-2, 3, (80, 3))) if v.any()]
    p = Projection(rng.integers(-1, 2, (2, 3)), [0.0, 1.0], [0.0] * 2, [1.0] * 2, [0.0] * 3, 1.0, ("a", "b"))
    found = search_many(p, rows(spark, data[:9]), rows(spark, data), k=5, candidate_pool=pool, sent_bytes=100).orderBy("source", "rank").collect()
    for i, v in data[:9]:
        want = brute(p, v, data, 5, pool, i)
        mine = [(r.relation_distance, r.cosine_distance, r["index"]) for r in found if r.source == i]
        assert np.allclose(mine, want, atol=1e-9)
        one = search(p, v, rows(spark, data), k=5, candidate_pool=pool, exclude_index=i).collect() if i < 6 else None
        assert one is None or np.allclose([(r.relation_distance, r.cosine_distance) for r in one], [w[:2] for w in want], atol=1e-9)


def test_plan_has_no_shuffle_of_the_table(spark):
    plan = search(P, [1.0, 1.0], rows(spark, TARGETS), candidate_pool=3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_many_sources_with_unclear_indexes_are_refused(spark):
    data = [(1, [1.0, 0.5]), (2, [0.5, 1.0]), (2, [0.1, 1.0])]
    with pytest.raises(CoordinateError):
        search_many(P, rows(spark, data), rows(spark, TARGETS), k=1)
    with pytest.raises(CoordinateError):
        search_many(P, rows(spark, [(None, [1.0, 0.5])]), rows(spark, TARGETS), k=1)
    with pytest.raises(CoordinateError):
        search_many(P, rows(spark, data[:2]), rows(spark, [*TARGETS, (None, [1.0, 0.5])]), k=1)


def test_lots_of_sources_do_not_change_the_result(spark):
    data = [(i, [float(i % 7), float(i % 5) + 1]) for i in range(60)]
    found = [sorted(map(tuple, search_many(P, rows(spark, data), rows(spark, data), k=3, candidate_pool=9, sent_bytes=n).collect())) for n in (16, 160, 1 << 20)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 180


def test_best_is_what_a_whole_sort_finds():
    rng = np.random.default_rng(5)
    for most in (1, 4, 50, 99):
        keys = tuple(rng.integers(0, 9, 60) for _ in range(3))
        assert _best(keys, most).tolist() == np.lexsort(keys)[:most].tolist()
