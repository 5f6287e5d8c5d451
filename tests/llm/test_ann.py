import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from orrery.llm import ann


def brute(rows, k=20):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        best = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in best]
    return out


def lists(found):
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        own = out.setdefault(r.query_id, [])
        own.append((r.vec_id, r.score))
        assert r.rank == len(own)
    return out


def recall(got, want):
    assert set(got) == set(want)
    for q, own in got.items():
        assert len(own) == len(want[q]) and own == sorted(own, key=lambda x: (-x[1], x[0]))
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / max(1, len(want[q])) for q in want])


def test_recall_and_scores(spark, sf):
    rows = [tuple(r)[:2] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = lists(ann.op7_multi_index_ann(spark, sf).collect()), brute(rows)
    assert recall(got, want) >= 0.95
    x = {i: np.array(v, np.float64) for i, v in rows}
    assert all(abs(s - (x[q] * x[i]).sum()) < 1e-12 for q, own in got.items() for i, s in own)


def test_many_shards_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 50)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 16))
    x[300:700] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = lists(ann.nearest(spark, df, centroids=16, first=100).collect()), brute(rows)
    assert recall(got, want) >= 0.95
    assert got[300] == want[300]


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 2.0]), (4, [1.0, float("nan"), 2.0]), (5, [float("inf"), 0.0, 1.0]), (6, [1.0]), (20, [1.0, 2.0, 3.0]), (40, [-1.0, 0.0, 5.0]), (41, [-1.0, 0.0, 5.0]), (None, [1.0, 1.0, 1.0]), (41, [-1.0, 0.0, 5.0])]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id long, embedding array<double>, cell int, score string")
    got = lists(ann.nearest(spark, df).collect())
    good = [(0, rows[0][1]), (20, rows[7][1]), (40, rows[8][1]), (41, rows[9][1])]
    assert got == brute(good)
    assert ann.nearest(spark, df.limit(0)).collect() == []
    assert ann.nearest(spark, df.filter("vec_id = 0")).collect() == []


def visited(x, queries, first):
    """The share of entries that queries rerank, as the operator's own index decides."""
    index = ann.Index(x[: ann.SAMPLE_ROWS], int(len(x) ** 0.5))
    cells = index.cells(x)
    n = np.bincount(cells)
    index.place(dict(enumerate(n.tolist())))
    shares = []
    for q in queries:
        begun, _ = index.walk(x[q], first)
        near = np.sort(x[np.isin(cells, begun)] @ x[q])[::-1]
        both = np.union1d(begun, index.beyond(x[q], index.least(x[q], near[min(20, len(near) - 1)])))
        shares.append(n[both].sum() / len(x))
    return float(np.mean(shares))


@pytest.mark.parametrize("spread, most", [(None, 0.6), (0.35, 0.1)])
def test_recall_on_a_table_of_many_times_the_first_visit(spark, tmp_path, spread, most):
    """20 times FIRST vectors without structure, or in clusters: recall by brute force, and how much of the table is visited."""
    rng = np.random.default_rng(1)
    n = 20 * ann.FIRST
    x = rng.normal(size=(n, 64)) if spread is None else rng.normal(size=(400, 64))[rng.integers(0, 400, n)] + spread * rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert visited(x, range(0, n, 400), ann.FIRST) <= most
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": x.tolist()}), tmp_path / "x.parquet")
    df = spark.read.parquet(str(tmp_path / "x.parquet"))
    got = lists(ann.nearest(spark, df, is_query="vec_id % 200 = 0").collect())
    hits = 0
    for q, own in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({i for i, _ in own} & set(np.argpartition(-s, 20)[:20].tolist()))
    assert len(got) == n // 200 and hits / (20 * len(got)) >= 0.9


def test_the_walk_goes_on_to_all_cells_above_the_bound():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 10))
    index = ann.Index(x, 20)
    index.place(dict(enumerate(np.bincount(index.cells(x)).tolist())))
    for q in x[:20]:
        begun, last = index.walk(q, 200)
        assert sorted(begun.tolist()) == sorted(index.beyond(q, last).tolist()) and index.count[begun].sum() >= 200
        for bound in (-5.0, 0.0, 8.0, 1e9, float("-inf")):
            least = index.least(q, bound)
            sums = (index.c[0] @ q[:5])[:, None] + (index.c[1] @ q[5:])[None, :]
            assert sorted(index.beyond(q, least).tolist()) == np.flatnonzero((sums.ravel() >= least) & (index.count > 0)).tolist()
