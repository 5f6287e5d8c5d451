import json
import sqlite3

import numpy as np
import pytest
from evidence import DIMENSIONS, PAIRS, SIZES, build
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from orrery import cli
from orrery.errors import ArtifactError, ReplayError
from orrery.operators import hard_negatives, metrics
from orrery.operators.projection import Projection
from orrery.plans import replay


def test_published_decision_is_recomputed(spark, tmp_path, capsys):
    root, a, b = build(tmp_path)
    assert cli.main(["replay-hard-negatives", "--root", root, "--cache-a", a, "--cache-b", b, "--output", str(tmp_path / "out" / "r.json")], spark) == 0
    report = json.loads(capsys.readouterr().out)
    assert report == json.loads((tmp_path / "out" / "r.json").read_text())
    assert report["hard_negative_pairs"] == len(PAIRS) and report["scientific_decision"]["queries_with_pairs"] == SIZES["test"]
    assert report["embedding_reconstruction"]["train"]["rows"] == SIZES["train"]


def test_export(spark, tmp_path, capsys):
    root, a, _ = build(tmp_path)
    assert cli.main(["export", "--root", root, "--cache", a, "--archive", str(tmp_path / "p.npz")], spark) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["verification"]["largest_prediction_difference"] < 1e-12 and report == json.loads((tmp_path / "p.json").read_text())
    p = Projection.load_archive(str(tmp_path / "p.npz"))
    assert p.relation_names == replay.NAMES and p.dimensions == DIMENSIONS
    bundle = tmp_path / replay.PROBE_BUNDLE
    changed = json.loads(bundle.read_text())
    changed["contract"]["primitives"][replay.NAMES[0]]["selected_alpha"] = 2.0
    bundle.write_text(json.dumps(changed))
    with pytest.raises(ArtifactError):
        replay.export_projection(spark, root, a, str(tmp_path / "q.npz"))


def tamper_blob(root):
    c = sqlite3.connect(f"{root}/b.sqlite3")
    c.execute("UPDATE embeddings_v2 SET embedding = ? WHERE stable_key = 'train/row 1'", (np.zeros(DIMENSIONS, np.float32).tobytes(),))
    c.commit()
    c.close()


def tamper_missing(root):
    c = sqlite3.connect(f"{root}/a.sqlite3")
    c.execute("DELETE FROM embeddings_v2 WHERE stable_key = 'test/row 0'")
    c.commit()
    c.close()


def tamper_json(name, change):
    def run(root):
        path = root / name
        value = json.loads(path.read_text())
        change(value)
        path.write_text(json.dumps(value))

    return run


@pytest.mark.parametrize(
    "tamper",
    [
        tamper_blob,
        tamper_missing,
        tamper_json(replay.SELECTION, lambda v: v.update(status="draft")),
        tamper_json(replay.SELECTION, lambda v: v["artifacts"]["test"]["selected_manifest"].update(rows=3)),
        tamper_json(replay.EMBEDDINGS, lambda v: v["splits"]["train"].update(array_sha256="0" * 64)),
        tamper_json(replay.PROBES, lambda v: v["predictions"]["test_queries"].update(array_sha256="0" * 64)),
        tamper_json(replay.HARD_NEGATIVES, lambda v: v["artifacts"]["pairs"].update(uncompressed_file_sha256="0" * 64)),
        tamper_json(replay.PUBLISHED, lambda v: v["scientific_decision"].update(gap=0.5)),
        lambda root: (root / replay.SELECTED.format("train")).write_text("{}\n"),
        lambda root: (root / replay.PAIRS).write_bytes(b"no archive"),
    ],
)
def test_changed_evidence_is_refused(spark, tmp_path, tamper):
    root, a, b = build(tmp_path)
    tamper(tmp_path)
    with pytest.raises(ReplayError):
        replay.replay_hard_negatives(spark, root, a, b)


def test_line_ends_may_differ(spark, tmp_path):
    root, a, b = build(tmp_path)
    for name in (replay.SELECTED, replay.PRIMITIVES):
        path = tmp_path / name.format("train")
        path.write_bytes(path.read_bytes().replace(b"\n", b"\r\n"))
    assert replay.replay_hard_negatives(spark, root, a, b)["status"].endswith("COMPLETE")


def test_ties_empty_queries_and_macro_means(spark):
    side = "index long, embedding array<double>, tokens long, true array<double>, predicted array<double>"
    queries = spark.createDataFrame([(0, [1.0, 0.0], 1, [0.0], [0.0]), (1, [0.0, 0.0], 1, [0.0], [0.0]), (2, [1.0, 1.0], 1, [0.0], [0.0])], side)
    candidates = spark.createDataFrame([(0, [1.0, 0.0], 1, [0.0], [1.0]), (1, [0.0, 1.0], 3, [1.0], [0.0])], side)
    pairs = spark.createDataFrame([(0, 0, 1), (0, 0, 1), (0, 1, 0), (1, 0, 1)], "query_index long, closer_index long, farther_index long")
    scores = hard_negatives.query_scores(pairs, queries, candidates).cache()
    rows = {r.query_index: r for r in scores.collect()}
    assert rows[0].pairs == 3 and rows[0].raw_cosine == pytest.approx(2 / 3) and rows[0].predicted_executor == pytest.approx(1 / 3)
    assert rows[1].raw_cosine == 0.5  # a zero vector is at distance 1 from everything
    assert rows[2].pairs == 0 and rows[2].raw_cosine is None
    d = hard_negatives.decision(scores).head()
    assert d.queries_with_pairs == 2 and d.queries_without_pairs == 1
    assert d.query_equal_weighted_accuracy["raw_cosine"] == pytest.approx((2 / 3 + 0.5) / 2)
    assert d.raw_best_methods == ["raw_euclidean"] or d.raw_best_methods == ["raw_cosine", "raw_euclidean"]


def test_misplaced_pairs(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 0), (2, 2)], "query_index long, pair_order long")
    assert sorted(map(tuple, hard_negatives.misplaced_pairs(pairs).collect())) == [(1, 1), (2, 2)]


def test_metrics_golden(spark):
    rows = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, p double")
    m = metrics.binary_metrics(rows).head()
    assert [round(v, 7) for v in m] == [0.75, 0.75, 0.6666667, 0.75, 0.4722880]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 4)), min_size=2, max_size=30).filter(lambda r: len({y for y, _ in r}) == 2))
def test_auc(spark, rows):
    df = spark.createDataFrame([(y, p / 4) for y, p in rows], "y int, p double")
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert metrics.roc_auc(df).head()[0] == pytest.approx(want)
