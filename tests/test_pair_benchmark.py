import hashlib
import json

import numpy as np
import pytest

from orrery import cli
from orrery.errors import ReplayError
from orrery.functions.integrity import canonical_json_sha256
from orrery.operators import metrics
from orrery.operators import pair_benchmark as pb


@pytest.fixture
def benchmark(tmp_path):
    rng = np.random.default_rng(11)
    texts = [f"text {i}" for i in range(24)]
    np_path, folder = tmp_path / "snapshot.npz", tmp_path / "manifest"
    folder.mkdir()
    metadata = {"benchmark": "demo", "resolved_revision": "r1", "seed": 1, "splits": {}}
    for s, split in enumerate(pb.SPLITS):
        rows = [{"example_id": f"{split}-{i}", "split": split, "left": texts[8 * s + i], "right": texts[8 * s + (i + 1 + i % 3) % 8], "label": i % 2} for i in range(8)]
        data = "".join(json.dumps(r) + "\n" for r in rows).encode() + b"\n"
        (folder / f"{split}.jsonl").write_bytes(data)
        metadata["splits"][split] = {"rows": 8, "sha256": hashlib.sha256(data).hexdigest()}
    (folder / "metadata.json").write_text(json.dumps(metadata))
    embeddings = rng.normal(size=(24, 6))

    def save(**changed):
        parts = dict(texts=np.array(texts), embeddings=embeddings, model=np.array("m"), dataset_sha256=np.array(canonical_json_sha256(metadata)))
        np.savez(np_path, **(parts | changed))

    save()
    return str(np_path), str(folder), save


def test_replay(spark, benchmark, capsys):
    snapshot, folder, _ = benchmark
    assert cli.main(["replay-pairs", "--snapshot", snapshot, "--manifest-dir", folder], spark) == 0
    report = json.loads(capsys.readouterr().out)
    assert set(report["scores"]) == {*pb.FEATURES, pb.SHUFFLED}
    assert report["split_rows"] == dict.fromkeys(pb.SPLITS, 8) and report["embedding_dimension"] == 6
    for name, s in report["scores"].items():
        assert s["selected_alpha"] in pb.ALPHAS and 0 <= s["balanced_accuracy"] <= 1
        assert (s["validation_balanced_accuracy"] is None) == (name == pb.SHUFFLED)
    gap = report["scores"]["Full pair"]["balanced_accuracy"] - report["scores"]["Cosine only"]["balanced_accuracy"]
    assert report["primary_comparison"]["full_pair_minus_cosine_balanced_accuracy"] == gap


def test_refused_inputs(spark, benchmark):
    snapshot, folder, save = benchmark
    for bad in ({"dataset_sha256": np.array("0" * 64)}, {"texts": np.array(["a"] * 24)}, {"embeddings": np.zeros((3, 2))}, {"model": np.array("")}, {"texts": np.array([f"other {i}" for i in range(24)])}):
        save(**bad)
        with pytest.raises(ReplayError):
            pb.replay_pairs(spark, snapshot, folder)
    save()
    with open(f"{folder}/test.jsonl", "a") as f:
        f.write("\n")
    with pytest.raises(ReplayError):
        pb.replay_pairs(spark, snapshot, folder)


def test_model_reaches_the_optimum(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3)).astype(np.float32)
    y = (x[:, 0] + rng.normal(size=60) > 0).astype(int)
    df = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y, strict=True)], "y int, f array<float>")
    m = pb.PairModel(df, "f", 0.01)
    z = (x - x.mean(0)) / x.std(0)
    w, b = np.asarray(m.model.coefficients), m.model.intercept
    p = 1 / (1 + np.exp(-(z @ w + b)))
    assert np.abs(z.T @ (p - y) / 60 + 0.01 * w).max() < 1e-5 and abs((p - y).mean()) < 1e-5


def test_shuffled_labels_are_a_permutation(spark):
    df = spark.createDataFrame([(f"e{i:03}", i % 2) for i in range(100)], "example_id string, y int")
    rows = sorted(pb.shuffled(df, 5).select("example_id", "y").collect())
    assert len(rows) == 100 and sum(r.y for r in rows) == 50 and [r.y for r in rows] != [i % 2 for i in range(100)]
    assert rows == sorted(pb.shuffled(df, 5).select("example_id", "y").collect())


def tasks_of(spark, run):
    """What ``run`` returns, and the number of tasks that each of its stages ran."""
    context = spark.sparkContext
    context.setJobGroup("counted", "")
    try:
        result = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    jobs, status = context._jsc.sc().statusTracker(), context.statusTracker()
    stages = {s for j in jobs.getJobIdsForGroup("counted") for s in status.getJobInfo(j).stageIds}
    return result, [info.numCompletedTasks for s in stages if (info := status.getStageInfo(s))]


def test_tasks_of_a_fit_do_not_follow_the_table(spark, monkeypatch):
    monkeypatch.setattr(pb, "FEATURES", ("Cosine only",))
    monkeypatch.setattr(pb, "ALPHAS", (1e-2,))
    most = max(16, spark.sparkContext.defaultParallelism)
    data = [(f"e{i}", pb.SPLITS[i % 3], int(i % 7 < 3 + i % 2), [i % 11 / 10]) for i in range(600)]
    df = spark.createDataFrame(data, "example_id string, split string, y int, `Cosine only` array<float>")
    spread, close = df.repartition(6 * most).cache(), df.repartition(2).cache()
    assert spread.count() == close.count()
    (found, tasks), same = tasks_of(spark, lambda: pb.PairModel(spread, "Cosine only", 1e-2).model), pb.PairModel(close, "Cosine only", 1e-2).model
    assert len(tasks) > 5 and max(tasks) <= most
    assert [*found.coefficients, found.intercept] == pytest.approx([*same.coefficients, same.intercept], abs=1e-7)
    (found, tasks), same = tasks_of(spark, lambda: pb.evaluate(df.repartition(6 * most + 1), 118)), pb.evaluate(close, 118)
    assert len(tasks) > 20 and sum(n > most for n in tasks) <= 3  # the table is cached once, and the control deals its rows out twice
    for a, b in zip(found, same, strict=True):
        assert vars(a) == pytest.approx(vars(b), abs=1e-7)


def test_rates_are_the_metrics_without_the_area(spark):
    df = spark.createDataFrame([(i % 2, i * 37 % 101 / 101) for i in range(50)], "y int, p double")
    whole = metrics.binary_metrics(df).head().asDict()
    assert list(whole) == ["accuracy", "balanced_accuracy", "f1", "roc_auc", "log_loss"]
    assert metrics.rates(df).head().asDict() == {k: v for k, v in whole.items() if k != "roc_auc"}
