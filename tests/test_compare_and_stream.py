import numpy as np
import pytest

from orrery.errors import CoordinateError
from orrery.functions.code_structure import NAMES
from orrery.operators.compare import compare_relations
from orrery.operators.projection import Projection
from orrery.streaming.project import start_projection

P = Projection(np.eye(3), [0.0] * 3, [1.0, 0.0, 1.0], [2.0, 1.0, 1.0], [0.0] * 3, 1.0, NAMES)
SIMPLE = "def f(a):\n    return g(a)\n"
NESTED = "def f(a):\n    for x in a:\n        if x:\n            g(x)\n"


def rows(spark, *changes):
    data = [("Query", SIMPLE, [1.0, 0.0, 0.0]), ("Candidate A", NESTED, [1.0, 0.1, 0.0]), ("Candidate B", SIMPLE, [0.0, 1.0, 0.0])]
    return spark.createDataFrame([changes[0] if changes and changes[0][0] == r[0] else r for r in data], "name string, source string, embedding array<double>")


def test_comparison(spark):
    ranking, coordinates, verdict = compare_relations(P, rows(spark))
    assert verdict == {"cosine": "A", "predicted": "A", "measured": "B", "prediction_agrees": False, "cosine_differs": False}
    r = {x.name: x for x in ranking.collect()}
    assert r["Candidate A"].cosine_rank == 1 and r["Candidate A"].measured_rank == 2 and r["Candidate B"].measured == 0
    c = {x.name: x for x in coordinates.collect()}
    assert c["Candidate A"].true_max_control_depth == 2 and c["Candidate A"].predicted_cyclomatic_complexity == 3.0


@pytest.mark.parametrize("bad", [("Query", "  \n", [1.0, 0.0, 0.0]), ("Query", "#" * 12_001, [1.0, 0.0, 0.0]), ("Candidate A", "x = 1", [1.0, 0.0, 0.0]), ("Candidate B", None, [1.0, 0.0, 0.0])])
def test_refused_sources(spark, bad):
    with pytest.raises(CoordinateError):
        compare_relations(P, rows(spark, bad))


def test_stream_is_projected_as_a_table_is(spark, tmp_path):
    table = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(20)], "vec_id long, embedding array<double>")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    start_projection(P, stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = sorted((r.vec_id, r.relation) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.vec_id, r.relation) for r in P.project(table).collect())
