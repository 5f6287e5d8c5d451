import pytest

from orrery.functions.code_structure import code_structure, structure_column
from orrery.plans.queries import SNIPPETS

MORE = (
    # comprehensions in a condition lie within the block, iterables of a comprehension before it
    ("def f(a):\n    while [x for x in a]:\n        pass\n", (3, 2, 0)),
    ("def f(a):\n    return [x for x in [y for y in a]]\n", (3, 1, 0)),
    ("def f(a):\n    try:\n        g()\n    except* A:\n        h()\n", (2, 0, 2)),
    ("@deco(1)\ndef f(a=g(), *, b: h() = 1):\n    return a and b or c\n", (3, 0, 0)),
    ("import x\ndef f():\n    with a(), b():\n        pass\n", (1, 1, 2)),
    ("def f():\n    class A:\n        def g(self):\n            return h()\n    return A\n", (1, 0, 0)),
)


@pytest.mark.parametrize("source, want", [(s, v) for _, s, v in SNIPPETS if v[0] is not None] + list(MORE))
def test_measures(source, want):
    assert code_structure(source).as_array() == list(map(float, want))


@pytest.mark.parametrize("source", ["x = 1", "def f(): pass\ndef g(): pass", "def f(:"])
def test_exactly_one_function(source):
    with pytest.raises((ValueError, SyntaxError)):
        code_structure(source)


def test_faults_are_rows(spark):
    rows = spark.createDataFrame([("def f(): g()",), ("x",), (None,)], "s string")
    found = [r[0] for r in rows.select(structure_column(rows.s)).collect()]
    assert [f.error is None for f in found] == [True, False, False] and found[0].distinct_call_sites == 1
