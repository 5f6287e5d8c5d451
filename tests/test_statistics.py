import random

import pytest
from pyspark.sql import functions as F

from orrery.operators.statistics import running_sum


@pytest.mark.parametrize("n", [0, 1, 500])
def test_running_sum(spark, n):
    """Against a loop, with columns of the names that the operator would use itself."""
    rnd = random.Random(n)
    data = [(i, rnd.randrange(9), "x", 2) for i in rnd.sample(range(10 * n + 1), n)]
    df = spark.createDataFrame(data, "i long, v long, part string, before int")
    found = running_sum(df, ["i"], F.col("v"), "sum")
    assert found.columns == [*df.columns, "sum"]
    total, want = 0, []
    for r in sorted(data):
        want.append((*r, total))
        total += r[1]
    assert sorted(map(tuple, found.collect())) == want


def test_running_sum_of_more_rows_than_are_sampled(spark):
    """Bounds of ranges are sampled: both passes must have the same ones, or places repeat and are left out."""
    n = 60_000
    df = spark.range(0, n, 1, 3).select((F.col("id") * 7919 % n).alias("i"))
    off = running_sum(df, ["i"], F.lit(1), "before").filter("i <> before").count()
    assert off == 0
