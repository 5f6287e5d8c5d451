import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from orrery.llm import common


@given(st.lists(st.none() | st.text("aé \n日", max_size=12), max_size=20), st.integers(1, 30))
def test_steps_hold_every_text(texts, most):
    seen = []
    for t in common.steps(pa.array(texts, pa.string()), most=most):
        seen += [bytes(t.data[a : b - t.gap]).decode() for a, b in zip(t.at[:-1], t.at[1:], strict=True)]
    assert seen == [x or "" for x in texts]


@given(st.lists(st.text("abcAB \t\né", max_size=30), min_size=1, max_size=6))
def test_words_of_each_text(texts):
    (t,) = common.steps(pa.array(texts), most=1 << 20)
    starts, ends, rows = common.word_spans(t)
    for i, text in enumerate(texts):
        own = [bytes(t.data[a:b]).decode() for a, b in zip(starts[rows[i] : rows[i + 1]], ends[rows[i] : rows[i + 1]], strict=True)]
        assert own == text.split()


def test_hashes_tell_spans_apart():
    data = np.arange(1000, dtype=np.uint64) % np.uint64(7)
    a = np.arange(0, 900, 7)
    h = common.span_hashes(data, np.concatenate([a, a, a + 1]), np.concatenate([a + 14, a + 15, a + 15]))
    n = len(a)
    assert len(set(h[:n])) == len(set(h[n : 2 * n])) == len(set(h[2 * n :])) == 1 and len(set(h)) == 3


def test_stored_tables_go_with_tidy(spark):
    df = common.stored(spark.range(5), spark)
    assert df.count() == 5
    common.tidy(spark)
    spark.catalog.clearCache()
    with pytest.raises(Exception, match="(?i)no such file|does not exist|not_exist"):
        df.collect()
