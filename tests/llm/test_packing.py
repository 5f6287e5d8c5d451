import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import packing

CAP = 1024


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(docs, rows, capacity=CAP):
    tok, per_doc, seqs = tokenizer(), {}, {}
    for r in rows:
        per_doc.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in docs:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        pieces = sorted(per_doc.pop(doc_id), key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        at = 0
        for p in pieces:
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            assert p.piece == 0 or p.length == capacity
            at += p.length
        assert at == len(ids) and (len(pieces) == 1 or len(ids) > capacity)
    assert not per_doc
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(seqs)


def test_query_against_the_json_vocabulary(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = packing.op2_best_fit_packing(spark, sf).collect()
    n = check(docs, rows)
    assert n <= -(-sum(r.length for r in rows) // CAP) * 1.03 + 1


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "a<|endoftext|>b"), (4, "word " * 5000), (5, "\n \t"), (6, "x" * 3000), (7, "日本語 é")]
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in docs], "doc_id long, text string, length int, rank string")
    check(docs, packing.pack(spark, df).collect())
    assert packing.pack(spark, df.limit(0)).collect() == []
    twice = packing.pack(spark, df.union(df)).collect()
    assert len(twice) == 2 * packing.pack(spark, df).count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60))
def test_plans_hold_each_piece_once(lengths):
    histogram = {x: lengths.count(x) for x in lengths}
    first = packing.best_fit(histogram, 30)
    for bins in (first, packing.local_search(first, 30)):
        found = [x for p, n in bins.items() for x in p * n]
        assert sorted(found) == sorted(lengths) and all(sum(p) <= 30 for p in bins)
    assert sum(packing.local_search(first, 30).values()) <= sum(first.values())


def optimum(lengths, capacity):
    """Fewest bins, by trying every place of every piece."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, fills):
        if len(fills) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(fills)
            return
        for k in range(len(fills)):
            if fills[k] + lengths[i] <= capacity and fills[k] not in fills[:k]:
                go(i + 1, fills[:k] + [fills[k] + lengths[i]] + fills[k + 1 :])
        go(i + 1, [*fills, lengths[i]])

    go(0, [])
    return best[0]


def plans(lengths, capacity):
    first = packing.best_fit({int(x): lengths.count(x) for x in lengths}, capacity)
    return sum(first.values()), sum(packing.local_search(first, capacity).values())


def test_against_the_optimum():
    rnd, gaps = random.Random(3), [0, 0]
    for _ in range(400):
        capacity = 40
        low = rnd.randrange(4, 12)
        lengths = [rnd.randrange(low, low + rnd.randrange(4, 16)) for _ in range(rnd.randrange(8, 13))]
        least, (fit, found) = optimum(lengths, capacity), plans(lengths, capacity)
        assert least <= found <= fit
        gaps[0] += fit - least
        gaps[1] += found - least
    assert gaps[0] >= 20 and gaps[1] <= gaps[0] // 3


@pytest.mark.parametrize("low, high, n, saved", [(300, 520, 3000, 20), (200, 700, 5000, 20), (250, 345, 20000, 50), (140, 217, 400, 2)])
def test_local_search_saves_sequences(low, high, n, saved):
    """Fewer sequences than best fit on lengths of middle size."""
    rng = np.random.default_rng(0)
    fit, found = plans(rng.integers(low, high, n).tolist(), CAP)
    assert found <= fit - saved


def test_local_search_on_many_bins_of_a_pattern():
    assert sum(packing.local_search({(6, 2): 2, (4,): 2, (4, 4): 1}, 10).values()) == 4
    bins = packing.local_search({(6,): 3000, (7,): 2000, (4,): 2000}, 20)
    assert sum(bins.values()) <= 2001 and sum(sum(p) * n for p, n in bins.items()) == 40000


def test_local_search_tries_stuck_bins_again():
    """A pattern without an improving step at first may have one after others have moved."""
    bins = packing.local_search({(6,): 3, (7,): 2, (4,): 2}, 20)
    assert sum(bins.values()) == 2 and sum(sum(p) * n for p, n in bins.items()) == 40
