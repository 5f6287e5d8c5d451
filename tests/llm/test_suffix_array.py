import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import suffix_array as sa


def check(text, symbols):
    t = np.append(np.asarray(text, np.int64) + 1, 0)
    found = sa.suffix_array(t.astype(np.uint16), symbols + 1)
    want = sorted(range(len(t)), key=lambda i: tuple(t[i:]))
    assert found.tolist() == want
    phi, lcp = sa.permuted_lcp(t.astype(np.uint16), found)
    for a, b in zip(want[:-1], want[1:]):
        k = 0
        while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        assert phi[b] == a and lcp[b] == k


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120))
def test_small_alphabet(text):
    check(text, 4)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 255), max_size=200))
def test_bytes(text):
    check(text, 256)


@pytest.mark.parametrize("text", [b"a" * 300, b"ab" * 200, b"abcabcabd" * 40, b"", b"z", b"banana" * 30 + b"bandana" * 30])
def test_repeats(text):
    check(list(text), 256)
    check(list(text[::-1]), 256)


@pytest.mark.parametrize("least", [0, 10**9])
def test_both_ways_of_inducing(monkeypatch, least):
    monkeypatch.setattr(sa, "LEAST_PER_SYMBOL", least)
    rng = np.random.default_rng(1)
    check(np.tile(rng.integers(0, 3, 40), 9).tolist(), 3)
    for n, symbols in ((1, 1), (2, 1), (50, 2), (400, 200), (300, 4)):
        check(rng.integers(0, symbols, n).tolist(), symbols)


def test_words_recurse(monkeypatch):
    """Text of words, as in a shard: the leftmost-smaller substrings are named and sorted by the recursion, to the end."""
    calls, real = [], sa.suffix_array
    monkeypatch.setattr(sa, "suffix_array", lambda t, symbols: calls.append((len(t), symbols)) or real(t, symbols))
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).tolist()) for _ in range(3000)]
    raw = b" ".join(words[i] for i in rng.integers(0, 3000, 30_000))
    raw += raw[5000:9000] + b"z" + raw[5000:9000]
    t = np.append(np.frombuffer(raw, np.uint8).astype(np.uint16) + 1, 0).astype(np.uint16)
    found = sa.suffix_array(t, 257)
    assert len(calls) >= 3 and calls[1][1] > 2048 and all(3 * b[0] <= 2 * a[0] for a, b in zip(calls[:-1], calls[1:], strict=True))
    text = t.astype(">u2").tobytes()
    assert np.array_equal(np.sort(found), np.arange(len(t)))
    assert all(text[2 * a :] < text[2 * b :] for a, b in zip(found[:-1].tolist(), found[1:].tolist(), strict=True))
