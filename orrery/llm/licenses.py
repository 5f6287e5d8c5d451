"""License scans: exact phrases, and a fuzzy search for short notices.

Texts are lower-cased (A-Z) and every run of characters between words becomes one space. A notice may differ in at
most ``errors`` characters. Split into errors + 1 pieces, at least one of them stands unchanged in any such match
(pigeonhole), so one automaton of all pieces locates every candidate; the ``regex`` library then matches the notice
with bounded errors in the window around it, and reports the span and the number of edits. Of notices that match at
overlapping places, the one with the fewest edits counts.

Defined cases: a null or empty text has no words, labels or spans and scores 0; texts are searched as a whole, whatever
their length; repeated rows are scanned one by one; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, lower, small_batches, steps, table

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices as they stand in many projects, in normal form, with their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("licensed under the gnu general public license version 2", "gpl"),
    ("under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("all rights reserved", "all-rights-reserved"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under the eclipse public license", "epl"),
    ("distributed under the boost software license version 1 0", "bsl"),
    ("spdx license identifier mit", "mit"),
    ("spdx license identifier apache 2 0", "apache"),
    ("spdx license identifier gpl 2 0", "gpl"),
    ("spdx license identifier gpl 3 0", "gpl"),
    ("spdx license identifier lgpl 2 1", "lgpl"),
    ("spdx license identifier agpl 3 0", "agpl"),
    ("spdx license identifier bsd 2 clause", "bsd"),
    ("spdx license identifier bsd 3 clause", "bsd"),
    ("spdx license identifier isc", "isc"),
    ("spdx license identifier mpl 2 0", "mpl"),
)
#: One edit is allowed for so many characters of a notice, and no more than so many in all.
CHARS_PER_ERROR, MOST_ERRORS = 14, 6

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def errors_of(notice: str) -> int:
    return min(MOST_ERRORS, max(1, len(notice) // CHARS_PER_ERROR))


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of about equal length, with their offsets."""
    cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=8)
def _compiled(phrases: tuple, notices: tuple):
    import ahocorasick
    import regex

    entries: dict[str, list] = {}
    for phrase, label in phrases:
        entries.setdefault(phrase, []).append((None, 0, label))
    patterns = []
    for i, (notice, _) in enumerate(notices):
        k = errors_of(notice)
        # the library doesn't always find the least number of edits by itself, so each number is asked for in turn
        patterns.append([regex.compile(f"(?:{regex.escape(notice, special_only=True, literal_spaces=True)}){{e<={n}}}") for n in range(k + 1)])
        for at, piece in pieces(notice, k):
            entries.setdefault(piece, []).append((i, at, None))
    automaton = ahocorasick.Automaton()
    for word, found in entries.items():
        automaton.add_word(word, (len(word), tuple(found)))
    automaton.make_automaton()
    return automaton, patterns


def _matches(patterns: list, text: str, lo: int, hi: int, size: int) -> list:
    """All matches of a notice in a window that don't overlap: those with the fewest edits first, and then, between what
    has been found, those with one edit more, up to the bound."""
    found, gaps = [], [(lo, hi)]
    for edits, pattern in enumerate(patterns):
        left = []
        for a, z in gaps:
            at = a
            for m in pattern.finditer(text, a, z) if z - a >= size - edits else ():
                found.append(m)
                left.append((at, m.start()))
                at = m.end()
            left.append((at, z))
        gaps = left
    return found


def _scan(t: Texts, phrases: tuple, notices: tuple) -> dict[str, list]:
    """Per row of t: words, base places as (word, label), and notices as (label, start byte, end byte, edits, length)."""
    automaton, patterns = _compiled(phrases, notices)
    data = lower(t.data[: t.n])
    word = _WORD[data]
    gap = np.zeros(t.n, bool)
    gap[t.at[1:] - 1] = True
    before = np.concatenate([[False], word[:-1]])
    keep = np.flatnonzero(word | gap | before)
    normal = np.where(word, data, np.uint8(32))
    normal[gap] = 10
    normal = normal[keep]
    begins = np.flatnonzero(word & ~before)
    first = np.searchsorted(begins, t.at)
    text = normal.tobytes().decode("latin-1")
    rows = len(t.at) - 1
    base: list[list] = [[] for _ in range(rows)]
    fuzzy: list[list] = [[] for _ in range(rows)]
    windows: dict[tuple[int, int], list[tuple[int, int]]] = {}
    edge = np.searchsorted(keep, t.at)
    solid = lambda i: 0 <= i < len(text) and text[i] not in " \n"
    for last, (size, found) in automaton.iter(text):
        start = last - size + 1
        row = int(np.searchsorted(t.at, keep[start], side="right")) - 1
        for notice, at, label in found:
            if notice is None:
                if not solid(start - 1) and not solid(last + 1):
                    base[row].append((int(np.searchsorted(begins, keep[start])) - int(first[row]), label))
                continue
            k, n = len(patterns[notice]) - 1, len(notices[notice][0])
            lo, hi = max(int(edge[row]), start - at - k), min(int(edge[row + 1]) - 1, start - at + n + k)
            own = windows.setdefault((row, notice), [])
            if own and lo <= own[-1][1]:
                own[-1] = (own[-1][0], max(hi, own[-1][1]))
            else:
                own.append((lo, hi))
    for (row, notice), own in windows.items():
        for lo, hi in own:
            for m in _matches(patterns[notice], text, lo, hi, len(notices[notice][0])):
                a, z = int(keep[m.start()] - t.at[row]), int(keep[m.end() - 1] - t.at[row]) + 1
                fuzzy[row].append((notices[notice][1], a, z, sum(m.fuzzy_counts), len(notices[notice][0])))
    for row in range(rows):
        if len(fuzzy[row]) > 1:
            left: list[tuple] = []
            for m in sorted(set(fuzzy[row]), key=lambda m: (m[3] / m[4], -m[4], m)):
                if all(m[1] >= x[2] or m[2] <= x[1] for x in left):
                    left.append(m)
            fuzzy[row] = sorted(left, key=lambda m: m[1])
    return {"n_words": np.diff(first).tolist(), "base": base, "fuzzy": fuzzy}


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, end: long, errors: int>>"


def scan_licenses(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", phrases=None, notices=NOTICES) -> DataFrame:
    """One row per document. Spans are byte offsets in the text's UTF-8 form; the score is the best notice's share of
    characters without edits, 1 for a base phrase and 0 without labels."""
    small_batches(spark)
    phrases, notices = tuple((phrases or PHRASES).items()), tuple(notices)
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in steps(b.column("text")):
                found = _scan(t, phrases, notices)
                out: list[tuple] = []
                for n, base, fuzzy in zip(found["n_words"], found["base"], found["fuzzy"], strict=True):
                    at, own = [w for w, _ in base], {x for _, x in base}
                    score = 1.0 if base else max((1 - m[3] / m[4] for m in fuzzy), default=0.0)
                    spans = [dict(zip(("label", "start", "end", "errors"), m, strict=False)) for m in fuzzy]
                    labels = ",".join(sorted(own | {m[0] for m in fuzzy}))
                    out.append((n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), labels, score, spans))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(t.lo, t.hi - t.lo), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark, table(spark, sf_dir, "documents")).drop("spans")
