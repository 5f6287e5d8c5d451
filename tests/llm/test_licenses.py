import random
import re

from orrery.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base(text):
    w, places = WORD.findall(low(text)), []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def distance(pattern, text):
    """Edits of the best match of pattern anywhere in text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_query(spark, sf):
    docs = dict(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = licenses.op6_license_scan(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_every_notice_within_its_errors_is_found(spark):
    rnd, docs = random.Random(1), []
    for n, (notice, _) in enumerate(licenses.NOTICES):
        for j in range(8):
            s = list(notice)
            for _ in range(rnd.randrange(0, licenses.errors_of(notice) + 2)):
                i, kind = rnd.randrange(len(s)), rnd.randrange(3)
                s[i : i + (kind > 0)] = [] if kind == 1 else [rnd.choice("abcxyz")]
            docs.append((n * 100 + j, "Zebra quilt, " + "".join(s).upper() + "! vortex plume"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.scan_licenses(spark, df).collect()}
    for i, text in docs:
        clean = " ".join(WORD.findall(low(text)))
        near = {label for notice, label in licenses.NOTICES if distance(notice, clean) <= licenses.errors_of(notice)}
        own = licenses.NOTICES[i // 100]
        if distance(own[0], clean) <= licenses.errors_of(own[0]):
            assert found[i].labels and set(found[i].labels.split(",")) <= near | set(found[i].base_labels.split(","))
        if not near:
            assert found[i].labels == found[i].base_labels
        for s in found[i].spans:
            assert s.errors <= max(map(licenses.errors_of, (n for n, _ in licenses.NOTICES)))


def test_spans_point_into_the_text(spark):
    text = "é — Released  under\nthe M1T License, ok. All rights reserved"
    r = licenses.scan_licenses(spark, spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    raw = text.encode()
    assert [(s.label, raw[s.start : s.end].decode(), s.errors) for s in r.spans] == [("mit", "Released  under\nthe M1T License", 1), ("all-rights-reserved", "All rights reserved", 0)]
    assert r.base_labels == "" and r.labels == "all-rights-reserved,mit" and r.score == 1.0


def test_every_match_of_a_text_is_found(spark):
    """Several notices in one text, side by side and with different numbers of edits, against a search by dynamic programming."""
    rnd, docs = random.Random(7), [(0, "all rights reserved all rights resrved"), (1, "Licensed under the Apache License version 2.0, licensed under the apache licence version 2.0")]
    for i in range(2, 60):
        parts = []
        for _ in range(rnd.randrange(2, 6)):
            notice = rnd.choice([n for n, _ in licenses.NOTICES][:3] + ["all rights reserved"])
            s = list(notice)
            for _ in range(rnd.randrange(0, licenses.errors_of(notice) + 1)):
                s[rnd.randrange(1, len(s) - 1)] = rnd.choice("qxz")
            parts.append("".join(s))
            if rnd.random() < 0.4:
                parts.append("vortex plume")
        docs.append((i, " ".join(parts)))
    found = {r.doc_id: r.spans for r in licenses.scan_licenses(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [s.errors for s in found[0]] == [0, 1] and [s.errors for s in found[1]] == [0, 1]
    for i, text in docs:
        clean = low(text).replace(".", " ").replace(",", "")
        assert all(min(distance(n, low(text)[s.start : s.end].replace(".", " ")) for n, x in licenses.NOTICES if x == s.label) <= s.errors for s in found[i])
        left = clean
        for s in reversed(found[i]):  # nothing is left that a notice fits
            left = left[: s.start] + "#" + left[s.end :] if len(clean) == len(text) else ""
        assert all(distance(n, part) > licenses.errors_of(n) for n, _ in licenses.NOTICES for part in left.split("#") if len(part) >= len(n) - licenses.errors_of(n))


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "mit"), (4, "license mit"), (5, "x MIT\n\nLicense mit license"), (6, "limit license"), (7, "mit licenses"), (8, "é general—public license"), (9, "w " * 60000 + "apache license")]
    df = spark.createDataFrame([(i, t, 1.0, "a") for i, t in docs], "doc_id long, text string, score double, labels string")
    rows = {r.doc_id: r for r in licenses.scan_licenses(spark, df.union(df)).collect()}
    for i, t in docs:
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t), i
    assert licenses.scan_licenses(spark, df.limit(0)).collect() == []
