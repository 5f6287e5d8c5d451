import re
import time

import pytest

from orrery.llm import quality_rules as q

WORD = re.compile(q.WORD)


def brute(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    m = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_capitals": sum("A" <= c <= "Z" for c in text), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
    failed = m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]
    own = 10 * m["n_symbols"] > m["n_words"] or m["n_lines"] >= 4 and 10 * m["n_dup_lines"] > 3 * m["n_lines"] or 10 * m["n_capitals"] > 4 * m["word_chars"] or m["word_chars"] > 40 * m["n_words"] or 2 * m["word_chars"] < 3 * m["n_words"]
    return m, failed, not (failed or own)


TEXTS = [None, "", " \n\t", "one two", "a b c d e f g h i j", "the quick brown fox jumps " * 2 + "over many lazy dogs and more cats here today", "x " * 3000, "é日 " * 12, "LOUD words " * 9, "line one is this\n" * 6 + "other words that differ from all those before", "# $ % words are many here but symbols count as well then", "w" * 2000 + " a b c d e f g h i", "a\x0bb\x0cc\rd e f g h i j k", "A b c d e A b c d e f g h i j k l m n o p q r s t u v w x y z"]


def test_measures_and_filter(spark):
    df = spark.createDataFrame([(i, t, 5, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int, kept string")
    names, cols = zip(*q.measures(df.text).items(), strict=True)
    for r in df.select("doc_id", *[c.alias(f"m_{n}") for n, c in zip(names, cols, strict=True)]).collect():
        want = brute(TEXTS[r.doc_id])[0]
        assert {n: r[f"m_{n}"] for n in names} == want, TEXTS[r.doc_id]
    kept = q.quality_filter(spark, df.union(df))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(2 * [i for i, t in enumerate(TEXTS) if brute(t)[2]])
    assert q.quality_filter(spark, df.limit(0)).collect() == []


def test_query(spark, sf):
    docs = dict(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = q.op10_quality_cascade(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        m, failed, kept = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"], failed, kept)


def test_cascade_orders_by_rejections_per_second(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * 20 if i % 10 else "w") for i in range(100)], "doc_id long, text string")
    clock = [0.0]
    monkeypatch.setattr(time, "perf_counter", lambda: clock.__setitem__(0, clock[0] + 1) or clock[0])
    rules = (q.Rule("never", lambda m: m["n_words"] < 0), q.Rule("few", lambda m: m["n_words"] < 5), q.Rule("most", lambda m: m["n_words"] > 5))
    assert [r.name for r in q.cascade(spark, docs, rules=rules)] == ["most", "few", "never"]


def test_no_python_runs_on_executors(spark, sf):
    plan = q.op10_quality_cascade(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("order", [q.RULES, q.RULES[::-1]])
def test_order_does_not_change_the_verdict(spark, order):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = df.select("doc_id", q.passes(order, q.measures(df.text)).alias("k")).collect()
    assert all(r.k == brute(TEXTS[r.doc_id])[2] for r in got)


def test_lazy_cascade_gives_the_same_verdicts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for order in (q.RULES, q.RULES[::-1]):
        got = df.select("doc_id", q.passes_lazily(order, df.text).alias("k")).collect()
        assert all(r.k == brute(TEXTS[r.doc_id])[2] for r in got)


def test_order_is_the_same_in_repeated_runs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    orders = {tuple(r.name for r in q.cascade(spark, docs)) for _ in range(3)}
    assert len(orders) == 1


def test_rules_are_weighed_among_documents_that_pass_earlier_ones(spark):
    """Of two rules that reject the same documents the second has no rejections left, and comes last."""
    docs = spark.createDataFrame([(i, "w " * 20 if i % 4 else "w" if i % 8 else "w " * 20 + "#" * 9) for i in range(400)], "doc_id long, text string")
    rules = (q.Rule("few", lambda m: m["n_words"] < 5), q.Rule("few_again", lambda m: m["n_words"] < 6), q.Rule("symbols", lambda m: m["n_symbols"] > 5))
    assert [r.name for r in q.cascade(spark, docs, rules=rules)] in (["few", "symbols", "few_again"], ["symbols", "few", "few_again"])


def test_the_cascade_takes_effect(spark, sf):
    """Counts that only later rules ask for stand inside the verdict's branches, not in a projection of all documents."""
    plan = q.op10_quality_cascade(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    kept = [x for x in plan.split("\n") if "[A-Z]" in x]
    assert len(kept) == 1 and kept[0].index("CASE WHEN") < kept[0].index("[A-Z]") and "AS kept" in kept[0]
    text = q.quality_filter(spark, spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("[A-Z]") == 1 and text.index("CASE WHEN") < text.index("[A-Z]")
