"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule rejects a document by a few counts of its text. On a sample the cascade estimates what a rule costs and how often
it rejects, and asks the rules in order of rejections per cost: a document that an early rule rejects isn't put to the
later ones. A count is taken when the first rule asks for it, once, and not at all for documents rejected before; so a
rule's cost is that of the counts it adds, and its rejections are those among documents that earlier rules let pass. The
order changes the running time alone, never the verdict, and is the same in repeated runs: costs are the sample's
characters and words times fixed prices, not clock readings.

Two windows of words are taken as equal by a 64-bit hash.

Defined cases: a null or empty text has no words and is rejected; texts may have any length; repeated rows are
judged one by one; an empty table gives an empty result (and the rules' given order); columns of other names are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE, WORD, SYMBOL = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+", "[#*$%&|<>]"
#: Words in a window whose repeats count.
WINDOW = 5
#: Documents that rules are weighed on.
SAMPLE_ROWS = 2000
#: Nanoseconds that a measure takes for a character and for a word of a text, as once measured; only ratios matter.
PRICES = {"words": (0, 129), "n_words": (0, 1), "word_chars": (31, 0), "n_symbols": (6, 0), "n_capitals": (6, 0), "lines": (6, 0), "n_lines": (0, 1), "n_dup_lines": (1, 0), "n_repeat_words": (0, 720)}


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def repeat_words(word: Column) -> Column:
    """Words that lie in a window of WINDOW words which occurs at least twice."""
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(word) - WINDOW), lambda i: F.xxhash64(*[F.get(word, i + j) for j in range(WINDOW)])
    )

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        near = lambda s, j: F.get(s, j)["h"]
        return _with(
            pairs,
            lambda s: _with(
                F.array_sort(F.transform(F.filter(s, lambda x, j: x["h"].eqNullSafe(near(s, j - 1)) | x["h"].eqNullSafe(near(s, j + 1))), lambda x: x["i"])),
                lambda p: F.aggregate(
                    F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1), x + WINDOW) - x)),
                    F.lit(0),
                    lambda a, x: a + x,
                ),
            ),
        )

    return F.when(
        F.size(word) > WINDOW,
        _with(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), count(h)).otherwise(F.lit(0))),
    ).otherwise(F.lit(0)).cast("long")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with value computed once: the variable of a lambda holds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


#: The counts that rules may ask for: what each is made from, and how.
PARTS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "words": ("text", words),
    "lines": ("text", _lines),
    "n_words": ("words", lambda w: F.size(w).cast("long")),
    "word_chars": ("text", lambda t: F.length(t) - _count(t, SPACE)),
    "n_symbols": ("text", lambda t: _count(t, SYMBOL)),
    "n_capitals": ("text", lambda t: _count(t, "[A-Z]")),
    "n_lines": ("lines", lambda x: F.size(x).cast("long")),
    "n_dup_lines": ("lines", lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    "n_repeat_words": ("words", repeat_words),
}
MEASURES = tuple(n for n in PARTS if n not in ("words", "lines"))


def measures(text: Column, word: Column | None = None) -> dict[str, Column]:
    """All counts, each a column on its own; ``word`` is the text's words, where they are at hand."""
    text = F.coalesce(text, F.lit(""))
    have = {"text": text, "words": words(text) if word is None else word, "lines": _lines(text)}
    return {n: _with(have[of], make) if of != "text" else make(text) for n, (of, make) in PARTS.items() if n in MEASURES}


@dataclass(frozen=True)
class Rule:
    """``reject`` makes a boolean column, never null, of the measures; true rejects the document."""

    name: str
    reject: Callable[[Mapping[str, Column]], Column]


#: The last four are the method's own; what they ask for is far from what prose of any language has.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 10),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("repeated_lines", lambda m: (m["n_lines"] >= 4) & (10 * m["n_dup_lines"] > 3 * m["n_lines"])),
    Rule("capitals", lambda m: 10 * m["n_capitals"] > 4 * m["word_chars"]),
    Rule("word_length", lambda m: (m["word_chars"] > 40 * m["n_words"]) | (m["word_chars"] * 2 < 3 * m["n_words"])),
)
BASE_RULES = ("few_words", "repeated_words")


class _Asked(dict):
    """A mapping of measures that notes which ones are looked up."""

    def __missing__(self, name: str) -> Column:
        self[name] = F.lit(0)
        return self[name]


def needs(rule: Rule) -> list[str]:
    """The measures that a rule asks for, and what they are made from."""
    rule.reject(asked := _Asked())
    return [n for n in PARTS if n in asked or any(PARTS[m][0] == n for m in asked)]


def cascade(spark: SparkSession, docs: DataFrame, text: str = "text", rules=RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per cost on a sample of about ``rows`` documents: first the rule with the highest rate, then
    the one with the highest rate among documents that pass the first, and so on."""
    rules = list(rules)
    total = docs.count()
    if not total:
        return rules
    sample = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).sample(min(1.0, rows / total), seed=7)
    m = measures(F.col("text"))
    judged = sample.select(F.length("text").alias("chars"), m["n_words"].alias("n"), F.array(*[r.reject(m) for r in rules]).alias("by"))
    # at most 2 ** rules rows, whatever the sample
    found = [(tuple(r["by"]), r["docs"], r["chars"], r["n"]) for r in judged.groupBy("by").agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"), F.sum("n").alias("n")).collect()]
    order: list[int] = []
    have: set[str] = set()
    while len(order) < len(rules):
        left = [f for f in found if not any(f[0][i] for i in order)]
        chars, n = sum(f[2] for f in left), sum(f[3] for f in left)

        def rate(i: int, left=left, chars=chars, n=n) -> float:
            cost = 1 + sum(PRICES[x][0] * chars + PRICES[x][1] * n for x in needs(rules[i]) if x not in have)
            return sum(f[1] for f in left if f[0][i]) / cost

        best = max((i for i in range(len(rules)) if i not in order), key=lambda i: (rate(i), -i))
        order.append(best)
        have.update(needs(rules[best]))
    return [rules[i] for i in order]


def passes(rules, m: Mapping[str, Column]) -> Column:
    """True if no rule rejects; they are asked in this order, and only as far as the first that does."""
    verdict = F.lit(True)
    for rule in reversed(list(rules)):
        verdict = F.when(rule.reject(m), F.lit(False)).otherwise(verdict)
    return verdict


def passes_lazily(rules, text: Column, have: Mapping[str, Column] | None = None) -> Column:
    """``passes`` that takes each measure when the first rule asks for it, and only then; ``have`` are those at hand."""
    rules = list(rules)

    def ask(i: int, have: dict[str, Column]) -> Column:
        if i == len(rules):
            return F.lit(True)
        for name in needs(rules[i]):
            of, make = PARTS[name]
            if name not in have and not (name in ("words", "lines") and all(n in have for n in needs(rules[i]) if PARTS[n][0] == name)):
                return _with(make(have[of]), then(i, have, name))
        return F.when(rules[i].reject(have), F.lit(False)).otherwise(ask(i + 1, have))

    def then(i: int, have: dict[str, Column], name: str) -> Callable[[Column], Column]:
        return lambda v: ask(i, have | {name: v})

    return ask(0, {"text": F.coalesce(text, F.lit("")), **(have or {})})


def quality_filter(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that a rule rejects."""
    return docs.filter(passes_lazily(cascade(spark, docs, text), docs[text]))


def op10_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that are asked for are taken of every document; the other ones by the cascade, as far as it goes."""
    docs = table(spark, sf_dir, "documents")
    order = cascade(spark, docs)
    out = docs.select("doc_id", "text", words(F.col("text")).alias("_words"))
    all_ = measures(F.col("text"), F.col("_words")) | {"n_repeat_words": repeat_words(F.col("_words"))}
    asked = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = out.select("doc_id", "text", *[all_[n].alias(n) for n in asked])
    have = {n: F.col(n) for n in asked}
    base = [r for r in order if r.name in BASE_RULES]
    failed = ~passes(base, have)
    return out.select("doc_id", *asked, failed.alias("base_failed"), passes_lazily(order, F.col("text"), have).alias("kept"))


SQL_OP10 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR (n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines)
       OR 10 * n_capitals > 4 * word_chars OR word_chars > 40 * n_words OR word_chars * 2 < 3 * n_words) AS kept
FROM b
"""
