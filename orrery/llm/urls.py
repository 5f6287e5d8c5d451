"""URL filters: path rules, and propagation of trust and distrust over the links between hosts.

The longest rule that fits a url decides. Other urls are judged by their host: hosts most of whose pages the rules
allow are trusted seeds, hosts (nearly) all of whose pages they block are distrusted seeds. Trust spreads along links
by personalised PageRank, distrust against them (who links to bad hosts is bad). In units of a lone seed's own score, a
host is blocked if its distrust reaches THRESHOLD and exceeds its trust. Scores are the solution of s = own + DAMPING *
(what neighbours pass on in equal shares): they aren't scaled to a distribution, as seeds count by themselves and not by
their share of all seeds, and a host without links keeps what it has.

Ranks live in tables of hosts, links in a table of distinct host pairs; every round is joins and map-side-combined
sums, written to the shared folder. Without links between hosts there is nothing to spread and seeds keep their score.

Defined cases: a url that is null or has no ``://`` has an empty host and path, fits no rule and is allowed; a null html
has no links; repeated pages count once per row for seeds and once for links; an empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table

#: verdict, host, path
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING = 0.85
TOLERANCE = 1e-6
#: What n seeds have yet to spread is below TOLERANCE after 85 + 6.2 ln n rounds; so many are never needed.
ROUNDS = 300
THRESHOLD = 0.2
#: Shares of a host's pages that rules must allow, or block, for it to be a seed.
TRUSTED_SHARE, BLOCKED_SHARE = 0.5, 0.9
#: Up to so many rules go to every task; more are joined.
SENT_RULES = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def suffixes(host: str) -> Iterator[str]:
    while host:
        yield host
        host = host.partition(".")[2]


def longest_rule(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str | None, str | None]:
    """(rule, verdict) of the rule that fits with the most characters; of equals the first by text, then 'allow'."""
    best = None
    for suffix in suffixes(host):
        for start, verdict in rules.get(suffix, ()):
            if path.startswith(start):
                found = (-len(suffix) - len(start), suffix + start, verdict)
                best = min(best, found) if best else found
    return best[1:] if best else (None, None)


def apply_rules(spark: SparkSession, pages: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """``pages`` (with host and path) plus rule and ruled, the rule's verdict. rules: (verdict, host, path)."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    first = rules.limit(SENT_RULES + 1).collect()
    if len(first) <= SENT_RULES:
        by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in first:
            by_host.setdefault(host, []).append((path, verdict))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [longest_rule(h, p, by_host) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
                rule, verdict = list(zip(*found, strict=True)) or ((), ())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*b.schema.names, "rule", "ruled"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
        return pages.mapInArrow(run, f"{fields}, rule string, ruled string")
    # distinct places are few beside pages, so this doesn't meet the pages of a hot host more than once
    places = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = places.select("host", "path", F.explode(ends).alias("suffix"))
    rules = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "verdict")
    fits = asked.join(rules, "suffix").filter(F.expr("startswith(path, start)"))
    order = F.struct((-F.length("suffix") - F.length("start")).alias("n"), F.concat("suffix", "start").alias("rule"), F.col("verdict"))
    best = fits.groupBy("host", "path").agg(F.min(order).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"))
    return pages.join(best, ["host", "path"], "left").select(*pages.columns, "rule", "ruled")


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of the absolute links in html, between different hosts."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)\shref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""), F.lit(1))
    links = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(found)).alias("dst"))
    return links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).filter("src <> dst").distinct()


def propagate(spark: SparkSession, links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(host, trust, distrust) in units of a seed's own score. seeds: host, trusted and blocked (0 or 1)."""
    links = stored(links, spark)
    scores = stored(seeds.select("host", F.col("trusted").cast("double").alias("trust"), F.col("blocked").cast("double").alias("distrust")), spark)
    if not links.limit(1).count():
        return scores
    out = links.groupBy("src").agg(F.count("*").alias("n_out"))
    into = links.groupBy("dst").agg(F.count("*").alias("n_in"))
    links = stored(links.join(out, "src").join(into, "dst"), spark)
    own = scores.select("host", F.col("trust").alias("own_trust"), F.col("distrust").alias("own_distrust"))
    for _ in range(ROUNDS):
        ahead = links.join(scores.toDF("src", "t", "u"), "src").select(F.col("dst").alias("host"), (DAMPING * F.col("t") / F.col("n_out")).alias("t"), F.lit(0.0).alias("u"))
        back = links.join(scores.toDF("dst", "t", "u"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (DAMPING * F.col("u") / F.col("n_in")).alias("u"))
        given = ahead.unionByName(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("u").alias("u"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        new = own.join(given, "host", "full").select("host", (zero("own_trust") + zero("t")).alias("trust"), (zero("own_distrust") + zero("u")).alias("distrust"))
        new = stored(new, spark)
        old = scores.toDF("host", "t", "u")
        moved = new.join(old, "host", "left").agg(F.max(F.abs(F.col("trust") - zero("t")) + F.abs(F.col("distrust") - zero("u")))).head()[0]
        scores = new
        if moved is None or moved < TOLERANCE:
            return scores
    raise RuntimeError(f"trust hasn't settled to {TOLERANCE} within {ROUNDS} rounds")


def judge(spark: SparkSession, pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    small_batches(spark, 10_000)
    host, path = host_and_path(F.col(url))
    places = pages.select(F.col(key).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    ruled = stored(apply_rules(spark, places, rules), spark)
    counts = ruled.filter("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("n_allow"), F.count_if(F.col("ruled") == "block").alias("n_block"))
    seeds = counts.select("host", (F.col("n_allow") >= TRUSTED_SHARE * F.col("n")).cast("int").alias("trusted"), (F.col("n_block") >= BLOCKED_SHARE * F.col("n")).cast("int").alias("blocked"))
    links = host_links(pages.select(host.alias("host"), F.col(html).alias("html")))
    scores = propagate(spark, links, seeds)
    bad = scores.filter((F.col("distrust") >= THRESHOLD) & (F.col("distrust") > F.col("trust"))).select("host", F.lit(True).alias("bad"))
    open_ = ruled.filter("ruled IS NULL").join(bad, "host", "left")
    verdict = F.when(F.col("bad"), "block").otherwise("allow")
    return ruled.filter("ruled IS NOT NULL").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict")).unionByName(open_.select("page_id", "host", "path", "rule", verdict.alias("verdict")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "pages"))
