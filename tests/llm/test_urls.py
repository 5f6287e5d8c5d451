import random
import re

import numpy as np
import pytest

from orrery.llm import urls


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(len(h) + len(p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute(pages):
    ruled, counts, links = [], {}, set()
    for i, url, html in pages:
        host, path = split(url)
        name, verdict = rule(host, path)
        ruled.append((i, host, path, name, verdict))
        if host:
            n = counts.setdefault(host, [0, 0, 0])
            n[0] += 1
            n[1] += verdict == "allow"
            n[2] += verdict == "block"
            for other in re.findall(r"""(?i)\shref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)""", html or ""):
                if other.lower() != host:
                    links.add((host, other.lower()))
    own = {h: (float(a >= 0.5 * n), float(b >= 0.9 * n)) for h, (n, a, b) in counts.items()}
    hosts = set(own) | {h for x in links for h in x}
    out = {h: sum(s == h for s, _ in links) for h in hosts}
    into = {h: sum(d == h for _, d in links) for h in hosts}
    t, u = {h: own.get(h, (0, 0))[0] for h in hosts}, {h: own.get(h, (0, 0))[1] for h in hosts}
    for _ in range(urls.ROUNDS):
        t, u = (
            {h: own.get(h, (0, 0))[0] + 0.85 * sum(t[s] / out[s] for s, d in links if d == h) for h in hosts},
            {h: own.get(h, (0, 0))[1] + 0.85 * sum(u[d] / into[d] for s, d in links if s == h) for h in hosts},
        )
    bad = {h for h in hosts if u[h] >= urls.THRESHOLD and u[h] > t[h]}
    return sorted((i, h, p, r, v or ("block" if h in bad else "allow")) for i, h, p, r, v in ruled)


def rows(df):
    return sorted(tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict").collect())


def test_query(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert rows(urls.op4_url_filter(spark, sf)) == brute(pages)


@pytest.mark.parametrize("sent", [urls.SENT_RULES, 2])
def test_links_spread_trust_and_distrust(spark, monkeypatch, sent):
    monkeypatch.setattr(urls, "SENT_RULES", sent)
    rnd, pages = random.Random(3), []
    hosts = [f"h{i}.example.{t}" for i in range(12) for t in ("com", "net", "org")]
    for i in range(250):
        host = rnd.choice(hosts)
        path = rnd.choice(["/en/7", "/en/1", "/de/8", "/de/1", "/es/1", "/fr/1"]) if rnd.random() < 0.04 else {"com": "/en/1", "net": "/fr/2", "org": "/x"}[host[-3:]]
        html = "".join(f'<a class="x" href="https://{rnd.choice(hosts).upper()}/en/1">x</a>' for _ in range(rnd.randrange(0, 3)) if rnd.random() < 0.2)
        pages.append((i, f"https://{host}{path}?q#f", html))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = rows(urls.judge(spark, df))
    assert found == brute(pages)
    assert {v for _, _, _, r, v in found if r is None} == {"allow", "block"}


def test_odd_rows(spark):
    pages = [(1, None, None), (2, "", "x"), (3, "no scheme/en/7", None), (4, "HTTP://A.Example.COM", "<a href=//b.net>"), (5, "x://example.com/en/7?a", None), (6, "x://com/en/", None), (7, "x://notexample.net/de/8", None), (8, "://?en", None), (9, "a://b.org#/es/", None), (10, "a://É.org/es/\nx", None), (11, "a://b://c.com/en/", None)]
    df = spark.createDataFrame([(*p, "h", "p", "v") for p in pages], "page_id long, url string, html string, host string, path string, verdict string")
    assert rows(urls.judge(spark, df)) == brute(pages)
    assert rows(urls.judge(spark, df.union(df))) == brute(pages * 2)
    assert rows(urls.judge(spark, df.limit(0))) == []


def test_scores_reach_hosts_many_links_away(spark):
    links = spark.createDataFrame([(f"h{i}", f"h{i + 1}") for i in range(25)], "src string, dst string")
    seeds = spark.createDataFrame([("h0", 1, 0), ("h25", 0, 1)], "host string, trusted int, blocked int")
    found = {r.host: r for r in urls.propagate(spark, links, seeds).collect()}
    assert all(abs(found[f"h{i}"].trust - 0.85**i) < 1e-5 and abs(found[f"h{i}"].distrust - 0.85 ** (25 - i)) < 1e-5 for i in range(26))


def test_scores_solve_the_linear_system(spark):
    """Cycles, hubs and hosts without links out, against the solved equations."""
    rng = np.random.default_rng(3)
    hosts = [f"h{i}.org" for i in range(30)]
    links = {(int(a), int(b)) for a, b in zip(rng.integers(0, 24, 60), rng.integers(0, 30, 60)) if a != b} | {(0, 1), (1, 0)} | {(i, 5) for i in range(24) if i != 5}
    trusted, blocked = rng.random(30) < 0.2, rng.random(30) < 0.2
    a = np.zeros((30, 30))
    for x, y in links:
        a[x, y] = 1
    share = lambda m: urls.DAMPING * (m / np.maximum(m.sum(axis=1, keepdims=True), 1)).T
    want = [np.linalg.solve(np.eye(30) - share(m), own.astype(float)) for m, own in ((a, trusted), (a.T, blocked))]
    found = urls.propagate(
        spark,
        spark.createDataFrame([(hosts[x], hosts[y]) for x, y in links], "src string, dst string"),
        spark.createDataFrame([(h, int(t), int(b)) for h, t, b in zip(hosts, trusted, blocked)], "host string, trusted int, blocked int"),
    )
    got = {r.host: (r.trust, r.distrust) for r in found.collect()}
    for i, h in enumerate(hosts):
        assert abs(got[h][0] - want[0][i]) < 1e-4 and abs(got[h][1] - want[1][i]) < 1e-4


def test_rules_are_those_of_the_contract(spark):
    assert urls.RULES == (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
    pages = [(1, "https://example.net/de/1", None), (2, "https://a.example.net/de/81", None), (3, "https://b.net/de/8", None)]
    found = rows(urls.judge(spark, spark.createDataFrame(pages, "page_id long, url string, html string")))
    assert [r[3:] for r in found] == [("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow")]
