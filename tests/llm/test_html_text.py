import html
import random
import re
import time

from orrery.llm import html_text, wrappers


def plain(source):
    """The article's blocks, for pages of the driver's simple template."""
    m = re.search(r"<article>(.*?)</article>", source or "", re.S)
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", m[1])] if m else []
    return "\n\n".join(b for b in blocks if b)


def test_query(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    found = sorted(tuple(r) for r in html_text.op5_html_wrappers(spark, sf).collect())
    assert found == sorted((i, u, plain(h), len(plain(h))) for i, u, h in pages)


PAGE = """<!doctype html><html><head><title>T &amp; t</title><style>p > a {}</style></head><body class="has-sidebar">
<header class=site><a href="/">Site</a></header><nav><li>Home<li>News</nav>
<div id="cookieNotice">We use cookies</div><aside>Side</aside>
<main><header><h1>Head&shy;line &lt;1&gt;</h1><p>By me</p></header><p>One <b>two
 three</b><br>four<p>Five &copy; &#x41;&nbsp;B 1 < 2<ul><li>i<li>j</ul><form>Ask <input></form><script>if (a < b) "</p>"</script>
<div class="ad-slot">Buy</div><table><tr><td>c1<td>c2</table><!-- <p>gone</p> --><div hidden>no</div>
<section class="reader-comments"><article class="comment"><p>First!</p></article></section></main>
<footer>Foot</footer></body></html>"""


def test_roles():
    assert html_text.extract(PAGE) == "Head\xadline <1>\n\nOne two three four\n\nFive © A B 1 < 2\n\ni\n\nj\n\nc1\n\nc2"
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<nav>a</nav>") == ""
    assert html_text.extract("just text &amp; more") == "just text & more"
    assert html_text.extract("<nav>menu<article><p>body</article>") == "body"
    assert html_text.extract("<p>a<script>never closed") == "a"
    assert html_text.extract("<article><p>a <button>b</button><span class='ad'>c <b>d</b></span> e</p></article>") == "a e"
    assert html_text.extract("<div class='content'>" * 500 + "deep") == "deep"


def bare(rnd, word):
    """A page without article: the template's texts stand among others."""
    body = [" ".join(word() for _ in range(rnd.randrange(3, 9))) for _ in range(rnd.randrange(1, 6))]
    extra = f"<h3>{word()}</h3>" if rnd.random() < 0.5 else ""
    source = "<html><body><div><span>Welcome to the site</span></div>" + extra + "<div>" + "".join(f"<p>{b}</p>" for b in body) + "</div><div>All about us</div></body></html>"
    return source, ([re.sub("<.*?>", "", extra)] if extra else []) + body


def test_wrappers_tell_the_template_from_content(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(5))
    pages = [(i, f"http://h{i % 2}.org/{i}", *bare(rnd, word)) for i in range(60)]
    pages.append((60, "http://alone.org/x", *bare(rnd, word)))
    df = spark.createDataFrame([(i, u, h, "w") for i, u, h, _ in pages], "page_id long, url string, html string, wrapper string")
    for sent in (html_text.SENT_CHARS, 0):
        found = {r.page_id: r.text.split("\n\n") for r in html_text.main_texts(spark, df, sent_chars=sent).collect()}
        assert all(found[i] == body for i, _, _, body in pages[:60])
        assert found[60] == ["Welcome to the site", *pages[60][3], "All about us"]


def test_wrappers_fit_their_pages():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(5))
    tokens = [html_text.Page(bare(rnd, word)[0]).tokens for _ in range(6)]
    w = wrappers.infer(tokens)
    assert w and all(wrappers.consume(w, wrappers.nodes_of(t), 0) == len(t) for t in tokens)
    assert "rep" in str(w) and "opt" in str(w)
    assert wrappers.infer(tokens[:2]) is None


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "http://a.org", ""), (3, "http://a.org", "<p>x</p>"), (4, "x", "<p>" + "w " * 50000), (5, None, "<main>m")]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, n_chars int")
    found = sorted(tuple(r) for r in html_text.main_texts(spark, df.union(df)).select("page_id", "text", "n_chars").collect())
    want = [(1, "", 0), (2, "", 0), (3, "x", 1), (4, ("w " * 50000).strip(), 99999), (5, "m", 1)]
    assert found == sorted(want * 2)
    assert html_text.main_texts(spark, df.limit(0)).collect() == []


def test_constants_inside_articles(spark):
    """Template texts in an article are left out by the host's wrapper, and a text that only copies share is kept."""
    page = lambda i: f"<body><div>Top</div><article><div>About this site</div><h1>Title {i}</h1><p>Body {i}</p><div>Read more soon</div></article></body>"
    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(9)] + [(9 + i, f"http://two.org/{i}", page(i)) for i in range(2)]
    rows += [(11 + i, f"http://copies.org/{i}", page(0)) for i in range(9)]
    found = {r.page_id: r.text for r in html_text.main_texts(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"Title {i}\n\nBody {i}" for i in range(9))
    assert all("About this site" in found[i] for i in range(9, 20))


def test_wrappers_are_inferred_over_all_pages_of_a_host(spark):
    """Copies don't crowd out other pages, and each of several templates has its wrapper, in whatever group its pages are."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(5))
    pages = [(f"http://h.org/{i}", *bare(rnd, word)) for i in range(40)]
    other = [word() for _ in range(4)]
    pages += [(f"http://h.org/t{i}", f"<html><body><table><tr><td>Menu of tables</td></tr></table><blockquote>{w}</blockquote></body></html>", [w]) for i, w in enumerate(other)]
    copy = bare(rnd, word)
    pages += [(u, copy[0], copy[1]) for u in ("http://h.org/same",) * 50] + [(f"http://h.org/c{i}", copy[0], copy[1]) for i in range(200)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string")
    found = {r.page_id: r.text.split("\n\n") for r in html_text.main_texts(spark, df).collect()}
    assert [i for i, (_, _, body) in enumerate(pages) if found[i] != body] == []


def test_wrappers_of_many_pages_stay_small():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(5))
    sizes = []
    found = []
    for i in range(2000):
        wrappers.fold(found, wrappers.nodes_of(html_text.Page(bare(rnd, word)[0]).tokens))
        if i in (99, 1999):
            sizes.append(len(str(found)))
    assert len(found) == 1 and sizes[1] <= 2 * sizes[0]


def test_class_words_lose_no_prose():
    """In an article a class names a topic as often as a role: prose and links stay, adverts and containers by role go."""
    source = """<article class='post'><h2 class='header'>Head</h2><p class='legal'>The legal text</p><p>See <a class='related'>linked words</a> too</p>
<p class='advert'>Buy</p><div class='related'>More pages</div><ul class='share'><li>X</ul><p class='menu'>Soup</p></article>"""
    assert html_text.extract(source) == "Head\n\nThe legal text\n\nSee linked words too\n\nSoup"


def test_deeply_nested_and_misnested_tags_take_linear_time():
    n = 100_000
    pages = {"<div>" * n + "deep": "deep", "<li>" * n + "</b>" * n + "last": "last", "<b><div>" * n + "</b>" * n + "x": "x", "<span class=ad>" * n + "gone": ""}
    began = time.perf_counter()
    for source, text in pages.items():
        assert html_text.extract(source) == text
    assert time.perf_counter() - began < 30


def test_tokens_are_balanced():
    """What a page leaves open is closed, so that pages which differ in that alone have one wrapper."""
    whole = html_text.Page("<ul><li>a</li><li>b</li></ul><p>c <b>d</b></p><table><tr><td>e</td></tr></table>").tokens
    assert html_text.Page("<ul><li>a<li>b</ul><p>c <b>d<table><tr><td>e").tokens == whole
    assert sum(v.startswith("/") for k, v in whole if k == "tag") * 2 == sum(k == "tag" for k, _ in whole)
