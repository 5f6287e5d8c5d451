"""Main text of web pages: wrappers inferred per host, and the roles of elements.

Pages become streams of block elements' tags and texts. Elements whose tag, role or class says so (navigation, headers,
footers, sidebars, notices, adverts, forms, scripts, comments of readers) are left out; in a page with an ``article`` or
``main`` element the text is inside of it, and there a class tells against prose only where it can't name a topic. In all pages, the host's wrappers (``wrappers``) tell what stands in every page of a template,
and so belongs to it, from what fills its slots.

Wrappers are inferred over all pages of a host whose texts differ, in groups of about the square root of the largest
host's pages, and those of the groups are then aligned with each other: one wrapper for each template that three or more
pages follow. They hold hashes, not texts. Wrappers are sent to all tasks if their measured size allows; otherwise pages
are joined with them by host and salt, so that a hot host's pages are dealt out.

Defined cases: null or empty html and pages without text give an empty text; a null url is a host of its own, without
wrapper; unclosed elements end with what encloses them, and elements may be nested to any depth; texts may have any length; repeated pages are extracted one by
one; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import html as html_lib
import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wrappers
from .common import small_batches, stored, table
from .urls import host_and_path

#: A task keeps parsed wrappers of so many characters in all.
PARSED_CHARS = 4 << 20
#: Wrappers are sent to every task up to so many characters in all.
SENT_CHARS = 16 << 20
SALTS = 32

TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?"""
    r"""|<(?P<raw>script|style|textarea|title|iframe|noscript|template|xmp|noframes)\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"""|</?[a-zA-Z][^>]*>|(?P<text>[^<]+|<)""",
    re.S | re.I,
)
ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Starting one of these ends open ones of the second set, up to an enclosing one of the third.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
OUT_TAGS = frozenset("head nav header footer aside form button select dialog menu svg math canvas object audio video map".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OUT_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets cookie cookies consent gdpr "
    "notice notices notification banner ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion "
    "form newsletter subscribe subscription signup login share sharing social related recommended comment comments reply replies "
    "disqus discussion respond topbar mainmenu submenu dropdown popup modal overlay toolbar pagination pager copyright legal disclaimer skip hidden".split()
)
IN_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
NOT_LEADING = frozenset("has with no without is not".split())
#: Inside an article only these words tell against a paragraph, heading, list item or inline element: others name its topic.
STRONG_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion share sharing newsletter "
    "subscribe subscription signup cookie cookies consent gdpr comment comments reply replies hidden".split()
)
PROSE = HEADINGS | frozenset("p li dt dd td th blockquote figcaption caption pre".split())


def _attrs(text: str) -> dict[str, str]:
    return {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(text)} if text.strip() else {}


def _out(name: str, attrs: dict[str, str], inside: bool) -> bool:
    if name in OUT_TAGS:
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    if set(attrs.get("role", "").lower().split()) & OUT_ROLES:
        return True
    against = STRONG_WORDS if inside and (name in PROSE or name not in BLOCKS) else OUT_WORDS
    for one in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", one).lower())
        if words and words[0] not in NOT_LEADING and (words[0] in against or words[-1] in against):
            return True
    return False


class _Open:
    """Open elements, with what the parser asks about them at hand: each element costs a bounded number of steps,
    however deeply it is nested."""

    def __init__(self) -> None:
        self.stack: list[tuple[str | None, bool, bool]] = []  # name, left out by itself, is an article or main
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.n_out = self.n_in = self.n_headings = 0
        self.headers = [0]  # open headers that are left out, since each open article

    def state(self) -> tuple[bool, bool]:
        """(in an article, left out). An article's own header may hold its headings."""
        own = self.n_in and self.n_headings and self.headers[-1] == self.n_out
        return self.n_in > 0, self.n_out > 0 and not own

    def push(self, name: str, out: bool, inner: bool) -> None:
        at = len(self.stack)
        self.stack.append((name, out, inner))
        self.places.setdefault(name, []).append(at)
        if name in BLOCKS:
            self.blocks.append(at)
        self._count(name, out, inner, 1)

    def _count(self, name: str, out: bool, inner: bool, n: int) -> None:
        self.n_out += n * out
        self.n_in += n * inner
        self.n_headings += n * (name in HEADINGS)
        if out and name == "header" and self.n_in:
            self.headers[-1] += n
        if inner and n > 0:
            self.headers.append(0)
        elif inner:
            self.headers.pop()

    def pop(self, to: int) -> list[str]:
        """Close all elements from ``to`` on; the names of blocks among them, innermost first."""
        closed = []
        while len(self.stack) > to:
            name, out, inner = self.stack.pop()
            if name is not None:
                self.places[name].pop()
                self._count(name, out, inner, -1)
                if name in BLOCKS:
                    self.blocks.pop()
                    closed.append(name)
        return closed

    def drop(self, name: str) -> None:
        """Close the innermost inline element of this name, while what is inside of it stays open."""
        at = self.places[name].pop()
        _, out, inner = self.stack[at]
        self.stack[at] = (None, False, False)
        self._count(name, out, inner, -1)

    def last(self, name: str) -> int:
        own = self.places.get(name)
        return own[-1] if own else -1

    def first(self, names: Iterable[str], after: int = -1) -> int:
        """The outermost open element of these names above ``after``, or -1."""
        found = -1
        for name in names:
            own = self.places.get(name)
            if own and (i := bisect_right(own, after)) < len(own) and (found < 0 or own[i] < found):
                found = own[i]
        return found


class Page:
    """Tokens for wrappers, which are block elements and the texts between their tags, and the blocks of what isn't left
    out: (text, its token, in an article). Ends of elements that the page leaves open are among the tokens."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        self.blocks: list[tuple[str, int, bool]] = []
        open_, tokens, parts = _Open(), self.tokens, []
        hidden, state = False, (False, False)

        def flush() -> None:
            nonlocal hidden
            text = " ".join("".join(parts).split()) if parts else ""
            if text:
                self.blocks.append((text, len(tokens), state[0]))
            if text or hidden:
                tokens.append(("text", text))
            parts.clear()
            hidden = False

        def pop(to: int) -> None:
            tokens.extend(("tag", "/" + name) for name in open_.pop(to))

        for m in TOKEN.finditer(source):
            text = m["text"]
            if text is not None:
                if not state[1]:
                    parts.append(html_lib.unescape(text) if "&" in text else text)
                elif not text.isspace():
                    hidden = True
                continue
            name = m["name"]
            if name is None:
                continue
            name = name.lower()
            if name == "br":
                parts.append(" ")
                continue
            block = name in BLOCKS
            if block:
                flush()
            if m["end"]:
                at = open_.last(name)
                if at >= 0:
                    if block or not open_.blocks or open_.blocks[-1] < at:
                        pop(at)
                    else:
                        open_.drop(name)
                    state = open_.state()
                continue
            attrs = _attrs(m["attrs"])
            if block and name not in ("html", "body") and (at := open_.last("p")) >= 0 and open_.blocks[-1] == at:
                pop(at)
            if name in ENDS:
                ends, within = ENDS[name]
                at = open_.first(ends, max(map(open_.last, within)))
                if at >= 0:
                    pop(at)
            if name == "body" and (at := open_.last("head")) >= 0:
                pop(at)
            inner = name in IN_TAGS or attrs.get("role", "").lower() == "main"
            if inner:  # what should have ended before the article does
                at = open_.first(("nav", "header", "footer", "form", "head"))
                if at >= 0:
                    pop(at)
            if block:
                tokens.append(("tag", name + "".join(sorted("." + c for c in attrs.get("class", "").split()))))
            if name not in VOID and not m["attrs"].rstrip().endswith("/"):
                out = _out(name, attrs, open_.n_in > 0)
                open_.push(name, out, inner and not out)
            elif block:
                tokens.append(("tag", "/" + name))
            state = open_.state()
        flush()
        pop(0)

    def text(self, templates: list | None = None) -> str:
        kept = self.blocks
        if any(b[2] for b in kept):
            kept = [b for b in kept if b[2]]
        if templates:
            fixed = wrappers.constants(templates, self.tokens)
            kept = [b for b in kept if b[1] not in fixed]
        return "\n\n".join(b[0] for b in kept)


def extract(source: str | None, templates: list | None = None) -> str:
    return Page(source).text(templates) if source else ""


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as a wrapper's nodes, and a hash of their text; pages without text are left out."""
    for b in batches:
        out: tuple[list, list, list] = ([], [], [])
        for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            page = Page(source)
            if text := page.text():
                nodes = wrappers.collapse(wrappers.nodes_of(page.tokens))
                for to, v in zip(out, (host, wrappers.text_hash(text) - (1 << 63), json.dumps(nodes)), strict=True):
                    to.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["host", "page", "nodes"])


WRAPPERS = "host string, nodes string, n long, page long"


def _aligned(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[pa.RecordBatch]:
    """From rows that are sorted by the columns ``by``: the wrappers of each group, from those of its pages or groups, and
    how many pages follow each. A group is never held, only its wrappers are."""
    key, found = None, []

    def out() -> pa.RecordBatch:
        columns = [[key[0]] * len(found), [json.dumps(w) for w, _ in found], [n for _, n in found], list(range(len(found)))]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["host", "nodes", "n", "page"])

    for b in batches:
        for *own, nodes, n in zip(*[b.column(c).to_pylist() for c in (*by, "nodes", "n")], strict=True):
            if own != key:
                if found:
                    yield out()
                key, found = own, []
            wrappers.fold(found, _tuples(json.loads(nodes)), n)
    if found:
        yield out()


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, its wrappers as JSON). pages: host, html."""
    parsed = pages.filter("host <> '' AND html <> ''").select("host", "html").mapInArrow(_nodes, "host string, page long, nodes string")
    parsed = stored(parsed.groupBy("host", "page").agg(F.min("nodes").alias("nodes")), pages.sparkSession)
    most = parsed.groupBy("host").count().agg(F.max("count")).head()[0] or 1
    group = F.pmod(F.xxhash64("page"), F.lit(math.isqrt(most - 1) + 1)).alias("group")
    parts = parsed.select("host", group, "nodes", F.lit(1).cast("long").alias("n"), "page").repartition("host", "group").sortWithinPartitions("host", "group", "page")
    parts = parts.mapInArrow(lambda it: _aligned(it, "host", "group"), WRAPPERS)
    parts = parts.repartition("host").sortWithinPartitions("host", F.desc("n"), "nodes")
    found = parts.mapInArrow(lambda it: _aligned(it, "host"), WRAPPERS).filter(F.col("n") >= wrappers.LEAST_PAGES)
    return found.groupBy("host").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), "page", "nodes"))), lambda x: x["nodes"]), ","), F.lit("]")).alias("wrapper"))


def main_texts(spark: SparkSession, pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", sent_chars: int = SENT_CHARS) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    small_batches(spark)
    host, _ = host_and_path(F.col(url))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))
    found = stored(host_wrappers(rows), spark)
    size = found.agg(F.sum(F.length("wrapper") + F.length("host"))).head()[0] or 0
    if size <= sent_chars:
        rows = rows.join(F.broadcast(found), "host", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, list] = {}
        for b in batches:
            texts = []
            for source, wrapper in zip(b.column("html").to_pylist(), b.column("wrapper").to_pylist(), strict=True):
                if wrapper and wrapper not in parsed:
                    if sum(map(len, parsed)) + len(wrapper) > PARSED_CHARS:
                        parsed.clear()
                    parsed[wrapper] = [_tuples(w) for w in json.loads(wrapper)]
                texts.append(extract(source, parsed[wrapper] if wrapper else None))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def _tuples(nodes: list) -> list[tuple]:
    return [(n[0], _tuples(n[1])) if n[0] in ("opt", "rep") else tuple(n) for n in nodes]


def op5_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark, table(spark, sf_dir, "pages"))
