"""Union-free regular expressions over the token streams of pages, inferred by aligning pages of one host.

A wrapper is a list of nodes: ("tag", name), ("text", hash or None, n), ("opt", nodes) and ("rep", nodes). A text node with
a hash has been the same in n pages, one with None is a slot. Only what LEAST_PAGES or more pages share counts as a
constant, so a text that one page has in addition never does. Aligning a page with a wrapper resolves each mismatch: two texts
make a slot; a tag that starts over what has just been matched makes a repeated group; else what one side has in
addition, up to the tag that the other side stands at, becomes optional. Wrappers of parts of a host's pages are aligned
with each other by the same rules; pages that no rule can align are of different templates, with a wrapper each.
"""

from __future__ import annotations

import hashlib

Node = tuple
#: Pages, of different content, in which a text must stand at the same place to be part of the template.
LEAST_PAGES = 3


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def nodes_of(tokens: list[tuple[str, str]]) -> list[Node]:
    """Tokens are ("tag", name) and ("text", text)."""
    return [("tag", v) if k == "tag" else ("text", text_hash(v), 1) for k, v in tokens]


def general(nodes: list[Node]) -> list[Node]:
    return [("text", None, 0) if n[0] == "text" else (n[0], general(n[1])) if n[0] in ("opt", "rep") else n for n in nodes]


def consume(nodes: list[Node], page: list[Node], at: int, found: dict[int, bool] | None = None) -> int:
    """Where the page stands after these nodes, or -1. ``found`` gets, per text position, whether it met its constant."""
    for n in nodes:
        kind = n[0]
        if kind == "rep":
            times = 0
            while (to := consume(n[1], page, at, found)) > at:
                at, times = to, times + 1
            if not times:
                return -1
        elif kind == "opt":
            mine: dict[int, bool] = {}
            if (to := consume(n[1], page, at, mine)) >= 0:
                at = to
                if found is not None:
                    found.update(mine)
        elif at >= len(page) or page[at][0] != kind:
            return -1
        elif kind == "tag":
            if page[at] != n:
                return -1
            at += 1
        else:
            if found is not None:
                found[at] = n[2] >= LEAST_PAGES and page[at][1] == n[1]
            at += 1
    return at


def _square(nodes: list[Node], end: int, first: Node) -> int:
    """Where the group that ends at ``end`` and begins with ``first`` starts, tags balanced in between; or -1."""
    if first[0] != "tag" or first[1].startswith("/") or not end or nodes[end - 1] != ("tag", "/" + first[1].split(".")[0]):
        return -1
    depth = 0
    for s in range(end - 1, -1, -1):
        n = nodes[s]
        if n[0] == "tag" and n[1] == "/" + first[1].split(".")[0]:
            depth += 1
        elif n[0] == "tag" and n[1].split(".")[0] == first[1].split(".")[0]:
            depth -= 1
            if not depth:
                return s if n == first else -1
    return -1


def collapse(nodes: list[Node]) -> list[Node]:
    """Adjacent equal groups as one repeated group."""
    out: list[Node] = []
    at = 0
    while at < len(nodes):
        start = _square(out, len(out), nodes[at])
        if start >= 0:
            body = general(collapse(out[start:]))
            to, times = at, 0
            while (nxt := consume(body, nodes, to)) > to:
                to, times = nxt, times + 1
            if times:
                out[start:] = [("rep", body)]
                at = to
                continue
        out.append(nodes[at])
        at += 1
    return out


def _met(node: Node, part: list[Node]) -> Node:
    """The optional or repeated node after a part that it consumes: texts of an option are counted or become slots."""
    body = align(node[1], part) if node[0] == "opt" and part else None
    return node if body is None else ("opt", body)


def align(wrapper: list[Node], page: list[Node]) -> list[Node] | None:
    """The wrapper made to fit the page as well; None if no rule resolves a mismatch."""
    out: list[Node] = []
    i = j = 0
    while i < len(wrapper) or j < len(page):
        w, p = wrapper[i] if i < len(wrapper) else None, page[j] if j < len(page) else None
        if w and p and w[0] == p[0] and w[0] in ("rep", "opt"):
            body = align(w[1], p[1])
            if body is not None:
                out.append((w[0], general(body) if w[0] == "rep" else body))
                i, j = i + 1, j + 1
                continue
        if w and w[0] in ("rep", "opt"):
            to = consume([w], page, j)
            if to >= 0:
                out.append(_met(w, page[j:to]))
                i, j = i + 1, to
                continue
            once = consume(w[1], page, j)
            if once >= 0:
                j = once
            out.append(w if w[0] == "opt" else ("opt", [w]))
            i += 1
            continue
        if p and p[0] in ("rep", "opt"):  # the page is a wrapper, too
            to = consume([p], wrapper, i)
            out.append(_met(p, wrapper[i:to]) if to >= 0 else ("opt", [p]))
            i, j = max(i, to), j + 1
            continue
        if w and p and w[0] == p[0] == "text":
            out.append(("text", w[1], w[2] + p[2]) if w[1] == p[1] else ("text", None, 0))
            i, j = i + 1, j + 1
            continue
        if w and p and w == p:
            out.append(w)
            i, j = i + 1, j + 1
            continue
        if p:  # the page goes on repeating
            start = _square(out, len(out), p)
            if start >= 0:
                body = general(collapse(out[start:]))
                to, times = j, 0
                while (nxt := consume(body, page, to)) > to:
                    to, times = nxt, times + 1
                if times:
                    out[start:] = [("rep", body)]
                    j = to
                    continue
        if w:  # the wrapper goes on repeating
            start = _square(out, len(out), w)
            if start >= 0:
                body = general(collapse(out[start:]))
                to, times = i, 0
                while (nxt := consume(body, wrapper, to)) > to:
                    to, times = nxt, times + 1
                if times:
                    out[start:] = [("rep", body)]
                    i = to
                    continue
        k = next((x for x in range(i + 1, len(wrapper)) if wrapper[x] == p), None) if p and p[0] == "tag" else None
        m = next((x for x in range(j + 1, len(page)) if page[x] == w), None) if w and w[0] == "tag" else None
        if p is None:
            k = len(wrapper)
        if w is None:
            m = len(page)
        if k is None and m is None:
            if w and p and (w[0] == "text") != (p[0] == "text"):  # one side has a text more
                if w[0] == "text":
                    out.append(("opt", [w]))
                    i += 1
                else:
                    out.append(("opt", [p]))
                    j += 1
                continue
            return None
        if m is None or k is not None and k - i <= m - j:
            out.append(("opt", wrapper[i:k]))
            i = k
        else:
            out.append(("opt", collapse(page[j:m])))
            j = m
    return out


def fold(found: list[tuple[list[Node], int]], nodes: list[Node], n: int = 1) -> None:
    """Aligns a page, or the wrapper of n pages, with the first of ``found`` (wrapper, pages) that a rule can align it
    with; what fits none is a template of its own."""
    for x, (wrapper, fit) in enumerate(found):
        new = align(wrapper, nodes)
        if new is not None:
            found[x] = new, fit + n
            return
    found.append((collapse(nodes), n))


def infer(pages: list[list[tuple[str, str]]]) -> list[Node] | None:
    """The wrapper of most of the pages' tokens; None if fewer than three fit one, which is too little to tell constants
    from content."""
    found: list[tuple[list[Node], int]] = []
    for p in pages:
        fold(found, nodes_of(p))
    wrapper, fit = max(found, key=lambda f: f[1], default=(None, 0))
    return wrapper if fit >= LEAST_PAGES else None


def constants(templates: list[list[Node]], tokens: list[tuple[str, str]]) -> set[int]:
    """Positions of the page's texts that are constants of the wrapper it follows furthest."""
    page, best = nodes_of(tokens), (-1, set())
    for wrapper in templates:
        found: dict[int, bool] = {}
        at = 0
        for n in wrapper:
            to = consume([n], page, at, found)
            if to < 0:
                if n[0] == "tag" or n[0] == "rep":
                    break
                continue
            at = to
        if at > best[0]:
            best = at, {i for i, same in found.items() if same}
    return best[1]
