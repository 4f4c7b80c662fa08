"""Main text of web pages by wrapper induction.

Pages of one host are aligned by simple tree matching.  A text slot that keeps one value over pages belongs to the host's
template; varying slots are content, unless they lie in a region that the markup declares to be something else: by its tag
(navigation, footer, form ...), its role, or a class or id that names an advert, a sidebar, a notice, reader comments ...

A template node counts the pages that have the slot and, by Misra-Gries counters, their most common values, each with the
marks of the first ``STRONG_PAGES`` different pages.  A value is template if at least ``SHARE`` of the slot's pages have it and
``WEAK_PAGES`` of these are different; inside an article that the markup declares, ``STRONG_SHARE`` and ``STRONG_PAGES``.  Pages
with the same longest text are copies, not different ones, so copies never make their own article template.  Slots on under
``RARE`` of a host's pages are content; they are dropped from the template by lossy counting, so a template has a bounded size.

Induction covers every page: each task folds its pages into one partial template for each host, partial templates of a host
are merged in two rounds (so a hot host is never gathered in one task page by page).  Templates go back to the
pages by a broadcast behind a check of their size; beyond it both are sorted together by host and salt, and
each template streams past ahead of its pages.

A name counts only if all its words do ("share-buttons", not "share-price").  Names never apply to html, body, main and article, to
layout flags ("no-sidebar", "comments-open"), to an ancestor of the article, or to a wrapper that holds all text of the page.  Where an article or main element has text, text outside it is no content.

Pages: null or empty html gives an empty text.  Broken markup is repaired (implied ends, missing ends, open quotes).  Elements nested
deeper than ``MAX_DEPTH`` stand beside each other, in order, as in browsers.  Repeated rows get equal texts, ties of values go to
the smaller mark, columns besides id, url and html are left out.  No text is cut off or capped.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm import common

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop|hidden|aria-hidden|style)(?![\w-])\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: An opening tag ends an open element of these kinds, up to the next boundary.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
BOUNDARY = {"article", "aside", "body", "div", "dl", "footer", "form", "html", "main", "nav", "ol", "section", "table", "ul"}
#: Never content, whatever they hold; and those that are none unless they hold the article.
SIDE_TAGS = {"nav", "footer", "aside", "head", "menu", "dialog", "button", "select", "svg", "canvas", "object", *RAW}
FORM_TAGS = {"form", "fieldset"}
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
CONTENT_TAGS = {"article", "main"}
FRAME_TAGS = {"html", "body", "main", "article"}
#: Words of a class or id that name a side region, words that may stand beside them, and words that make a name a flag of the layout.
SIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead "
    "cookie cookies consent notice notices alert alerts newsletter subscribe signup login popup modal share sharing social related recommended recommendations widget widgets toolbar pagination pager".split()
)
COMMENT_NAMES = set("comment comments commentlist disqus replies respond".split())
BESIDE_NAMES = set(
    "site page main global primary secondary top bottom left right inner outer box bar block container wrap wrapper holder list links link item items button buttons icon icons section area panel region zone slot unit "
    "column col row group post posts article articles stories form field header thread count js ui".split()
)
HEADER_NAMES = {"header", "site-header", "top-header", "page-top", "topbar"}
FLAG_NAMES = set("has no with without open closed enabled disabled hide show".split())
NAME_TOKEN = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

#: Nesting past which elements stand beside each other.
MAX_DEPTH = 150
SHARE, WEAK_PAGES = 0.8, 3
STRONG_SHARE, STRONG_PAGES = 0.9, 8
#: Share of a host's pages under which a slot is dropped, pages between two looks, and values counted in a slot.
RARE, LOOK, VALUES = 0.1, 64, 4
#: Partial templates kept in a task before they are passed on.
TASK_HOSTS = 2_000
BROADCAST_BYTES = 64 << 20
SALTS = 64


# -- pages ---------------------------------------------------------------------------------


class Node:
    """An element, or a text ("#text"); ``named``: what ``named`` says."""

    __slots__ = ("tag", "label", "text", "kids", "up", "named", "hidden", "content", "holds", "size", "slot")

    def __init__(self, tag: str, label: str = "", text: str = ""):
        self.tag, self.label, self.text = tag, label or tag, text
        self.kids: list[Node] = []
        self.up: Node | None = None
        self.named, self.hidden, self.content, self.holds = PLAIN, False, tag in CONTENT_TAGS, False
        self.size, self.slot = len(text), None

    def add(self, kid: Node) -> None:
        kid.up = self
        self.kids.append(kid)


#: What a name says: nothing, a side region, reader comments.
PLAIN, SIDE, COMMENTS = range(3)


def named(value: str) -> int:
    """What the names in a class or id make of an element.

    A name counts if all its words do: "share-buttons" and "site-footer" are side regions, "share-price" and "social-history" are not.
    """
    out = PLAIN
    for token in value.split():
        words = {w.lower() for w in NAME_TOKEN.split(token) if w and not w.isdigit()}
        if words & FLAG_NAMES:
            continue
        rest = words - BESIDE_NAMES
        if token.lower() in HEADER_NAMES:
            out = max(out, SIDE)
        elif rest and rest <= COMMENT_NAMES | SIDE_NAMES:
            out = max(out, COMMENTS if rest & COMMENT_NAMES else SIDE)
    return out


class Marks(dict):
    """Attributes of a tag as written to (classes, named, hidden, content); emptied now and then."""

    def __missing__(self, written: str) -> tuple[str, int, bool, bool]:
        classes, name, hidden, content = "", PLAIN, False, False
        for a in ATTRIBUTE.finditer(written):
            kind, value = a[1].lower(), html.unescape(a[2] or a[3] or a[4] or "")
            if kind == "class":
                classes = re.sub(r"\d+", "#", " ".join(value.split()))
            if kind in ("class", "id"):
                name = max(name, named(value))
            elif kind == "role":
                hidden |= value.strip().lower() in SIDE_ROLES
                content |= value.strip().lower() == "main"
            elif kind == "itemprop":
                content |= value.strip().lower() == "articlebody"
            elif kind == "style":
                hidden |= bool(HIDDEN_STYLE.search(value))
            else:
                hidden |= kind == "hidden" or value.strip().lower() == "true"
        if len(self) >= 20_000:
            self.clear()
        self[written] = out = (classes, name, hidden, content)
        return out


NO_MARKS = ("", PLAIN, False, False)


def parse(page: str, marks: Marks | None = None) -> Node:
    """The tree of blocks; inline elements are part of the text of their block, but hidden ones and named ones are left out."""
    marks = Marks() if marks is None else marks
    root = Node("#root")
    every, stack, run = [root], [root], []
    mute: list = []  # tag of an inline element that is left out, and how often it is open
    at, n = 0, len(page)

    def put(node: Node) -> None:
        """Under the open element; past MAX_DEPTH beside it, with what it says about its inside."""
        if len(stack) <= MAX_DEPTH:
            stack[-1].add(node)
            return
        above, home = stack[-1], stack[MAX_DEPTH - 1]
        if node.tag == "#text":
            if home.kids[-1] is not above:  # the element goes on after another one
                more = Node(above.tag, above.label)
                more.named, more.hidden, more.content = above.named, above.hidden, above.content
                home.add(more)
                every.append(more)
                stack[-1] = above = more
            above.add(node)
            return
        if len(stack) > MAX_DEPTH + 1 or above.up is home:
            node.named, node.content = max(node.named, above.named), node.content or above.content
            node.hidden |= above.hidden or above.tag in SIDE_TAGS or above.tag in FORM_TAGS
        home.add(node)

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                put(Node("#text", text=text))

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            if not mute:
                run.append(page[at:])
            break
        if m.start() > at and not mute:
            run.append(page[at : m.start()])
        at = m.end()
        name, written, closing = (m[2], m[3], m[1]) if m[2] else (m[5], m[6], m[4])
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            if not mute:
                run.append(" ")
            continue
        if name in INLINE:
            if mute:
                if name == mute[0]:
                    mute[1] += -1 if closing else 1
                    if not mute[1]:
                        mute = []
            elif written and not closing and name not in VOID and not written.endswith("/"):
                _, side, hidden, _ = marks[written]
                if side or hidden:
                    mute = [name, 1]
            continue
        mute = []  # an inline element ends where a block begins or ends
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name), 0)
            if depth:
                flush()
                del stack[depth:]
            continue
        flush()
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else n
            continue
        if name in VOID:
            continue
        closes = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
        if closes:
            for i in range(len(stack) - 1, 0, -1):
                tag = stack[i].tag
                if tag in closes:
                    del stack[i:]
                    break
                if tag in BOUNDARY:
                    break
        classes, side, hidden, content = marks[written] if written else NO_MARKS
        node = Node(name, f"{name} {classes}" if classes else name)
        node.named, node.hidden, node.content = side, hidden, content or node.content
        put(node)
        every.append(node)
        stack.append(node)
    flush()
    settle_regions(every)
    return root


def settle_regions(every: list[Node]) -> None:
    """Sizes of all elements, and the ancestors of the article: of one outside named regions, if there is any."""
    for node in reversed(every):
        node.size += sum(k.size for k in node.kids if k.tag == "#text")
        if node.up is not None:
            node.up.size += node.size
    free, bound = [], []
    for node in every:
        if not node.content or (node.tag == "article" and node.named == COMMENTS):
            continue
        worst, up = 0, node.up
        while up is not None:
            if up.tag in SIDE_TAGS or up.hidden or (up.named == COMMENTS and up.tag not in FRAME_TAGS):
                worst = 2
                break
            if up.named and up.tag not in FRAME_TAGS:
                worst = 1
            up = up.up
        (free if not worst else bound if worst == 1 else []).append(node)
    for node in free or bound:
        up = node
        while up is not None and not up.holds:
            up.holds, up = True, up.up


def is_side(node: Node, inside: bool, whole: int) -> bool:
    if node.tag in SIDE_TAGS or node.hidden:
        return True
    if node.named == COMMENTS and node.tag not in ("html", "body", "main"):
        return not node.holds or node.tag == "article"
    if node.tag in FRAME_TAGS or node.holds:
        return False
    return node.tag in FORM_TAGS or (node.tag == "header" and not inside) or bool(node.named and node.size < whole)


def seen(node: Node, inside: bool, whole: int) -> list[Node]:
    """Children that are no side regions."""
    return [k for k in node.kids if k.tag == "#text" or not is_side(k, inside or node.content, whole)]


def texts(root: Node) -> Iterator[str]:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "#text":
            yield node.text
        todo += reversed(node.kids)


# -- slots and simple tree matching --------------------------------------------------------
# A slot of a page is [label, children, texts, slot that it went into].  A node of a template is [label, children, pages
# that have it, pages before it came, {mark of a text: [pages, marks of different pages]}].

#: Pairs of siblings up to which lists are matched exactly; longer ones by ``long_match``.
EXACT = 10_000
#: Neighbours that are items of one list; of other kinds only longer runs than LONG are.
ITEMS = {"#text", "p", "li", "tr", "td", "th", "dt", "dd", "option"}
LONG = 8


def mark(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).hexdigest()


def groups(kids: list[Node]) -> list[list[Node]]:
    """Neighbours with the same label that are items of a list, together; others apart."""
    runs: list[list[Node]] = []
    for k in kids:
        if runs and runs[-1][0].label == k.label:
            runs[-1].append(k)
        else:
            runs.append([k])
    out: list[list[Node]] = []
    for run in runs:
        if len(run) > LONG or run[0].tag in ITEMS:
            out.append(run)
        else:
            out += [[k] for k in run]
    return out


def lift(nodes: list[Node], inside: bool, whole: int) -> list:
    """Neighbours of one slot as one slot with its children."""
    slot: list = [nodes[0].label, [], [], None]
    for node in nodes:
        node.slot = slot
        if node.tag == "#text":
            slot[2].append(node.text)
            continue
        within = inside or node.content
        slot[1] = absorb(slot[1], [lift(g, within, whole) for g in groups(seen(node, within, whole))])
    return slot


def absorb(left: list, right: list) -> list:
    """Both lists of slots in order; matched ones become one."""
    if not left:
        return right
    out, i, j = [], 0, 0
    for x, y in match(left, right)[1]:
        a, b = left[x], right[y]
        b[3] = a
        a[2] += b[2]
        a[1] = absorb(a[1], b[1])
        out += left[i:x] + right[j:y] + [a]
        i, j = x + 1, y + 1
    return out + left[i:] + right[j:]


def weight(a: list, b: list, memo: dict | None = None) -> int:
    """Simple tree matching: the size of the largest mapping that keeps order and depth."""
    if a[0] != b[0]:
        return 0
    if not a[1] or not b[1]:
        return 1
    memo = {} if memo is None else memo
    key = id(a), id(b)
    if key not in memo:
        memo[key] = 1 + match(a[1], b[1], memo, True)[0]
    return memo[key]


def long_match(left: list, right: list) -> list[tuple[int, int]]:
    """Pairs of two long lists in almost linear time: equal heads and tails, and between them the longest chain of siblings that are
    the same occurrence of their label."""
    n, m = len(left), len(right)
    head = 0
    while head < min(n, m) and left[head][0] == right[head][0]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and left[n - 1 - tail][0] == right[m - 1 - tail][0]:
        tail += 1
    where: dict[tuple, int] = {}
    counts: dict = {}
    for j in range(head, m - tail):
        label = right[j][0]
        counts[label] = counts.get(label, 0) + 1
        where[label, counts[label]] = j
    counts, met = {}, []
    for i in range(head, n - tail):
        label = left[i][0]
        counts[label] = counts.get(label, 0) + 1
        if (label, counts[label]) in where:
            met.append((i, where[label, counts[label]]))
    # the longest rising run of places on the right, by the least end of each length
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(met):
        p = bisect.bisect_left(ends, j)
        ends[p : p + 1] = [j]
        at[p : p + 1] = [k]
        before.append(at[p - 1] if p else -1)
    chain, k = [], at[-1] if at else -1
    while k >= 0:
        chain.append(met[k])
        k = before[k]
    return [(i, i) for i in range(head)] + chain[::-1] + [(n - t, m - t) for t in range(tail, 0, -1)]


def match(left: list, right: list, memo: dict | None = None, size: bool = False) -> tuple[int, list[tuple[int, int]]]:
    """(size, pairs) of the best mapping of two lists of siblings; lists with equal labels go pair by pair."""
    n, m = len(left), len(right)
    memo = {} if memo is None else memo
    if n == m and all(a[0] == b[0] for a, b in zip(left, right, strict=True)):
        return sum(weight(a, b, memo) for a, b in zip(left, right, strict=True)) if size else 0, [(i, i) for i in range(n)]
    if n * m > EXACT:
        pairs = long_match(left, right)
        return sum(weight(left[i], right[j], memo) for i, j in pairs) if size else 0, pairs
    w = [[weight(a, b, memo) for b in right] for a in left]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, own = best[i], best[i + 1], w[i]
        for j in range(m - 1, -1, -1):
            row[j] = max(below[j], row[j + 1], own[j] and below[j + 1] + own[j])
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        if w[i][j] and best[i][j] == best[i + 1][j + 1] + w[i][j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return best[0][0], pairs


# -- templates -----------------------------------------------------------------------------


def learn(page: str | None, marks: Marks | None = None) -> list:
    """A page as a template of its own."""
    root = parse(page or "", marks)
    who = mark(max(texts(root), key=len, default=""))

    def node(slot: list) -> list:
        return [slot[0], [node(k) for k in slot[1]], 1, 0, {mark("\x00".join(slot[2])): [1, [who]]} if slot[2] else {}]

    return node(lift([root], False, root.size))


def counted(a: dict, b: dict) -> dict:
    """Misra-Gries counters of both."""
    out = dict(a)
    for value, (n, pages) in b.items():
        own = out.get(value)
        out[value] = [n + own[0], sorted({*pages, *own[1]})[:STRONG_PAGES]] if own else [n, pages]
    if len(out) > VALUES:
        least = sorted((n for n, _ in out.values()), reverse=True)[VALUES]
        out = {v: [n - least, pages] for v, (n, pages) in out.items() if n > least}
    return out


def later(node: list, pages: int) -> list:
    node[3] += pages
    for k in node[1]:
        later(k, pages)
    return node


def join_nodes(a: list, b: list, of_a: int, of_b: int) -> list:
    """Template ``a`` of ``of_a`` pages with ``b`` of ``of_b`` pages added."""
    a[2], a[3], a[4] = a[2] + b[2], a[3] + b[3], counted(a[4], b[4])
    out, i, j = [], 0, 0
    gone = of_b if of_b > 1 else 0  # one page has lost no slot
    for x, y in [*match(a[1], b[1])[1], (len(a[1]), len(b[1]))]:
        out += [later(k, gone) if gone else k for k in a[1][i:x]] + [later(k, of_a) for k in b[1][j:y]]
        if x < len(a[1]):
            out.append(join_nodes(a[1][x], b[1][y], of_a, of_b))
        i, j = x + 1, y + 1
    a[1] = out
    return a


def prune(node: list, pages: int) -> None:
    """Drops slots that can't be on RARE of the pages."""
    node[1] = [k for k in node[1] if k[2] + RARE * k[3] > RARE * pages]
    for k in node[1]:
        prune(k, pages)


def add_page(template: list | None, page: list) -> list:
    if template is None:
        return page
    join_nodes(template, page, template[2], 1)
    if template[2] % LOOK == 0:
        prune(template, template[2])
    return template


def decided(node: list) -> list:
    """[label, children, value that is template, value that is template inside an article too]."""
    def constant(share: float, pages: int) -> str:
        return min((v for v, (n, who) in node[4].items() if n >= share * node[2] and len(who) >= pages), default="")

    return [node[0], [decided(k) for k in node[1]], constant(SHARE, WEAK_PAGES), constant(STRONG_SHARE, STRONG_PAGES)]


# -- extraction ----------------------------------------------------------------------------


def content(page: Node, template: list | None) -> str:
    """Texts of the page that are neither template nor declared to be something else."""
    whole = page.size
    slot = lift([page], False, whole)
    constant: dict[int, tuple[str, str]] = {}

    def settle(own: list, known: list) -> None:
        if own[2] and (known[2] or known[3]):
            constant[id(own)] = known[2], known[3]
        for x, y in match(own[1], known[1])[1]:
            settle(own[1][x], known[1][y])

    if template is not None:
        settle(slot, template)
    declared = any(k.content and k.holds and k.size for k in elements(page))
    out: list[str] = []

    def walk(node: Node, inside: bool) -> None:
        for k in seen(node, inside, whole):
            if k.tag != "#text":
                walk(k, inside or k.content)
            elif inside or not declared:
                own = k.slot
                while own[3] is not None:
                    own = own[3]
                if id(own) not in constant or constant[id(own)][inside] != mark("\x00".join(own[2])):
                    out.append(k.text)

    walk(page, False)
    return " ".join(out)


def elements(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += node.kids


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def dumps(t: list) -> str:
    return json.dumps(t, ensure_ascii=False, separators=(",", ":"))


def induce(pages: DataFrame, salts: int = 16) -> DataFrame:
    """host, template: one row for each host of ``pages`` (host, html)."""

    def fold(batches):
        kept: dict[str, list] = {}
        marks = Marks()

        def rows():
            written = [dumps(t) for t in kept.values()]
            salt = [int(mark(h + t), 16) % salts for h, t in zip(kept, written, strict=True)]
            out = pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(written, pa.string()), pa.array(salt, pa.int32())], ["host", "template", "salt"])
            kept.clear()
            return out

        for batch in common.small(batches):
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kept[host] = add_page(kept.get(host), learn(page, marks))
                if len(kept) >= TASK_HOSTS:
                    yield rows()
        if kept:
            yield rows()

    def merged(pdf: pd.DataFrame) -> list:
        whole = None
        for t in sorted(pdf.template):
            t = json.loads(t)
            if whole is None:
                whole = t
            else:
                join_nodes(whole, t, whole[2], t[2])
                prune(whole, whole[2])
        return whole

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf.host.iloc[0]], "template": [dumps(merged(pdf))]})

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf.host.iloc[0]], "template": [dumps(decided(merged(pdf)))]})

    parts = pages.select("host", "html").mapInArrow(fold, "host string, template string, salt int")
    return parts.groupBy("host", "salt").applyInPandas(merge, "host string, template string").groupBy("host").applyInPandas(finish, "host string, template string")


class Templates(dict):
    """Host to its template, read when first needed; emptied at TASK_HOSTS."""

    def __init__(self, written: dict[str, str]):
        super().__init__()
        self.written = written

    def __missing__(self, host: str) -> list | None:
        if len(self) >= TASK_HOSTS:
            self.clear()
        self[host] = out = json.loads(self.written[host]) if host in self.written else None
        return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", use_templates: bool = True) -> DataFrame:
    """``page_id``, ``url`` and ``text`` for every row; rows without a url form a host of their own."""
    spark = pages.sparkSession
    kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"), pages[page].alias("html")).withColumn("host", host_of(F.coalesce(F.col("url"), F.lit(""))))
    out = f"page_id {kind}, url string, text string"
    names = {"page_id": page_id, "url": url}
    templates = common.cut_lineage(induce(rows)) if use_templates else spark.createDataFrame([], "host string, template string")
    size = templates.agg(F.sum(F.octet_length("template") + F.octet_length("host") + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast({r["host"]: r["template"] for r in templates.collect()})

        def run(batches):
            known, marks = Templates(shared.value), Marks()
            for batch in common.small(batches):
                found = [content(parse(p or "", marks), known[h]) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["page_id", "url", "text"])

        return rows.select("page_id", "url", "host", "html").mapInArrow(run, out).withColumnsRenamed(names)

    def stream(batches):
        host, template, marks = None, None, Marks()
        for batch in common.small(batches):
            keep, found = [], []
            for at, (h, known, p) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 4, 3)), strict=True)):
                if known is not None:
                    host, template = h, json.loads(known)
                    continue
                keep.append(at)
                found.append(content(parse(p or "", marks), template if h == host else None))
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(found, pa.string())], ["page_id", "url", "text"])

    own = rows.withColumn("template", F.lit(None).cast("string")).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    ahead = templates.select(F.lit(None).cast(kind).alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "host", "template", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    both = own.unionByName(ahead).repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("template").isNull())
    return both.select("page_id", "url", "host", "html", "template").mapInArrow(stream, out).withColumnsRenamed(names)
