from __future__ import annotations

import html
import math
import random
import time

import numpy as np
import pytest

from tidebook.llm import ann, html_extract, queries


def plain(rows, k=10):
    ok = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, dtype=np.float32).astype(float)
    out = {}
    for q in ok:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((ok[q] - ok[i]) ** 2).sum())), i) for i in ok if i != q)[:k]
            out[q] = [(i, pytest.approx(s, abs=1e-9)) for s, i in near]
    return out


def found(spark, d):
    out = {}
    for r in sorted(queries.op4_neighbours(spark, d).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_small_tables_are_exact(spark, make):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist(), 0) for i in range(350)]
    rows += [(400, rows[7][1], 0), (401, rows[7][1], 0), *[(500 + i, rows[9][1], 0) for i in range(40)]]
    rows += [(600, None, 0), (601, [0.0] * 8, 0), (602, [1.0, None] + [0.0] * 6, 0), (603, [float("nan")] * 8, 0), (604, [], 0), (None, [1.0] * 8, 0), (700, [float("inf")] * 8, 0)]
    assert found(spark, make(embeddings=rows)) == plain(rows)


def test_fewer_candidates_than_asked(spark, make):
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (100, [1.0, 0.0], 0)]
    assert found(spark, make(embeddings=rows)) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 0)], [(0, None, 0)]])
def test_no_queries_or_vectors(spark, make, rows):
    assert queries.op4_neighbours(spark, make(embeddings=rows)).count() == 0


def test_recall(spark, make):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=24).tolist(), 0) for i in range(4_000)]
    rows += [(4_000 + i, (np.ones(24) + rng.normal(size=24) * 1e-3).tolist(), 0) for i in range(1_500)]
    want, got = plain(rows), found(spark, make(embeddings=rows))
    hit = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hit / sum(len(v) for v in want.values()) >= 0.9


PAGE = """<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site name</header><nav><ul><li><a href="/">Home</a></li><li>{t}</li></ul></nav>
<div class="sidebar"><p>see also {t}</p></div><div class="ad">buy {t}</div><{main}><h1>{t}</h1><p><b>{a}<br><p>{b}</p><form><p>name {t}</p></form><ul><li>one {t}<li>two</ul></{main}>
<section id="comments"><p>reader {t}</p></section><footer>&copy; {t}</footer>"""


def page(rng, main="article"):
    word = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))
    t, a, b = word(3), word(12), word(9)
    raw = PAGE.format(t=t, a=html.escape(a + " & <x>"), b=b + "\n\n  " + b, main=main)
    return raw, f"{t} {a} & <x> {b} {b} one {t} two"


def test_article_text(spark, make):
    rng = random.Random(0)
    made = [page(rng, rng.choice(["article", "main"])) for _ in range(60)]
    rows = [(i, f"https://{'hot' if i % 3 else f'h{i}'}.example.org/{i}", raw) for i, (raw, _) in enumerate(made)]
    rows += [(100, None, None), (101, "x", ""), (102, "http://hot.example.org/z", made[1][0]), (103, "http://hot.example.org/z", "<p>loose <b>text")]
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in queries.op6_html_extract(spark, make(pages=rows)).collect()}
    for i, (_, text) in enumerate(made):
        assert got[i] == (rows[i][1], text, len(text))
    assert got[100] == (None, "", 0) and got[101] == ("x", "", 0) and got[102][1] == made[1][1] and got[103][1] == "loose text"


def test_constant_slots_of_a_host_are_template(spark, make):
    rng = random.Random(1)
    raw = "<html><body><div><p>Welcome to our site</p></div><div><h2>{}</h2><p>{}</p></div><div><p>All rights kept</p></div></body></html>"
    word = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(n))
    texts = [(word(3), word(20)) for _ in range(12)]
    rows = [(i, f"http://plain.example.com/{i}", raw.format(*t)) for i, t in enumerate(texts)]
    rows += [(50 + i, "http://same.example.com/x", raw.format("one", "page")) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in queries.op6_html_extract(spark, make(pages=rows)).collect()}
    assert all(got[i] == " ".join(t) for i, t in enumerate(texts))
    assert got[50] == "Welcome to our site one page All rights kept"  # copies alone teach nothing


def test_salted_join_gives_the_same(spark, make, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "http://h.example.org/", page(rng)[0]) for i in range(20)]
    d = make(pages=rows)
    first = sorted(map(tuple, queries.op6_html_extract(spark, d).collect()))
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, queries.op6_html_extract(spark, d).collect())) == first


def slots_of(raw):
    root = html_extract.parse(raw)
    return html_extract.lift([root], False, root.size)


def test_tree_matching():
    a, b = slots_of("<div><p>x</p><ul><li>y</ul></div>"), slots_of("<div><h1>t</h1><p>z</p></div>")
    assert html_extract.weight(a, b) == 4  # root, div, p and its text
    assert html_extract.weight(a, a) == 7


def every_mapping(a, b):
    """The best of all mappings that keep order and depth, tried one by one."""
    if a[0] != b[0]:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max([best(x[1:], y)] + [every_mapping(x[0], k) + best(x[1:], y[i + 1 :]) for i, k in enumerate(y) if x[0][0] == k[0]])

    return 1 + best(a[1], b[1])


def test_tree_matching_against_all_mappings():
    rng = random.Random(5)

    def tree(depth):
        kids = "".join(tree(depth - 1) for _ in range(rng.randint(0, 3))) if depth else "t"
        tag = rng.choice(["div", "section", "ul"])
        return f"<{tag}>{kids}</{tag}>"

    for _ in range(200):
        a, b = slots_of(tree(3)), slots_of(tree(3))
        assert html_extract.weight(a, b) == every_mapping(a, b)


def extracted(spark, make, rows):
    return {r["page_id"]: r["text"] for r in queries.op6_html_extract(spark, make(pages=rows)).collect()}


def test_text_comes_through_the_template(spark, make):
    """No article, no telling names: only the alignment of a host's pages tells its slots apart."""
    rng = random.Random(6)
    word = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(n))
    raw = "<html><body><div class=q1><p>Our shop</p><div>open daily</div></div>{extra}<div class=q2><h2>{t}</h2><p>{b}</p></div><div class=q3><p>Call us</p></div></body></html>"
    made = [(word(3), word(20), rng.random() < 0.3) for _ in range(40)]
    rows = [(i, "http://plain.example.com/", raw.format(t=t, b=b, extra="<div class=q4>Sale of the day</div>" if e else "")) for i, (t, b, e) in enumerate(made)]
    rows += [(100, "http://plain.example.com/odd", "<div>odd one</div>")]  # one odd page changes nothing
    d = make(pages=rows)
    got = extracted(spark, make, rows)
    assert all(got[i] == f"{t} {b}" for i, (t, b, _) in enumerate(made)) and got[100] == "odd one"
    bare = {r["page_id"]: r["text"] for r in html_extract.extract(spark.read.parquet(f"{d}/pages.parquet"), use_templates=False).collect()}
    assert all(bare[i] == f"Our shop open daily {'Sale of the day ' * e}{t} {b} Call us" for i, (t, b, e) in enumerate(made))


def test_regions_by_class_and_id(spark, make):
    side = "".join(f'<{tag} {mark}>gone</{tag}>' for tag in ("div", "section") for mark in ('class="comments"', "id='ad-top'", "class=side-bar-x", 'class="Sidebar left"', 'id="cookieNotice"', 'role="navigation"', "hidden", 'style="display: none"', 'class="site-header"'))
    raw = f'<body class="page has-sidebar"><div class="no-sidebar"><article class="post comments-open"><h1>Title</h1>{side.replace("side-bar-x", "related")}<p>one <span class="ad">gone</span>two</p><div class="comments"><article class="comment">gone</article></div></article></div>{side}'
    wrapped = '<body><div class="modal widget"><p>all of it</p></div>'
    teaser = '<body><div class="sidebar"><article>teaser</article></div><article>story</article><div id="comments"><article>reader</article></div>'
    only = '<body><div class="sidebar"><article>story</article></div><p>menu</p>'
    broken = '<article><p title="open>shown</p><p class=\'x>also</p></article>'
    rows = [(1, "http://a/", raw), (2, "http://b/", wrapped), (3, "http://c/", teaser), (4, "http://d/", only), (5, "http://e/", broken), (5, "http://e/", broken)]
    got = extracted(spark, make, rows)
    assert got == {1: "Title one two", 2: "all of it", 3: "story", 4: "story", 5: "shown also"}


def test_deep_and_long_pages(spark, make):
    deep = "<div>" * 50_000 + "a<nav>n</nav><p>b" + "</div>" * 50_000 + "c"
    comments = "<p>k</p>" + "<div class=comments>" * 400 + "x<p>y" + "</div>" * 400 + "z"
    long = "<article>" + "".join(f"<p>word{i}</p>" for i in range(30_000)) + "</article>"
    got = extracted(spark, make, [(1, "http://a/", deep), (2, "http://a/", deep), (3, "http://b/", comments), (4, "http://c/", long)])
    assert got == {1: "a b c", 2: "a b c", 3: "k z", 4: " ".join(f"word{i}" for i in range(30_000))}


def test_templates_stay_small():
    rng = random.Random(7)
    kept = None
    for i in range(600):
        kinds = "".join(f"<{rng.choice(['div', 'section'])} class=c{'abcdefgh'[rng.randrange(8)]}{'abcdefgh'[rng.randrange(8)]}><p>{rng.random()}</p></x>" for _ in range(8))
        kept = html_extract.add_page(kept, html_extract.learn(f"<div class=top>Name</div>{kinds}"))
        if i == 299:
            half = len(html_extract.dumps(kept))
    assert len(html_extract.dumps(kept)) < 1.5 * half
    assert "Name" == html_extract.content(html_extract.parse("<div class=top>Name</div>"), None)
    assert "" == html_extract.content(html_extract.parse("<div class=top>Name</div>"), html_extract.decided(kept))


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "http://a/", "<p>x", "h", "t", 3)], "page_id long, url string, html string, host string, template string, salt int")
    assert [tuple(r) for r in html_extract.extract(rows).collect()] == [(1, "http://a/", "x")]


def test_empty_pages(spark, make):
    assert queries.op6_html_extract(spark, make(pages=[])).count() == 0


def test_crowds_of_near_equal_vectors():
    rng = np.random.default_rng(3)
    for noise in (1e-6, 1e-3, 2e-2):
        n = ann.BLOCK
        x = rng.normal(size=(n, 64))
        crowd = rng.permutation(n)[: n // 3]
        x[crowd] = rng.normal(size=64) + rng.normal(size=(len(crowd), 64)) * noise
        pivots, reach = ann.apart(x[: ann.SAMPLE])
        asks = np.append(crowd[:20], np.setdiff1d(np.arange(n), crowd)[:20])
        block = ann.Block(np.arange(n), x, pivots, reach)
        hit = []
        for a, order in zip(asks, ann.order_of(x[asks], pivots, ann.ORDER), strict=True):
            want = np.argsort(((x - x[a]) ** 2).sum(axis=1), kind="stable")[:11]
            hit.append(len(set(want) & set(block.nearest(x[a], order, 11)[0])) / 11)
        assert min(hit[:20]) == 1 and np.mean(hit[20:]) >= 0.9


def test_names_count_as_a_whole(spark, make):
    """A word of a longer name says nothing: the article keeps its text, and outside one such blocks stay too."""
    article = '<nav>menu</nav><article><p>start</p><section class="social-history"><p>one</p></section><div class="alert-levels"><p>two</p></div><div class="ad-box">gone</div><div class="related-posts">gone</div></article>'
    loose = '<div class="share-price-report"><p>prices</p></div><div id="widget-review"><p>verdict</p></div><div class="share-buttons">gone</div><div id="sidebar-left">gone</div><div class="comment-list">gone</div>'
    got = extracted(spark, make, [(1, "http://a/", article), (2, "http://b/", loose)])
    assert got == {1: "start one two", 2: "prices verdict"}


def test_long_lists_are_matched_in_order():
    node = lambda label: [label, [], [], None]
    rng = random.Random(4)
    for _ in range(60):
        left, right = ([node(rng.choice("abc")) for _ in range(rng.randint(0, 25))] for _ in range(2))
        pairs = html_extract.long_match(left, right)
        assert all(left[i][0] == right[j][0] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= html_extract.match(left, right, size=True)[0]
    assert html_extract.long_match(left, left) == [(i, i) for i in range(len(left))]


def test_flat_pages_of_many_blocks_take_seconds():
    flat = lambda n, a, b: "<div>" + "".join(f"<h2>{a}{i}</h2><p>{b}{i}</p>" for i in range(n)) + "</div>"
    began = time.process_time()
    one, two = flat(5_000, "h", "p"), flat(4_990, "g", "q")
    template = html_extract.add_page(html_extract.learn(one), html_extract.learn(two))
    text = html_extract.content(html_extract.parse(two), html_extract.decided(template))
    assert time.process_time() - began < 10
    assert text.split() == [w for i in range(4_990) for w in (f"g{i}", f"q{i}")]
