"""Templates of hosts with several layouts, with mostly copies, and with long or deep pages."""

from __future__ import annotations

import random

from riskloom.llm import html_extract

PAGES = "page_id long, url string, html string"


def texts(spark, rows):
    df = spark.createDataFrame([(i, "http://a.example/", f"<html><body>{h}</body></html>") for i, h in rows], PAGES)
    return {r.page_id: r.text for r in html_extract.extract(df).collect()}


def words(i, n=9):
    return " ".join(f"w{(i * 7919 + k * 104729) % 99991}" for k in range(n))


def test_layouts_of_one_host(spark):
    """Boilerplate of each of six layouts goes, however few of the host's pages have that layout."""
    rows = [(10 * k + i, f"<div class=kind{'abcdef'[k]}><div class=inner><p>Welcome to part {'abcdef'[k]}</p><div><p>{words(10 * k + i)}</p></div><p>Copyright of {'abcdef'[k]}</p></div></div>")
            for k in range(6) for i in range(10 - k)]
    assert texts(spark, rows) == {i: words(i) for i, _ in rows}


def test_mostly_copies(spark):
    """Three hundred copies of one page, some with another counter, hide neither its template nor that of the others."""
    layout = "<div><p>Welcome, dear reader</p><div><p>{}</p></div><p>All rights reserved</p><p>{}</p></div>"
    rows = [(i, layout.format(words(0, 90), i % 3)) for i in range(300)] + [(1000 + i, layout.format(words(1000 + i, 90), "x")) for i in range(4)]
    got = texts(spark, rows)
    assert {i: t.split("\n")[0] for i, t in got.items()} == {i: words(0, 90) if i < 1000 else words(i, 90) for i, _ in rows}
    assert not any("Welcome" in t or "rights" in t for t in got.values())


def test_all_pages_by_tree_matching(spark):
    """Small pages against simple tree matching with every other page of the host."""
    rows = [(i, f"<div><p>Top</p><ul><li>same<li>{words(i, 3)}</ul><p>{words(i)}</p>{'<h2>Seldom</h2>' if i == 3 else ''}<p>Often{i % 2 if i < 2 else ''}</p><p>End</p></div>") for i in range(7)]
    trees = {i: html_extract.parse(f"<html><body>{h}</body></html>") for i, h in rows}
    for t in trees.values():
        html_extract.shape(t)
    want = {}
    for i, a in trees.items():
        votes = [html_extract.constant(a, b) for j, b in trees.items() if j != i]
        same = {id(x) for x in html_extract.leaves(a) if 2 * sum(id(x) in v for v in votes) > len(votes)}
        row = lambda x, a=a, same=same: sum(-1 if id(y) in same else 1 for y in html_extract.leaves(a) if y.row == x.row)
        want[i] = "\n".join(x.text for x in html_extract.leaves(a) if id(x) not in same or row(x) > 0)
    assert texts(spark, rows) == want


def test_zones_that_hold_the_article(spark):
    part = "<article><h1>T</h1><p>x y</p></article>"
    rows = [
        (1, f'<div class="page has-sidebar"><div class="row">{part}</div></div>'),
        (2, f'<div class="sidebar-layout"><div><div>{part}</div></div><div class="sidebar">no</div></div>'),
        (3, f'<form id="aspnetForm"><div><input>{part}</div></form>'),
        (4, '<article><div class="article-header"><h1>T</h1></div><p>x y</p><div class="post-share">no</div></article>'),
        (5, '<main><div class="header"><h1>T</h1></div><p>x y</p><div id="comments"><article class="comment">no</article></div></main>'),
        (6, f'<div class="left-sidebar">no</div><div class="cookie-notice">no</div><div class="page-header">no</div>{part}'),
    ]
    assert texts(spark, rows) == {i: "T\nx y" for i, _ in rows}


def test_long_and_deep_pages(spark):
    """A template block with one varying leaf, seventy in a row and sixty levels deep."""
    row = lambda i, k: f"<div><p>Label {k}</p><p>{words(100 * i + k, 3)}</p></div>"
    rows = [(i, "<div>" + "".join(row(i, k) for k in range(70)) + "</div>" + "<div>" * 60 + row(i, 70)) for i in range(4)]
    assert texts(spark, rows) == {i: "\n".join(words(100 * i + k, 3) for k in range(71)) for i in range(4)}
    long, other = (html_extract.parse(h) for _, h in rows[:2])
    html_extract.shape(long), html_extract.shape(other)
    assert len(html_extract.constant(long, other)) == 71


def best_matching(a, b):
    """The most equal text leaves that a matching of two trees pairs, keeping order, ancestry and tags; by plain recursion."""
    if a.label != b.label:
        return 0
    if a.label == "#":
        return int(a.key == b.key)

    def lists(x, y):
        return max(lists(x[1:], y), lists(x, y[1:]), best_matching(x[0], y[0]) + lists(x[1:], y[1:])) if x and y else 0

    return lists(a.children, b.children)


def test_alignment_is_the_best_one():
    rng = random.Random(5)

    def tree(depth):
        if not depth or rng.random() < 0.4:
            return f"<p>{rng.choice('abc')}</p>"
        tag = rng.choice(["div", "section"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randint(1, 3))) + f"</{tag}>"

    for _ in range(300):
        a, b = (html_extract.from_signature(html_extract.signature(html_extract.parse("".join(tree(2) for _ in range(3))))) for _ in range(2))
        html_extract.shape(a), html_extract.shape(b)
        got, texts_of_b = html_extract.align(a, b), [x.key for x in html_extract.leaves(b)]
        assert len(got) == len(set(got)) == best_matching(a, b)
        assert {html_extract.leaves(a)[k].key for k in got} <= set(texts_of_b)


def test_picked_leaves_keep_their_blocks():
    tree = html_extract.parse("<div><p>a</p><ul><li>b<li>c</ul></div><section><p>d</p></section>")
    picked = html_extract.from_signature(html_extract.signature(tree), lambda number, _: number in (0, 2))
    same = html_extract.parse("<div><p>a</p><ul><li>c</ul></div>")
    assert html_extract.signature(picked) == html_extract.signature(same)


def test_shifted_equal_blocks(spark):
    """A constant block keeps its place in the wrapper when a page has an equal text before it, in another row."""
    rows = [(i, f"<div><section><p>{words(i)}</p>{'<p>More</p>' if i == 4 else ''}<p>{words(50 + i)}</p></section><p>More</p><p>End of all</p></div>") for i in range(6)]
    want = {i: f"{words(i)}\n{words(50 + i)}" for i, _ in rows}
    want[4] = f"{words(4)}\nMore\n{words(54)}"
    assert texts(spark, rows) == want


def test_blocks_few_pages_share(spark):
    """A constant node that the page with most of them lacks is in another tree of the wrapper."""
    rows = [(i, f"<div><p>First</p><p>Second</p>{'<p>Third</p>' if i % 3 else ''}{'<p>Fifth</p>' if i % 3 != 1 else ''}<div><p>{words(i)}</p></div></div>") for i in range(9)]
    assert texts(spark, rows) == {i: words(i) for i, _ in rows}


def test_names_cut_nothing_of_an_article(spark):
    kept = [
        '<h2 id="related-work">Related work</h2>', '<h2 id="search">Search</h2>', '<h2 id="social-history">Social</h2>', '<p class="notice">Important</p>',
        '<div class="menu-of-the-day">Soup</div>', '<section class="login-flow">Flow</section>', '<div class="search-results-study">Study</div>',
        '<section id="comments-on-method">Method</section>', '<section id="comments">Own</section>', '<div class="form-group">Group</div>', '<p><span class="ad-hoc">Ad hoc</span></p>',
    ]
    text = ["Related work", "Search", "Social", "Important", "Soup", "Flow", "Study", "Method", "Own", "Group", "Ad hoc"]
    cut = ['<div class="share-buttons">x</div>', '<div id="comments">x</div>', '<ul class="related links"><li>x</ul>', '<div class="ad">x</div>', '<aside>x</aside>', '<div class="post-comments">x</div>']
    inline = "<p>Let <math><mi>a</mi></math> be <label>b</label> and <object>c</object></p>"
    assert texts(spark, [(1, f"<article>{''.join(kept)}{''.join(cut)}{inline}</article>")]) == {1: "\n".join([*text, "Let a be b and c"])}


def test_paragraphs_of_links_stay(spark):
    rows = [(i, f"<div><p>{words(i)}</p><p><a>Alice {i}</a> and <a>Bob {i}</a></p><div><ul><li><a>Next {i}</a><li><a>Last {i}</a></ul></div></div>") for i in range(5)]
    assert texts(spark, rows) == {i: f"{words(i)}\nAlice {i} and Bob {i}" for i, _ in rows}


def test_very_deep_page(spark):
    rows = [(i, "<div>" * 3000 + f"<p>Top</p><p>{words(i)}</p>") for i in range(3)]
    assert texts(spark, rows) == {i: words(i) for i, _ in rows}
