"""Toxicity by held-out accuracy and by a plain model; page text; the pipeline against brute force."""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import covered, fingerprint, groups, hits, quality, without_hits
from test_rules import check_pieces

import __spark_entry__ as entry
import corpus_pipeline
from riskloom.llm import html_extract, toxicity
from riskloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def area(score, label):
    order = sorted(range(len(score)), key=lambda i: score[i])
    rank = {i: k + 1 for k, i in enumerate(order)}
    p = sum(label)
    return (sum(rank[i] for i in range(len(label)) if label[i]) - p * (p + 1) / 2) / (p * (len(label) - p))


def toxic_table(n=1500):
    rng = np.random.default_rng(1)
    plain = [f"{a}{b}" for a in ("lor", "tam", "vel", "quo", "sit", "nec") for b in ("em", "ia", "us", "or", "ante", "il")]
    docs, labels = [], []
    for i in range(n):
        ws, bad = list(rng.choice(plain, int(rng.integers(5, 120)))), i % 5 == 0
        if bad:
            for _ in range(2):
                ws.insert(int(rng.integers(len(ws))), "Zarg" + str(rng.choice(["a", "os", "ix"])))
        docs.append((i, " ".join(ws), "en", "s", 0.5))
        if i % 4:
            labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = toxic_table()
    d = spark.createDataFrame([*docs, (None, None, None, None, None), (-5, "", "x", "y", 0.1)], "doc_id long, text string, lang string, source string, score double")
    lb = spark.createDataFrame([*labels, (None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(d, lb).collect()}
    assert len(got) == len(docs) + 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, *_ in docs if got[i].held_out]
    assert area([got[i].score for i in held], [i % 5 == 0 for i in held]) > 0.98
    assert np.mean([got[i].predicted == (i % 5 == 0) for i in held]) > 0.95
    # Labels of held-out rows, and the other columns, change nothing.
    flipped = spark.createDataFrame([(i, 1, 1 - t if got[i].held_out else t) for i, _, t in labels], "doc_id long, quality int, toxic int")
    other = toxicity.score(d.selectExpr("doc_id", "text", "'zz' lang", "'q' source"), flipped).collect()
    assert {r.doc_id: round(r.score, 9) for r in other} == {i: round(r.score, 9) for i, r in got.items()}


def test_toxicity_model(spark):
    """The differences against the formulas, by plain counting."""
    docs, labels = toxic_table(150)
    toxic = {i: t for i, _, t in labels}
    rows = [(t, toxic[i]) for i, t, *_ in docs if i in toxic]
    got = {r.gram: r.d for r in toxicity.differences(toxicity.gram_counts(spark.createDataFrame(rows, "text string, toxic int"))).collect()}
    n = [Counter(), Counter()]
    for text, c in rows:
        data = b"  " + b" ".join(re.sub(rb"[^a-z\x80-\xff]+", b" ", text.lower().encode()).split()) + b" "
        n[c].update(data[i:i + 5] for i in range(len(data) - 4))
    every = set(n[0]) | set(n[1])
    total = [sum(c.values()) for c in n]
    d = [4.0 * t / min(total) for t in total]
    before = Counter(g[1:] for g in every)
    bases, kinds = defaultdict(int), Counter(g[:3] for g in before)
    for g, k in before.items():
        bases[g[:3]] += k
    heads = [Counter(), Counter()]
    lost = [defaultdict(float), defaultdict(float)]
    for c in (0, 1):
        for g, k in n[c].items():
            heads[c][g[:4]] += k
            lost[c][g[:4]] += min(k, d[c])

    def p(c, g):
        low = g[1:]
        shared = max(before[low] - 0.5, 0) / bases[low[:3]] + 0.5 * kinds[low[:3]] / bases[low[:3]] / 256
        h = heads[c][g[:4]]
        return (n[c][g] - min(n[c][g], d[c])) / h + lost[c][g[:4]] / h * shared if h else shared

    want = {int.from_bytes(g, "big"): math.log(p(1, g)) - math.log(p(0, g)) for g in every}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want)


def test_toxicity_without_evidence(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {r.score for r in toxicity.score(d, none).collect()} == {0.5}
    assert toxicity.score(d.limit(0), none).collect() == []
    rows = QUERIES["op8_toxicity"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()


def page(i, article, extra=""):
    return (f"<html><head><title>t{i}</title></head><body><header>Site</header><nav><a href=x>m{i}</a></nav><div class=\"cookie-notice\">We use {i}</div>"
            f"{article}<aside>s{i}</aside><form>f</form>{extra}<div id='comments'><p>nice {i}</p></div><footer>&copy; {i}</footer></body></html>")


def test_pages(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op9_wrapper_induction"](spark, SF).collect()}
    for r in rows:
        article = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        text = "\n".join(b for b in blocks if b)
        assert tuple(got[r.page_id]) == (r.page_id, r.url, text, len(text))


def test_page_cases(spark):
    plain = [f"<div class=top>Welcome</div><div class=body><h2>Title {i}</h2><p>Text {'abc def ' * (i + 3)}{i} &lt;x&gt;</p><p>More {i * 37}</p><ul><li>one {i}<li>two {i}</ul></div><div>All rights reserved</div>" for i in range(5)]
    rows = [(i, f"http://A.example:80/{i}", f"<html><body>{p}</body></html>", "h", 1) for i, p in enumerate(plain)]
    rows += [(10 + i, "http://b.example/x", page(i, f"<article><h1>H {i}</h1><p>x <b>y</b>{i}<br>z<script>no</script></p><aside>no</aside></article>"), "h", 1) for i in range(4)]
    rows += [(20, None, None, "h", 1), (21, "", "", "h", 1), (22, "u", "no markup &amp; more", "h", 1), (23, "u", "<p>a<p>b <i>c</i>d<table><tr><td>e<td>f</table><!-- x --><style>q", "h", 1), (23, "u", "<b>", "h", 1)]
    rows += [(30, "http://c.example/", "<div>" * 3000 + "deep", "h", 1), (31, "http://c.example/", "<p>a</p>" * 5000, "h", 1), (32, "http://c.example/", '<a href="x' * 3000, "h", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text int")
    got = sorted(((r.page_id, r.text) for r in html_extract.extract(df).collect()), key=str)
    want = [(i, f"Title {i}\n" + " ".join(f"Text {'abc def ' * (i + 3)}{i} <x>".split()) + f"\nMore {i * 37}\none {i}\ntwo {i}") for i in range(5)]
    want += [(10 + i, f"H {i}\nx y{i} z") for i in range(4)]
    want += [(20, ""), (21, ""), (22, "no markup & more"), (23, "a\nb cd\ne\nf"), (23, ""), (30, "deep"), (31, "\n".join("a" * 5000))]
    assert [g for g in got if g[0] != 32] == sorted(want, key=str)
    assert html_extract.extract(df.limit(0)).collect() == []


def test_signature_round_trip():
    tree = html_extract.parse("<div><p>a<p>b<ul><li>c</ul></div>d")
    again = html_extract.from_signature(html_extract.signature(tree))
    assert html_extract.shape(tree) == html_extract.shape(again)
    assert len(html_extract.constant(tree, again)) == 4


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """The smallest table with odd rows added: nulls, empties, repeated rows, a clashing column."""
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = docs.orderBy("doc_id").limit(12)
    odd = spark.createDataFrame([(9001, None, "en", None, None), (9002, "", None, "s", 0), (9003, "word " * 60, "en", "s", 300)], docs.schema)
    docs.union(one).union(odd).selectExpr("*", "'k' AS kept").write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline(spark, small):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    verdicts = quality(rows)
    rows = [(i, t) for (i, t, _), v in zip(rows, verdicts, strict=True) if v[-1]]
    rows = sorted(set(rows))  # repeated rows are one near copy of each other
    first = groups([fingerprint(t) for _, t in rows])
    rows = [r for k, r in enumerate(rows) if first[k] == k]
    gone = covered([t.encode() for _, t in rows], corpus_pipeline.PASSAGE_BYTES)
    rows = [(i, np.frombuffer(t.encode(), np.uint8)[~g].tobytes().decode("utf-8", "ignore")) for (i, t), g in zip(rows, gone, strict=True)]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = [(i, without_hits(t, p) if p else t) for (i, t), (n, p, _) in zip(rows, hits([t for _, t in rows], items), strict=True) if 2 * len(p) <= n]
    check_pieces(entry.queries()["pipeline"](spark, small).collect(), rows)


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), small).collect() == []
