"""Exact search against brute force, whichever side is held."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import vectors as V
from riskloom.operators import retrieval as R


def brute(vectors, queries, k, metric):
    out = {}
    for q, qv in queries:
        scored = []
        for i, v in vectors:
            a, b = np.array(v), np.array(qv)
            s = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) if metric == "cosine" else ((a - b) ** 2).sum()
            scored.append((-round(s, 9) if metric == "cosine" else round(s, 9), i))
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("block", [2 << 20, 300, 48])
def test_nearest(spark, metric, block, monkeypatch):
    """One block of all, blocks of a few vectors, a block for each. A third of the vectors are copies."""
    monkeypatch.setattr(R, "BLOCK_BYTES", block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(45, 6))
    base[20:35] = base[4]
    vectors = [(i, base[i].tolist()) for i in range(45)]
    queries = [(f"q{j}", rng.normal(size=6).tolist()) for j in range(57)] + [("copy", base[4].tolist())]
    v = spark.createDataFrame(vectors, "id long, vec array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query string, vec array<double>")
    got = {}
    for r in R.nearest(v, q, 4, metric).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r.id)
    assert got == brute(vectors, queries, 4, metric)


def test_string_ids_and_few_vectors(spark):
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0])], "id string, vec array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query int, vec array<double>")
    assert [(r.rank, r.id) for r in R.nearest(v, q, 5).orderBy("rank").collect()] == [(1, "a"), (2, "b")]


def test_hash_embedding(spark):
    texts = ["", "abc", "é ſ"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.hash_embed(F.col("t")).alias("v"), V.hash_embed(F.col("t"), 40).alias("s")).collect():
        buf = hashlib.sha256(r.t.encode()).digest()
        while len(buf) < 128:
            buf += hashlib.sha256(buf).digest()
        raw = np.frombuffer(buf[:128], dtype="uint8") / 255.0
        assert np.allclose(r.v, raw / (np.linalg.norm(raw) + 1e-12), atol=1e-14)
        assert len(r.s) == 40


def test_vector_expressions(spark):
    row = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0])], "a array<double>, b array<double>").select(
        V.cosine(F.col("a"), F.col("b")).alias("c"), V.squared_l2(F.col("a"), F.col("b")).alias("l")).first()
    assert row.c == pytest.approx(1 / np.sqrt(50)) and row.l == 13


def test_evaluation(spark):
    ranked = spark.createDataFrame([("q", r, i) for r, i in enumerate("abcdefghijk", 1)] + [("p", 1, "z"), ("n", 1, "y")], "query string, rank int, id string")
    truths = spark.createDataFrame([("q", "d"), ("q", "k"), ("p", "z"), ("n", "a")], "query string, id string")
    rows = {r["query"]: (r.hit, r.reciprocal_rank) for r in R.evaluate(ranked, truths).collect()}
    assert rows == {"q": (0.0, 0.25), "p": (1.0, 1.0), "n": (0.0, 0.0)}
    means = R.mean_metrics(R.evaluate(ranked, truths)).first()
    assert (means.hit_at_k, means.mrr, means.queries) == (pytest.approx(1 / 3), pytest.approx(1.25 / 3), 3)


def test_embed_falls_back(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "cc")], "id int, text string")

    def fails(batch):
        raise RuntimeError

    assert {(len(r.vec), r.origin) for r in R.embed_batch(texts, fails).collect()} == {(128, "hash")}
    assert {(len(r.vec), r.origin) for r in R.embed_batch(texts).collect()} == {(128, "hash")}

    def picky(batch):
        if "b" in batch:
            raise RuntimeError
        return [[len(t)] * len(t) for t in batch]

    for parts in (1, 3):  # the same whatever shares a batch with the refused text; other lengths are refused too
        rows = R.embed_batch(texts.repartition(parts), picky, dim=1).collect()
        assert {(r.id, r.origin, len(r.vec)) for r in rows} == {(1, "service", 1), (2, "hash", 1), (3, "hash", 1)}


def test_neighbours_embed_equal_texts_once(spark):
    """Rows pass as they are, nulls and whole numbers beyond 2^53 included; no row carries a vector to Python; scores are those of hash_embed."""
    texts = ["sql injection", None, "", "Éa 東京", "x" * 5000, "sql injection"]
    rows = [(t, i, None if i % 2 else (1 << 53) + i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "t string, i int, n bigint").coalesce(1)
    out = R.kb_neighbours(df, "t", 2)
    assert "sha2" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.i: r for r in out.collect()}
    assert {i: (r.t, r.n) for i, r in got.items()} == {i: (t, n) for t, i, n in rows}
    assert R.kb_neighbours(df.limit(0), "t", 2).collect() == []
    vecs = {r.i: r.vec for r in df.select("i", V.hash_embed(F.col("t")).alias("vec")).collect()}
    kb = R.kb_vectors(spark).collect()
    for i, t in enumerate(texts):
        assert R._hashed(t or "").tolist() == vecs[i]
        norms = [np.linalg.norm(e.vec) * (np.linalg.norm(vecs[i]) + V.EPSILON) + V.EPSILON for e in kb]
        best = sorted((-round(float(np.dot(e.vec, vecs[i]) / n), 9), e.id, e.text) for e, n in zip(kb, norms, strict=True))[:2]
        assert [(-r.score, r.id, r.text) for r in got[i].retrieved] == best
