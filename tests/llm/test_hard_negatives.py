"""Hard negatives against all inner products."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import hard_negatives
from riskloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def expected(rows, every=50):
    """rows: (vec_id, embedding, label) with the labels as they count."""
    good = [(i, [math.floor(256 * x) for x in v], lb) for i, v, lb in rows if i is not None and lb is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (anchor, v, label) in enumerate(good):
        if anchor % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, u, strict=True)), i, lb) for b, (i, u, lb) in enumerate(good) if b != a and len(u) == len(v)]
        for ps, pid in sorted((s, i) for s, i, lb in scored if lb == label)[:5]:
            near = sorted((s, i) for s, i, lb in scored if lb != label and 50 * -ps <= 100 * -s <= 95 * -ps)[:3]
            out += [(anchor, pid, k + 1, i, -ps, -s) for k, (s, i) in enumerate(near)]
    return sorted(out)


def relabelled(i, label):
    return label if i is None or label is None or i % 7 else (label + 1) % 10


def mined(spark, path):
    return sorted(tuple(r) for r in QUERIES["op13_hard_negatives"](spark, str(path)).collect())


def test_given_table(spark):
    rows = [(r.vec_id, r.embedding, relabelled(r.vec_id, r.label)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert mined(spark, SF) == expected(rows)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)], rng.choice([0, 0, 0, 1, 2])) for i in range(-60, 600)]
    rows += [(601, None, 1), (602, [0.5, None, 0.1, 0.2], 1), (603, [0.5, math.nan, 0.1, 0.2], 1), (604, [math.inf, 0.5, 0.1, 0.2], 1), (605, [0.5] * 4, None), (None, [0.5] * 4, 1)]
    rows += [(650, [0.1, 0.2], 0), (651, [0.3, 0.2], 0), (652, [0.2, 0.1], 1), (700, [], 1), (701, [], 1), (702, [], 2), (750, [1e10, 1.0, 1.0, 0.0], 1), (751, [2e10, 1.0, 0.5, 0.0], 1)]
    rows += [(100, rows[160][1], rows[160][2])]  # a repeated anchor
    spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, score int, col string").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = mined(spark, tmp_path), expected([(i, v, relabelled(i, lb)) for i, v, lb in rows])
    small = lambda found: [r for r in found if max(abs(r[4]), abs(r[5])) < 1 << 62]
    assert small(got) == small(want) and len(small(want)) > 100


def test_skew_and_copies(spark):
    """A label with most rows, a vector with a third of them, several trees and cells."""
    rng = np.random.default_rng(5)
    rows = [(i, ([0.5] * 8 if i % 3 == 0 else [float(x) for x in rng.normal(size=8)]), 0 if i % 4 else int(rng.integers(1, 5))) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert hard_negatives.index(hard_negatives.prepared(df, F.col("label")), 6000).count() > 5
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 500 == 0, F.col("label")).collect())
    v, ids, label = np.floor(256 * np.array([r[1] for r in rows])), np.arange(6000), np.array([r[2] for r in rows])
    want = []
    for a in range(0, 6000, 500):
        s = v @ v[a]
        order = np.lexsort((ids, -s))
        for p in [j for j in order if label[j] == label[a] and j != a][:5]:
            near = [j for j in order if label[j] != label[a] and 50 * s[p] <= 100 * s[j] <= 95 * s[p]][:3]
            want += [(a, int(p), k + 1, int(j), int(s[p]), int(s[j])) for k, j in enumerate(near)]
    assert got == sorted(want)


def test_cover_tree():
    x = np.floor(40 * np.random.default_rng(0).normal(size=(300, 5)))
    x[50:90] = x[49]
    centre, radius, first, number, fresh = hard_negatives.cover_tree(x)
    assert sorted(centre[fresh]) == list(range(300))  # every row once
    norms = (x * x).sum(axis=1)
    points = np.column_stack([x, np.sqrt(norms.max() - norms)])

    def below(node):
        return {int(centre[node])}.union(*(below(k) for k in range(first[node], first[node] + number[node])))

    for node in range(len(centre)):
        away = np.sqrt(((points[sorted(below(node))] - points[centre[node]]) ** 2).sum(axis=1))
        assert away.max() <= radius[node] + 1e-6
        kids = centre[first[node]:first[node] + number[node]]
        if len(kids) > 1 and radius[node] > 0:  # centres of a level lie apart
            gaps = np.sqrt(((points[kids][:, None] - points[kids][None]) ** 2).sum(axis=2)) + 1e9 * np.eye(len(kids))
            assert gaps.min() > radius[node] / hard_negatives.SHRINK - 1e-6


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(empty, F.col("vec_id") % 50 == 0, F.col("label")).count() == 0
