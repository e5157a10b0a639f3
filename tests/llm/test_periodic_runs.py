"""Runs against a search of all periods, and the transform against plain sums."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np

from riskloom.llm import periodic_runs
from riskloom.llm.queries import QUERIES


def runs_of(w, shortest=6, exponent=4):
    found = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, exponent * q):
                found.add((i, j + q - i, q))
            i = j + 1
    shorter = lambda i, n, q: any(q % p == 0 and all(w[k] == w[k + p] for k in range(i, i + n - p)) for p in range(1, q))
    return sorted((r for r in found if not shorter(*r)), key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def cases():
    rng = random.Random(3)
    yield from ([], [1], [1] * 5, [1] * 6, [1] * 700, fibonacci(300), fibonacci(150) * 5, [1, 2] * 3, [1, 2] * 4, ([1] * 20 + [2]) * 4, ([1] * 7 + [2]) * 9)
    yield (([1] * 3 + [2]) * 5 + [3]) * 5
    for _ in range(1200):
        w = [rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.7:
            unit = [rng.randint(1, 3) for _ in range(rng.randint(1, 25))]
            at = rng.randint(0, len(w))
            w[at:at] = [unit[i % len(unit)] for i in range(rng.randint(0, 6 * len(unit)))]
        yield w


def test_against_all_periods():
    for w in cases():
        row = np.concatenate([[1000], np.array(w, np.int64), [1001]])
        assert [(s - 1, n, q) for s, n, q in periodic_runs.find(row).tolist()] == runs_of(w), w


def test_many_texts_in_one_row():
    row, want, number = [10_000], [], 10_000
    for w in cases():
        want += [(s + len(row), n, q) for s, n, q in runs_of(w)]
        number += 1
        row += [*w, number]
    assert [tuple(r) for r in periodic_runs.find(np.array(row)).tolist()] == want


def test_transform():
    rng = np.random.default_rng(2)
    for size in (2, 4, 64):
        x = rng.integers(0, periodic_runs.PRIME, (3, size)).astype(np.uint64)
        assert (periodic_runs.transform(periodic_runs.transform(x), inverse=True) == x).all()
    row = rng.integers(0, 3, 400)
    for block in (1, 2, 8, 32):
        starts = np.arange(0, 300, block)
        at, off = periodic_runs.zero_mismatch(row, starts, block)
        want = {(i, d) for i, s in enumerate(starts) for d in range(block) if s + 3 * block <= len(row) and (row[s:s + block] == row[s + block + d:s + 2 * block + d]).all()}
        assert {(i, d) for i, d in zip(at.tolist(), off.tolist(), strict=True) if starts[i] + 3 * block <= len(row)} == want


def test_work_stays_near_the_length():
    """A row of one word, and one whose every block matches at many distances, would take the square otherwise."""
    for body in (np.ones(200_000, np.int64), np.array(([1] * 60 + [2]) * 3000), np.arange(200_000) % 50_000):
        assert len(periodic_runs.find(np.concatenate([[-1], body, [-2]]))) <= 3001


def echoed(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def digest(doc_id, text):
    w = echoed(doc_id, text)
    runs = runs_of(w)
    out = {i for s, n, q in runs for i in range(s + q, s + n)}
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), s, n, q, 1000 * n // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in out)))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "ä é", "\x1cx", "longer"])
    texts = [" ".join(word() for _ in range(rng.randint(0, 90))) + rng.choice(["", "\n", "\t \x0b"]) for _ in range(300)]
    texts += ["", None, " \n ", "a", "a " * 9000, " ".join(f"{i % 2000}" for i in range(9000))]
    rows = [(i - 5, t, "x", None) for i, t in enumerate(texts)] + [(None, "b " * 40, None, 1), (3, texts[8], "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((digest(r[0], r[1]) for r in rows), key=str)


def test_empty_table(spark):
    assert periodic_runs.collapse(spark.createDataFrame([], "doc_id long, text string")).count() == 0
