"""Substring, suffix-array and SimHash dedup against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from brute import covered, digest, fingerprint, groups, words
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import repeats, simhash, substring_dedup, suffix_dedup
from riskloom.llm.queries import QUERIES
from riskloom.llm.suffix_array import suffix_array

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_words string, key int, missing string, carried string, component_id string"


def rows_of(texts):
    return [(i, t, "x", 1, "y", None, "z") for i, t in texts]


@pytest.fixture(scope="module")
def awkward(spark):
    """Copies within and between texts, borders of texts, nulls, ties, very long periods, clashing columns."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}é" for i in range(300)]
    some = lambda n: " ".join(rng.choice(vocabulary, n))
    passage, other = some(140), some(60)
    texts = [
        (0, None), (1, ""), (2, " \t\n "), (3, some(100) + " " + passage + " " + some(50)), (4, passage + "\n" + some(20)), (5, some(7) + "\x0b" + passage),
        (6, other), (6, other), (6, some(90)), (None, some(80)), (None, some(80)), (7, "ab " * 3000), (8, "ab " * 40), (9, some(30) + " " + some(30)),
        (10, passage[:500] + "!" + passage[500:]), (11, some(34)), (12, some(35)), (13, "x" * 1200), (14, passage[200:640]), (15, passage[199:700] + other),
    ]
    return texts, spark.createDataFrame(rows_of(texts), DOCS)


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def expected_words(texts):
    rows = [words(t) for _, t in texts]
    gone = covered(rows, 35)
    return sorted(((i, len(r), int(g.sum()), digest(" ".join(w for w, x in zip(r, g, strict=True) if not x))) for (i, _), r, g in zip(texts, rows, gone, strict=True)), key=str)


def expected_bytes(texts):
    rows = [(t or "").encode() for _, t in texts]
    gone = covered(rows, 400)
    spans = [int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()) for g in gone]
    return sorted(((i, len(r), int(g.sum()), s, digest(np.frombuffer(r, np.uint8)[~g].tobytes())) for (i, _), r, g, s in zip(texts, rows, gone, spans, strict=True)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot", [False, True])
def test_awkward(spark, awkward, hot, monkeypatch):
    texts, df = awkward
    if hot:  # every core counts as hot, so windows go one by one
        sketch = repeats.count_sketch

        def all_hot(docs, keys_of):
            made = sketch(docs, keys_of)
            keys = {int(k) for b in docs.toArrow().to_batches() for key, _ in keys_of(b) for k in key}
            made.hot = np.sort(np.array(sorted(keys), np.uint64))
            return made

        monkeypatch.setattr(repeats, "count_sketch", all_hot)
    got = [(r[0], r[1], r[2], digest(r[3])) for r in substring_dedup.deduplicate(df).collect()]
    assert sorted(got, key=str) == expected_words(texts)
    got = [(r[0], r[1], r[2], r[3], digest(bytes(r[4]))) for r in suffix_dedup.deduplicate(df).collect()]
    assert sorted(got, key=str) == expected_bytes(texts)


def test_clean_keeps_columns(awkward):
    texts, df = awkward
    cleaned = suffix_dedup.clean(df)
    assert cleaned.columns == df.columns
    gone = covered([(t or "").encode() for _, t in texts], 400)
    want = [(i, np.frombuffer((t or "").encode(), np.uint8)[~g].tobytes().decode("utf-8", "ignore"), "x", 1, "y", None, "z") for (i, t), g in zip(texts, gone, strict=True)]
    assert found(cleaned) == sorted(want, key=str)


def test_documents(spark):
    texts = documents(spark)
    assert found(QUERIES["op1_substring_dedup"](spark, SF)) == expected_words(texts)
    assert found(QUERIES["op2_suffix_array_dedup"](spark, SF)) == expected_bytes(texts)


def test_simhash_documents(spark):
    texts = documents(spark)
    prints = [fingerprint(t) for _, t in texts]
    first = groups(prints)
    ids = [min(texts[k][0] for k in range(len(texts)) if first[k] == first[j]) for j in range(len(texts))]
    want = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(texts, prints, ids, strict=True)), key=str)
    assert found(QUERIES["op3_simhash"](spark, SF)) == want


def test_simhash_awkward(spark, awkward):
    texts, df = awkward
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(texts)
    assert {r.component_id for r in got if r.fp == 0} == {0}
    assert {r.doc_id: r.fp & (2**64 - 1) for r in got if r.doc_id not in (6, None)} == {i: fingerprint(t) for i, t in texts if i not in (6, None)}
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert kept.count() == len({r.root for r in got}) == 16


@pytest.mark.parametrize("share", [100_000, 7])
def test_links_join_all_near_pairs(spark, share):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64) * np.uint64(2)
    values = {int(c) for c in centres}
    for c in centres:
        for _ in range(25):
            values.add(int(c) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    values |= {int(v) for v in rng.integers(0, 2**63, 100, dtype=np.uint64)} | {0, 2**64 - 1, 2**64 - 2, 1}
    values = sorted(values)
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    stars = {r.node: r.root for r in simhash.components(simhash.links(df, 2, share)).collect()}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    order = sorted(range(len(values)), key=lambda k: signed[k])
    first = groups([values[k] for k in order])
    assert {signed[order[k]]: signed[order[f]] for k, f in enumerate(first)} == {s: stars.get(s, s) for s in signed}


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert substring_dedup.deduplicate(none).collect() == suffix_dedup.deduplicate(none).collect() == suffix_dedup.clean(none).collect() == []
    assert simhash.near_duplicates(none).collect() == simhash.deduplicate(none).collect() == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(symbols):
    assert suffix_array(np.array(symbols, np.int64)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_suffix_array_of_regular_texts():
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    for symbols in (a, b, [1] * 300, list(range(300)), list(range(300, 0, -1)), [2, 1] * 150, b + [5] + b):
        assert suffix_array(np.array(symbols)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_hot_windows_carry_no_flank(spark, monkeypatch):
    """Copies of one text make its cores hot; the rows of their windows must not each hold what surrounds the core."""
    text = " ".join(f"word{i}" for i in range(130))
    df = spark.createDataFrame([(i, text) for i in range(1100)], "doc_id long, text string")
    sent, unrepeated = [], repeats.unrepeated

    def seen(contexts, solve):
        sent.append([tuple(r) for r in contexts.selectExpr("bit >= 0", "length(flank)").distinct().collect()])
        return unrepeated(contexts, solve)

    monkeypatch.setattr(repeats, "unrepeated", seen)
    assert {(r[1], r[2], r[3]) for r in suffix_dedup.deduplicate(df).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()} == {(len(text), len(text), 1)}
    assert {(r[0], r[1]) for r in substring_dedup.deduplicate(df).select("n_words", "n_removed").collect()} == {(130, 130)}
    assert sent == [[(True, 0)], [(True, 0)]]


def test_held_contexts_are_bounded(monkeypatch):
    monkeypatch.setattr(repeats, "HELD_ROWS", 10)
    monkeypatch.setattr(repeats, "SENT_ROWS", 4)
    held, out = repeats.Held(8), []
    for size in (3, 0, 9, 25):
        number = np.arange(size) % 6
        rows = {c: number.astype(np.uint64) for c in ("key", "key2", "context")} | {c: number for c in ("doc_id", "text_key", "at", "bit")} | {"null": number == 5}
        out += held.add(rows, np.repeat(number.astype(np.uint8), 8).reshape(-1, 8))
        assert held.rows <= 10
    out += held.sent()
    rows = [r for b in out for r in b.to_pylist()]
    assert max(b.num_rows for b in out) == 4 and sum(r["n"] for r in rows) == 37
    assert all(r["flank"] == bytes([r["key"]] * 8) and r["doc_id"] == (None if r["key"] == 5 else r["key"]) for r in rows)


def test_cores_are_solved_in_parts():
    bucket = np.repeat(np.arange(7), [2, 2, 9, 1, 1, 1, 3])
    assert list(suffix_dedup._whole_buckets(bucket, 4)) == [(0, 4), (4, 13), (13, 16), (16, 19)]
    assert list(suffix_dedup._whole_buckets(bucket[:0], 4)) == []
