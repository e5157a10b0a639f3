"""Quality rules, decontamination, sharding, packing and chat formatting."""

from __future__ import annotations

import math
import random
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import digest, hits, quality, without_hits
from checks.compare import TABLES, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm import chat_format, decontaminate, packing, quality_rules, sharding
from riskloom.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, hit string, row int, ws string, slot string, shard double, kept string, `a.b` string"
TEXTS = [
    (0, None, "en"), (1, "", None), (2, "a a a a a a", "xx"), (3, "the cat\nthe cat\n\n the cat ###", "en"), (3, "the cat\nthe cat\n\n the cat ###", "en"),
    (None, "One TWO three four five six seven eight nine ten eleven", "en"), (4, "x " * 400, "de"), (5, "eleven, SHORT item!\n twelve", "fr"), (6, "Éa éa 東京 tokyo", "en"),
    (7, " ".join(f"v{i}" for i in range(9000)), "en"), (7, "short", "en"),
]
ITEMS = [(1, "one two three four five six seven eight nine ten"), (10, "short item"), (2, "two-three four five six seven eight nine ten eleven"), (None, "éa"), (3, None), (4, " .. "), (1, "v10 v11 v12 v13 v14 v15 v16 v17 v18 v19 v20")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, "h", 1, "w", "s", 0.5, "k", "c") for i, t, g in TEXTS], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = db.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_quality(spark, docs):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted((tuple(r) for r in quality_rules.assess(docs).select(*columns).collect()), key=str)
    assert got == sorted(quality(TEXTS), key=str)
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect()) == [TEXTS[9][1]]
    assert quality_rules.assess(docs.limit(0)).collect() == quality_rules.keep(docs.limit(0)).collect() == []


def test_quality_documents(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op10_quality_rules"](spark, SF).collect()) == sorted(quality(rows))


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_decontaminate(spark, docs, broadcast):
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, h string")
    want = hits([t for _, t, _ in TEXTS], ITEMS)
    rows = decontaminate.scan(docs, benchmark, max_broadcast=broadcast).select("row.doc_id", "row.text", "hit.*").collect()
    got = sorted(((r.doc_id, r.text, r.n_words, set(r.places), r["items"]) for r in rows), key=str)
    assert got == sorted(((i, t, n, p, f) for (i, t, _), (n, p, f) in zip(TEXTS, want, strict=True)), key=str)
    cleaned = decontaminate.decontaminate(docs, benchmark)
    assert cleaned.columns == docs.columns
    kept = [(i, without_hits(t, p) if p else t) for (i, t, _), (n, p, _) in zip(TEXTS, want, strict=True) if 2 * len(p) <= n]
    assert sorted(((r.doc_id, r.text) for r in cleaned.collect()), key=str) == sorted(kept, key=str)
    assert decontaminate.scan(docs.limit(0), benchmark).collect() == []
    assert {len(r.hit["places"]) for r in decontaminate.scan(docs, benchmark.limit(0)).collect()} == {0}


def test_native_plans(spark):
    for name in ("op4_decontaminate", "op5_shard_lookup", "op10_quality_rules"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_shards(spark, docs):
    names = [f"s{i}" for i in range(7)]
    owner = sharding.fill(names, slots=1009)
    # A plain walk: in turns, each shard takes its next free slot.
    free, want = set(range(1009)), {}
    walks = [iter([(sharding._number(f"offset {n}") + j * (sharding._number(f"skip {n}") % 1008 + 1)) % 1009 for j in range(1009)]) for n in names]
    while free:
        for k, walk in enumerate(walks):
            slot = next((s for s in walk if s in free), None) if free else None
            if slot is not None:
                free.discard(slot)
                want[slot] = k
    assert owner == [want[s] for s in range(1009)]
    assert max(Counter(owner).values()) - min(Counter(owner).values()) <= 1
    fewer = sharding.fill(names[:-1], slots=1009)
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a < 6)
    assert moved < 0.2 * 1009
    weighted = Counter(sharding.fill(names, [2, 1, 1, 1, 1, 1, 0], 1009))
    assert weighted[6] == 0 and abs(weighted[0] - 2 * weighted[1]) <= 2
    placed = sharding.place(docs, names, slots=1009)
    assert sorted(placed.columns) == sorted(docs.columns) and placed.count() == len(TEXTS)
    assert len({(r.doc_id, r.shard) for r in placed.collect()}) == len({i for i, _, _ in TEXTS})
    assert sharding.place(docs.limit(0), names).collect() == []
    for bad in (["a", "a"], []):
        with pytest.raises(ValueError):
            sharding.fill(bad)
    with pytest.raises(ValueError):
        sharding.fill(names, slots=1000)


def test_shard_files(spark, docs, tmp_path):
    sharding.write(docs, str(tmp_path / "out"), ["a", "b"], slots=101)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(TEXTS)


def check_pieces(rows, texts):
    tokenizer = Tokenizer.from_file(PATH)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts}
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == set(ids)
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    for i, pieces in found.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length <= 4096 and p.length & (p.length - 1) == 0 and p.doc_tokens == len(ids[i])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[i][at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[i])


def test_packing_documents(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_pieces(QUERIES["op6_power_of_two_packing"](spark, SF).collect(), texts)


class Caught:
    """In a DataFrame's place: hands out the function that its worker would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, cut, schema):
        return cut


def test_packing_worker_holds_a_slice():
    """A batch of 24 MB, with one long text and many short ones, costs a worker arrays of a small slice only."""
    texts = ["alpha beta, gamma " * 50_000, None, ""] + [f"alpha beta gamma {i % 7} " * 300 for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    cut = packing.pieces(Caught(), PATH)
    list(cut(iter([batch.slice(1, 5)])))  # loads the tokenizer
    tracemalloc.start()
    seen = Counter()
    for out in cut(iter([batch])):
        for i, n in zip(out.column(0).to_pylist(), out.column(2).to_pylist(), strict=True):
            seen[i] += n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    assert len(seen) == len(texts) and seen[1] == seen[2] == 1 and seen[0] == 200_001 and seen[5] == 1201


def test_packing_awkward(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 50)
    odd = [None, "", "  ", "<|endoftext|> a<|startoftext|>b <|x", "ΑΣ. İstanbul ŐŰ 東京 ́x \x1c\x85 ﬁ ½²³ IT'S don't 's ſ K µ ª ÿ ß ẞ \x00\x7f a\xadb", "tab\tnew\nline\x0b\x0c\r", "word " * 9000, "a" * 5000]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    from pyspark.sql import functions as F
    rows = packing.pack(df, PATH).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_pieces(rows, list(enumerate(odd)))
    assert packing.pack(df.limit(0), PATH).collect() == []
    packing.write(df, str(tmp_path / "out"), PATH)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
    again = packing.pack(df.union(df), PATH).collect()
    assert len(again) == 2 * len(rows) and len({r.sequence_id for r in again}) == len(again)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_words_are_tokenised_as_texts(text):
    known = packing.WordIds(PATH)
    import pyarrow as pa
    ids, counts = packing.token_ids(pa.array([text]), known, 2)
    assert ids.tolist() == [*known.tokenizer.encode(text, add_special_tokens=False).ids, 2] and counts.tolist() == [len(ids)]


def test_known_words_are_held_as_bytes():
    """Words told without a pattern, and all others, give the tokenizer's ids; a kept word has no list and no numbers of its own."""
    known = packing.WordIds(PATH)
    for word in ["", ".", "?!", "Word", "WORD.", "naïve", "naïve;", "a.b", "x1", "it's", "ΑΣ", "东京", "\x00a", "a\x7f", "<|endoftext|>", "µª", "e\u0301"]:
        assert list(memoryview(known.ids(word)).cast("I")) == known.tokenizer.encode(word, add_special_tokens=False).ids
    assert {type(piece) for piece in known.pieces.values()} == {bytes}


@given(st.text("<|\\im_startend>\nab", max_size=30), st.text("<|\\n\nab", max_size=10))
def test_turns_read_back(text, role):
    piece, a, b = chat_format.render(role, text)
    assert chat_format.read(piece) == (role, text) and chat_format.unescape(piece[a:b]) == text
    assert chat_format.START not in piece[1:] and piece.count(chat_format.END) == 1


def test_events_fold(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "start", "assistant", "He"), (1, 1, 3, "delta", None, "o"), (1, 1, 2, "delta", None, "ll"), (1, 2, 9, "message", "user", None),
        (1, 1, 10, "regenerate", None, None), (1, 1, 11, "delta", None, "Bye"), (1, 0, 12, "edit", None, "hi!"), (2, 0, 0, "delta", "assistant", "x"), (None, None, 0, None, None, None),
        (3, 0, 0, "message", "user", "a"), (3, 0, 0, "message", "user", "a"), (4, 5, 0, "odd", "system", "s"),
    ]
    df = spark.createDataFrame([(*x, "extra") for x in log], "conv_id long, turn long, seq long, kind string, role string, text string, piece string")
    rows = chat_format.format_conversations(df).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.place):
        got.setdefault(r.conv_id, []).append((*chat_format.read(r.piece), r.piece[r.loss_start:r.loss_end]))
    assert got == {1: [("user", "hi!", ""), ("assistant", "Bye", "Bye"), ("user", "", "")], 2: [("assistant", "x", "x")], None: [("", "", "")], 3: [("user", "a", "")] * 2, 4: [("system", "s", "")]}
    assert chat_format.digests(chat_format.format_conversations(df.limit(0))).collect() == []


def test_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    text = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", text), (-1, 1, "assistant", text)]
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(r for r in rows if r[0] == conv)
        loss = "".join(t or "" for _, _, role, t in turns if role == "assistant")
        want[conv] = (conv, len(turns), digest("".join(f"{role}\n{t or ''}\n" for _, _, role, t in turns)), len(loss), digest(loss))
    got = {r.conv_id: r for r in QUERIES["op7_chat_events"](spark, SF).collect()}
    assert {c: tuple(r)[:5] for c, r in got.items()} == want
    assert all(r.formatted_chars > r.loss_chars for r in got.values())


def test_quality_distance_sums_each_histogram_once(spark):
    """A total inside a lambda would be taken anew for every class."""
    row = spark.createDataFrame([([1, 2, 3], [3, 2, 1], [0, 0, 0])], "a array<long>, b array<long>, none array<long>")
    distance = quality_rules.js_distance
    found = row.select(distance(F.col("a"), F.col("b")).alias("d"), distance(F.col("a"), F.col("none")).alias("n"), distance(F.col("a"), F.col("a")).alias("z"))
    (got,) = found.collect()
    assert abs(got.d - (2 * (1 / 6 * math.log2(0.5) + 3 / 6 * math.log2(1.5)) / 2) ** 0.5) < 1e-12 and got.n is None and got.z == 0
    plan = row.select(distance(F.col("a"), F.col("b")).alias("d"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") == 3


def test_quality_reference_withstands_junk(spark):
    """Junk with a third of a language's rows, one very long text and a group of copies do not become the reference."""
    rng = random.Random(3)
    common, rare = quality_rules.COMMON["en"], [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    said = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(n)) + "."
    junk = lambda n: " ".join("".join(rng.choice("#*$%&|<>") for _ in range(4)) for _ in range(n))
    clean = [(i, said(rng.randint(100, 300)), "en") for i in range(300)]
    bad = [(1000 + i, junk(rng.randint(100, 300)), "en") for i in range(150)] + [(2000, junk(60_000), "en")]
    copies = [(3000 + i, "one two three four five six seven eight " * 2 + said(80), "en") for i in range(1)] * 150
    got = {r.doc_id: r.kept for r in quality_rules.assess(spark.createDataFrame(clean + bad + copies, "doc_id long, text string, lang string")).collect()}
    assert not any(got[i] for i, *_ in bad)
    assert sum(got[i] for i, *_ in clean) >= 0.98 * len(clean)
