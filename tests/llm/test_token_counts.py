"""Token counts against the tokenizer itself."""

from __future__ import annotations

import random
import unicodedata

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, pre_tokenizers

from riskloom.llm import token_counts
from riskloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


def expected(texts):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def odd_texts():
    rng = random.Random(7)
    letters = " '\n\t\r\x85\xa0　ab1é.中!<|>stéᲉ\U000105c0"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    return made + ["", None, " ", "  a", "a  b ", "a \n b", "a\n\nb", "it's we'll 'S", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>  ", "a" * 30_000, "ab " * 60_000]


def test_odd_texts(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "a b", 2, "y"), (0, texts[0], 1, "x")], "doc_id long, text string, n_tokens int, pieces string")
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count(docs.repartition(5), PATH).collect() if r.doc_id is not None)
    want = [(i, len((t or "").encode()), n) for i, (t, n) in enumerate(zip(texts, expected(texts), strict=True))]
    assert got == sorted([*want, want[0]])


def test_a_small_table_counts_alike(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = token_counts.frequent(docs, PATH, 50).collect()
    assert len(table) == 1 and 0 < len(table[0].pieces) <= 50 and " the" in table[0].pieces
    rows = {r.doc_id: r for r in docs.collect()}
    wanted = dict(zip(rows, expected([r.text for r in rows.values()]), strict=True))
    assert {r.doc_id: r.n_tokens for r in token_counts.count(docs, PATH, 50).collect()} == wanted
    found = QUERIES["op11_token_counts"](spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in found} == wanted
    assert all(r.over_limit == (r.n_tokens > 1024) and r.n_bytes == len((rows[r.doc_id].text or "").encode()) for r in found)


def test_empty_table(spark):
    assert token_counts.count(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_frequent_items_lose_none_that_is_frequent():
    counts = token_counts.lower({"a": 100, "b": 40, "c": 3, "d": 2, "e": 1}, 2)
    assert list(counts) == ["a", "b"] and counts["a"] > counts["b"] > 0


def test_every_character_is_parted_as_the_library_does():
    parts, library = token_counts.Parts(PATH), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for c in range(1, 0x110000):
        if 0xD800 <= c < 0xE000 or unicodedata.category(chr(c)) == "Cn" or (0x3400 <= c < 0xD7A4 or 0xE000 <= c < 0xF900 or c >= 0x17000) and c % 97:
            continue
        text = f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}a {chr(c)}"
        stretches, order, _ = token_counts.stretches(pa.array([text]))
        found = [p for i in order for p in parts.of(stretches[i])]
        assert found == [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)], hex(c)


@pytest.mark.parametrize("text", ["", " ", "a b"])
def test_stretches_give_the_text_back(text):
    stretches, order, begin = token_counts.stretches(pa.array([text, None, text]))
    assert "".join(stretches[i] for i in order) == text * 2 and begin[0] == 0
