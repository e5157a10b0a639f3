"""Token counts by a two-tier lookup of pre-token lengths; no text and no pre-token is shuffled.

The tokenizer (a `tokenizers` file of the byte-level kind) parts a text into
pre-tokens and gives each its own ids, so a text's count is the sum of its
pre-tokens' lengths.

1. `frequent` reads all texts and keeps, per task, a bounded summary of how often
   pre-tokens occur (frequent items by counters that are lowered together when there
   are too many).  A task gives one packed row; rows are merged in two levels to one
   table of at most `TABLE` pre-tokens with their lengths, which is broadcast.
2. `count` looks pre-tokens up in that table first, then in the worker's own cache,
   and encodes what neither knows.  The table decides speed only, never a count.

A batch of texts is cut at spaces between two characters that are no white space: a
pre-token always begins there.  Each different stretch of a batch is parted once.
Stretches with an added token's string, or with a character that Python's tables do
not know yet, go to the tokenizer as they are; it cuts at added tokens by itself.

A null text is empty and has 0 tokens, as has an empty one.  Texts of any length are
counted whole; a long pre-token is encoded and not kept.  Repeated rows and ids each
give their row; ties do not arise.  An empty table gives an empty result.  Columns
other than `doc_id` and `text` are not looked at, so their names cannot clash.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm.packing import SHOWN

#: Pre-tokens in the broadcast table, in a worker's cache, and the longest one (in characters) that is kept.
TABLE, CACHE, LONGEST = 1 << 16, 1 << 18, 48
#: Summaries are merged in this many groups, and those groups in one task.
GROUPS = 64
BATCH_BYTES = 16_000_000
# Fixed value: the pattern by which byte-level tokenizers part a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STOPS = (".", ",", ";", ":", "!", "?")


def boundaries(data: np.ndarray) -> np.ndarray:
    """Places of the spaces (of UTF-8 `data`) that stand between two characters that are surely no white space."""
    at = np.flatnonzero(data == 32)
    at = at[(at > 0) & (at < len(data) - 1)]
    after, last = data[at + 1], data[at - 1]
    second, third = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    # White space beyond ASCII begins with the bytes C2, E1, E2 or E3.
    begins = (after > 32) & ~np.isin(after, [0xC2, 0xE1, 0xE2, 0xE3])
    two = (second >= 0xC3) & (second <= 0xDF)
    three = (second >= 0x80) & (second < 0xC0) & ((third == 0xE0) | ((third >= 0xE4) & (third <= 0xEF)))
    return at[begins & (((last > 32) & (last < 0x80)) | ((last >= 0x80) & (two | three)))]


def stretches(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different stretches of a batch, the number of each stretch in order, and where each text's stretches begin."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    inside = ends[0] + boundaries(data[ends[0]:ends[-1]])
    cuts = np.sort(np.concatenate([ends, inside]), kind="stable")
    cuts = cuts[np.concatenate([[True], cuts[1:] > cuts[:-1]])]
    parts = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    coded = parts.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(cuts, ends)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about BATCH_BYTES."""
    for batch in batches:
        step = max(1, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


class Parts:
    """Pre-tokens of a stretch, or None if only the tokenizer can part it."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.find = regex.compile(PATTERN).findall
        hidden = [b for b in range(256) if b not in set(SHOWN)]
        self.alphabet = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def of(self, stretch: str) -> list[str] | tuple[str, ...] | None:
        word = stretch[1:] if stretch[:1] == " " else stretch
        if word.isalpha():  # letters as the pattern has them, but for those that Python does not know yet
            return (stretch,)
        if word[-1:] in STOPS and word[:-1].isalpha():
            return stretch[:-1], word[-1]
        if "<" in stretch and any(a in stretch for a in self.added):
            return None
        if not stretch.isascii() and "Cn" in map(unicodedata.category, set(stretch)):
            return None
        return self.find(stretch)

    def piece(self, piece: str) -> int:
        """The tokens of one pre-token: the merges of its bytes, each shown as a letter of the byte alphabet."""
        return len(self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet)))

    def text(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


class Lengths(dict):
    """The broadcast table as a hash table; a key that it lacks is sought in the cache and encoded at last."""

    def __init__(self, parts: Parts, pieces: list[str], lengths: list[int]):
        super().__init__(zip(pieces, lengths, strict=True))
        self.parts, self.cache = parts, {}

    def __missing__(self, piece: str) -> int:
        found = self.cache.get(piece)
        if found is None:
            found = self.parts.piece(piece)
            if len(piece) <= LONGEST:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[piece] = found
        return found

    def stretch(self, text: str) -> int:
        pieces = self.parts.of(text)
        return self.parts.text(text) if pieces is None else sum(map(self.__getitem__, pieces))


def lower(counts: dict[str, int], size: int) -> dict[str, int]:
    """At most `size` counters: all are lowered by the first one that finds no room."""
    if len(counts) <= size:
        return counts
    rest = np.partition(np.fromiter(counts.values(), np.int64, len(counts)), len(counts) - size - 1)[len(counts) - size - 1]
    return {piece: int(n - rest) for piece, n in counts.items() if n > rest}


def frequent(docs: DataFrame, path: str, size: int = TABLE) -> DataFrame:
    """One row: pieces array<string>, lengths array<int>; at most `size` pre-tokens that are frequent in all texts."""
    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, counts = Parts(path), {}
        for batch in slices(batches):
            texts, order, _ = stretches(batch.column(0))
            new = Counter()
            for text, n in zip(texts, np.bincount(order, minlength=len(texts)).tolist(), strict=True):
                for piece in parts.of(text) or ():
                    if len(piece) <= LONGEST:
                        new[piece] += n
            for piece, n in counts.items():
                new[piece] += n
            counts = lower(new, 2 * size)
        if counts:
            yield packed(counts)

    def packed(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))], ["pieces", "counts"])

    def merged(batches: Iterator[pa.RecordBatch]) -> dict[str, int]:
        counts = {}
        for batch in batches:
            for row in batch.to_pylist():
                new = Counter(dict(zip(row["pieces"], row["counts"], strict=True)))
                new.update(counts)
                counts = lower(new, 2 * size)
        return counts

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if counts := merged(batches):
            yield packed(counts)

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(path)
        pieces = sorted(lower(merged(batches), size))
        yield pa.RecordBatch.from_arrays([pa.array([pieces], pa.list_(pa.string())), pa.array([[parts.piece(p) for p in pieces]], pa.list_(pa.int32()))], ["pieces", "lengths"])

    schema = "pieces array<string>, counts array<long>"
    one = docs.select("text").mapInArrow(summary, schema).withColumn("slot", F.spark_partition_id() % GROUPS)
    two = one.repartition(GROUPS, "slot").select("pieces", "counts").mapInArrow(merge, schema)
    return two.repartition(1).mapInArrow(table, "pieces array<string>, lengths array<int>")


def count(docs: DataFrame, path: str, size: int = TABLE) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; the table of frequent pre-tokens has at most `size` rows of LONGEST characters."""
    row = frequent(docs, path, size).collect()[0]
    tier = docs.sparkSession.sparkContext.broadcast((list(row.pieces), np.array(row.lengths, np.uint8 if max(row.lengths, default=0) < 256 else np.int32)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, sizes = tier.value
        known = Lengths(Parts(path), pieces, sizes.tolist())
        for batch in slices(batches):
            texts, order, begin = stretches(batch.column(1))
            each = np.fromiter(map(known.stretch, texts), np.int64, len(texts))
            upto = np.concatenate([[0], np.cumsum(each[order])])[begin]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(np.diff(upto))], ["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    return docs.select("doc_id", "text", n_bytes).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
