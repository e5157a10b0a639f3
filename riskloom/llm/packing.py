"""Packing by power-of-two pieces: no sequence crosses documents and no sequence is padded.

A document of n tokens becomes n // 4096 pieces of 4096 tokens and then one piece
for each binary digit of the rest, longest first.  Every piece is a sequence of
its own; sequences of equal length form a bucket, from which batches of one
length are drawn (`write` stores a folder per length).

Tokens come from a `tokenizers` file.  Its words do not cross white space, so each
different word of an Arrow batch is looked up once and tokenised when new; the
documents' ids are then gathered by numpy.  A task works on a small slice of a batch
at a time and holds a table of known words, which is emptied when it is full.
Nothing is shuffled, and a lost task is simply run again.

A null text counts as empty; every document ends with the id 2, so an empty one is
one piece of length 1.  Repeated rows each give their pieces.  An empty table
gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm.common import per_worker

CAPACITY, END = 4096, 2
#: A task keeps at most this many known words.
KNOWN_WORDS = 400_000
#: Texts are tokenised in slices of this many bytes (and at most one document more), whatever an Arrow batch holds.
BATCH_BYTES = 2_000_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long"

# Fixed value: the pattern by which the tokenizer parts words, and the bytes that its byte alphabet shows as themselves.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARKS = frozenset(".,;:!?")
SHOWN = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]


class WordIds:
    """Ids of words; equal to what the tokenizer gives for the word as a whole text."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.parts, self.plain = regex.compile(PARTS), re.compile("[!-~¡-ÿ]+")
        hidden = [b for b in range(256) if b not in set(SHOWN)]
        self.alphabet = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.clear()
        same = "L'Été, d'où 3² «Straße» it's ÿ½%%% | naïve... I'LL µ§ {a_b}"
        self.quick = b"".join(map(self._quick, same.split())) == self._encoded(same)

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pieces: dict[str, bytes] = {}  # ids as bytes: no list or number of their own for each
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)

    def _part(self, part: str) -> bytes:
        found = self.pieces.get(part)
        if found is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)
            found = self.pieces[part] = array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
        return found

    def _quick(self, word: str) -> bytes:
        word = word.lower()
        if word.isalpha():
            return self._part(word)
        if word[-1] in MARKS and word[:-1].isalpha():
            return self._part(word[:-1]) + self._part(word[-1])
        return b"".join([self._part(part) for part in self.parts.findall(word)])

    def ids(self, word: str) -> bytes:
        """The ids as bytes, 32 bits each."""
        if self.quick and (
            word.isascii() and (word.isalpha() or word[-1:] in MARKS and word[:-1].isalpha())  # most words, told without a pattern
            or self.plain.fullmatch(word) and not ("<|" in word and any(s in word for s in self.special))
        ):
            return self._quick(word)
        return self._encoded(word)

    def _encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def rows(self, words: list[str]) -> np.ndarray:
        """The row of each word in `begin`; row r of `flat` goes from begin[r] to begin[r + 1]."""
        if len(self.known) + len(words) > KNOWN_WORDS:
            self.clear()
        known, n = self.known, len(self.known)
        rows, new = list(map(known.get, words)), []
        for k in [k for k, row in enumerate(rows) if row is None]:
            rows[k] = known[words[k]] = n + len(new)
            new.append(self.ids(words[k]))
        if new:
            sizes = np.fromiter(map(len, new), np.int64, len(new)) // 4
            used, total = int(self.begin[n]), int(sizes.sum())
            self.flat, self.begin = _room(self.flat, used + total), _room(self.begin, n + len(new) + 1)
            self.flat[used:used + total] = np.frombuffer(b"".join(new), np.uint32)
            self.begin[n + 1:n + 1 + len(new)] = used + np.cumsum(sizes)
        return np.array(rows, np.int64)


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    grown = np.zeros(max(size, 2 * len(array)), array.dtype)
    grown[:len(array)] = array
    return grown


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of `size[0]` places, then those of the next."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def token_ids(texts: pa.Array, words: WordIds, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids, document after document with `end` behind each, and the documents' numbers of ids."""
    texts = texts.cast(pa.large_string()).fill_null("")
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    rows = words.rows(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy(zero_copy_only=False)]
    begin, size = words.begin[rows], words.begin[rows + 1] - words.begin[rows]
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
    ends = np.concatenate([[0], np.cumsum(size)])[offsets]
    counts = np.diff(ends) + 1
    out = np.full(int(counts.sum()), end, np.uint32)
    tokens = words.flat[ragged(begin, size)]
    out[np.arange(len(tokens)) + np.repeat(np.arange(len(counts)), counts - 1)] = tokens
    return out, counts


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows in order, parted where the bytes of their texts pass a multiple of BATCH_BYTES."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begins = [0, *(np.flatnonzero(np.diff(upto // BATCH_BYTES)) + 1).tolist(), batch.num_rows]
    for at, end in zip(begins[:-1], begins[1:], strict=True):
        if at < end:
            yield batch.slice(at, end - at)


def lengths(n: int, capacity: int) -> list[int]:
    """Sizes of a document's pieces, in order: whole capacities, then the binary digits of the rest."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row per piece: doc_id, start, length, ids (little-endian unsigned 32 bit) and the document's number of ids."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = per_worker(f"words of {path}", lambda: WordIds(path))
        for batch in batches:
            for part in slices(batch, 1):
                ids, counts = token_ids(part.column(1), words, end)
                each = [lengths(int(n), capacity) for n in counts]
                size = np.fromiter((x for xs in each for x in xs), np.int64)
                doc = np.repeat(np.arange(len(counts)), [len(xs) for xs in each])
                ends = np.cumsum(size)
                start = ends - size - (np.cumsum(counts) - counts)[doc]
                data = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], 4 * ends])), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()).take(pa.array(doc)), pa.array(start), pa.array(size), data.cast(pa.binary()), pa.array(counts[doc])],
                    ["doc_id", "start", "length", "ids", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(cut, SCHEMA)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces with the number of their sequence; a piece fills its sequence from offset 0."""
    return pieces(docs, path, capacity, end).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write(docs: DataFrame, out: str, path: str, capacity: int = CAPACITY, end: int = END) -> None:
    """Parquet with a folder per length; tasks write their own pieces."""
    pack(docs, path, capacity, end).withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(out)
