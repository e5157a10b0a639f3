"""Suffix-array dedup: removes bytes covered by a string of `length` bytes that starts at two or more places.

See `repeats` for how candidates are found: anchors whose core of 273 bytes occurs
twice or more, with the 127 bytes on either side.  Contexts that are equal as a
whole are one entry with a count.  All contexts of a core meet in a task, which
builds one suffix array (by linear grouping, see `suffix_array`) over them, read to
the right of the core and, backwards, to its left, in blocks of bytes.  Neighbours in
it give the longest common extensions to both sides; a context repeats a string
of `length` bytes if some other context shares enough to the right and the left
together.  Joining neighbours from the longest right extension down, smaller sets
into larger, finds the widest such string of every context without comparing pairs.

Texts are UTF-8 bytes; null counts as empty; shorter texts lose nothing.  Repeated
rows are copies of each other.  An empty table gives an empty result.  Only doc_id
and text are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.llm import repeats
from riskloom.llm.repeats import Anchors, Windows
from riskloom.llm.substring_dedup import text_bytes
from riskloom.llm.suffix_array import suffix_array

LENGTH = 400
BLOCK = 32  # bytes of a symbol of the suffix array
SIDE = 128  # bytes kept of either side of a core; one more than the span reaches
NO_BYTE = 0xFF  # never part of UTF-8
SOLVED = 16_384  # contexts that share a suffix array, unless one core has more


def windows_of(length: int) -> Windows:
    return Windows(length, min(16, length), min(SIDE, length - min(16, length) + 1))


def _scan(texts: pa.Array, w: Windows) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Anchors]]:
    data, offsets = text_bytes(texts)
    for a, b in repeats.chunks(np.diff(offsets)):
        units, sizes = data[offsets[a]:offsets[b]], np.diff(offsets[a:b + 1])
        yield a, b, units, sizes, repeats.anchors(units.astype(np.uint64) + np.uint64(1), sizes, w)


def _flanks(found: Anchors, pick: np.ndarray, units: np.ndarray, w: Windows) -> np.ndarray:
    """Bytes to the right of the core, then those to the left of the anchor read backwards; NO_BYTE beyond."""
    at, n = found.at[pick][:, None], len(units) - 1
    step = np.arange(SIDE)
    right = np.where(at + w.core + step < found.last[pick][:, None] + w.length, units[np.minimum(at + w.core + step, n)], np.uint8(NO_BYTE))
    left = np.where(at - 1 - step >= found.first[pick][:, None], units[np.maximum(at - 1 - step, 0)], np.uint8(NO_BYTE))
    return np.ascontiguousarray(np.concatenate([right, left], axis=1))


def _block_ranks(sides: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of BLOCK-byte blocks that order as the blocks do."""
    words = np.ascontiguousarray(sides).reshape(-1, BLOCK).view(">u8")
    order = np.lexsort(words.T[::-1])
    ordered = words[order]
    new = np.concatenate([[0], (ordered[1:] != ordered[:-1]).any(axis=1).cumsum()])
    ranks = np.empty(len(words), np.int64)
    ranks[order] = new
    return ranks.reshape(len(sides), -1), int(new[-1]) + 1


def _shared(sides: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the next one in `order`."""
    differ = sides[order[:-1]] != sides[order[1:]]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), sides.shape[1])


class Extents:
    """Of each context: the widest stretch left and right of the anchor that is part of a repeated string."""

    def __init__(self, right: np.ndarray, left: np.ndarray, bucket: np.ndarray, w: Windows):
        self.w, n = w, len(bucket)
        self.left_size = (left != NO_BYTE).sum(axis=1)
        self.right_size = (right != NO_BYTE).sum(axis=1)
        self.l, self.r = np.full(n, -1), np.full(n, -1)
        ranks, many = _block_ranks(np.concatenate([right, left]))
        blocks = ranks.shape[1]
        text = np.concatenate([many + 2 * bucket[:, None], ranks[:n], many + 2 * bucket[:, None] + 1, ranks[n:]], axis=1)
        suffixes = suffix_array(text.ravel())
        kind = suffixes % (2 * blocks + 2)
        by_right = suffixes[kind == 0] // (2 * blocks + 2)
        by_left = suffixes[kind == blocks + 1] // (2 * blocks + 2)
        shared_right = _shared(right, by_right)
        left_rank = np.empty(n, np.int64)
        left_rank[by_left] = np.arange(n)
        sizes = np.bincount(bucket)[bucket[by_right]]
        self._pairs(by_right, shared_right, sizes, left)
        edges = np.flatnonzero(np.concatenate([[True], bucket[by_right][1:] != bucket[by_right][:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 2:
                self._bucket(by_right[a:b].tolist(), shared_right[a:b - 1], left_rank, by_left, left)

    def _pairs(self, order: np.ndarray, shared: np.ndarray, sizes: np.ndarray, left: np.ndarray) -> None:
        """Buckets of two contexts, all at once."""
        at = np.flatnonzero(sizes == 2)[::2]
        if not len(at):
            return
        x, y = order[at], order[at + 1]
        differ = left[x] != left[y]
        l = np.where(differ.any(axis=1), differ.argmax(axis=1), left.shape[1])
        l = np.minimum(l, np.minimum(self.left_size[x], self.left_size[y]))
        r = self.w.core + np.minimum(shared[at], np.minimum(self.right_size[x], self.right_size[y]))
        good = l + r >= self.w.length
        for side in (x, y):
            self.l[side[good]], self.r[side[good]] = l[good], r[good]

    def _bucket(self, order: list[int], shared: np.ndarray, left_rank: np.ndarray, by_left: np.ndarray, left: np.ndarray) -> None:
        number = {x: int.from_bytes(left[x].tobytes(), "big") for x in order}
        rank = {x: int(left_rank[x]) for x in order}
        bits, core, length = 8 * SIDE, self.w.core, self.w.length
        left_size, right_size = self.left_size, self.right_size
        sets = [[rank[x]] for x in order]  # of each group, at its first place, the ranks from the left
        group = list(range(len(order)))

        def root(i: int) -> int:
            while group[i] != i:
                group[i] = i = group[group[i]]
            return i

        for i in np.argsort(-shared, kind="stable").tolist():
            depth = int(shared[i])
            a, b = root(i), root(i + 1)
            few, many = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
            for at in few:
                place = bisect_left(many, at)
                x = int(by_left[at])
                for neighbour in many[max(0, place - 1):place + 1]:
                    y = int(by_left[neighbour])
                    l = min((bits - (number[x] ^ number[y]).bit_length()) >> 3, left_size[x], left_size[y])
                    r = core + min(depth, right_size[x], right_size[y])
                    if l + r >= length:
                        for z in (x, y):
                            self.l[z], self.r[z] = max(self.l[z], l), max(self.r[z], r)
                many.insert(place, at)
            group[b] = a
            sets[a] = many


def _whole_buckets(bucket: np.ndarray, most: int = SOLVED) -> Iterator[tuple[int, int]]:
    """Stretches of sorted `bucket` with whole buckets, of `most` rows or one bucket."""
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    at = 0
    while at < len(edges) - 1:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + most, "right")) - 1)
        yield int(edges[at]), int(edges[to])
        at = to


def _solver(w: Windows):
    def solve(part: pa.Table) -> Iterator[pa.RecordBatch]:
        same, copies = repeats.copies_of(part)
        bit = part.column("bit").to_numpy()
        missing = np.zeros((part.num_rows, w.span), bool)
        lone = copies < 2
        alone = np.flatnonzero(lone & (bit >= 0))  # a window of a hot core: its context is itself
        missing[alone, bit[alone]] = True
        usual = np.flatnonzero(bit < 0)
        if len(usual):
            one = usual[np.unique(same[usual], return_index=True)[1]]  # a row of each different context
            key = part.column("key").to_numpy().view(np.uint64) ^ repeats.mix(part.column("key2").to_numpy().view(np.uint64))
            _, bucket, many = np.unique(key[one], return_inverse=True, return_counts=True)
            missing[one[lone[one]]] = True
            # Only cores with several contexts, one of them at a single place, have something to compare.
            open_cores = (many > 1) & (np.bincount(bucket, weights=lone[one]) > 0)
            pick = np.flatnonzero(open_cores[bucket])
            pick = pick[np.argsort(bucket[pick], kind="stable")]
            for a, b in _whole_buckets(bucket[pick]):
                rows = one[pick[a:b]]
                flanks = repeats.flank_rows(part.take(pa.array(rows)))
                _, own = np.unique(bucket[pick[a:b]], return_inverse=True)
                found = Extents(flanks[:, :SIDE], flanks[:, SIDE:], own, w)
                good = np.flatnonzero((found.l >= 0) & lone[rows])
                missing[rows[good], found.l[good]] = False
                missing[rows[good], w.length - found.r[good]] = False
        out = np.flatnonzero(lone & missing.any(axis=1))
        if len(out):
            yield repeats.missing_batch(part, missing, out)

    return solve


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """A row per row of `docs`: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the kept bytes."""
    return _applied(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length)


def clean(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs`, same columns, with the kept text. Bytes of a character that was cut apart go with it."""
    others = [c for c in docs.columns if c != "text"]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("carried"))
    names = {c: F.col(f"carried.c{i}") for i, c in enumerate(others)}
    return _applied(own, length).select(*[F.col("whole") if c == "text" else names[c] for c in docs.columns]).toDF(*docs.columns)


def _applied(docs: DataFrame, length: int) -> DataFrame:
    carry = "carried" in docs.columns
    w = windows_of(length)
    width = (w.span + 7) // 8

    def keys_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for *_, found in _scan(batch.column(0), w):
            yield found.key, found.key2

    sketch = repeats.count_sketch(docs.select("text"), keys_of)
    found = repeats.contexts(docs, sketch, w, lambda texts: _scan(texts, w), lambda found, pick, units: _flanks(found, pick, units, w))
    rows = repeats.unrepeated(found, _solver(w))
    held = docs.sparkSession.sparkContext.broadcast((sketch.bits, sketch.hot))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = repeats.Sketch(*held.value)
        for batch in batches:
            for a, b, units, sizes, found in _scan(batch.column(1), w):
                base = np.cumsum(sizes) - sizes
                keep = sketch.repeated(found.key, found.key2)
                gone = repeats.coverage(found, keep, w, len(units), *repeats.missing_rows(batch.column(2).slice(a, b - a), base, width))
                first = np.zeros(len(units) + 1, bool)
                first[base] = True
                starts = gone & (first[:-1] | ~np.concatenate([[False], gone[:-1]]))[:len(units)]
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([base, [len(units)]])])  # noqa: B023, E731
                removed, spans = sums(gone), sums(starts)
                ends = np.concatenate([[0], np.cumsum(sizes - removed)]).astype(np.int32)
                kept = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(units[~gone]))])
                if carry:
                    whole = pa.array([k.decode("utf-8", "ignore") for k in kept.to_pylist()], pa.string())
                    yield pa.RecordBatch.from_arrays([whole, batch.column(3).slice(a, b - a)], ["whole", "carried"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(removed), pa.array(spans), kept],
                                                     ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = StructType().add("whole", "string").add("carried", docs.schema["carried"].dataType) if carry else "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return repeats.with_unrepeated(docs, rows).mapInArrow(apply, schema)
