"""Helpers to find windows of a fixed length that start at two or more places of a corpus.

A text is a row of 64-bit numbers (word hashes or bytes).  The window of `length`
units at place s has as its anchor the unit in [s, s + span) whose gram of `gram`
units has the least hash.  Equal windows have anchors at equal places, so only
anchors with equal cores (the `core` units from the anchor, which every window of
the anchor holds) have to be looked at: about two for every `span` units.

1. `count_sketch`: a count-min sketch of the cores, whose cells count to two.
   Partitions make sparse sketches that are merged by slice; the result has a
   fixed size and is broadcast.  An estimate is never below the count, so windows
   whose anchor is estimated to be alone are not repeated and go no further.
2. `candidates`: the context of each other anchor, equal ones of a task in one row.
3. An operator's solver meets all contexts of a core, however many texts they are
   in, and names the windows that are not repeated.
4. `unrepeated`: per text, a row of those, to be joined with the text.

A core with a large share of all anchors is `hot`: its windows are sent one by one,
by their own hash and without what surrounds them, so no task gets all its contexts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut, text_key

P1, P2 = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD1342543DE82EF95)
CHUNK = 1 << 17  # units that are worked on together, unless one text has more
CELL_BITS, SLICE_BITS = 26, 20
HOT_SHARE = 1e-4
HELD_ROWS, SENT_ROWS = 200_000, 16_384  # contexts that a task holds to combine equal ones, and sends at a time
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Windows:
    length: int
    gram: int
    span: int

    @property
    def core(self) -> int:
        return self.length - self.span + 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    found = _POWERS.get(int(base))
    if found is None or len(found) < n:
        size = max(n, 2 * CHUNK)
        found = _POWERS[int(base)] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64))])
    return found[:n]


class Hashes:
    """Hashes of any stretch of a chunk, from prefix sums of a polynomial."""

    def __init__(self, values: np.ndarray, base: np.uint64):
        n = len(values)
        self.back = powers(np.uint64(pow(int(base), -1, 1 << 64)), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(base, n), out=self.sums[1:])

    def of(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.back[start])


def sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[:len(x) - (width - span)], x[width - span:]) if width > span else x


@dataclass
class Anchors:
    """Of a chunk: places, the first and last start of their windows, and the core's two hashes."""

    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    key: np.ndarray
    key2: np.ndarray
    hashes: Hashes


def anchors(values: np.ndarray, sizes: np.ndarray, w: Windows) -> Anchors:
    n = len(values)
    ends = np.cumsum(sizes)
    limit = np.repeat(ends, sizes)  # the end of each unit's text
    one, two = Hashes(values, P1), Hashes(values, P2)
    if n < w.length:
        none = np.empty(0, np.int64)
        return Anchors(none, none, none, none.astype(np.uint64), none.astype(np.uint64), one)
    start = np.arange(n - w.gram + 1)
    gram = one.of(start, w.gram) | np.uint64(1)
    gram = np.where(gram == MOST, MOST - np.uint64(2), gram)
    least = sliding(gram, w.span, np.minimum)[:n - w.length + 1]
    whole = start[:len(least)] + w.length <= limit[:len(least)]
    least = np.where(whole, least, np.uint64(0))
    edge = np.zeros(w.span - 1, np.uint64)
    most = sliding(np.concatenate([edge, least, np.zeros(len(gram) - len(least), np.uint64)]), w.span, np.maximum)
    at = np.flatnonzero(most == gram[:len(most)])
    begin = limit[at] - np.repeat(sizes, sizes)[at]
    first, last = np.maximum(begin, at - w.span + 1), np.minimum(at, limit[at] - w.length)
    return Anchors(at, first, last, one.of(at, w.core), two.of(at, w.core), one)


def chunks(sizes: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts with at most `most` units together; a longer text is a run of its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


# --- 1. the sketch

def cells_of(key: np.ndarray, key2: np.ndarray) -> np.ndarray:
    """Cell numbers in two rows of 2^CELL_BITS cells."""
    low = np.uint64((1 << CELL_BITS) - 1)
    return np.concatenate([key & low, (key2 & low) + np.uint64(1 << CELL_BITS)]).astype(np.uint32)


class Sketch:
    """The merged sketch: a bit for each cell that counted two or more, and the hot keys."""

    def __init__(self, bits: np.ndarray, hot: np.ndarray):
        self.bits, self.hot = bits, hot

    def repeated(self, key: np.ndarray, key2: np.ndarray) -> np.ndarray:
        cells = cells_of(key, key2)
        found = (self.bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1
        return found[:len(key)] & found[len(key):]


def count_sketch(docs: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], flush: int = 2_000_000) -> Sketch:
    """`docs` are the columns that `keys_of` expects; it yields pairs of key arrays."""
    def piece(keys: list) -> Iterator[pa.RecordBatch]:
        key, key2 = (np.concatenate(x) for x in zip(*keys, strict=True))
        cells, counts = np.unique(cells_of(key, key2), return_counts=True)
        at = np.flatnonzero(np.diff(cells >> SLICE_BITS)) + 1
        for a, b in zip([0, *at], [*at, len(cells)], strict=True):
            local = cells[a:b] & np.uint32((1 << SLICE_BITS) - 1)
            yield pa.RecordBatch.from_pydict({"slice": [int(cells[a] >> SLICE_BITS)], "once": [local.tobytes()], "twice": [local[counts[a:b] > 1].tobytes()], "n": [0]})
        uniq, counts = np.unique(key, return_counts=True)
        often = counts >= max(2, HOT_SHARE * len(key))
        yield pa.RecordBatch.from_pydict({"slice": [-1], "once": [uniq[often].tobytes()], "twice": [counts[often].astype(np.int64).tobytes()], "n": [len(key)]})

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for key, key2 in keys_of(batch):
                held.append((key, key2))
                n += len(key)
            if n >= flush:
                yield from piece(held)
                held, n = [], 0
        if n:
            yield from piece(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None
        for batch in batches:
            for number, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if number != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pydict({"slice": [at], "bits": [np.packbits(twice, bitorder="little").tobytes()]})
                    at, once, twice = number, np.zeros(1 << SLICE_BITS, bool), np.zeros(1 << SLICE_BITS, bool)
                cells = np.frombuffer(a, np.uint32)
                twice[cells[once[cells]]] = True
                once[cells] = True
                twice[np.frombuffer(b, np.uint32)] = True
        if at is not None:
            yield pa.RecordBatch.from_pydict({"slice": [at], "bits": [np.packbits(twice, bitorder="little").tobytes()]})

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.int64))], ["key", "n"])

    pieces = cut(docs.mapInArrow(sparse, "slice long, once binary, twice binary, n long"))
    bits = np.zeros((2 << CELL_BITS) // 8, np.uint8)
    size = (1 << SLICE_BITS) // 8
    merged = pieces.where("slice >= 0").repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice long, bits binary")
    for row in merged.toLocalIterator():  # 2^(CELL_BITS + 1) bits in all, whatever the input
        bits[row["slice"] * size:(row["slice"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    total = pieces.agg(F.sum("n")).first()[0] or 0
    hot = (
        pieces.where("slice < 0").select("once", "twice").mapInArrow(often, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= max(1000, 2 * HOT_SHARE * total)).select("key").collect()  # at most 1 / (2 HOT_SHARE)
    )
    return Sketch(bits, np.sort(np.array([r["key"] for r in hot], np.int64).view(np.uint64)))


# --- 2. contexts of candidate anchors

CONTEXTS = "key long, key2 long, context long, flank binary, n long, doc_id long, text_key long, at int, bit int"


class Held:
    """Contexts of a task, at most HELD_ROWS at a time. `width`: bytes of a flank; 0 if the rows have none."""

    def __init__(self, width: int):
        self.width, self.rows, self.parts = width, 0, []
        self.flanks = np.empty((HELD_ROWS, width), np.uint8)  # memory is taken up as rows come

    def add(self, rows: dict[str, np.ndarray], flanks: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(rows["key"]), HELD_ROWS):
            part = {c: x[a:a + HELD_ROWS] for c, x in rows.items()}
            size = len(part["key"])
            if self.rows + size > HELD_ROWS:
                yield from self.sent()
            self.flanks[self.rows:self.rows + size] = flanks[a:a + size]
            self.rows += size
            self.parts.append(part)

    def sent(self) -> Iterator[pa.RecordBatch]:
        """Equal contexts of one core in one row, with their number and one of their places."""
        if not self.rows:
            return
        rows = {c: np.concatenate([p[c] for p in self.parts]) for c in self.parts[0]}
        self.parts = []
        _, first, counts = np.unique(rows["key"] ^ mix(rows["context"] + rows["key2"]), return_index=True, return_counts=True)
        for a in range(0, len(first), SENT_ROWS):
            pick = first[a:a + SENT_ROWS]
            data = pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(np.arange(len(pick) + 1, dtype=np.int32) * np.int32(self.width)), pa.py_buffer(self.flanks[pick])])
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(rows[c][pick].view(np.int64)) for c in ("key", "key2", "context")], data, pa.array(counts[a:a + SENT_ROWS]),
                 pa.array(rows["doc_id"][pick], mask=rows["null"][pick]), pa.array(rows["text_key"][pick]), pa.array(rows["at"][pick].astype(np.int32)), pa.array(rows["bit"][pick].astype(np.int32))],
                [c.split()[0] for c in CONTEXTS.split(", ")])
        self.rows = 0


def contexts(docs: DataFrame, sketch: Sketch, w: Windows, scan: Callable, flanks_of: Callable) -> DataFrame:
    """The contexts of the anchors that the sketch lets through.

    `scan` gives runs of an Arrow column of texts: first, last, units, their number per text, and anchors.
    `flanks_of(found, pick, units)` gives what surrounds the cores, as rows of bytes (a multiple of 8 each).
    The windows of a hot core go as rows of their own with an empty flank: `bit` tells which, and their own hash is the key.
    """
    held = docs.sparkSession.sparkContext.broadcast((sketch.bits, sketch.hot))

    def usual(found: Anchors, pick: np.ndarray, units: np.ndarray, rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        flanks = flanks_of(found, pick, units)
        weights = np.arange(1, flanks.shape[1] // 4, 2, dtype=np.uint64)
        return rows | {"context": mix((mix(flanks.view(np.uint64)) * weights).sum(axis=1, dtype=np.uint64)), "bit": np.full(len(pick), -1)}, flanks

    def windows(found: Anchors, pick: np.ndarray, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        starts = found.at[pick][:, None] - np.arange(w.span)
        real = (starts >= found.first[pick][:, None]) & (starts <= found.last[pick][:, None])
        row, bit = np.nonzero(real)
        one = {c: x[row] for c, x in rows.items()}
        return one | {"key": mix(one["key"] ^ found.hashes.of(starts[real], w.length)) + bit.astype(np.uint64), "bit": bit, "context": np.zeros(len(bit), np.uint64)}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, flanked, bare = Sketch(*held.value), None, Held(0)
        for batch in batches:
            ids = batch.column(0)
            doc_id, null, own_key = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for a, _, units, sizes, found in scan(batch.column(2)):
                keep = np.flatnonzero(sketch.repeated(found.key, found.key2))
                base, doc_of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
                hot = np.isin(found.key[keep], sketch.hot)
                for is_hot, some, step in ((False, keep[~hot], SENT_ROWS), (True, keep[hot], max(1, HELD_ROWS // (2 * w.span)))):
                    for b in range(0, len(some), step):
                        pick = some[b:b + step]
                        doc = doc_of[found.at[pick]]
                        rows = {"key": found.key[pick], "key2": found.key2[pick], "at": found.at[pick] - base[doc],
                                "doc_id": doc_id[a + doc], "null": null[a + doc], "text_key": own_key[a + doc]}
                        if is_hot:
                            one = windows(found, pick, rows)
                            yield from bare.add(one, np.empty((len(one["key"]), 0), np.uint8))
                        else:
                            rows, flanks = usual(found, pick, units, rows)
                            flanked = flanked or Held(flanks.shape[1])
                            yield from flanked.add(rows, flanks)
        for some in (flanked, bare):
            if some:
                yield from some.sent()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text").mapInArrow(each, CONTEXTS)


def copies_of(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A number for each different context of a core, and how many places have it."""
    key, key2, context = (part.column(c).to_numpy().view(np.uint64) for c in ("key", "key2", "context"))
    _, same = np.unique(mix(key ^ mix(key2 + context)), return_inverse=True)
    return same, np.bincount(same, weights=part.column("n").to_numpy())[same]


def flank_rows(part: pa.Table) -> np.ndarray:
    """Of rows that are no windows of hot cores."""
    return np.frombuffer(b"".join(part.column("flank").to_pylist()), np.uint8).reshape(part.num_rows, -1)


def missing_batch(part: pa.Table, missing: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    bits = np.packbits(missing[rows], axis=1, bitorder="little")
    return pa.RecordBatch.from_arrays(
        [*[part.column(c).combine_chunks().take(pa.array(rows)) for c in ("doc_id", "text_key", "at")], pa.array([b.tobytes() for b in bits], pa.binary())],
        ["doc_id", "text_key", "at", "missing"])


def whole_keys(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[pa.Table]:
    """Tables of about `most` rows, cut where the key (column 0) changes; rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if rows >= most:
            changed = np.flatnonzero(batch.column(0).to_numpy() != held[-1].column(0)[-1].as_py())
            if len(changed):
                yield pa.Table.from_batches([*held, batch.slice(0, int(changed[0]))])
                held, rows, batch = [], 0, batch.slice(int(changed[0]))
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def unrepeated(contexts: DataFrame, solve: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Per text, the anchors with windows that are not repeated: `missing` has a bit for each window of the anchor."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_keys(batches):
            yield from solve(part)

    found = contexts.repartition("key", "key2").sortWithinPartitions("key", "key2").mapInArrow(each, "doc_id long, text_key long, at int, missing binary")
    return found.groupBy(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key")).agg(F.collect_list(F.struct("at", "missing")).alias("missing"))


def with_unrepeated(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, text, missing, ...) for each row of `docs` (doc_id, text, ...)."""
    own = docs.withColumn("text_key", text_key(F.col("text")))
    joined = own.join(rows, own["doc_id"].eqNullSafe(rows["own_id"]) & (own["text_key"] == rows["own_key"]), "left")
    return joined.select("doc_id", "text", "missing", *[c for c in docs.columns if c not in ("doc_id", "text")])


def missing_rows(column: pa.Array, base: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the chunk (sorted, each once) and bits (a row each) from the lists of a run of texts that begin at `base`."""
    column = column.fill_null([])
    flat = column.flatten()
    if not len(flat):
        return np.empty(0, np.int64), np.empty((0, 8 * width), np.uint8)
    at = flat.field("at").to_numpy() + np.repeat(base, column.value_lengths().to_numpy())
    bits = np.unpackbits(np.frombuffer(b"".join(flat.field("missing").to_pylist()), np.uint8).reshape(-1, width), axis=1, bitorder="little")
    order = np.argsort(at, kind="stable")
    places, first = np.unique(at[order], return_index=True)
    return places, np.bitwise_or.reduceat(bits[order], first, axis=0)


def coverage(a: Anchors, keep: np.ndarray, w: Windows, n: int, places: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """Which of the chunk's n units a repeated window covers. Windows of an anchor without a missing row all repeat."""
    at, first, last = a.at[keep], a.first[keep], a.last[keep]
    row = np.searchsorted(places, at)
    listed = np.zeros(len(at), bool)
    if len(places):
        row = np.minimum(row, len(places) - 1)
        listed = places[row] == at
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, first[~listed], 1)
    np.add.at(change, last[~listed] + w.length, -1)
    if listed.any():
        starts = at[listed][:, None] - np.arange(w.span)
        good = (starts >= first[listed][:, None]) & (starts <= last[listed][:, None]) & (missing[row[listed]][:, :w.span] == 0)
        np.add.at(change, starts[good], 1)
        np.add.at(change, starts[good] + w.length, -1)
    return np.cumsum(change[:-1]) > 0
