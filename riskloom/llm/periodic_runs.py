"""Runs of repeated words, found by block convolution at dyadic scales.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical), of at least `exponent` * q and `shortest` words, that no neighbouring
word extends.  A batch of documents is one row of word numbers, with a number of its
own between documents, so nothing matches across them.

For each scale B = 1, 2, 4, ... the row is cut into blocks of B words.  A block's sum
of squared differences to every stretch that begins B to 2B - 1 words later,
sum P^2 + sum T^2 - 2 sum P T, comes from one cyclic convolution of 2B places by a
number-theoretic transform modulo `PRIME`.  A sum that is zero modulo the prime is
then compared word by word, so what is left are exactly the places without mismatch.
A run whose period q lies in [B, 2B) has at least two neighbouring blocks that match
at distance q, since its words match over (exponent - 1) * q >= 3B places; such
seeds are extended by less than B words to each side.

Work stays near n log^2 n for n words:
- A block can only match if each of its words comes again within 2B words; others,
  and those without such a neighbour, are not transformed.
- A block that lies, with the 2B words behind it, in a run of a smaller scale is
  left out: a run of a period in [B, 2B) that held the block would share enough words
  with that run to have its period (Fine and Wilf).
- So two neighbouring blocks that match at one distance are a repetition of more than
  two periods of its own, and a row has fewer such repetitions than words.

A null text has no words, and so no run; neither has an empty one.  Texts of any
length are searched whole.  Repeated rows each give their row.  Runs of one document
are listed by start, then period.  An empty table gives an empty result.  Columns other
than `doc_id` and `text` are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import words

#: 15 * 2^27 + 1, a prime; 31 is a primitive root of it.
PRIME, ROOT = 2013265921, 31
SHORTEST, EXPONENT = 6, 4
BATCH_BYTES = 8_000_000
#: Words that are transformed or compared at once, unless one block has more.
CHUNK = 1 << 18
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def powers(base: int, n: int) -> np.ndarray:
    """base^0, ..., base^(n - 1) modulo the prime, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % PRIME])
    return out[:n]


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row (a power of two long), its result in bit-reversed order; the inverse takes that order."""
    count, size = rows.shape
    x = rows.astype(np.uint64)
    root = pow(ROOT, (PRIME - 1) // size, PRIME)
    halves = [size >> k for k in range(1, size.bit_length())]
    for half in reversed(halves) if inverse else halves:
        step = pow(root, size // (2 * half), PRIME)
        twist = powers(pow(step, -1, PRIME) if inverse else step, half)
        pair = x.reshape(count, -1, 2, half)
        a, b = pair[:, :, 0], pair[:, :, 1]
        if inverse:
            b = b * twist % PRIME
            x = np.stack([(a + b) % PRIME, (a + PRIME - b) % PRIME], axis=2).reshape(count, size)
        else:
            x = np.stack([(a + b) % PRIME, (a + PRIME - b) * twist % PRIME], axis=2).reshape(count, size)
    return x * np.uint64(pow(size, -1, PRIME)) % PRIME if inverse else x


def zero_mismatch(row: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in `starts`, distance) of the later stretches, `block` to 2 * `block` - 1 words on, that may equal the block."""
    pattern = row[starts[:, None] + np.arange(block)].astype(np.uint64)
    later = np.minimum(starts[:, None] + block + np.arange(2 * block), len(row) - 1)
    window = row[later].astype(np.uint64)
    window[:, -1] = 0  # no stretch reaches it
    # sum over i of P[i] T[j + i]: the cyclic convolution of T with P read backwards
    backwards = np.zeros_like(window)
    backwards[:, 0], backwards[:, block + 1:] = pattern[:, 0], pattern[:, :0:-1]
    product = transform(transform(window) * transform(backwards) % PRIME, inverse=True)[:, :block]
    squares = np.concatenate([np.zeros((len(starts), 1), np.uint64), np.cumsum(window * window % PRIME, axis=1)], axis=1)
    sums = squares[:, block:2 * block] - squares[:, :block] + (pattern * pattern % PRIME).sum(axis=1, dtype=np.uint64)[:, None]
    return np.nonzero((sums + 2 * (PRIME - product)) % PRIME == 0)


def next_same(row: np.ndarray) -> np.ndarray:
    """How many words on each word comes again; more than the row is long if it does not."""
    order = np.argsort(row, kind="stable")
    gap = np.full(len(row), 2 * len(row) + 2, np.int64)
    same = row[order[1:]] == row[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gap


def equal_blocks(row: np.ndarray, starts: np.ndarray, distances: np.ndarray, block: int) -> np.ndarray:
    """Whether each block equals the one that many words on, word by word."""
    out = np.zeros(len(starts), bool)
    step = max(1, CHUNK // block)
    for at in range(0, len(starts), step):
        places = starts[at:at + step, None] + np.arange(block)
        other = np.minimum(places + distances[at:at + step, None], len(row) - 1)
        out[at:at + step] = (row[places] == row[other]).all(axis=1)
    return out


def extended(row: np.ndarray, edge: np.ndarray, distances: np.ndarray, block: int, step: int) -> np.ndarray:
    """How many words from each edge on, backwards (-1) or forwards (1), equal the one `distance` later; less than a block."""
    out = np.zeros(len(edge), np.int64)
    part = max(1, CHUNK // block)
    for at in range(0, len(edge), part):
        places = np.clip(edge[at:at + part, None] + step * np.arange(block), 0, len(row) - 1)
        other = np.minimum(places + distances[at:at + part, None], len(row) - 1)
        out[at:at + part] = np.argmin(np.pad((row[places] == row[other]) & (places != other), ((0, 0), (0, 1))), axis=1)
    return out


def inside(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether [starts, ends) lies in one of the stretches [first, last), which are in order of `first`."""
    if not len(first):
        return np.zeros(len(starts), bool)
    reach = np.maximum.accumulate(last)
    at = np.searchsorted(first, starts, side="right") - 1
    return (at >= 0) & (reach[np.maximum(at, 0)] >= ends)


def find(row: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT) -> np.ndarray:
    """(start, length, period) of all runs of a row of word numbers whose first and last number occur once; by start, then period."""
    if exponent < 4 or shortest < 4:
        raise ValueError("two neighbouring blocks are sure to match only in runs of four periods and of four words")
    gap, runs, block = next_same(row), np.zeros((0, 3), np.int64), 1
    while (exponent * block) < len(row):
        whole = len(row) // block
        near = gap[:whole * block].reshape(whole, block).max(axis=1) < 2 * block
        starts = np.flatnonzero(near) * block
        known = runs[np.argsort(runs[:, 0], kind="stable")]
        starts = starts[~inside(starts, starts + 3 * block, known[:, 0], known[:, 0] + known[:, 1])]
        beside = np.isin(starts + block, starts), np.isin(starts - block, starts)
        starts = starts[beside[0] | beside[1]]
        found = [seeds(row, part, block) for part in blocks_of(starts, max(2, CHUNK // (2 * block)))]
        if found:
            runs = np.concatenate([runs, grown(row, np.concatenate(found), block, shortest, exponent)])
        block *= 2
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def blocks_of(starts: np.ndarray, size: int) -> list[np.ndarray]:
    """Parts of `starts` of about `size`, each with the last one of the part before, so that neighbours meet."""
    return [starts[max(0, at - 1):at + size] for at in range(0, len(starts), size)]


def seeds(row: np.ndarray, starts: np.ndarray, block: int) -> np.ndarray:
    """(distance, start) of blocks that match at a distance at which a neighbouring block matches, too."""
    at, off = zero_mismatch(row, starts, block)
    start, distance = starts[at], off + block
    key = distance * (len(row) + block) + start
    paired = np.isin(key + block, key) | np.isin(key - block, key)
    start, distance = start[paired], distance[paired]
    sure = equal_blocks(row, start, distance, block)
    return np.stack([distance[sure], start[sure]], axis=1)


def grown(row: np.ndarray, found: np.ndarray, block: int, shortest: int, exponent: int) -> np.ndarray:
    """The runs of the seeds: neighbouring blocks of one distance are joined and extended to both sides."""
    if not len(found):
        return np.zeros((0, 3), np.int64)
    distance, start = np.unique(found, axis=0).T
    fresh = np.concatenate([[True], (distance[1:] != distance[:-1]) | (start[1:] != start[:-1] + block)])
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    left, right, period = start[first], start[last] + block, distance[first]
    left = left - extended(row, left - 1, period, block, -1)
    right = right + extended(row, right, period, block, 1)
    runs = np.stack([left, right + period - left, period], axis=1)
    return runs[runs[:, 1] >= np.maximum(shortest, exponent * period)]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those in no run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def collapse(docs: DataFrame, shortest: int = SHORTEST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, n_words, all runs, and the words left (joined by one space) when each run keeps its first period only."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                split = pc.ascii_split_whitespace(part.column(1).fill_null(""))
                flat = split.flatten()
                real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
                counts = np.diff(np.concatenate([[0], np.cumsum(real)])[split.offsets.to_numpy() - split.offsets[0].as_py()])
                flat = flat.filter(pa.array(real))
                coded = flat.dictionary_encode()
                # A number of its own stands before, between and behind the documents.
                ends = np.cumsum(counts)
                begin = ends - counts + np.arange(1, len(counts) + 1)
                row = np.arange(len(flat) + len(counts) + 1) + len(coded.dictionary)
                row[np.arange(len(flat)) + np.repeat(np.arange(1, len(counts) + 1), counts)] = coded.indices.to_numpy(zero_copy_only=False)
                runs = find(row, shortest, exponent)
                doc = np.searchsorted(begin, runs[:, 0], side="right") - 1
                sizes = np.bincount(doc, minlength=len(counts))
                stay = kept(len(row), runs)
                stay = np.delete(stay, np.concatenate([[0], ends + np.arange(1, len(counts) + 1)]))
                left = np.concatenate([[0], np.cumsum(stay)])[np.concatenate([[0], ends])]
                rest = pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(stay)))
                listed = pa.StructArray.from_arrays([pa.array(runs[:, 0] - begin[doc]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).cast(pa.int64()), pa.array(counts),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), listed),
                    pc.binary_join(rest, " "),
                ], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(each, SCHEMA)


def with_echoes(docs: DataFrame) -> DataFrame:
    """The documents with repetitions put in: of a tenth of them, by the checksum of the id, the words from some place on repeat."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8"))
    g = F.floor(h / 10).cast("long")

    def echoed(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int")))), " ")

    marked = docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), words(F.col("text"))).alias("ws"), "text")
    return marked.select("doc_id", F.when(F.col("ws").isNotNull(), echoed(F.col("ws"))).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one, and digests of all runs and of the words left."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
