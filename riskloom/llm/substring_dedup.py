"""Substring dedup with a count-min prefilter: removes words covered by a repeated window.

See `repeats` for the passes.  The sketch counts each window by its anchor, which
overestimates; windows estimated to occur once are left alone.  The second pass
groups the others exactly: contexts with one core meet in a task, equal windows
of them are counted by 48 bits of hash (together with the core's 128), and
the windows that occur once are named.  Contexts that are equal as a whole are
one row with a count, so copies do not multiply.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged.  Null and empty texts have no words;
texts under a window's length lose none.  Repeated rows are copies of each other
and lose all words that a window covers.  An empty table gives an empty result.
Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import repeats
from riskloom.llm.repeats import P1, Anchors, Hashes, Windows, mix

WINDOW = 35
HASH_BYTES = 6  # of a window's hash in a context; windows are compared within one core, which 128 bits tell
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True


def windows_of(length: int) -> Windows:
    """Anchors are chosen among grams of a little under half the window."""
    gram = max(1, length * 16 // 35)
    return Windows(length, gram, length - gram + 1)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and the offsets of the texts in them; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the number of words of each text."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    space = SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(~space & (np.concatenate([space[1:], [True]]) | edge[1:])) + 1
    hashes = Hashes(data.astype(np.uint64) + np.uint64(1), P1).of(starts, ends - starts)
    return mix(hashes + (ends - starts).astype(np.uint64)), np.diff(np.searchsorted(starts, offsets))


def _scan(texts: pa.Array, w: Windows) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Anchors]]:
    """Runs of texts: first, last, their words' hashes and numbers, and the anchors."""
    data, offsets = text_bytes(texts)
    for a, b in repeats.chunks(np.diff(offsets), 6 * repeats.CHUNK):
        values, sizes = word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        yield a, b, values, sizes, repeats.anchors(values, sizes, w)


def _flanks(found: Anchors, pick: np.ndarray, w: Windows) -> np.ndarray:
    """Six bytes of the hash of each of an anchor's windows, last start first; 0 where there is none."""
    starts = found.at[pick][:, None] - np.arange(w.span)
    real = (starts >= found.first[pick][:, None]) & (starts <= found.last[pick][:, None])
    hashes = found.hashes.of(np.where(real, starts, 0), np.where(real, w.length, 0)) | np.uint64(1)
    rows = np.where(real, hashes, np.uint64(0)).view(np.uint8).reshape(len(starts), w.span, 8)[:, :, :HASH_BYTES].reshape(len(starts), -1)
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))


def _hashes_in(flanks: np.ndarray, w: Windows) -> np.ndarray:
    out = np.zeros((len(flanks), w.span, 8), np.uint8)
    out[:, :, :HASH_BYTES] = flanks[:, :w.span * HASH_BYTES].reshape(len(flanks), w.span, HASH_BYTES)
    return out.view(np.uint64)[:, :, 0]


def _solver(w: Windows):
    def solve(part: pa.Table) -> Iterator[pa.RecordBatch]:
        _, copies = repeats.copies_of(part)
        core = mix(part.column("key").to_numpy().view(np.uint64) + mix(part.column("key2").to_numpy().view(np.uint64)))
        bit = part.column("bit").to_numpy()
        missing = np.zeros((part.num_rows, w.span), bool)
        usual = np.flatnonzero(bit < 0)
        if len(usual):
            flanks = _hashes_in(repeats.flank_rows(part.take(pa.array(usual))), w)
            _, group = np.unique((mix(flanks ^ core[usual][:, None]) + np.arange(w.span, dtype=np.uint64)).ravel(), return_inverse=True)
            counts = np.bincount(group, weights=np.repeat(part.column("n").to_numpy()[usual], w.span))[group].reshape(-1, w.span)
            missing[usual] = (flanks != 0) & (counts < 2)
        alone = np.flatnonzero(bit >= 0)  # a window of a hot core: its context is itself
        missing[alone, bit[alone]] = True
        out = np.flatnonzero((copies < 2) & missing.any(axis=1))
        if len(out):
            yield repeats.missing_batch(part, missing, out)

    return solve


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per row of `docs`: doc_id, n_words, n_removed and the kept words, joined by one space."""
    w = windows_of(window)
    width = (w.span + 7) // 8

    def keys_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for *_, found in _scan(batch.column(0), w):
            yield found.key, found.key2

    sketch = repeats.count_sketch(docs.select("text"), keys_of)
    found = repeats.contexts(docs, sketch, w, lambda texts: _scan(texts, w), lambda found, pick, _: _flanks(found, pick, w))
    rows = repeats.unrepeated(found, _solver(w))
    held = docs.sparkSession.sparkContext.broadcast((sketch.bits, sketch.hot))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = repeats.Sketch(*held.value)
        for batch in batches:
            texts = batch.column(1)
            for a, b, values, sizes, found in _scan(texts, w):
                base = np.cumsum(sizes) - sizes
                keep = sketch.repeated(found.key, found.key2) if len(found.at) else np.empty(0, bool)
                gone = repeats.coverage(found, keep, w, len(values), *repeats.missing_rows(batch.column(2).slice(a, b - a), base, width))
                kept = []
                for text, at, size in zip(texts.slice(a, b - a).to_pylist(), base, sizes, strict=True):
                    words, out = (text or "").encode().split(), gone[at:at + size]
                    kept.append(b" ".join(compress(words, (~out).tolist()) if out.any() else words).decode())
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[np.concatenate([base, [len(values)]])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(removed), pa.array(kept, pa.string())],
                                                 ["doc_id", "n_words", "n_removed", "kept"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return repeats.with_unrepeated(own, rows).mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept string")
