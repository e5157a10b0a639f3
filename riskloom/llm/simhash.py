"""SimHash near-duplicates: tiled exact comparison of fingerprints.

1. A text's fingerprint: bit b is 1 if it is set in over half of the XXH64 hashes
   of its shingles (repeats included).  Equal fingerprints become one row.
2. Fingerprints are laid out by the bit counts of their four 16-bit parts, a cell
   for each of at most 17^4 combinations.  Two that differ in d bits lie in cells
   whose counts differ by at most d in sum, so each is sent to its own cell and,
   as a visitor, to the smaller cells within the radius.  A large cell is split by
   hash into shares of bounded size, and pairs of shares are compared.
3. A task compares tiles with numpy (exclusive or, bit counts), skipping pairs of
   tiles whose bit counts, total or by byte, differ beyond the radius.  Of the links found it
   keeps a spanning forest, so a group of g near copies gives g rows, not g * g.
4. Components by passing the smallest label along links, with pointer jumping,
   until nothing changes; each round is written to the checkpoint folder.

Only links and labels of distinct fingerprints are shuffled, never texts, and
nothing but counts of rows and of cells reaches the driver.

Null and empty texts have fingerprint 0 and are linked like any other.  Repeated
rows share a component.  A null doc_id has a row but is never the smallest id; a
component of null ids only has a null id.  An empty table gives an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut, text_key

SHINGLE, MAX_BITS, SEED = 3, 2, 42
TILE = 1024
#: Fingerprints of one cell that are held together in a task.
SHARE = 100_000
CHUNK = 200_000  # hashes whose bits are counted together


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    if not words:
        return 0
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [hash_of(b" ".join(words), seed)]
    else:
        line, ends = b" ".join(words), []
        at = -1
        for word in words:
            at += len(word) + 1
            ends.append(at)
        starts = [0, *[e + 1 for e in ends]]
        hashes = [hash_of(line[s:e], seed) for s, e in zip(starts, ends[shingle - 1:], strict=False)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.array(hashes[at:at + CHUNK], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """A row per row of `docs`: doc_id, key (of the text), fp (the fingerprint's 64 bits as a signed number)."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text").mapInArrow(each, "doc_id long, key long, fp long")


def _part_counts(fp: str = "fp") -> list:
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Ways from a cell to a smaller one (in the order of their numbers) within the radius, and staying."""
    return [s for s in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, s)) <= radius and s <= (0, 0, 0, 0)]


class Forest:
    """Joins of numbered nodes; remembers the links that joined two groups."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return int(i)

    def roots(self, at: slice) -> np.ndarray:
        found = self.parent[at]
        while (above := self.parent[found]) is not found and (above != found).any():
            found = above
        return found

    def join(self, near: np.ndarray, x: slice, y: slice) -> None:
        """Join the groups of all near pairs. A round takes one open pair of each column; few rounds suffice."""
        while True:
            open_pairs = near & (self.roots(x)[:, None] != self.roots(y)[None, :])
            columns = np.flatnonzero(open_pairs.any(axis=0))
            if not len(columns):
                return
            for i, j in zip(open_pairs[:, columns].argmax(axis=0) + x.start, columns + y.start, strict=True):
                ri, rj = self.root(i), self.root(j)
                if ri != rj:
                    self.parent[max(ri, rj)] = min(ri, rj)
                    self.links.append((i, j))


def compare(home: np.ndarray, guests: np.ndarray | None, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same groups as all near pairs among `home`, or between `home` and `guests`."""
    sides = [home] if guests is None else [home, guests]
    tiles, values = [], []
    for side in sides:
        profile = np.bitwise_count(side.view(np.uint8).reshape(-1, 8)).astype(np.int16)
        order = np.lexsort((*profile.T, profile.sum(axis=1)))
        base = sum(map(len, values))
        values.append(side[order])
        own = []
        for at in range(0, len(side), tile):
            counts = profile[order[at:at + tile]]
            total = counts.sum(axis=1)
            own.append((slice(base + at, base + min(at + tile, len(side))), total.min(), total.max(), counts.min(axis=0), counts.max(axis=0)))
        tiles.append(own)
    both = np.concatenate(values)
    forest = Forest(len(both))
    for k, (x, x_low, x_high, x_least, x_most) in enumerate(tiles[0]):
        for y, y_low, y_high, y_least, y_most in tiles[0][k:] if guests is None else tiles[1]:
            if x_low - y_high > radius or y_low - x_high > radius or np.maximum(0, np.maximum(x_least - y_most, y_least - x_most)).sum() > radius:
                continue
            near = np.bitwise_count(both[x, None] ^ both[None, y]) <= radius
            if near.any():
                forest.join(near, x, y)
    ends = np.array(forest.links, np.int64).reshape(-1, 2)
    return both[ends[:, 0]], both[ends[:, 1]]


def links(distinct: DataFrame, radius: int = MAX_BITS, share: int = SHARE) -> DataFrame:
    """Links (a, b) between different fingerprints that join the same groups as all pairs within the radius."""
    cell = lambda parts: sum((p.cast("long") * 17**(3 - k) for k, p in enumerate(parts)), F.lit(0).cast("long"))
    own = distinct.select("fp", *[c.alias(f"p{k}") for k, c in enumerate(_part_counts())])
    own = own.withColumn("own", cell([F.col(f"p{k}") for k in range(4)]))
    sizes = F.broadcast(cut(own.groupBy("own").agg(F.ceil(F.count("*") / share).cast("int").alias("shares"))))  # at most 17^4 rows
    own = own.join(sizes, "own").select("*", F.pmod(F.xxhash64("fp"), F.col("shares")).cast("int").alias("mine")).drop("shares")
    moves = F.array(*[F.struct(*[F.lit(d).alias(f"d{k}") for k, d in enumerate(step)]) for step in _steps(radius)])
    sent = own.select("fp", "own", "mine", *[f"p{k}" for k in range(4)], F.explode(moves).alias("d"))
    to = [F.col(f"p{k}") + F.col(f"d.d{k}") for k in range(4)]
    valid = to[0].between(0, 16) & to[1].between(0, 16) & to[2].between(0, 16) & to[3].between(0, 16)
    met = sent.where(valid).select("fp", "mine", F.col("own").alias("from"), cell(to).alias("own")).join(sizes, "own")
    # At home in the own share and a guest of the shares before it; a guest of all shares of other cells.
    last = F.when(F.col("from") == F.col("own"), F.col("mine")).otherwise(F.col("shares") - 1)
    rows = met.select("own", F.explode(F.sequence(F.lit(0), last)).alias("share"), "from", "mine", "fp")
    rows = rows.select("own", "share", F.when((F.col("from") == F.col("own")) & (F.col("share") == F.col("mine")), 0).otherwise(1).alias("role"), "fp")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, at = np.empty(0, np.uint64), None
        for batch in batches:
            own, of, role, fp = (batch.column(i).to_numpy() for i in range(4))
            fp = fp.view(np.uint64)
            edges = np.flatnonzero(np.diff(own) | np.diff(of) | np.diff(role)) + 1
            for a, b in zip([0, *edges], [*edges, len(own)], strict=True):
                block = (own[a], of[a])
                if block != at:
                    home, at = np.empty(0, np.uint64), block
                part = fp[a:b]
                found = [compare(part, None, radius)] if role[a] == 0 else []
                if len(home):
                    found.append(compare(home, part, radius))
                if role[a] == 0:
                    home = np.concatenate([home, part])
                for x, y in found:
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    return rows.repartition("own", "share").sortWithinPartitions("own", "share", "role").mapInArrow(each, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a, b): root is the smallest node reachable, roots themselves left out.

    Alternates two star steps: every node's larger neighbours, then its smaller ones, are linked to its smallest
    neighbour, until each group is one star. Links stay as many or get fewer, and rounds grow with the logarithm.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    now, seen = cut(edges.select(hi, lo).where("hi <> lo").distinct()), None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if mark == seen:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = mark
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        near = large.join(least, "hi")
        small = near.select("hi", F.col("m").alias("lo")).unionByName(near.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        now = cut(small.distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = MAX_BITS) -> DataFrame:
    """A row per row of `docs`: doc_id, key (of the text), fp, root (the group's own number) and component_id (the smallest id reachable)."""
    prints = cut(fingerprints(docs, shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    stars = components(links(distinct.select("fp"), radius))
    root = distinct.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = root.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(root.join(ids, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "key", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, radius: int = MAX_BITS) -> DataFrame:
    """`docs`, same columns, with one row of each group: that of its smallest id (a null one last), of equal ids the smallest text hash."""
    found = near_duplicates(docs, shingle, radius)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")
    first = found.groupBy("root").agg(least).select(F.col("least.doc_id").alias("keep_id"), F.col("least.key").alias("keep_key"))
    own_id, own_key = docs["doc_id"].cast("long"), text_key(docs["text"])
    kept = docs.join(first, own_id.eqNullSafe(first["keep_id"]) & (own_key == first["keep_key"]), "left_semi")
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    once = kept.select(*named, own_id.alias("keep_id"), own_key.alias("keep_key")).dropDuplicates(["keep_id", "keep_key"])
    return once.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
