"""Hard negatives by cover trees over norm-augmented vectors.

An anchor's positives are its best `positives` other rows of the same label by inner
product.  For each of them the best `negatives` rows of other labels are sought whose
score lies between `low` and `high` percent of the positive's.

Index.  Every row is in one tree.  Rows of a label are dealt to the nearest of a few
pivots (a bounded sample of the vectors, the only thing that is sampled), and groups
of over `TREE` rows are dealt on by the row's number, so that a label or a vector that
a third of all rows share is many trees.  A vector x gets one more component,
sqrt(M^2 - |x|^2) with M the tree's greatest norm; all then have the norm M, and near
means a high inner product.  A tree is a cover tree of that space: the children of a
node of radius r are the node's centre and further centres among its points, each
over r / `SHRINK` from the others and together within r / `SHRINK` of all points.

Search.  Anchors in blocks and trees meet in the cells of a grid whose two sides follow
from the numbers of anchors and rows, so each side is copied by a factor of its own.
In a cell an anchor goes best first through all trees at once.  A node's inner products
are that of its centre, a row of the table, give or take |anchor| times the node's
covering radius.  Nodes outside of all windows, or below what an anchor already has,
are skipped; a centre met for the first time is a result with its exact score.  Each cell
gives its few best rows per anchor, and a ranked limit merges them.

Scores are exact integers: each component x counts as floor(`SCALE` * x), and products
are taken in double precision where they stay below 2^53, else by Python's integers.
A score beyond 64 bits is stored as the nearest 64-bit number.

Rows with a null id, label or vector, or with a null or non-finite component, take no
part.  Vectors of different lengths never meet; empty vectors score 0.  Ties go to the
smaller id, then to the row numbered first.  Repeated rows count one by one, and a
repeated anchor gives its rows once per copy; a row never meets itself.  An empty table
gives an empty result.  Other columns are not looked at, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import cut
from riskloom.llm.packing import ragged

SCALE = 256
#: Rows of a tree, and components of rows and of anchors that meet in a cell.
TREE, CELL_ROWS, CELL_ANCHORS = 1024, 1 << 22, 1 << 19
#: At most this many pivots, and the ratio of a node's radius to its children's.
PIVOTS, SHRINK = 256, 1.5
LEAST, MOST = -(1 << 63), (1 << 63) - 1
TREES = "label int, size int, rids binary, ids binary, vectors binary, centre binary, radius binary, first binary, number binary, fresh binary"


def prepared(vectors: DataFrame, label: Column) -> DataFrame:
    """rid, vec_id, label, v: the rows that take part, with whole numbers for components; written, so that row numbers stay."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    valid = vectors.select("vec_id", label.cast("int").alias("label"), "embedding").where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    return cut(valid.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), "label", whole.alias("v")))


def cover_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, children side by side: centre (a row of x), covering radius, first child, number of children, centre not met above."""
    norms = (x * x).sum(axis=1)
    extra, products = np.sqrt(norms.max() - norms), x @ x.T

    def distances(some: np.ndarray, middle: int) -> np.ndarray:
        squares = norms[some] + norms[middle] - 2 * products[middle, some] + (extra[some] - extra[middle]) ** 2
        return np.sqrt(np.maximum(squares, 0))

    away = distances(np.arange(len(x)), 0)
    centre, radius, first, number, fresh = [0], [away.max()], [0], [0], [True]
    todo = [(0, np.arange(len(x)), away)]
    while todo:
        node, members, away = todo.pop()
        if radius[node] == 0:  # copies of the centre
            kids = [(m, members[:0], away[:0], True) for m in members if m != centre[node]]
        else:
            kids, reach, middle = [], away.max() / SHRINK, centre[node]
            while len(members):
                near = away <= reach
                kids.append((middle, members[near], away[near], middle != centre[node]))
                members = members[~near]
                if len(members):
                    middle = members[0]
                    away = distances(members, middle)
        first[node], number[node] = len(centre), len(kids)
        for middle, own, away, new in kids:
            if len(own) > 1:
                todo.append((len(centre), own, away))
            centre.append(middle)
            radius.append(away.max() if len(own) > 1 else 0.0)
            first.append(0)
            number.append(0)
            fresh.append(new)
    return np.array(centre, np.int32), np.array(radius), np.array(first, np.int32), np.array(number, np.int32), np.array(fresh)


def index(rows: DataFrame, total: int) -> DataFrame:
    """A row per tree: its label, its rows and its nodes."""
    wanted = min(PIVOTS, max(1, total // (10 * TREE)))
    sample = [np.array(r.v) for r in rows.select("rid", "v").orderBy(F.xxhash64("rid")).limit(wanted).collect()]
    pivots = {n: np.array([v for v in sample if len(v) == n]) for n in {len(v) for v in sample}}

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot = np.zeros(batch.num_rows, np.int32)
            for n, some, v in by_length(batch.column(batch.schema.get_field_index("v"))):
                if n in pivots:
                    p = pivots[n]
                    pivot[some] = np.argmin((p * p).sum(axis=1) - 2 * (v @ p.T), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot)], [*batch.schema.names, "pivot"])

    def built(table: pa.Table) -> pa.Table:
        _, _, v = next(by_length(table["v"].combine_chunks()))
        centre, radius, first, number, fresh = cover_tree(v)
        packed = [table["rid"].to_numpy(), table["vec_id"].to_numpy(), v, centre, radius, first, number, fresh]
        return pa.Table.from_arrays([table["label"].slice(0, 1), pa.array([v.shape[1]], pa.int32()), *(pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in packed)],
                                    [c.split()[0] for c in TREES.split(", ")])

    dealt = rows.mapInArrow(nearest, "rid long, vec_id long, label int, v array<double>, pivot int").withColumn("size", F.size("v"))
    group = ["label", "size", "pivot"]
    heavy = dealt.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > TREE)  # at most total / TREE rows
    heavy = F.broadcast(heavy) if total // TREE <= 1_000_000 else heavy
    dealt = dealt.join(heavy, group, "left").withColumn("part", F.pmod(F.xxhash64("rid"), F.ceil(F.coalesce("n", F.lit(1)) / TREE)))
    return dealt.groupBy(*group, "part").applyInArrow(built, TREES)


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors of a list column as matrices: (length, their places, the matrix)."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(lengths) - lengths
    for n in np.unique(lengths):
        some = np.flatnonzero(lengths == n)
        yield int(n), some, flat[begin[some][:, None] + np.arange(n)].reshape(len(some), n)


class Forest:
    """The trees of a cell whose vectors have one length, their nodes side by side."""

    def __init__(self, trees: list[dict]):
        self.size = trees[0]["size"]
        parts: list[list[np.ndarray]] = [[] for _ in range(8)]
        nodes = 0
        self.roots, self.labels = [], np.array([t["label"] for t in trees])
        for tree in trees:
            rids, ids = (np.frombuffer(tree[c], np.int64) for c in ("rids", "ids"))
            x = np.frombuffer(tree["vectors"], np.float64).reshape(len(rids), self.size)
            centre, first, number = (np.frombuffer(tree[c], np.int32) for c in ("centre", "first", "number"))
            radius, fresh = np.frombuffer(tree["radius"], np.float64), np.frombuffer(tree["fresh"], bool)
            lost = 1e-7 * np.abs(x).max(initial=0) * math.sqrt(self.size)  # what doubles may have lost
            for part, values in zip(parts, (x[centre], ids[centre], rids[centre], first + np.int64(nodes), number, radius * (1 + 1e-9) + lost, fresh), strict=False):
                part.append(values)
            self.roots.append(nodes)
            nodes += len(centre)
        self.x, self.ids, self.rids, self.first, self.number, self.radius, self.fresh = map(np.concatenate, parts[:7])
        self.roots, self.greatest = np.array(self.roots), float(np.abs(self.x).max(initial=0))

    def scores(self, nodes: np.ndarray, vector: np.ndarray) -> np.ndarray:
        """Exact inner products of the nodes' centres."""
        if self.greatest * np.abs(vector).max(initial=0) * self.size < 2.0 ** 53:
            return self.x[nodes] @ vector
        return np.array([sum(int(a) * int(b) for a, b in zip(row, vector, strict=True)) for row in self.x[nodes]], object)


def best_first(forest: Forest, roots: np.ndarray, vector: np.ndarray, rid: int, windows: list[tuple[float, float]], k: int) -> list[list[tuple[int, int, int]]]:
    """Per window the k best (-score, id, rid) with a score inside of it; the row `rid` itself is left out.

    The most promising open nodes are opened together, more of them in each round.
    """
    best: list[list[tuple[int, int, int]]] = [[] for _ in windows]
    norm = math.sqrt(float(vector @ vector)) * (1 + 1e-9)

    def least(own: list[tuple[int, int, int]], lo: float) -> float:
        return max(lo, -own[-1][0]) if len(own) == k else lo

    def visit(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scores, fresh = forest.scores(nodes, vector), forest.fresh[nodes]
        for (lo, hi), own in zip(windows, best, strict=True):
            places = np.flatnonzero(fresh & (scores >= least(own, lo)) & (scores <= hi))
            if len(places) > 4 * k:  # only those that tie with the k-th (the row itself not counted) or beat it
                kth = np.partition(scores[places], len(places) - k - 1)[len(places) - k - 1]
                places = places[scores[places] >= kth]
            rows = nodes[places]
            own.extend((-int(s), int(i), int(r)) for s, i, r in zip(scores[places], forest.ids[rows], forest.rids[rows], strict=True) if r != rid)
            own.sort()
            del own[k:]
        inner = forest.number[nodes] > 0
        middle, slack = scores[inner].astype(np.float64), norm * forest.radius[nodes[inner]] + 1e-6
        return nodes[inner], middle - slack, middle + slack

    opened, below, above = visit(roots)
    wave = 64
    while len(opened):
        hope = np.full(len(opened), -np.inf)
        for (lo, hi), own in zip(windows, best, strict=True):
            top = np.minimum(above, hi)
            hope = np.where((top >= least(own, lo)) & (below <= hi), np.maximum(hope, top), hope)
        order = np.argsort(-hope, kind="stable")
        order = order[hope[order] > -np.inf]
        now, later = order[:wave], order[wave:]
        first, number = forest.first[opened[now]], forest.number[opened[now]]
        more = visit(ragged(first, number))
        opened, below, above = (np.concatenate([old[later], new]) for old, new in zip((opened, below, above), more, strict=True))
        wave *= 4
    return best


def grid(size: int, asking: int, cores: int) -> tuple[int, int]:
    """Sides of the grid: cells that fit a task, three for every core, and the least that is copied (down * size + across * asking)."""
    cells = max(3 * cores, size * asking / (CELL_ROWS * CELL_ANCHORS))
    down = max(1, math.ceil(asking / CELL_ANCHORS), round(math.sqrt(cells * asking / max(size, 1))))
    return down, max(1, math.ceil(size / CELL_ROWS), math.ceil(cells / down))


def numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def bounds(lo: int, hi: int) -> tuple[float, float]:
    """A window; the outermost 64-bit numbers stand for everything beyond them, too."""
    return -math.inf if lo == LEAST else lo, math.inf if hi == MOST else hi


def search(anchors: DataFrame, trees: DataFrame, down: int, across: int, same: bool, k: int) -> DataFrame:
    """Anchors (rid, label, v, windows) against trees of the same label, or of the others: rid, window, score, vec_id, found."""
    names = ["rid", "window", "score", "vec_id", "found"]

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], [], [], [], []]
        rows = right.to_pylist()
        forests = {size: Forest([r for r in rows if r["size"] == size]) for size in {r["size"] for r in rows}}
        for rid, label, v, windows in zip(*(left[c].to_pylist() for c in ("rid", "label", "v", "windows")), strict=True):
            if len(v) not in forests:
                continue
            forest = forests[len(v)]
            roots = forest.roots[(forest.labels == label) == same]
            for number, found in enumerate(best_first(forest, roots, np.array(v, np.float64), rid, [bounds(w["lo"], w["hi"]) for w in windows], k)):
                for score, vec_id, other in found:
                    for column, value in zip(out, (rid, number, max(LEAST, min(MOST, -score)), vec_id, other), strict=True):
                        column.append(value)
        return pa.table([pa.array(c, pa.int64()) for c in out], names)

    # An anchor goes to all columns (those with trees of its label, if only these count), a tree to all rows.
    left = anchors.withColumn("row", F.pmod(F.xxhash64("rid"), F.lit(down)))
    if same:
        left = left.join(trees.select("label", F.col("col").alias("to")).distinct(), "label")
    else:
        left = left.withColumn("to", F.explode(numbers(across)))
    right = trees.withColumn("row", F.explode(numbers(down)))
    parts = 3 * down * across  # cells are few and costly, so Spark is not left to join their small partitions
    left, right = left.repartition(parts, "row", "to"), right.repartition(parts, "row", "col")
    return left.groupBy("row", "to").cogroup(right.groupBy("row", "col")).applyInArrow(cell, ", ".join(f"{n} long" for n in names))


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor and positive that has a negative."""
    rows = prepared(vectors, label)
    own = F.greatest(F.size("v"), F.lit(1))
    total, size, asking = (n or 0 for n in rows.agg(F.count("*"), F.sum(own), F.sum(F.when(is_anchor, own))).first())
    down, across = grid(size, asking, vectors.sparkSession.sparkContext.defaultParallelism)
    column = F.pmod(F.xxhash64("label", "rids"), F.lit(across)).alias("col")
    trees = cut(index(rows, total).select("*", column))
    anchors = rows.where(is_anchor)
    everything = F.array(F.struct(F.lit(LEAST).cast("long").alias("lo"), F.lit(MOST).cast("long").alias("hi")))
    order = [F.col("score").desc(), "vec_id", "found"]
    near = search(anchors.select("rid", "label", "v", everything.alias("windows")), trees, down, across, True, positives)
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("rid").orderBy(*order))).where(F.col("place") <= positives)
    # 100 * negative >= low * positive and 100 * negative <= high * positive, in whole numbers
    lo, hi = (-F.floor(-F.lit(low).cast("decimal(20,0)") * F.col("score") / 100)).cast("long"), F.floor(F.lit(high).cast("decimal(20,0)") * F.col("score") / 100).cast("long")
    listed = near.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("place", lo.alias("lo"), hi.alias("hi"), "vec_id", "score"))).alias("windows"))
    asked = cut(anchors.join(listed, "rid"))
    far = search(asked.select("rid", "label", "v", F.transform("windows", lambda w: F.struct(w["lo"].alias("lo"), w["hi"].alias("hi"))).alias("windows")), trees, down, across, False, negatives)
    far = far.withColumn("rank", F.row_number().over(Window.partitionBy("rid", "window").orderBy(*order))).where(F.col("rank") <= negatives)
    positive = F.get("windows", F.col("window").cast("int"))
    told = asked.select("rid", F.col("vec_id").alias("anchor_id"), "windows")
    return far.join(told, "rid").select(
        "anchor_id", positive["vec_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        positive["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )
