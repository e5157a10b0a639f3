"""Toxicity by class-conditional Kneser-Ney models of byte n-grams.

A text is read as its bytes with A-Z in lower case and everything in ASCII that is
no letter as single spaces.  For each class c (toxic, ordinary) the probability of
byte x behind the four bytes h is

    p_c(x | h) = max(N_c(hx) - D_c, 0) / N_c(h) + lambda_c(h) * shared(x | h')

where shared() is one Kneser-Ney distribution for both classes, made of the
number of different bytes seen before h'x.  D_c is in proportion to the class's
size, so expressions that are rare for their class fall back to the shared
counts alike in both, and only well-attested ones tell the classes apart.  The
score is a rising curve over the difference of the two log-likelihoods, divided by
the text's length plus `PAD` bytes.

Labels come from rows whose crc32(doc_id as text) mod 5 is 1 to 4: 1 to 3 give the
counts, 4 fits the curve (on at most `CALIBRATION` of them, in the
order of a hash of the id).  Neither labels, lang, source nor doc_id enter a score.

An n-gram that training has not seen has N_c(hx) = 0; as shared() is the same for both
classes, the difference of the logarithms is that of lambda_c(h) (1 for a class without h),
so a row per history holds it.  An unseen history tells nothing.

Counts are summed by Spark; the differences are computed there and stay exact rows, by
n-gram and by history, as many as the input has.  The most frequent rows, up to
`MAX_BROADCAST_ROWS`, are broadcast; what a text holds beside them goes to the other rows by
a join, one row for each different n-gram of a text.  Without other rows texts are not
shuffled, unless there are more than `MAX_BROADCAST_LABELS` labels.

A null text counts as empty and gets the score of a text without evidence.  A
doc_id with several labels is toxic if one says so; null ids have no label.
Without labels of both classes every score is the share of toxic labels, 0.5
if there are none.  Repeated rows each get their row.  Only doc_id, text and the
labels' doc_id and toxic are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import repeats
from riskloom.llm.common import cut
from riskloom.llm.substring_dedup import text_bytes

ORDER, DISCOUNT, SHARED_DISCOUNT, PAD = 5, 4.0, 0.5, 500
CALIBRATION, MAX_BROADCAST_LABELS, MAX_BROADCAST_ROWS = 50_000, 2_000_000, 4_000_000
HISTORY = 1 << (8 * ORDER)  # keys of histories are above those of n-grams
CHUNK = 1 << 18
OPEN = pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int64()), ("back", pa.float64())]))
PLAIN = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def plain_bytes(text: str | None) -> bytes:
    return b"  " + b" ".join((text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split()) + b" "


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts as numbers, and how many each text has."""
    rows = [plain_bytes(t) for t in texts]
    data = np.frombuffer(b"".join(rows), np.uint8).astype(np.uint64)
    sizes = np.array([len(r) for r in rows])
    if len(data) < ORDER:
        return np.empty(0, np.uint64), np.zeros(len(rows), np.int64)
    found = np.zeros(len(data) - ORDER + 1, np.uint64)
    for k in range(ORDER):
        found = (found << np.uint64(8)) | data[k:len(found) + k]
    ends = np.cumsum(sizes)
    whole = np.arange(len(found)) + ORDER <= np.repeat(ends, sizes)[:len(found)]
    return found[whole], np.maximum(sizes - ORDER + 1, 0)


def _runs(texts: pa.Array) -> Iterator[tuple[int, int, list]]:
    sizes = np.diff(text_bytes(texts)[1])
    for a, b in repeats.chunks(sizes, CHUNK):
        yield a, b, texts.slice(a, b - a).to_pylist()


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, fold) of the documents whose labels may be learnt from."""
    known = labels.where("toxic is not null").select(F.col("doc_id").alias("label_id"), "toxic").where(F.col("label_id").isNotNull())
    known = cut(known.groupBy("label_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(F.crc32(F.col("label_id").cast("string").cast("binary")) % 5 != 0))
    side = F.broadcast(known) if known.count() <= MAX_BROADCAST_LABELS else known
    own = docs.select("doc_id", "text", fold().alias("fold"))
    return own.where("fold <> 0").join(side, own["doc_id"] == side["label_id"]).select("doc_id", "text", "toxic", "fold")


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, n0, n1) over `texts` (text, toxic)."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            gram, n0, n1 = (np.concatenate(x) for x in zip(*held, strict=True))
            uniq, at = np.unique(gram, return_inverse=True)
            return uniq, np.bincount(at, n0, len(uniq)), np.bincount(at, n1, len(uniq))

        def batch_of(rows: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[0].view(np.int64)), *[pa.array(x.astype(np.int64)) for x in rows[1:]]], ["gram", "n0", "n1"])

        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for a, b, texts in _runs(batch.column(0)):
                found, sizes = grams(texts)
                label = np.repeat(toxic[a:b], sizes)
                uniq, at = np.unique(found, return_inverse=True)
                held.append((uniq, np.bincount(at, label == 0, len(uniq)), np.bincount(at, label > 0, len(uniq))))
            if len(held) > 8:
                held[:] = [merged()]
                if len(held[0][0]) > 2_000_000:
                    yield batch_of(held.pop())
        if held:
            yield batch_of(merged())

    counted = texts.select("text", "toxic").mapInArrow(each, "gram long, n0 long, n1 long")
    return counted.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def differences(counts: DataFrame, with_histories: bool = False) -> DataFrame | None:
    """(gram, n, d): the count of a gram and log p_toxic - log p_ordinary; None without both classes.

    With histories, also a row each, at `HISTORY` plus its bytes, for the n-grams behind it that `counts` lacks.
    """
    counts = cut(counts)
    total = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    if not total["n0"] or not total["n1"]:
        return None
    least = min(total["n0"], total["n1"])
    d0, d1 = (DISCOUNT * total[c] / least for c in ("n0", "n1"))
    low = (1 << (8 * (ORDER - 1))) - 1
    rows = counts.select("gram", "n0", "n1", F.shiftright("gram", 8).alias("h"), F.col("gram").bitwiseAND(F.lit(low)).alias("low"))
    lost = lambda n, d: F.least(F.col(n).cast("double"), F.lit(d))
    heads = rows.groupBy("h").agg(F.sum("n0").alias("h0"), F.sum("n1").alias("h1"), F.sum(lost("n0", d0)).alias("l0"), F.sum(lost("n1", d1)).alias("l1"))
    lows = rows.groupBy("low").agg(F.count("*").alias("before")).withColumn("lh", F.shiftright("low", 8))
    bases = lows.groupBy("lh").agg(F.sum("before").alias("all_before"), F.count("*").alias("types"))
    shared = lows.join(bases, "lh").select(
        "low", (F.greatest(F.col("before") - SHARED_DISCOUNT, F.lit(0.0)) / F.col("all_before") + SHARED_DISCOUNT * F.col("types") / F.col("all_before") / 256).alias("shared"))
    p = lambda n, d, h, lam: F.when(F.col(h) > 0, (F.col(n) - lost(n, d)) / F.col(h) + F.col(lam) / F.col(h) * F.col("shared")).otherwise(F.col("shared"))
    both = rows.join(heads, "h").join(shared, "low")
    seen = both.select("gram", (F.col("n0") + F.col("n1")).alias("n"), (F.log(p("n1", d1, "h1", "l1")) - F.log(p("n0", d0, "h0", "l0"))).alias("d"))
    if not with_histories:
        return seen
    back = lambda h, lam: F.when(F.col(h) > 0, F.log(F.col(lam) / F.col(h))).otherwise(0.0)
    return seen.unionByName(heads.select((F.col("h") + F.lit(HISTORY)).alias("gram"), (F.col("h0") + F.col("h1")).alias("n"), (back("h1", "l1") - back("h0", "l0")).alias("d")))


@dataclass
class Model:
    keys: np.ndarray  # of the broadcast rows, rising
    values: np.ndarray
    others: DataFrame | None  # all other rows (gram, d)

    def of(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The broadcast values at keys, and whether there is one."""
        if not len(self.keys):
            return np.zeros(len(found)), np.zeros(len(found), bool)
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        known = self.keys[at] == found
        return np.where(known, self.values[at], 0.0), known


def model_of(rows: DataFrame, most: int | None = None) -> Model:
    most = MAX_BROADCAST_ROWS if most is None else most
    rows = cut(rows)
    power = F.floor(F.log2("n")).cast("int")
    least, held = 64, 0
    for r in rows.groupBy(power.alias("power")).agg(F.count("*").alias("rows")).orderBy(F.desc("power")).collect():
        held += r["rows"]
        if held > most:
            break
        least = r["power"]
    else:
        least = 0
    table = rows.where(power >= least).select("gram", "d").toArrow()
    keys, values = table["gram"].to_numpy().astype(np.uint64), table["d"].to_numpy()
    order = np.argsort(keys)
    return Model(keys[order], values[order], rows.where(power < least).select("gram", "d") if held > most else None)


def evidence(docs: DataFrame, model: Model, points: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """The other columns of `docs` and z, the length-normalised difference of each row's text, or its place on a curve."""
    held = docs.sparkSession.sparkContext.broadcast((model.keys, model.values))
    others, types = [c for c in docs.columns if c != "text"], dict(docs.dtypes)
    head = ", ".join([*[f"{c} {types[c]}" for c in others], "sum double, size long"])
    whole = model.others is None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Model(*held.value, None)
        for batch in batches:
            for a, b, texts in _runs(batch.column(len(others))):
                found, sizes = grams(texts)
                values, known = table.of(found)
                missing = np.flatnonzero(~known)
                back, known_back = table.of((found[missing] >> np.uint64(8)) | np.uint64(HISTORY))
                if whole:
                    values[missing] = back
                sums = np.concatenate([[0.0], np.cumsum(values)])
                ends = np.cumsum(sizes)
                columns = [*[batch.column(k).slice(a, b - a) for k in range(len(others))], pa.array(sums[ends] - sums[ends - sizes]), pa.array(sizes)]
                if not whole:
                    columns.append(pa.array(_open_grams(found[missing], back, known_back, np.searchsorted(missing, ends)), OPEN))
                yield pa.RecordBatch.from_arrays(columns, [*others, "sum", "size", *([] if whole else ["open"])])

    if whole:
        summed = docs.select(*others, "text").mapInArrow(each, head)
    else:
        rows = docs.select(*others, "text").mapInArrow(each, f"{head}, open array<struct<gram:bigint,n:bigint,back:double>>")
        # A text's own row and its open n-grams go on together, so that no row is read twice; its number joins them.
        rows = rows.withColumn("row", F.monotonically_increasing_id()).select("row", *others, "sum", "size", F.explode_outer("open").alias("o")).select("row", *others, "sum", "size", "o.*")
        none = -1 - F.col("row")  # no key of any row, and spread
        by_gram = model.others.select("gram", "d")
        by_history = model.others.select(F.col("gram").alias("h"), F.col("d").alias("far"))
        rows = rows.withColumn("gram", F.coalesce("gram", none)).join(by_gram, "gram", "left")
        rows = rows.withColumn("h", F.when(F.col("d").isNull() & F.col("back").isNull() & (F.col("gram") >= 0), F.shiftright("gram", 8) + F.lit(HISTORY)).otherwise(none)).join(by_history, "h", "left")
        value = F.coalesce("d", "back", "far", F.lit(0.0)) * F.coalesce("n", F.lit(0))
        summed = rows.groupBy("row").agg(*[F.first(c).alias(c) for c in others], (F.first("sum") + F.sum(value)).alias("sum"), F.first("size").alias("size")).drop("row")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = batch.column(len(others)).to_numpy() / (batch.column(len(others) + 1).to_numpy() + PAD)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(others)], pa.array(z if points is None else on_curve(z, points))], [*others, "z"])

    return summed.mapInArrow(placed, ", ".join([*[f"{c} {types[c]}" for c in others], "z double"]))


def _open_grams(found: np.ndarray, back: np.ndarray, known: np.ndarray, ends: np.ndarray) -> list[list[dict]]:
    """For each text its different n-grams that the broadcast rows lack: n-gram, count, value of its history if that is broadcast."""
    out, start = [], 0
    for end in ends:
        keys, at, n = np.unique(found[start:end], return_index=True, return_counts=True)
        values, has = back[start:end][at], known[start:end][at]
        out.append([{"gram": int(g), "n": int(c), "back": float(v) if h else None} for g, c, v, h in zip(keys, n, values, has, strict=True)])
        start = end
    return out


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (z, share of toxic labels) of a rising curve: neighbours in z are pooled while the share would fall.

    Each pool is smoothed towards the share of all labels with the weight of one label.
    """
    order = np.argsort(z, kind="stable")
    pools: list[list[float]] = []  # sum of z, of y, number
    for value, label in zip(z[order], y[order], strict=True):
        pools.append([value, label, 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    rows, base = np.array(pools), y.mean()
    return rows[:, 0] / rows[:, 2], np.maximum.accumulate((rows[:, 1] + base) / (rows[:, 2] + 1))


def on_curve(z: np.ndarray, points: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Shares by linear interpolation; a small part follows z everywhere, so different evidence has different scores."""
    return 0.99 * np.interp(z, *points) + 0.01 / (1 + np.exp(-np.clip(8 * z, -50, 50)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per row of `docs`: doc_id, held_out, score (0 to 1) and predicted (1 if the score is 0.5 or more)."""
    known = labelled(docs, labels)
    d = differences(gram_counts(known.where("fold < 4")), with_histories=True)
    own = docs.select("doc_id", "text", (F.coalesce(fold(), F.lit(1)) == 0).alias("held_out"))
    if d is None:
        share = known.agg(F.avg("toxic")).first()[0]
        scored = own.select("doc_id", "held_out", F.lit(0.5 if share is None else float(share)).alias("score"))
    else:
        model = model_of(d)
        sample = known.where("fold = 4").select("doc_id", "toxic", "text")
        rows = evidence(sample, model).orderBy(F.xxhash64("doc_id"), "z").limit(CALIBRATION).select("toxic", "z").collect()
        y, z = np.array([r["toxic"] for r in rows], float), np.array([r["z"] for r in rows], float)
        points = calibrated(z, y) if len(set(y.tolist())) == 2 else (np.array([0.0, 0.2]), np.array([0.1, 0.9]))
        scored = evidence(own, model, points).select("doc_id", "held_out", F.col("z").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
