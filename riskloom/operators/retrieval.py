"""Exact nearest neighbours and their evaluation.

Search is exact, so every (query, vector) score is computed, but no pair is
ever a row: blocks of queries meet blocks of vectors, and of each meeting only
the best k are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import dims
from riskloom.functions.vectors import EPSILON, HASH_DIM, hash_embed

EmbedFn = Callable[[list[str]], list[list[float]]]

BLOCK_BYTES = 2 << 20  # of numbers in a block of vectors
MAX_CELLS = 4_000_000  # scores that a task holds at a time
SCORE_DIGITS = 9  # equal vectors must tie whatever the summation order, so scores are rounded; ties go to the smaller id


def _scores(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Rows: queries, columns: vectors; larger is better for cosine, smaller for l2."""
    products = queries @ vectors.T
    if metric == "cosine":
        norms = np.linalg.norm(vectors, axis=1)[None, :] * (np.linalg.norm(queries, axis=1)[:, None] + EPSILON) + EPSILON
        return np.round(products / norms, SCORE_DIGITS)
    square = (queries**2).sum(axis=1)[:, None] + (vectors**2).sum(axis=1)[None, :]
    return np.round(np.maximum(square - 2 * products, 0.0), SCORE_DIGITS)


def _best(scores: np.ndarray, ids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row by score, then id. Only what reaches the k-th score gets sorted."""
    keyed = -scores if metric == "cosine" else scores
    k = min(k, keyed.shape[1])
    limit = np.partition(keyed, k - 1, axis=1)[:, k - 1]
    picked = np.empty((len(keyed), k), dtype=int)
    for i, row in enumerate(keyed):
        near = np.flatnonzero(row <= limit[i])
        picked[i] = near[np.lexsort((ids[i, near], row[near]))[:k]]
    return np.take_along_axis(scores, picked, axis=1), np.take_along_axis(ids, picked, axis=1)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def _packed(rows: DataFrame, name: str) -> DataFrame:
    """Rows (name, vec) as blocks (names, matrix): up to BLOCK_BYTES of numbers each, in the order they come."""
    kind = dict(rows.dtypes)[name]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: list = []
        vectors: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for key, vec in zip(batch[name], batch["vec"], strict=True):
                names.append(key)
                vectors.append(np.asarray(vec, dtype="float64"))
                size += vectors[-1].nbytes
                if size >= BLOCK_BYTES:
                    yield pd.DataFrame({"names": [names], "matrix": [np.stack(vectors).tobytes()]})
                    names, vectors, size = [], [], 0
        if names:
            yield pd.DataFrame({"names": [names], "matrix": [np.stack(vectors).tobytes()]})

    return rows.select(name, "vec").mapInPandas(pack, f"names array<{kind}>, matrix binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 3, metric: str = "cosine") -> DataFrame:
    """R2 (cosine) and R3 (l2): (query, rank, id, score), the k best vectors of each query.

    Takes vectors(id, vec) and queries(query, vec) of any size, in one job of one shape.  Both are
    packed into blocks of bounded bytes; every query block meets every vector block in a cell of a
    grid (an equi-join, whose smaller side AQE may broadcast), where a task computes the block of
    scores and keeps the k best of each query.  A ranked limit merges those.
    """
    kind, id_kind = dict(queries.dtypes)["query"], dict(vectors.dtypes)["id"]
    better = F.desc("score") if metric == "cosine" else F.asc("score")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(better, "id"))
    cells = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = lambda: F.pmod(F.xxhash64("matrix"), F.lit(cells))
    every = F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    asked = _packed(queries, "query").select(F.col("names").alias("asked"), F.col("matrix").alias("q"), every.alias("cell"))
    held = _packed(vectors, "id").select(F.col("names").alias("held"), F.col("matrix").alias("v"), place().alias("cell"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for asked, q, held, v in zip(batch["asked"], batch["q"], batch["held"], batch["v"], strict=True):
                q, v = (np.frombuffer(m).reshape(len(n), -1) for m, n in ((q, asked), (v, held)))
                step = max(1, MAX_CELLS // len(held))
                for start in range(0, len(asked), step):
                    scores = _scores(q[start:start + step], v, metric)
                    best, ids = _best(scores, np.broadcast_to(np.asarray(held), scores.shape), k, metric)
                    yield pd.DataFrame({"query": np.repeat(np.asarray(asked[start:start + step]), best.shape[1]), "id": ids.ravel(), "score": best.ravel()})

    met = asked.join(held, "cell").select("asked", "q", "held", "v")
    found = met.mapInPandas(search, f"query {kind}, id {id_kind}, score double")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def _hashed(text: str, dim: int = HASH_DIM) -> np.ndarray:
    """`hash_embed` of one text, number for number: the squares are added in the same order."""
    data = hashlib.sha256(text.encode()).digest()
    while len(data) < dim:
        data += hashlib.sha256(data).digest()
    v = np.frombuffer(data, np.uint8, dim) / 255.0
    return v / (np.sqrt(np.cumsum(v * v)[-1]) + EPSILON)


def kb_vectors(spark) -> DataFrame:
    """The knowledge base with its hash embeddings: fixed size."""
    return dims.kb(spark).select(F.col("key").alias("id"), F.col("summary").alias("text"), hash_embed(F.col("summary")).alias("vec"))


def kb_neighbours(texts: DataFrame, text: str, k: int = 3) -> DataFrame:
    """J11 against the knowledge base: adds `retrieved`, the k nearest entries of each row's text.

    The base is the fixed side, so it is held and the rows stream: no shuffle.
    """
    entries = kb_vectors(texts.sparkSession).orderBy("id").collect()
    ids, notes = pa.array([e["id"] for e in entries], pa.string()), pa.array([e["text"] for e in entries], pa.string())
    matrix = np.array([e["vec"] for e in entries])
    schema = texts.schema.simpleString()[7:-1] + ", retrieved: array<struct<id:string,score:double,text:string>>"
    names, place = [*texts.columns, "retrieved"], texts.columns.index(text)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            coded = batch.column(place).fill_null("").dictionary_encode()  # equal texts are embedded and searched once a batch
            scores = _scores(np.stack([_hashed(t) for t in coded.dictionary.to_pylist()]), matrix, "cosine")
            scores, at = _best(scores, np.broadcast_to(np.arange(len(ids)), scores.shape), k, "cosine")
            which = pa.array(at.ravel())
            near = pa.StructArray.from_arrays([ids.take(which), pa.array(scores.ravel()), notes.take(which)], ["id", "score", "text"])
            found = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * at.shape[1], pa.int32()), near)
            yield pa.RecordBatch.from_arrays([*batch.columns, found.take(coded.indices)], names)

    return texts.mapInArrow(search, schema)


def with_neighbours(findings: DataFrame, k: int = 3) -> DataFrame:
    """Adds the neighbours of each finding's type as the rows stream by; the rules behind them run once."""
    typed = findings.withColumn("__type", F.coalesce("type", F.lit("")))
    return kb_neighbours(typed, "__type", k).drop("__type")


def embed_batch(texts: DataFrame, embed_fn: EmbedFn | None = None, dim: int = HASH_DIM) -> DataFrame:
    """(id, text) -> (id, text, vec, origin) by an injected batch function; all vectors have `dim` numbers.

    A text that the function refuses, or gives another number of numbers, gets the hash embedding (origin
    `hash`).  A refused batch is asked again text by text, so the result does not depend on how rows are batched.
    """
    hashed = hash_embed(F.col("text"), dim)
    if embed_fn is None:
        return texts.select("id", "text", hashed.alias("vec"), F.lit("hash").alias("origin"))

    def ask(several: list[str]) -> list[list[float] | None]:
        try:
            vectors = [list(map(float, v)) for v in embed_fn(several)]
            if len(vectors) == len(several):
                return [v if len(v) == dim else None for v in vectors]
        except Exception:  # asked one by one, or falls back
            pass
        return [None] if len(several) == 1 else [v for text in several for v in ask([text])]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(vec=ask(list(batch["text"])) if len(batch) else [])

    served = texts.select("id", "text").mapInPandas(call, f"id {dict(texts.dtypes)['id']}, text string, vec array<double>")
    return served.select("id", "text", F.coalesce("vec", hashed).alias("vec"), F.when(F.col("vec").isNull(), "hash").otherwise("service").alias("origin"))


def add_entries(vectors: DataFrame, entries: DataFrame, embed_fn: EmbedFn | None = None) -> DataFrame:
    """The table with newly embedded (id, text) rows; nothing is embedded again."""
    return vectors.select("id", "text", "vec").unionByName(embed_batch(entries, embed_fn).select("id", "text", "vec"))


def save_vectors(vectors: DataFrame, path: str) -> None:
    """(id, text, vec) as a Parquet table."""
    vectors.select("id", "text", "vec").write.mode("errorifexists").parquet(path)


def load_vectors(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def evaluate(ranked: DataFrame, truths: DataFrame, k: int = 3, depth: int = 10) -> DataFrame:
    """Per query, hit (1 if a truth is among the first k) and reciprocal rank within `depth`.

    ranked(query, rank, id) has at least `depth` ranks; truths(query, id).
    """
    hits = ranked.where(F.col("rank") <= depth).join(truths, ["query", "id"], "left_semi")
    best = hits.groupBy("query").agg(F.min("rank").alias("first"))
    return ranked.select("query").distinct().join(best, "query", "left").select(
        "query",
        F.when(F.col("first") <= k, 1.0).otherwise(0.0).alias("hit"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def mean_metrics(evaluated: DataFrame) -> DataFrame:
    """G13."""
    return evaluated.agg(F.avg("hit").alias("hit_at_k"), F.avg("reciprocal_rank").alias("mrr"), F.count(F.lit(1)).alias("queries"))
