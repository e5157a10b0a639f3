"""Registered queries: embeddings and retrieval (2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.corpus import code_corpus, table
from checks.queries_enrich import rated
from riskloom.functions.vectors import hash_embed as hash_vector
from riskloom.operators import retrieval
from riskloom.session import scratch_dir, spread

DIGITS = 1_000_000


def printed(vec):
    """A vector as whole millionths, so that both engines write the same text."""
    return F.array_join(F.transform(vec, lambda x: F.round(x * DIGITS).cast("bigint").cast("string")), " ")


def documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def hash_embed(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", printed(hash_vector(F.col("text"))).alias("vec"))


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def label_queries(spark, sf_dir):
    """One query per label: the mean of the label's vectors, one average per dimension."""
    rows = table(spark, sf_dir, "embeddings")
    dim = len(rows.select("embedding").first()[0])
    means = rows.groupBy(F.col("label").alias("query")).agg(*[F.avg(F.get("embedding", F.lit(i)).cast("double")).alias(f"m{i}") for i in range(dim)])
    return means.select("query", F.array(*[f"m{i}" for i in range(dim)]).alias("vec"))


def _knn(spark, sf_dir, metric, k=3):
    out = retrieval.nearest(vectors(spark, sf_dir), label_queries(spark, sf_dir), k, metric)
    return out.select(F.col("query").alias("label"), "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def knn_cosine(spark, sf_dir):
    return _knn(spark, sf_dir, "cosine")


def knn_l2(spark, sf_dir):
    return _knn(spark, sf_dir, "l2")


def _evaluated(spark, sf_dir):
    ranked = retrieval.nearest(vectors(spark, sf_dir), label_queries(spark, sf_dir), 10)
    truths = table(spark, sf_dir, "embeddings").select(F.col("label").alias("query"), F.col("vec_id").alias("id"))
    return retrieval.evaluate(ranked, truths)


def knn_many(spark, sf_dir):
    """Every vector whose id is divisible by 20 against all vectors."""
    rows = vectors(spark, sf_dir)
    out = retrieval.nearest(rows, rows.where("id % 20 = 0").withColumnRenamed("id", "query"), 5, "l2")
    return out.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def retrieval_eval(spark, sf_dir):
    return _evaluated(spark, sf_dir).select(F.col("query").alias("label"), "hit", F.round("reciprocal_rank", 9).alias("reciprocal_rank"))


def retrieval_means(spark, sf_dir):
    return retrieval.mean_metrics(_evaluated(spark, sf_dir)).select(F.round("hit_at_k", 9).alias("hit_at_k"), F.round("mrr", 9).alias("mrr"), "queries")


def kb_with_neighbours(spark, sf_dir):
    out = retrieval.with_neighbours(rated(code_corpus(spark, sf_dir)).select("path", "seq", "type"))
    return out.select("path", "seq", "type", F.array_join(F.transform("retrieved", lambda r: r["id"]), "; ").alias("neighbours"),
                      F.round(F.col("retrieved")[0]["score"], 6).alias("best"))


def kb_search(spark, sf_dir):
    """Every document's text against the knowledge base."""
    out = retrieval.kb_neighbours(documents(spark, sf_dir), "text")
    return out.select("doc_id", F.posexplode("retrieved").alias("pos", "r")).select("doc_id", (F.col("pos") + 1).alias("rank"), "r.id", F.round("r.score", 6).alias("score"))


def flaky_embedder(texts):
    """A stand-in service: refuses batches that hold an empty text, else answers with text statistics."""
    if any(t == "" for t in texts):
        raise RuntimeError("refused")
    return [[len(t), t.count(" "), t.count("e")] for t in texts]


def embed_batch(spark, sf_dir):
    out = retrieval.embed_batch(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), flaky_embedder, dim=3)
    return out.select(F.col("id").alias("doc_id"), "origin", F.array_join(F.transform("vec", lambda x: x.cast("bigint").cast("string")), " ").alias("vec"))


def vectors_append(spark, sf_dir):
    """Benchmark items are embedded and added to the embedded documents."""
    base = retrieval.embed_batch(documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text"))
    extra = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), "text")
    return retrieval.add_entries(base, extra).select("id", F.round(F.col("vec")[0] * DIGITS).cast("bigint").alias("first"))


def vectors_roundtrip(spark, sf_dir):
    path = scratch_dir(spark, "vectors")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("text"), F.col("embedding").alias("vec"))
    retrieval.save_vectors(rows, path)
    back = retrieval.load_vectors(spark, path)
    return back.select("id", "text", printed(F.transform("vec", lambda x: x.cast("double"))).alias("vec"))


QUERIES = {f.__name__: f for f in [
    hash_embed, knn_cosine, knn_l2, knn_many, retrieval_eval, retrieval_means, kb_with_neighbours, kb_search, embed_batch, vectors_append, vectors_roundtrip,
]}
