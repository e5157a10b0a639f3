"""Training-data pipeline over `documents`; every stage calls one operator of riskloom.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before
it kept. All but the last return the columns of `documents`, extra ones included,
whatever their names; texts that a stage shortens get a new `n_chars`, where there is
such a column. Every stage reads whole texts of any length and gives an empty table
for an empty one. What else each does with nulls, ties and repeated rows it says itself.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, packing, quality_rules, simhash, suffix_dedup
from riskloom.llm.common import shared_dir, table

#: Bytes that a repeated passage must have to be cut. A passage of over 50 words has 250 or more, but for about one in a
#: hundred of the shortest-worded; the operator's own 400 bytes would leave many of them whole.
PASSAGE_BYTES = 250

ORACLE_SQL = None  # fingerprints and tokens are beyond SQL; tests/llm compares with a brute-force version


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. A null or empty text has too few words and goes; repeated rows are judged alike; a null `lang` meets the base rules only."""
    return quality_rules.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that of the smallest id, ties by its row. Null and empty texts are one group."""
    return simhash.deduplicate(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of PASSAGE_BYTES that start anywhere else; every copy goes, as ties have no first. A null text becomes an empty one."""
    return _counted(suffix_dedup.clean(docs, PASSAGE_BYTES))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of benchmark items; a document that is mostly such words goes. Null texts have none, null items no words."""
    return _counted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document; a null text is an empty one, and repeated rows each give their pieces."""
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", keep_quality),
    ("simhash", drop_near_copies),
    ("suffix_array", cut_repeated_passages),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each is written as Parquet below the shared folder and read again."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
