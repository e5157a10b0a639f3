"""Sharding by a permutation-filled lookup table, in DataFrame functions only.

Each shard walks the slots of a table of prime size in an order of its own
(`(offset + turn * skip) mod size`, both from hashes of its name).  The shards
take turns, a shard of weight w in w turns of each round, and claim the next slot
of their order that is still free.  All shards get nearly equal parts, and a
shard that comes or goes moves few documents of the others.

The table is built once on the driver: its size is a parameter, at most
`MAX_SLOTS`, and does not depend on the documents.  It is broadcast, and a
document finds its shard by one probe with the hash of its id: no shuffle.

Equal ids share a shard, so repeated rows stay together; a null id counts as the
text "null".  Other columns pass through `place` unless named `slot` or `shard`,
which give way to the result's.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS, SHARDS, MAX_SLOTS = 4099, 32, 1_000_003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def fill(names: list[str], weights: list[int] | None = None, slots: int = SLOTS) -> list[int]:
    """The owner of each slot, as an index into `names`."""
    if slots > MAX_SLOTS or slots < 3 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the number of slots must be a prime from 3 to {MAX_SLOTS}")
    if not names or len(set(names)) < len(names) or len(names) > slots:
        raise ValueError("shards need different names, and at least one slot each")
    weights = weights or [1] * len(names)
    if len(weights) != len(names) or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("each shard needs a weight of 0 or more, and one of them more than 0")
    at = [_number(f"offset {name}") % slots for name in names]
    skip = [_number(f"skip {name}") % (slots - 1) + 1 for name in names]
    owner, left = [-1] * slots, slots
    while left:
        for k, weight in enumerate(weights):
            for _ in range(min(weight, left)):
                while owner[at[k]] >= 0:
                    at[k] = (at[k] + skip[k]) % slots
                owner[at[k]] = k
                left -= 1
    return owner


def lookup(spark: SparkSession, names: list[str], weights: list[int] | None = None, slots: int = SLOTS) -> DataFrame:
    """The table as rows (slot, shard)."""
    owners = ",".join(map(str, fill(names, weights, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner")).select("slot", F.col("owner").cast("int").alias("shard"))


def slot_of(doc_id: Column, slots: int = SLOTS) -> Column:
    """32 bits of the id's MD5, modulo the table's size."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("int")


def place(docs: DataFrame, names: list[str], weights: list[int] | None = None, slots: int = SLOTS) -> DataFrame:
    """`docs` with `slot` and `shard` (an index into `names`)."""
    table = lookup(docs.sparkSession, names, weights, slots)
    own = docs.drop("slot", "shard").withColumn("slot", slot_of(F.col("doc_id"), slots))
    return own.join(F.broadcast(table), "slot").select(*[F.col(f"`{c}`") for c in own.columns], "shard")


def write(docs: DataFrame, path: str, names: list[str], weights: list[int] | None = None, slots: int = SLOTS, files_per_shard: int = 8) -> None:
    """Parquet in a folder per shard. Slots are spread over a shard's files, so no task writes a whole shard."""
    placed = place(docs, names, weights, slots).withColumn("file", F.pmod(F.xxhash64("doc_id"), F.lit(files_per_shard)))
    placed.repartition("shard", "file").drop("file").write.partitionBy("shard").parquet(path)
