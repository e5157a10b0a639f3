"""A stored table with one row per key that is changed by rewriting the buckets a batch touches.

Rows lie in hash buckets of the key; a manifest names the current folder of every
bucket.  A change reads the buckets of its keys, writes new folders for those that
change and publishes the next manifest in one step: readers see all of it or
nothing, and a reader of an older manifest keeps its files.  Two writers that
change different buckets both succeed; one that lost a bucket to another computes
its change again on the new rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.session import scratch_dir
from riskloom.sources.commit_log import CommitLog, Folder

BUCKETS = 64
Transaction = tuple[str, int]  # name of a writer, number of its batch
Plan = Callable[[dict], tuple[set[int], set[int], DataFrame]]  # manifest -> buckets read, buckets written, their new rows


class KeyedTable:
    """`key` names the table's key, `order` the column by which the latest of several writes of a key is told.

    The number of buckets is fixed when the table is made: choose it so that a bucket is
    a few hundred megabytes at the size the table will reach.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "session_id", order: str = "last_active", buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.order = spark, path, schema, key, order
        self.log, self.data = CommitLog(spark, path + "/_manifest"), Folder(spark, path + "/data")
        self.log.publish(0, {"n": buckets, "key": key, "buckets": {}, "dropped": [], "writers": {}, "cleaned": 0})
        made = self.log.read(0)
        if made["key"] != key:
            raise ValueError(f"{path} is keyed by {made['key']}, not {key}")
        self.n = made["n"]

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)), F.lit(self.n)).cast("int")

    def rows(self, manifest: dict | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The table as of a manifest (the newest), or some of its buckets."""
        current = (manifest or self.log.latest()[1])["buckets"]
        wanted = current if buckets is None else {str(b) for b in buckets} & current.keys()
        paths = [f"{self.path}/data/{current[b]}/bucket={b}" for b in sorted(wanted)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def lookup(self, key: Any) -> DataFrame:
        """One key's row. Reads its bucket, whose files are sorted by key and carry a Bloom filter of it."""
        at = self.spark.range(1).select(self.bucket(F.lit(key))).first()[0]
        return self.rows(buckets=[at]).where(F.col(self.key) == F.lit(key).cast(self.schema[self.key].dataType))

    def upsert(self, updates: DataFrame, writer: Transaction | None = None) -> int:
        """Write rows over those of their keys; of several rows of a key the latest stays. Returns the manifest's number.

        The updates of a key are combined before they are shuffled, so a hot key is one row
        per task. Equal times are settled by the rows' contents.
        """
        rest = [c for c in self.schema.names if c != self.key]
        typed = updates.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        latest = F.max_by(F.struct(*rest), F.struct(self.order, F.to_json(F.struct(*rest))))
        staged, name = self._staged(typed.groupBy(self.key).agg(latest.alias("last")).select(self.key, "last.*"))

        def plan(manifest: dict) -> tuple[set[int], set[int], DataFrame]:
            touched = self._buckets_of(staged)
            old = self.rows(manifest, touched).join(staged.select(F.col(self.key).alias("__new")), F.col(self.key).eqNullSafe(F.col("__new")), "left_anti")
            return touched, touched, old.unionByName(staged.select(*self.schema.names))

        return self._commit(plan, writer, name)

    def delete(self, keys: DataFrame, writer: Transaction | None = None) -> int:
        """Remove the rows of some keys. Buckets that hold none of them stay as they are."""
        staged, name = self._staged(keys.select(F.col(self.key).cast(self.schema[self.key].dataType).alias(self.key)).distinct())

        def plan(manifest: dict) -> tuple[set[int], set[int], DataFrame]:
            asked = self._buckets_of(staged)
            there = self.rows(manifest, asked).select(self.key)
            named = staged.select(F.col(self.key).alias("__gone"))
            touched = self._buckets_of(there.join(named, F.col(self.key).eqNullSafe(F.col("__gone")), "left_semi"))
            kept = self.rows(manifest, touched).join(named, F.col(self.key).eqNullSafe(F.col("__gone")), "left_anti")
            return asked, touched, kept

        return self._commit(plan, writer, name)

    def clean(self, keep: int = 2) -> int:
        """Remove the folders that the manifests before the last `keep` replaced; returns their number.

        Folders of a writer that died before publishing are in no manifest and stay.
        """
        number, manifest = self.log.latest()
        upto = number - keep + 1
        if upto <= manifest["cleaned"]:
            return 0
        gone = [folder for n in range(manifest["cleaned"] + 1, upto + 1) for folder in self.log.read(n)["dropped"]]
        for folder in gone:
            self.data.remove(folder)
        while not self.log.publish(number + 1, {**manifest, "dropped": [], "cleaned": max(upto, manifest["cleaned"])}):
            number, manifest = self.log.latest()
        return len(gone)

    def _staged(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """Written once: a change that is computed again must not ask its input again."""
        name = scratch_dir(self.spark, "changes")
        rows.write.parquet(name)
        return self.spark.read.schema(rows.schema).parquet(name), name

    def _buckets_of(self, rows: DataFrame) -> set[int]:
        """At most as many rows as there are buckets."""
        return {r[0] for r in rows.select(self.bucket(F.col(self.key)).alias("b")).distinct().collect()}

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """New folders for the buckets of some rows. Buckets are even, as every key has one row; so one task writes a bucket."""
        version = uuid.uuid4().hex
        (rows.withColumn("bucket", self.bucket(F.col(self.key))).repartition("bucket").sortWithinPartitions("bucket", self.key)
         .write.partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(f"{self.path}/data/{version}"))
        return {name.rsplit("=", 1)[1]: version for name in self.data.names(f"{version}/bucket=*")}

    def _commit(self, plan: Plan, writer: Transaction | None, staged: str) -> int:
        def seen(manifest: dict) -> bool:
            return writer is not None and manifest["writers"].get(writer[0], -1) >= writer[1]

        def settle() -> int:
            while True:
                number, base = self.log.latest()
                if seen(base):  # a batch that is replayed after a crash
                    return number
                read, touched, rows = plan(base)
                if not touched and writer is None:
                    return number
                new = self._write(rows) if touched else {}
                dropped = [f"{v}/bucket={b}" for b, v in base["buckets"].items() if int(b) in touched]
                manifest = base
                while True:
                    kept = {b: v for b, v in manifest["buckets"].items() if int(b) not in touched}
                    writers = {**manifest["writers"], **({writer[0]: writer[1]} if writer else {})}
                    if self.log.publish(number + 1, {**manifest, "buckets": {**kept, **new}, "dropped": dropped, "writers": writers}):
                        return number + 1
                    number, manifest = self.log.latest()
                    if seen(manifest) or any(base["buckets"].get(str(b)) != manifest["buckets"].get(str(b)) for b in read):
                        for version in set(new.values()):
                            self.data.remove(version)
                        break

        try:
            return settle()
        finally:
            Folder(self.spark, staged).remove(".")
