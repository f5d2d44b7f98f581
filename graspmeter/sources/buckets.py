"""A table of rows by key, kept in hash buckets, that micro-batches of changes update in place.

``data/gen=G/bucket=B`` has bucket B as batch G left it, ``manifest/gen=G`` names the buckets
that batch G wrote. A batch reads and writes the buckets of its own keys only; all others keep
their files. The manifest is written last, so a batch that failed on the way has changed
nothing, and a batch that is run again starts from what was there before it and overwrites its
own generation.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graspmeter.sources import state

MANIFEST = "bucket int, gen long"


class BucketStore:
    """Rows of ``schema`` with one row a ``key``; ``buckets`` bounds the files of a generation and what is known of them."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str, version: str, buckets: int = 64):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.key, self.version, self.buckets = key, version, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def manifest(self) -> DataFrame:
        """``(bucket, gen)`` of every bucket that a finished batch wrote."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def generations(self, before: int | None = None) -> dict[int, int]:
        """The newest generation of each bucket, or the newest before a batch. At most ``buckets`` rows."""
        rows = self.manifest()
        if before is not None:
            rows = rows.where(F.col("gen") < before)
        return {r.bucket: r.gen for r in rows.groupBy("bucket").agg(F.max("gen").alias("gen")).collect()}

    def _read(self, generations: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/data/gen={gen}/bucket={bucket}" for bucket, gen in sorted(generations.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self.generations())

    def apply(self, changes: DataFrame, batch_id: int) -> None:
        """Keep the newest row per key of the store and the changes, in the buckets that the changes touch.

        The newest is the one of the highest version; a change wins a tie. Changes without a key
        are left out. An empty batch writes nothing.
        """
        columns = self.schema.fieldNames()
        changes = changes.where(F.col(self.key).isNotNull()).select(*columns)
        touched = {r.bucket for r in changes.select(self.bucket().alias("bucket")).distinct().collect()}
        if not touched:
            return
        before = {bucket: gen for bucket, gen in self.generations(batch_id).items() if bucket in touched}
        merged = state.upsert(self._read(before), changes, self.key, F.col(self.version)).select(*columns, self.bucket().alias("bucket"))
        dealt = merged.repartition(min(len(touched), self.buckets), "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/gen={batch_id}")
        noted = self.spark.createDataFrame([(bucket,) for bucket in sorted(touched)], "bucket int").coalesce(1)
        noted.write.mode("overwrite").parquet(f"{self.folder}/manifest/gen={batch_id}")


def upsert_stream(changes: DataFrame, folder: str, key: str, version: str, buckets: int = 64) -> BucketStore:
    """Run a stream of changes over all available input into a bucketed table."""
    store = BucketStore(changes.sparkSession, folder, changes.schema, key, version, buckets)
    query = (
        changes.writeStream.foreachBatch(lambda batch, batch_id: store.apply(batch, batch_id))
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return store
