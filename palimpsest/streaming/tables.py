"""Append-only tables in folders by key bucket, for look-ups from micro-batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BucketedTable:
    """Rows by a hash bucket of ``key`` under ``path``: data/gen=G/bucket=B/batch=K.

    A batch that is run again overwrites its own folders. A look-up reads the key column of the
    buckets that its batch has. ``compact`` writes all rows to a new generation, in which a bucket
    is a few files whatever the number of batches before, and then names it in ``manifest``; readers
    go over to it with that one row. Superseded generations may be deleted by ``vacuum``.
    """

    path: str
    schema: str
    key: str
    buckets: int = 64

    def _parquet(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def generation(self, spark: SparkSession) -> int:
        rows = self._parquet(spark, "manifest", "rows bigint, gen int")
        return rows.agg(F.max("gen")).first()[0] or 0

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """All rows, or those of batches before ``before``, with their bucket."""
        rows = self._parquet(spark, "data", f"{self.schema}, gen int, bucket int, batch bigint")
        rows = rows.filter(F.col("gen") == self.generation(spark))
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        return rows.drop("gen", "batch")

    def stored_keys(self, rows: DataFrame, batch: int) -> DataFrame:
        """Keys that earlier batches wrote to the buckets of ``rows``; other buckets are not read."""
        own = rows.select(self.bucket(F.col(self.key)).alias("_bucket")).distinct()
        asked = [r["_bucket"] for r in own.collect()]  # bucket numbers
        return self.read(rows.sparkSession, batch).filter(F.col("bucket").isin(asked)).select(self.key)

    def unseen(self, rows: DataFrame, batch: int) -> DataFrame:
        """Rows whose key no earlier batch wrote; only the buckets of these rows are read."""
        return rows.join(self.stored_keys(rows, batch), self.key, "left_anti")

    def write(self, rows: DataFrame, batch: int, gen: int | None = None) -> None:
        spark = rows.sparkSession
        gen = self.generation(spark) if gen is None else gen
        placed = rows.withColumns(
            {"gen": F.lit(gen), "bucket": self.bucket(F.col(self.key)), "batch": F.lit(batch).cast("long")}
        )
        (
            placed.repartition("bucket")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("gen", "bucket", "batch")
            .parquet(f"{self.path}/data")
        )

    def compact(self, spark: SparkSession, batch: int) -> None:
        """Rewrite the rows of the batches up to ``batch``, the last that was written."""
        rows, gen = self.read(spark).drop("bucket"), self.generation(spark) + 1
        self.write(rows, batch, gen)
        count = spark.createDataFrame([(rows.count(),)], "rows bigint").coalesce(1)
        count.write.mode("overwrite").parquet(f"{self.path}/manifest/gen={gen}")

    def vacuum(self, spark: SparkSession) -> None:
        """Delete superseded generations; none may be in use."""
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for gen in range(self.generation(spark)):
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/gen={gen}")
            folder.getFileSystem(conf).delete(folder, True)
