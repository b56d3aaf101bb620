"""Structured Streaming: upserts and windowed counts that arrive file by file, in folders from which a stopped stream goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.tables import latest

#: Buckets of a table that upserts keep.
BUCKETS = 64


def arriving(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of the Parquet files below ``path``, so many at a time."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    where, fs = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions below ``path`` that were written to their end, in order."""
    found = [int(n[1:]) for n in _names(spark, path) if n[:1] == "v" and n[1:].isdigit()]
    return sorted(v for v in found if "_SUCCESS" in _names(spark, f"{path}/v{v}"))


def _manifest(spark: SparkSession, path: str, below: int | None = None) -> dict[int, int]:
    """Version of each bucket, by the last manifest (of those before ``below``)."""
    known = [v for v in versions(spark, f"{path}/manifest") if below is None or v < below]
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/manifest/v{known[-1]}").collect()} if known else {}  # a row for each bucket


def _buckets(spark: SparkSession, path: str, of: dict[int, int], schema) -> DataFrame:
    folders = [f"{path}/data/v{v}/__bucket={b}" for b, v in sorted(of.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upserted(stream: DataFrame, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The last row of each key once all that has arrived is taken in.

    The table is cut into buckets of keys.  A micro-batch merges its rows into the buckets that they touch, writes these
    as the next version, and then a manifest that names the version of every bucket; a batch that is repeated after a
    failure starts from the manifest before it and writes the same again.  What no manifest but the last two names is
    deleted.  A stream that starts again goes on from the last manifest, whether or not there is anything new; ``buckets`` must
    stay the same.
    """
    spark, schema = stream.sparkSession, stream.schema
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _manifest(spark, path, number)
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # buckets at most
        held = _buckets(spark, path, {b: v for b, v in before.items() if b in touched}, schema)
        rows = latest(batch.select(*schema.names).unionByName(held), keys, order).withColumn("__bucket", bucket)
        rows.write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/data/v{number}")
        after = before | dict.fromkeys(touched, number)
        named = spark.createDataFrame(sorted(after.items()), "bucket int, version int")
        named.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v{number}")
        for b in touched:
            if b in before:
                for v in (v for v in versions(spark, f"{path}/data") if v < before[b]):
                    old, fs = _files(spark, f"{path}/data/v{v}/__bucket={b}")
                    fs.delete(old, True)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return _buckets(spark, path, _manifest(spark, path), schema)


def windowed(stream: DataFrame, path: str, time: str, keys: list[str], width: str = "1 day", late: str = "7 days") -> DataFrame:
    """start, keys, n: rows in each window of time, once all that has arrived is taken in; rows later than ``late`` behind the newest are dropped.

    A stream that starts again goes on with the counts that it had.
    """
    counts = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v{number}")

    query = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    known = versions(spark, path)
    if not known:
        return spark.createDataFrame([], counts.schema)
    # Of each window the version of the last batch that changed it.
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").schema(counts.schema).parquet(*[f"{path}/v{k}" for k in known])
    version = F.regexp_extract(F.col("_metadata.file_path"), r"/v(\d+)/[^/]*$", 1).cast("int")
    return rows.select("*", version.alias("__v")).groupBy("start", *keys).agg(F.max_by("n", "__v").alias("n"))
