"""Stage tables: a table is built once for each session and input, in the shared folder, and read afterwards."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_built: dict[tuple[str, str, str], str] = {}


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.  Only on one machine may it be unset: then it is one of our own."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = os.path.join(tempfile.gettempdir(), "siltstone-shared")
        os.makedirs(there, exist_ok=True)
    return there.rstrip("/")


def stage(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """The table ``name`` of ``sf_dir``, which ``build(spark, sf_dir)`` makes where this session hasn't yet."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
        build(spark, sf_dir).write.parquet(path)
        _built[key] = path
    return spark.read.parquet(_built[key])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own in the shared folder, reread: later jobs depend on neither executors nor what ``df`` was made of."""
    key = (df.sparkSession.sparkContext.applicationId, "", f"{name}-{uuid.uuid4().hex}")
    path = f"{shared(df.sparkSession)}/{key[2]}"
    df.write.parquet(path)
    _built[key] = path
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, name: str = "__k") -> DataFrame:
    """``df`` with its place (from 0) in ``order``, as a table: sorted by range, then a row's number in its partition and the sizes of the partitions before.

    Only as many counts as there are partitions meet in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, before = F.shiftright("__at", 33), W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sizes = done.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return done.withColumn("__part", part).join(sizes, "__part").withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__at", "__before")


def clear(spark: SparkSession) -> None:
    """Delete the stage tables of this session."""
    mine = spark.sparkContext.applicationId
    for key in [k for k in _built if k[0] == mine]:
        where = spark._jvm.org.apache.hadoop.fs.Path(_built.pop(key))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
