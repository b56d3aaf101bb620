"""Helpers that several operators share: tables in the shared folder, reading documents."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of white space that separate words where a contract says ``[^\x20\x09-\x0D]+``.
SPACE = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.  Only on one machine may it be unset (tests): then it is one of our own."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = os.path.join(tempfile.gettempdir(), "siltstone-shared")
        os.makedirs(there, exist_ok=True)
    return there.rstrip("/")


#: Tables of each session that nobody has dropped yet.
_tables: dict[str, set[str]] = {}


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and reread it: later jobs don't depend on executors' memory or shuffle files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siltstone_path = path
    _tables.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that ``table`` wrote, once nothing reads it any more."""
    path = getattr(df, "_siltstone_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _tables.get(spark.sparkContext.applicationId, set()).discard(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that the operators of this session wrote; results that weren't written elsewhere can't be read any more."""
    for path in list(_tables.get(spark.sparkContext.applicationId, ())):
        delete(spark, path)


def parts(spark: SparkSession) -> int:
    """Shuffle partitions that the session is configured for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c):
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which nulls are equal; the keys come from the left side."""
    moved = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = None
    for k in keys:
        one = left[k].eqNullSafe(moved[f"__{k}"])
        on = one if on is None else on & one
    return left.join(moved, on, how).drop(*[f"__{k}" for k in keys])
