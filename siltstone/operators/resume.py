"""Long runs in groups: results and progress are committed group by group, and a run that was stopped goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.model_calls import BackendDown

#: Groups that may fail in a row.
FAILURES = 3


class Stopped(RuntimeError):
    """Too many groups failed in a row; what was done before is committed."""


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """group, done, rows, error of every group that a run at ``path`` has come to."""
    schema = "group string, done boolean, rows long, error string"
    if not exists(spark, f"{path}/progress"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/progress")


def folder(group: str) -> str:
    """A folder name for any group."""
    return "g-" + group.encode("utf-8").hex()


def run_groups(rows: DataFrame, group: str, work: Callable[[DataFrame], DataFrame], path: str, failures: int = FAILURES) -> DataFrame:
    """The results of ``work`` on the rows of each group, of this run and of those before it at ``path`` (a shared folder).

    ``group``: a column of few values, for instance a ticker; groups come in order, null is none.  A group's results are
    overwritten and then its progress row is, so a run that was killed in between does that group once more.  Groups that are
    done are skipped.  A group of which the backend is down is noted as failed; after ``failures`` of them in a row the
    run stops, and the next run asks them again.  Other errors stop the run at once.
    """
    spark = rows.sparkSession
    known = rows.select(F.col(group).cast("string").alias("group")).where("group IS NOT NULL").distinct()
    todo = [r["group"] for r in known.join(progress(spark, path).where("done").select("group"), "group", "left_anti").orderBy("group").collect()]
    failed = 0
    for name in todo:
        where, error, n = f"{path}/results/{folder(name)}", None, 0
        try:
            work(rows.where(F.col(group).cast("string") == name)).write.mode("overwrite").parquet(where)
            n, failed = spark.read.parquet(where).count(), 0
        except Exception as e:
            if "BackendDown" not in f"{type(e).__name__}: {e}" and not isinstance(e, BackendDown):
                raise
            error, failed = str(e)[-300:], failed + 1
        row = spark.createDataFrame([(name, error is None, n, error)], "group string, done boolean, rows long, error string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{path}/progress/{folder(name)}")
        if failed >= failures:
            raise Stopped(f"{failed} groups in a row failed, the last was {name!r}; groups before them are kept at {path}")
    done = [r["group"] for r in progress(spark, path).where("done").join(known, "group", "left_semi").orderBy("group").collect()]
    if not done:
        return spark.createDataFrame([], work(rows.limit(0)).schema)
    first = spark.read.parquet(f"{path}/results/{folder(done[0])}").schema
    return spark.read.schema(first).parquet(*[f"{path}/results/{folder(g)}" for g in done])
