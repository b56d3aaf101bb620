"""Files in and out: encodings, whole texts, references, column-oriented JSON, line JSON, tables by level, additive data sets, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.store import shared

#: What bytes 80 to 9F mean in the Windows code page (those that it leaves undefined stay control characters).
C1 = "".join(chr(k) for k in range(0x80, 0xA0))
WINDOWS = bytes(range(0x80, 0xA0)).decode("cp1252", errors="surrogateescape")
WINDOWS = "".join(c if ord(c) < 0xD800 or ord(c) > 0xDFFF else C1[k] for k, c in enumerate(WINDOWS))


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8, or the Windows code page where they aren't UTF-8."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(utf8, F.translate(F.decode(content, "ISO-8859-1"), C1, WINDOWS))


def trimmed_html(html: Column) -> Column:
    """A page without what follows its end."""
    return F.regexp_replace(html, "(?is)</html>.*", "</html>")


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """path, html of every file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", decoded(F.col("content")).alias("html"))


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """path, md of every file below ``path``, whole."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("md"))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``df`` with columns renamed; names that it doesn't have are left out of account."""
    return df.withColumnsRenamed(names)


def reference(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A CSV file with a header, its columns renamed; all are text."""
    return renamed(spark.read.csv(path, header=True, quote='"', escape='"'), columns).select(*columns.values())


def tagged(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files below ``path`` with source_file: the folder that each row comes from."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return rows.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("source_file"))


def from_columns(text: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, ord (number), ``fields``: the rows of column-oriented JSON ({field: {ord: value}}) in ``json``; rows in order of the number, not of its digits."""
    parsed = text.select(key, F.from_json("json", "map<string,map<string,string>>").alias("m"))
    ords = F.array_distinct(F.flatten(F.transform(F.map_values("m"), lambda v: F.map_keys(v))))
    rows = parsed.select(key, "m", F.explode(ords).alias("o"))
    return rows.select(key, F.col("o").cast("int").alias("ord"), *[F.try_element_at(F.try_element_at("m", F.lit(f)), F.col("o")).alias(f) for f in fields])


def matching_lines(rows: DataFrame, company: str, year: str) -> DataFrame:
    """Rows of line JSON whose company holds ``company`` and whose doc_name holds ``year``, in any case."""
    return rows.where(F.lower("company").contains(company.lower()) & F.lower("doc_name").contains(year.lower()))


def write_levels(chunks: DataFrame, path: str | None) -> None:
    """A table with a folder for each level, so that one level is read alone; no path, no table."""
    if path is not None:
        chunks.write.partitionBy("level").mode("overwrite").parquet(path)


def append_new(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose key the data set at ``path`` lacks (of several rows of a key, one).  A crash leaves the data set as it was."""
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fresh = rows.dropDuplicates(keys)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        fresh = fresh.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    fresh.write.mode("append").parquet(path)


def lookup(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the given ids; ids without a row are silently absent."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def delete(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def missing(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Ids that no row has."""
    return ids.select(key).distinct().join(rows.select(key), key, "left_anti")


def move(source: DataFrame, dest: DataFrame, ids: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(source, destination, report) after moving ``ids``: rows are written to the destination's new table, read back, and only what is there leaves the source.

    report: key, state (moved, missing: no such row in the source).  Rows of the destination with a moved id are replaced.
    """
    spark = source.sparkSession
    going = lookup(source, ids, key)
    path = f"{shared(spark)}/{name}"
    delete(dest, going, key).unionByName(going).write.mode("overwrite").parquet(path)
    there = spark.read.parquet(path)
    confirmed = lookup(going, there, key).select(key).distinct()
    report = ids.select(key).distinct().join(confirmed.withColumn("state", F.lit("moved")), key, "left").na.fill("missing", ["state"])
    return delete(source, confirmed, key), there, report


def with_ids(rows: DataFrame, parts: list[str], column: str = "id") -> DataFrame:
    """``rows`` with an id that follows from ``parts`` where there is none."""
    own = F.sha1(F.concat_ws("/", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]))
    return rows.withColumn(column, F.coalesce(F.col(column), own) if column in rows.columns else own)


def with_provenance(rows: DataFrame, commit: str, dirty: bool) -> DataFrame:
    """``rows`` with the code's commit (8 characters) and whether it had changes."""
    return rows.withColumns({"code_commit": F.lit(commit[:8]), "code_dirty": F.lit(dirty)})


def write_sheets(sheets: dict[str, DataFrame], path: str) -> dict[str, str]:
    """One Parquet table for each sheet of a report, below ``path``; says where each is."""
    out = {}
    for name, df in sheets.items():
        out[name] = f"{path}/{name}"
        df.write.mode("overwrite").parquet(out[name])
    return out


def create_levels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An empty table with a folder for each level, unless there is one at ``path``; either way what it holds."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def batched(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with batch: a number for every ``size`` successive rows of a partition (no batch spans two)."""
    at = F.monotonically_increasing_id()
    return rows.withColumn("__at", at).withColumn("batch", F.shiftright("__at", 33) * 2**32 + F.floor((F.col("__at") % F.lit(2**33)) / size)).drop("__at")


def batch_call(rows: DataFrame, column: str, call, threads: int = 8) -> DataFrame:
    """``rows`` with reply: ``call(text)`` for each row, several at a time, in order.  A row whose call fails has ""; a batch of which every call fails stops the job."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType())])

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        def one(text):
            try:
                return call(text)
            except Exception as e:  # a failed call is a value here, unless all fail
                return e

        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                found = list(pool.map(one, pdf[column]))
                failed = [x for x in found if isinstance(x, Exception)]
                if failed and len(failed) == len(found):
                    raise RuntimeError("every call of a batch failed") from failed[0]
                yield pdf.assign(reply=["" if isinstance(x, Exception) else x for x in found])

    return rows.mapInPandas(run, schema)
