"""Folders and small files on whatever file system Spark writes to."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a single machine, where it is unset, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="sparkquads-"))
        found = _local[0]
    return found.rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    """A new folder's path in the shared folder. It is removed when the driver ends."""
    path = f"{shared_dir(spark)}/sparkquads/{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    except Exception:  # noqa: BLE001 - at exit the JVM may be gone
        pass


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def numbered_files(spark: SparkSession, folder: str, prefix: str) -> dict[int, str]:
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        raise FileNotFoundError(folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return {int(n[len(prefix) : -5]): f"{folder}/{n}" for n in names if n.startswith(prefix) and n.endswith(".json")}


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Written beside and renamed, so that a reader finds all of it or nothing. Fails if the file exists: of two writers
    one wins."""
    folder, _, name = path.rpartition("/")
    fs, beside = _fs(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    try:
        out.write(bytearray(json.dumps(value, indent=1).encode()))
    finally:
        out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(beside, _fs(spark, path)[1], spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Exception:
        fs.delete(beside, False)
        raise


def read_json(spark: SparkSession, path: str) -> dict:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a range or of a hash partition on average, so that a task's memory doesn't grow with the table.
PART = 1 << 19


def parts(spark: SparkSession, rows: int) -> int:
    return max(-(-rows // PART), min(spark.sparkContext.defaultParallelism, -(-rows // (PART // 8))), 1)


def ranged(df: DataFrame, rows: int, *order: str) -> DataFrame:
    """Range-partitioned and sorted, into as many partitions as the rows ask for, whatever their compressed size."""
    return df.repartitionByRange(parts(df.sparkSession, rows), *order).sortWithinPartitions(*order)


def dense_ranks(df: DataFrame, order: list[str], name: str, path: str, rows: int | None = None) -> DataFrame:
    """df with the place, from 0, of each row in the order of some columns.

    Rows are range-partitioned and sorted, stored with partition and place in it, and then numbered by the sizes of the
    partitions before, a table of as many rows as there are partitions. No task sees more than its range.
    """
    spark = df.sparkSession
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order) if rows is None else ranged(df, rows, *order)
    placed = written(ranges.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}), path)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_id").alias("low")).orderBy("_part").collect()
    start, rows = 0, []
    for r in sizes:
        rows.append((r["_part"], start - r["low"]))
        start += r["n"]
    offsets = spark.createDataFrame(rows, "_part int, _off long")
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_id") + F.col("_off")).drop("_part", "_id", "_off")
