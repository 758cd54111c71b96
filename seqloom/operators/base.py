"""Help that operators share: the scratch folder, settled intermediate tables and distributed ranks."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class InvalidInput(ValueError):
    """Parameters or files that can't be worked on at all."""


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    """Has the driver's file system remove a path when the driver ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in spark.checkpoint.dir. Only a local master, as in tests, may go without; it then gets a temporary folder. What this
    package puts there is removed when the driver ends.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("spark.checkpoint.dir", path)
        _remove_at_exit(spark, path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
        _remove_at_exit(spark, spark.sparkContext.getCheckpointDir())
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _remove_at_exit(spark, path)
    return path


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df, written as Parquet into the shared folder and read back: compressed, by the session's codec or the given one, and columns can be pruned."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a table that `written` has made, in one folder or several, and nothing reads any more."""
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more; without a collection on the driver they stay for long.

    Spark's listeners refer to the plan of the query that ended last, so an empty one comes after it.
    """
    gc.collect()
    spark.range(1).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jvm.System.gc()


def dense_rank_of_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the place, from 0, of each row in a total order, without a single-task sort.

    Rows are range-partitioned and sorted; a row's place is its partition's offset and its place there. The
    table of offsets has one row per partition. The sorted rows are written once, so the rank is fixed and what reads it
    later reads only the columns it needs.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(sorted_.withColumn("__at", F.monotonically_increasing_id()), "ranked", "zstd")
    del sorted_
    forget(df.sparkSession)
    part, own = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn(name, F.col("__before") + own).drop("__at", "__p", "__before")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by hash into four times the shuffle partitions. The number is given, so that adaptive execution doesn't
    join partitions whose rows are few but costly."""
    return df.repartition(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
