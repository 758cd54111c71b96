"""The packed data set: sequences and candidates in Parquet, made once and clustered at any identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.base import InvalidInput


def write_store(path: str, seqs: DataFrame, cand: DataFrame, bands: int, signed: DataFrame | None = None) -> None:
    """sequences/, candidates/ with a folder per band, signatures/ (idx, read_len, sigs) if given, and manifest/ with counts that readers can check.

    Candidates are dealt by band and by hash of the target, so that bands don't limit the tasks; each band has a few files.
    """
    spark = seqs.sparkSession
    seqs.write.mode("overwrite").parquet(f"{path}/sequences")
    if signed is not None:
        signed.write.mode("overwrite").parquet(f"{path}/signatures")
    slices = int(spark.conf.get("spark.sql.shuffle.partitions")) // bands + 1
    dealt = cand.repartition("band", F.pmod(F.xxhash64("tar"), F.lit(slices)))
    dealt.write.mode("overwrite").partitionBy("band").parquet(f"{path}/candidates")
    n, m = spark.read.parquet(f"{path}/sequences").count(), spark.read.parquet(f"{path}/candidates").count()
    spark.createDataFrame([(n, m, bands)], "sequences long, candidates long, bands int").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """(idx, read_len, sigs) as they were stored: sequences can be grouped anew or looked up without signing again."""
    return spark.read.parquet(f"{path}/signatures")


def read_store(spark: SparkSession, path: str, bands: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(sequences, candidates) with the first `bands` bands only; other bands' folders are not read."""
    cand = spark.read.parquet(f"{path}/candidates")
    return spark.read.parquet(f"{path}/sequences"), cand if bands is None else cand.where(cand.band < bands)


def check_store(spark: SparkSession, path: str) -> dict:
    """The manifest; raises InvalidInput if the store is empty or its row counts differ from it."""
    m = spark.read.json(f"{path}/manifest").first()
    seqs, cand = read_store(spark, path)
    if not m or not m["sequences"] or (seqs.count(), cand.count()) != (m["sequences"], m["candidates"]):
        raise InvalidInput(f"{path} is empty or incomplete")
    return m.asDict()
