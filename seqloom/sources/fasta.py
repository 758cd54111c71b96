"""FASTA files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.base import InvalidInput


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def check_fasta(spark: SparkSession, path: str) -> None:
    """Raises InvalidInput unless the file exists, its first line does not end in a carriage return, and its last byte is a line feed. An empty file passes; of a folder, each file is looked at. Reads the first line and one byte."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        raise InvalidInput(f"no such file: {path}")
    status = fs.getFileStatus(p)
    if status.isDirectory():
        for s in fs.listStatus(p):
            if s.isFile() and s.getPath().getName()[0] not in "._":
                check_fasta(spark, s.getPath().toString())
        return
    size = status.getLen()
    if not size:
        return
    stream = fs.open(p)
    try:
        last = b""
        while part := stream.readNBytes(1 << 16):
            line, end, _ = part.partition(b"\n")
            last = line[-1:] or last
            if end:
                break
        if last == b"\r":
            raise InvalidInput("lines end in CR LF; LF is needed")
        stream.seek(size - 1)
        if stream.read() != 10:
            raise InvalidInput("the last line has no line end")
    finally:
        stream.close()


def read_fasta(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """(pos, name, seq, name_len, read_len) of a FASTA file, or of a folder of them by name; files are read in splits.

    Records begin at a '>' at the start of a line; a file's first line is a name even without one. A name keeps
    its '>'. Line feeds are taken out of sequences and nothing else is; a header that follows a header makes an
    empty sequence. pos counts records in the order of the files: a table of splits, one row each, has their offsets.
    """
    if check:
        check_fasta(spark, path)
    raw = spark.read.option("lineSep", "\n>").text(path)
    rows = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    before = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("file", "split").agg(F.min("at").alias("lo"), F.count("*").alias("n"))
    splits = splits.select("file", "split", "lo", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    text = F.regexp_replace("value", r"\n\z", "")
    first = (F.col("split") == 0) & (F.col("at") == F.col("lo"))
    whole = F.when(first, text).otherwise(F.concat(F.lit(">"), text))
    records = rows.join(splits, ["file", "split"]).select((F.col("offset") + F.col("at") - F.col("lo")).alias("pos"), whole.alias("whole")).where("whole <> ''")
    named = records.withColumn("name", F.substring_index(F.col("whole"), "\n", 1))
    seq = F.replace(F.expr("substring(whole, length(name) + 1)"), F.lit("\n"), F.lit(""))
    return named.select("pos", "name", seq.alias("seq")).withColumns({"name_len": F.octet_length("name"), "read_len": F.octet_length("seq")})


def write_fasta(seqs: DataFrame, path: str) -> None:
    """Sequences (name, seq) as a folder of FASTA files, each sequence on one line."""
    seqs.select(F.concat_ws("\n", "name", "seq").alias("value")).write.text(path)
