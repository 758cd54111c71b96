"""Exact deduplication by a 128-bit content hash, with a comparison of bytes inside each hash group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, lower_ascii, others


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """Adds keep_id, group_size, kept and text_sha256 to the rows of df; no row is dropped.

    Texts are equal when identical after lower-casing A-Z. The groups are made on the 128-bit MD5
    together with the text's bytes: Spark's hash aggregate finds a group by the hash and then compares
    all bytes, so texts that collide stay apart. Copies are folded inside each map task, so a group that
    holds a third of all rows crosses the network once per task. Only groups of two or more go to the
    join, on hash and digest; a hot group's rows are split there by adaptive execution.

    Nulls: a null text counts as empty; a null id is smaller than any other id.
    Repeated rows (same id, same text) are one document: all of them carry the same answer.
    Columns of df that have the names of added columns, in any case of letters, are replaced; all others pass through. An empty table gives an empty one.
    """
    added = ("keep_id", "group_size", "kept", "text_sha256")
    kept = others(df, *added)
    text = lower_ascii(F.coalesce(col(text_col).cast("string"), F.lit("")))
    best = F.max if keep == "max" else F.min
    groups = (
        df.select(F.unhex(F.md5(text.cast("binary"))).alias("h"), text.alias("norm"), col(id_col).alias("id"))
        .groupBy("h", "norm")
        .agg(best("id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select("h", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "keep_id", "group_size")
    )
    h, gh, gs = (fresh(df, x) for x in ("__h", "__group_h", "__group_sha"))
    groups = groups.withColumnsRenamed({"h": gh, "sha": gs})
    rows = df.select(*map(col, kept), F.unhex(F.md5(text.cast("binary"))).alias(h), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    joined = rows.join(groups, (F.col(h) == F.col(gh)) & (F.col("text_sha256") == F.col(gs)), "left")
    keep_id = F.when(F.col("group_size").isNull(), col(id_col)).otherwise(F.col("keep_id"))
    return joined.select(
        *map(col, kept),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        col(id_col).eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs.select("doc_id", "text")).drop("text")


OP6_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
