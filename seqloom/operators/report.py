"""Cluster tables, reports and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cluster_table(assigned: DataFrame, seqs: DataFrame) -> DataFrame:
    """(cluster_id, representative, idx, name, read_len): representative is the smallest idx of a cluster."""
    rep = assigned.groupBy("cluster_id").agg(F.min("idx").alias("representative"))
    return assigned.join(rep, "cluster_id").join(seqs.select("idx", "name", "read_len"), "idx").select("cluster_id", "representative", "idx", "name", "read_len")


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_id").agg(F.min("idx").alias("representative"), F.count("*").alias("size"))


def cluster_count(assigned: DataFrame) -> DataFrame:
    """One row: the number of clusters. A first-hit cluster is named by its root, so its roots are counted and nothing is grouped."""
    return assigned.agg(F.count_if(F.col("idx") == F.col("cluster_id")).alias("clusters"))


def run_statistics(seqs: DataFrame, compared: DataFrame, hits: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row about a run: valid sequences, the longest and shortest, pairs compared, edges found, and clusters. compared has one row (compare_pairs)."""
    stats = sequence_stats(seqs).select("valid", "longest", "shortest")
    return stats.withColumns({"compare_pairs": compared.scalar(), "edges": hits.agg(F.count("*")).scalar(), "clusters": cluster_count(assigned).scalar()})


def report_lines(assigned: DataFrame, seqs: DataFrame) -> DataFrame:
    """(representative, idx, part, line): the report's lines; in the order of these columns they make the text.

    A cluster begins with its representative's name and whole sequence; its other members follow by name,
    set in by two spaces. Clusters are in the order of their representatives.
    """
    rep = assigned.groupBy("cluster_id").agg(F.min("idx").alias("representative"))
    rows = assigned.join(rep, "cluster_id").join(seqs.select("idx", "name", "seq"), "idx")
    head = F.col("idx") == F.col("representative")
    lines = F.when(head, F.array("name", "seq")).otherwise(F.array(F.concat(F.lit("  "), F.col("name"))))
    return rows.select("representative", "idx", F.posexplode(lines).alias("part", "line"))


def write_report(lines: DataFrame, path: str) -> None:
    """The report as text files whose names are in order; a range partitioning spreads the sort."""
    lines.orderBy("representative", "idx", "part").select("line").write.text(path)


def sequence_stats(seqs: DataFrame) -> DataFrame:
    """One row: how many sequences there are and are valid, and the longest and shortest valid ones."""
    ok = F.col("read_len") < 65_535
    return seqs.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("valid"),
        F.max(F.when(ok, F.col("read_len"))).alias("longest"), F.min(F.when(ok, F.col("read_len"))).alias("shortest"),
    )


def member_order(assigned: DataFrame) -> DataFrame:
    """(cluster_id, idx, place) with the place of each member in its cluster."""
    return assigned.withColumn("place", F.row_number().over(Window.partitionBy("cluster_id").orderBy("idx")) - 1)
