"""First-hit clustering: the parent of a sequence is its hit in the smallest band, a cluster the root of a chain of parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import settled


def parents(cand: DataFrame, hits: DataFrame) -> DataFrame:
    """(tar, parent, band). A pair may be a candidate in several bands; its first one counts."""
    pair = hits.select("rep", "tar", "band")
    return pair.groupBy("tar").agg(F.min_by("rep", "band").alias("parent"), F.min("band").alias("band"))


def roots(parent: DataFrame) -> DataFrame:
    """(tar, root) by pointer jumping: each round doubles the length of the chain that is followed. Parents are smaller than their children, so there is no cycle."""
    now = settled(parent.select(F.col("tar").alias("node"), F.col("parent").alias("up")))
    while True:
        up = now.select(F.col("node").alias("mid"), F.col("up").alias("next"))
        hop = now.join(up, F.col("up") == F.col("mid"), "left").select("node", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved"))
        hop = settled(hop)
        if not hop.where("moved").limit(1).count():
            return hop.select(F.col("node").alias("tar"), F.col("up").alias("root"))
        now = hop.drop("moved")


def assignments(seqs: DataFrame, root: DataFrame) -> DataFrame:
    """(idx, cluster_id) for every sequence; one without a parent is its own cluster."""
    return seqs.select("idx").join(root.withColumnRenamed("tar", "idx"), "idx", "left").select("idx", F.coalesce("root", "idx").alias("cluster_id"))


def compare_pairs(cand: DataFrame, parent: DataFrame) -> DataFrame:
    """How many alignments rounds over the bands would make: a target's candidates up to the band of its first hit."""
    first = parent.select("tar", F.col("band").alias("hit_band"))
    return cand.where("rep <> tar").join(first, "tar", "left").where(F.col("hit_band").isNull() | (F.col("band") <= F.col("hit_band"))).agg(F.count("*").alias("compare_pairs"))


def pending(cand: DataFrame, parent: DataFrame, band: int | None = None) -> DataFrame:
    """The candidates whose targets have no hit in an earlier band: what a round over their band, or over the given one, has left to align."""
    done = parent.select("tar", F.col("band").alias("done"))
    open_ = cand.where(F.col("rep") != F.col("tar")) if band is None else cand.where((F.col("band") == band) & (F.col("rep") != F.col("tar")))
    return open_.join(done, (open_["tar"] == done["tar"]) & (F.col("done") < F.col("band")), "left_anti")
