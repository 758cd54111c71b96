"""Graph steps as relations: canonical edges, degrees, weights to communities, best moves, collapse, modularity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import dense_rank_of_rows


def canonical(edges: DataFrame) -> DataFrame:
    """(u, v, w) with u <= v; edges without positive weight or with a null end are dropped."""
    return edges.where("w > 0 AND u IS NOT NULL AND v IS NOT NULL").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")


def merged(edges: DataFrame) -> DataFrame:
    """One edge per pair, with the sum of weights."""
    return canonical(edges).groupBy("u", "v").agg(F.sum("w").alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, w) from either end; a loop comes twice."""
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other"), "w"), F.struct(F.col("v").alias("node"), F.col("u").alias("other"), "w"))).alias("e")).select("e.*")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.sum("w").alias("degree"))


def total_degree(edges: DataFrame) -> DataFrame:
    return degrees(edges).agg(F.sum("degree").alias("total_degree"))


def weight_to_communities(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(node, comm, w, near): weight from a node to the communities beside it, loops left out; near is the lowest neighbour there."""
    other = member.select(F.col("node").alias("other"), "comm")
    return both_ways(edges).where("node <> other").join(other, "other").groupBy("node", "comm").agg(F.sum("w").alias("w"), F.min("other").alias("near"))


def best_moves(edges: DataFrame, member: DataFrame, gamma: float) -> DataFrame:
    """(node, old_comm, new_comm, gain): the move of each node with the largest positive gain, all judged from the same state; ties go to the community of the lowest neighbour."""
    deg = degrees(edges)
    state = member.join(deg, "node")
    mass = state.groupBy("comm").agg(F.sum("degree").alias("mass"))
    total = deg.agg(F.sum("degree")).scalar()
    ties = weight_to_communities(edges, member)
    own = ties.select("node", F.col("comm").alias("old_comm"), F.col("w").alias("w_old"))
    node = state.withColumnRenamed("comm", "old_comm").join(mass.select(F.col("comm").alias("old_comm"), F.col("mass").alias("mass_old")), "old_comm").join(own, ["node", "old_comm"], "left")
    g = F.lit(float(gamma))
    gain = (F.col("w") - g * F.col("degree") * (F.col("mass") + F.col("degree")) / total) - (
        F.coalesce("w_old", F.lit(0.0)) - g * F.col("degree") * F.col("mass_old") / total
    )
    tried = ties.join(node, "node").where("comm <> old_comm").join(mass, "comm").withColumn("gain", gain).where("gain > 0")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("gain"), "near"))
    return tried.withColumn("rank", rank).where("rank = 1").select("node", "old_comm", F.col("comm").alias("new_comm"), "gain")


def collapse(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(u, v, w) between communities; what lies within one becomes its loop."""
    a, b = member.select(F.col("node").alias("u"), F.col("comm").alias("cu")), member.select(F.col("node").alias("v"), F.col("comm").alias("cv"))
    return merged(edges.join(a, "u").join(b, "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"), "w"))


def modularity(edges: DataFrame, member: DataFrame, gamma: float) -> DataFrame:
    """One row: the modularity of a partition at a resolution."""
    deg = degrees(edges).join(member, "node").groupBy("comm").agg(F.sum("degree").alias("mass"))
    inside = collapse(edges, member).where("u = v").agg(F.coalesce(F.sum("w"), F.lit(0.0))).scalar()
    sums = deg.agg(F.sum("mass").alias("total"), F.sum(F.col("mass") * F.col("mass")).alias("squares"))
    q = 2 * inside / F.col("total") - F.lit(float(gamma)) * F.col("squares") / (F.col("total") * F.col("total"))
    return sums.select(F.when(F.col("total") > 0, q).otherwise(F.lit(0.0)).alias("modularity"))


def community_totals(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(comm, nodes, total): the nodes of each community and their total degree."""
    return degrees(edges).join(member, "node").groupBy("comm").agg(F.count("*").alias("nodes"), F.sum("degree").alias("total"))


def dense_ids(member: DataFrame) -> DataFrame:
    """(node, comm, id): communities numbered from 0 in the order of their smallest nodes. The numbers come from a range sort over one row per community."""
    first = member.groupBy("comm").agg(F.min("node").alias("first"))
    return member.join(dense_rank_of_rows(first, [F.col("first")], "id").select("comm", "id"), "comm").select("node", "comm", "id")


def composed(member: DataFrame, coarser: DataFrame) -> DataFrame:
    """(node, comm): the communities of (node, comm) followed through those of (comm, upper), as when a graph of communities has been clustered again. One that
    has no upper community stays as it is."""
    return member.join(coarser.select("comm", "upper"), "comm", "left").select("node", F.coalesce("upper", "comm").alias("comm"))
