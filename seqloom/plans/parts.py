"""The whole chain from sequences to clusters over the descriptions of parts, and its SQL.

A description has fewer than 63 residues as it is, so SQL can hold a row of the alignment's table in one long; the queries go through the
same operators as those over documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import residues as R
from ..operators import align, candidates, community, fast, graph, report
from ..operators.base import settled


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("description"))
    return candidates.rank_by_length(candidates.sequences_from_text(part, "p_partkey", "description"))


def _cand(seqs: DataFrame) -> DataFrame:
    return candidates.candidates(candidates.long_signatures(candidates.signatures(seqs)))


def _run(spark: SparkSession, sf_dir: str, identity: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sequences, candidates, hits, parents, assignments)."""
    seqs = _ranked(spark, sf_dir)
    cand = _cand(seqs)
    hits = settled(align.edges(cand, seqs, identity))
    up = settled(fast.parents(cand, hits))
    return seqs, cand, hits, up, fast.assignments(seqs, fast.roots(up))


def part_similarity_pairs(spark, sf_dir):
    seqs = _ranked(spark, sf_dir)
    pairs = align.align(candidates.distinct_pairs(_cand(seqs), 80), seqs)
    return pairs.select("rep", "tar", "lcs", (F.col("lcs") / F.greatest(F.col("rep_len") + F.col("tar_len") - F.col("lcs"), F.lit(1))).alias("similarity"))


def part_lcs_in_catalyst(spark, sf_dir):
    """The alignments of part_similarity_pairs without leaving Catalyst."""
    seqs = _ranked(spark, sf_dir).select("idx", R.residue_hex(F.col("seq")).alias("codes"))
    pairs = candidates.distinct_pairs(_cand(_ranked(spark, sf_dir)), 80)
    rep, tar = seqs.select(F.col("idx").alias("rep"), F.col("codes").alias("a")), seqs.select(F.col("idx").alias("tar"), F.col("codes").alias("b"))
    return pairs.join(rep, "rep").join(tar, "tar").select("rep", "tar", R.lcs_short(F.col("a"), F.col("b")).cast("int").alias("lcs"))


def part_edges_95(spark, sf_dir):
    return _run(spark, sf_dir, 95)[2]


def part_edges_80(spark, sf_dir):
    return _run(spark, sf_dir, 80)[2]


def part_fast_parent(spark, sf_dir):
    return _run(spark, sf_dir, 80)[3]


def part_fast_roots(spark, sf_dir):
    return _run(spark, sf_dir, 80)[4]


def part_fast_cluster_sizes(spark, sf_dir):
    return report.cluster_sizes(_run(spark, sf_dir, 80)[4])


def part_fast_compare_pairs(spark, sf_dir):
    _, cand, _, up, _ = _run(spark, sf_dir, 80)
    return fast.compare_pairs(cand, up)


def part_fast_cluster_table(spark, sf_dir):
    seqs, _, _, _, got = _run(spark, sf_dir, 80)
    return report.cluster_table(got, seqs)


def part_fast_member_order(spark, sf_dir):
    return report.member_order(_run(spark, sf_dir, 80)[4])


def part_fast_report_lines(spark, sf_dir):
    seqs, _, _, _, got = _run(spark, sf_dir, 80)
    return report.report_lines(settled(got), seqs)


def part_fast_pending(spark, sf_dir):
    _, cand, _, up, _ = _run(spark, sf_dir, 80)
    return fast.pending(cand, up).select("band", "tar", "rep")


def part_cluster_count(spark, sf_dir):
    return report.cluster_count(_run(spark, sf_dir, 80)[4])


def part_run_statistics(spark, sf_dir):
    seqs, cand, hits, up, got = _run(spark, sf_dir, 80)
    return report.run_statistics(seqs, fast.compare_pairs(cand, up), hits, got)


def part_fast_modularity(spark, sf_dir):
    _, _, hits, _, got = _run(spark, sf_dir, 80)
    edges = hits.select(F.col("rep").alias("u"), F.col("tar").alias("v"), F.lit(1.0).alias("w"))
    found = graph.modularity(edges, settled(got).select(F.col("idx").alias("node"), F.col("cluster_id").alias("comm")), community.resolution(80))
    return found.select(F.round("modularity", 9).alias("modularity"))


def part_degrees(spark, sf_dir):
    """How many similar sequences each has: the degrees of the similarity graph."""
    hits = _run(spark, sf_dir, 80)[2]
    return graph.degrees(hits.select(F.col("rep").alias("u"), F.col("tar").alias("v"), F.lit(1).cast("long").alias("w")))


QUERIES = {
    f.__name__: f
    for f in (
        part_similarity_pairs, part_lcs_in_catalyst, part_edges_95, part_edges_80, part_fast_parent, part_fast_roots, part_fast_cluster_sizes, part_fast_compare_pairs,
        part_fast_cluster_table, part_fast_member_order, part_fast_report_lines, part_fast_pending, part_cluster_count, part_run_statistics,
        part_fast_modularity, part_degrees,
    )
}


def _chain(signed: str, identity: int) -> str:
    """From candidates to clusters; signed is the SQL up to the candidates `cand` of the sequences `seqs`."""
    return f"""WITH RECURSIVE {signed}, t AS (SELECT ({identity} / 100.0)::float AS t),
pairs AS (SELECT rep, tar, any_value(rep_len) AS rep_len, any_value(tar_len) AS tar_len, min(band) AS band
          FROM cand CROSS JOIN t WHERE rep <> tar AND tar_len::float >= rep_len::float * t GROUP BY rep, tar),
codes AS (SELECT idx, translate(seq, '{R._FROM}', '{R._TO}') AS h FROM seqs),
aligned AS (SELECT rep, tar, rep_len, tar_len, band, (length(ha) - bit_count(list_reduce(list_transform(string_split(hb, ''),
    lambda c: list_sum(list_transform(range(length(ha)), lambda k: CASE WHEN substr(ha, k + 1, 1) = c AND c <> '0' THEN 1::bigint << k ELSE 0 END))::bigint),
    lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::bigint << length(ha)) - 1), (1::bigint << length(ha)) - 1)))::int AS lcs
  FROM (SELECT pairs.*, a.h AS ha, b.h AS hb FROM pairs JOIN codes a ON a.idx = rep JOIN codes b ON b.idx = tar)),
hits AS (SELECT rep, tar, band, lcs, (lcs * 100 // (rep_len + tar_len - lcs))::int AS score
         FROM aligned CROSS JOIN t WHERE lcs::float > (rep_len + tar_len - lcs)::float * t),
up AS (SELECT tar, arg_min(rep, band) AS parent, min(band) AS band FROM hits WHERE score > 0 GROUP BY tar),
walk AS (SELECT tar, parent AS node FROM up UNION ALL SELECT walk.tar, up.parent FROM walk JOIN up ON up.tar = walk.node),
got AS (SELECT idx, coalesce(root, idx) AS cluster_id FROM seqs LEFT JOIN (SELECT tar, min(node) AS root FROM walk GROUP BY tar) ON tar = idx),
reps AS (SELECT cluster_id, min(idx) AS representative, count(*) AS size FROM got GROUP BY cluster_id),
compared AS (SELECT count(*) AS compare_pairs FROM cand LEFT JOIN up ON up.tar = cand.tar WHERE cand.rep <> cand.tar AND (up.tar IS NULL OR cand.band <= up.band)),
ends AS (SELECT rep AS node FROM hits UNION ALL SELECT tar FROM hits)"""


def oracles(signed: str) -> dict[str, str]:
    low, high = _chain(signed, 80), _chain(signed, 95)
    edges = "SELECT rep, tar, band, lcs, score, (score / 100.0)::float AS weight FROM hits WHERE score > 0"
    return {
        "part_similarity_pairs": f"{low} SELECT rep, tar, lcs, lcs / greatest(rep_len + tar_len - lcs, 1) AS similarity FROM aligned",
        "part_lcs_in_catalyst": f"{low} SELECT rep, tar, lcs FROM aligned",
        "part_edges_95": f"{high} {edges}",
        "part_edges_80": f"{low} {edges}",
        "part_fast_parent": f"{low} SELECT tar, parent, band FROM up",
        "part_fast_roots": f"{low} SELECT idx, cluster_id FROM got",
        "part_fast_cluster_sizes": f"{low} SELECT cluster_id, representative, size FROM reps",
        "part_fast_compare_pairs": f"{low} SELECT compare_pairs FROM compared",
        "part_fast_cluster_table": f"{low} SELECT cluster_id, representative, idx, '>' || pos AS name, read_len FROM got JOIN reps USING (cluster_id) JOIN seqs USING (idx)",
        "part_fast_member_order": f"{low} SELECT cluster_id, idx, (row_number() OVER (PARTITION BY cluster_id ORDER BY idx) - 1)::int AS place FROM got",
        "part_fast_report_lines": f"""{low}, m AS (SELECT representative, idx, '>' || pos AS name, seq FROM got JOIN reps USING (cluster_id) JOIN seqs USING (idx))
SELECT representative, idx, 0 AS part, CASE WHEN idx = representative THEN name ELSE '  ' || name END AS line FROM m
UNION ALL SELECT representative, idx, 1, seq FROM m WHERE idx = representative""",
        "part_fast_pending": f"{low} SELECT cand.band, cand.tar, cand.rep FROM cand LEFT JOIN up ON up.tar = cand.tar WHERE cand.rep <> cand.tar AND (up.tar IS NULL OR up.band >= cand.band)",
        "part_cluster_count": f"{low} SELECT count_if(idx = cluster_id)::bigint AS clusters FROM got",
        "part_run_statistics": f"""{low} SELECT count(*) AS valid, max(read_len) AS longest, min(read_len) AS shortest, (SELECT compare_pairs FROM compared) AS compare_pairs,
  (SELECT count(*) FROM hits WHERE score > 0) AS edges, (SELECT count_if(idx = cluster_id) FROM got)::bigint AS clusters FROM seqs""",
        "part_fast_modularity": f"""{low}, mass AS (SELECT cluster_id, count(*)::double AS k FROM ends JOIN got ON idx = node GROUP BY cluster_id)
SELECT round(2 * (SELECT count(*) FROM hits JOIN got a ON a.idx = rep JOIN got b ON b.idx = tar WHERE a.cluster_id = b.cluster_id) / sum(k)
  - {community.resolution(80)!r} * sum(k * k) / (sum(k) * sum(k)), 9) AS modularity FROM mass""",
        "part_degrees": f"{low} SELECT node, count(*) AS degree FROM ends GROUP BY node",
    }
