"""The registered queries of the sequence engine and their SQL.

Sequences are whole documents, projected to residues. Graph steps work on the suppliers and parts of line items.
Queries that align documents, and those that follow from such alignments, have no SQL: the tests hold them against brute force, and `parts`
has the same queries over shorter texts with SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import residues as R
from ..operators import align, candidates, community, fast, graph, report, words
from ..operators.base import scratch, settled, written
from ..operators.components import components
from ..sources import fasta, store
from . import parts

GAMMA = 0.5


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.sequences_from_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.rank_by_length(_raw(spark, sf_dir))


def _long(seqs: DataFrame, bands: int = R.BANDS) -> DataFrame:
    return candidates.long_signatures(candidates.signatures(seqs, bands))


def _cand(seqs: DataFrame, bands: int = R.BANDS) -> DataFrame:
    return candidates.candidates(_long(seqs, bands))


def _hits(seqs: DataFrame, cand: DataFrame, identity: int, spend: bool = False) -> DataFrame:
    return settled(align.edges(cand, seqs, identity, spend))


def _fast(spark: SparkSession, sf_dir: str, identity: int = 95) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    seqs = _ranked(spark, sf_dir)
    cand = _cand(seqs)
    up = settled(fast.parents(cand, _hits(seqs, cand, identity)))
    return seqs, cand, up, fast.assignments(seqs, fast.roots(up))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select((F.col("l_partkey") + 1_000_000).cast("long").alias("u"), F.col("l_suppkey").cast("long").alias("v"), F.col("l_quantity").alias("w"))


def _member(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    return nodes.withColumn("comm", F.pmod("node", F.lit(10)))


def seq_lengths(spark, sf_dir):
    return _raw(spark, sf_dir).select("pos", "name_len", "read_len")


def length_filter(spark, sf_dir):
    return candidates.length_filter(_raw(spark, sf_dir)).select("pos", "read_len")


def seq_stats(spark, sf_dir):
    return report.sequence_stats(_raw(spark, sf_dir))


def length_rank(spark, sf_dir):
    return candidates.rank_by_length(_raw(spark, sf_dir)).select("idx", "pos", "read_len")


def encode_residues(spark, sf_dir):
    text = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return candidates.sequences_from_text(text, project=False).select("pos", R.residue_hex(F.col("seq")).alias("codes"))


def residue_histogram(spark, sf_dir):
    one = _raw(spark, sf_dir).select(F.explode(F.split(R.residue_hex(F.col("seq")), "")).alias("code")).where("code <> ''")
    return one.groupBy("code").agg(F.count("*").alias("n"))


def pack_bitplanes(spark, sf_dir):
    """Four planes of 32 residues each, bit k of a plane for the k-th residue of the chunk."""
    codes = _raw(spark, sf_dir).select("pos", R.residue_hex(F.col("seq")).alias("codes")).where("length(codes) > 0")
    chunk = codes.select("pos", "codes", F.explode(F.expr("sequence(0, (length(codes) - 1) div 32)")).alias("chunk"))
    cut = chunk.select("pos", "chunk", F.expr("substring(codes, chunk * 32 + 1, 32)").alias("c"))
    digit = lambda k: F.conv(F.substring("c", k + 1, F.lit(1)), 16, 10).cast("long")
    plane = lambda p: F.aggregate(
        F.sequence(F.lit(0), F.length("c") - 1), F.lit(0).cast("long"), lambda a, k: a + F.call_function("shiftleft", F.shiftright(digit(k), p).bitwiseAND(F.lit(1).cast("long")), k)
    )
    return cut.select("pos", "chunk", *[plane(p).alias(f"plane{p}") for p in range(4)])


def kmers(spark, sf_dir):
    pos = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("pos"))
    return words.word_statistics(_raw(spark, sf_dir), pos)


def kmer_counts(spark, sf_dir):
    return words.word_counts(_raw(spark, sf_dir))


def hash_kmers(spark, sf_dir):
    return words.word_hashes(_raw(spark, sf_dir), (0, 1, 2, 63))


def minhash_signatures(spark, sf_dir):
    return _long(_ranked(spark, sf_dir)).select("idx", "band", "sig")


def bucket_sizes(spark, sf_dir):
    return _long(_ranked(spark, sf_dir)).groupBy("band", "sig").agg(F.count("*").alias("n"), F.min("idx").alias("head"))


def candidates_lag(spark, sf_dir):
    return _cand(_ranked(spark, sf_dir)).select("band", "tar", "rep")


def candidate_counts_by_band(spark, sf_dir):
    return _cand(_ranked(spark, sf_dir)).where("rep <> tar").groupBy("band").agg(F.count("*").alias("n"))


def distinct_pairs(spark, sf_dir):
    return candidates.distinct_pairs(_cand(_ranked(spark, sf_dir))).select("rep", "tar", "band")


def length_filtered_pairs(spark, sf_dir):
    return candidates.distinct_pairs(_cand(_ranked(spark, sf_dir)), 95).select("rep", "tar", "rep_len", "tar_len")


def band_pruned_candidates(spark, sf_dir):
    return _cand(_ranked(spark, sf_dir), 16).where("rep <> tar").select("band", "tar", "rep")


def running_offsets(spark, sf_dir):
    """Where each record's text would begin in a file of records in the order of idx: prefix sums by partition, then within."""
    seqs = candidates.rank_by_length(_raw(spark, sf_dir)).select("idx", (F.col("name_len") + F.col("read_len") + 2).cast("long").alias("bytes")).withColumn("part", F.expr("idx div 4096"))
    past = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = seqs.groupBy("part").agg(F.sum("bytes").alias("b")).select("part", F.coalesce(F.sum("b").over(past), F.lit(0)).alias("base"))
    own = Window.partitionBy("part").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return seqs.join(base, "part").select("idx", "bytes", (F.col("base") + F.coalesce(F.sum("bytes").over(own), F.lit(0))).alias("start"))


def similarity_pairs(spark, sf_dir):
    seqs = _ranked(spark, sf_dir)
    cand = _cand(seqs)
    pairs = align.align(candidates.distinct_pairs(cand, 95), seqs, spent=cand)
    return pairs.select("rep", "tar", "lcs", (F.col("lcs") / F.greatest(F.col("rep_len") + F.col("tar_len") - F.col("lcs"), F.lit(1))).alias("similarity"))


def edges_95(spark, sf_dir):
    seqs = _ranked(spark, sf_dir)
    return align.edges(_cand(seqs), seqs, 95)


def edges_80(spark, sf_dir):
    seqs = _ranked(spark, sf_dir)
    return align.edges(_cand(seqs), seqs, 80)


def fast_parent(spark, sf_dir):
    return _fast(spark, sf_dir)[2]


def fast_roots(spark, sf_dir):
    return _fast(spark, sf_dir)[3]


def fast_cluster_sizes(spark, sf_dir):
    return report.cluster_sizes(_fast(spark, sf_dir)[3])


def fast_compare_pairs(spark, sf_dir):
    _, cand, up, _ = _fast(spark, sf_dir)
    return fast.compare_pairs(cand, up)


def fast_cluster_table(spark, sf_dir):
    seqs, _, _, got = _fast(spark, sf_dir)
    return report.cluster_table(got, seqs)


def fast_member_order(spark, sf_dir):
    return report.member_order(_fast(spark, sf_dir)[3])


def fast_report_lines(spark, sf_dir):
    seqs, _, _, got = _fast(spark, sf_dir)
    return report.report_lines(settled(got), seqs)


def fast_modularity(spark, sf_dir):
    seqs = _ranked(spark, sf_dir)
    cand = _cand(seqs)
    hits = _hits(seqs, cand, 80)
    got = settled(fast.assignments(seqs, fast.roots(fast.parents(cand, hits))))
    edges = hits.select(F.col("rep").alias("u"), F.col("tar").alias("v"), F.lit(1.0).alias("w"))
    return graph.modularity(edges, got.select(F.col("idx").alias("node"), F.col("cluster_id").alias("comm")), community.resolution(80))


def _communities(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    seqs = _ranked(spark, sf_dir)
    return seqs, settled(community.community_clusters(seqs, _hits(seqs, _cand(seqs), 80, spend=True), 80))


def leiden_clusters(spark, sf_dir):
    return _communities(spark, sf_dir)[1]


def leiden_report(spark, sf_dir):
    seqs, got = _communities(spark, sf_dir)
    return report.report_lines(got, seqs)


def edge_canonicalise(spark, sf_dir):
    return graph.canonical(_graph(spark, sf_dir)).groupBy("u", "v", "w").agg(F.count("*").alias("n"))


def multi_edge_merge(spark, sf_dir):
    return graph.merged(_graph(spark, sf_dir))


def degree(spark, sf_dir):
    return graph.degrees(_graph(spark, sf_dir))


def total_degree(spark, sf_dir):
    return graph.total_degree(_graph(spark, sf_dir))


def neighbour_comm_weight(spark, sf_dir):
    edges = graph.merged(_graph(spark, sf_dir))
    return graph.weight_to_communities(edges, _member(edges))


def best_move_step(spark, sf_dir):
    edges = graph.merged(_graph(spark, sf_dir))
    got = graph.best_moves(edges, _member(edges), GAMMA)
    return got.select("node", "old_comm", "new_comm", F.round("gain", 6).alias("gain"))


def collapse_step(spark, sf_dir):
    edges = graph.merged(_graph(spark, sf_dir))
    return graph.collapse(edges, _member(edges))


def modularity(spark, sf_dir):
    edges = graph.merged(_graph(spark, sf_dir))
    return graph.modularity(edges, _member(edges), GAMMA).select(F.round("modularity", 9).alias("modularity"))


def community_totals(spark, sf_dir):
    edges = graph.merged(_graph(spark, sf_dir))
    return graph.community_totals(edges, _member(edges))


def dense_community_ids(spark, sf_dir):
    """Communities are the best moves' targets, numbered by first appearance."""
    edges = graph.merged(_graph(spark, sf_dir))
    member = _member(edges)
    moves = graph.best_moves(edges, member, GAMMA).select("node", F.col("new_comm").alias("moved"))
    return graph.dense_ids(member.join(moves, "node", "left").select("node", F.coalesce("moved", "comm").alias("comm")))


def composed_communities(spark, sf_dir):
    """Members of communities after these have moved themselves on the collapsed graph."""
    edges = graph.merged(_graph(spark, sf_dir))
    member = _member(edges)
    above = graph.collapse(edges, member)
    each = member.select(F.col("comm").alias("node")).distinct().withColumn("comm", F.pmod("node", F.lit(3)) + 100)
    moves = graph.best_moves(above, each, GAMMA).select(F.col("node").alias("comm"), F.col("new_comm").alias("upper"))
    return graph.composed(member, moves)


def connected_components(spark, sf_dir):
    """Documents that meet in a bucket of any band, directly or over others."""
    cand = _cand(_ranked(spark, sf_dir)).where("rep <> tar")
    return components(cand.select(F.col("rep").alias("a"), F.col("tar").alias("b"))).select("node", "root")


def fasta_round_trip(spark, sf_dir):
    """Documents written as FASTA files and scanned again."""
    path = scratch(spark, "fasta")
    fasta.write_fasta(_raw(spark, sf_dir), path)
    return fasta.read_fasta(spark, path).select("name", F.md5(F.col("seq").cast("binary")).alias("seq_md5"), "name_len", "read_len")


def packed_store(spark, sf_dir):
    """The packed data set of all bands written, and its first sixteen bands read again; names come from the stored sequences."""
    path = scratch(spark, "store")
    seqs = _ranked(spark, sf_dir)
    signed = written(candidates.signatures(seqs), "signed")
    store.write_store(path, seqs, candidates.candidates(candidates.long_signatures(signed)), R.BANDS, signed)
    store.check_store(spark, path)
    stored, cand = store.read_store(spark, path, 16)
    name = stored.select(F.col("idx").alias("tar"), "name")
    return cand.where("rep <> tar").join(name, "tar").select("band", "tar", "rep", "name")


def stored_signatures(spark, sf_dir):
    """Bucket heads from the stored signatures of a packed data set, without signing again."""
    path = scratch(spark, "store")
    seqs = _ranked(spark, sf_dir)
    signed = written(candidates.signatures(seqs), "signed")
    store.write_store(path, seqs, candidates.candidates(candidates.long_signatures(signed)), R.BANDS, signed)
    again = candidates.long_signatures(store.read_signatures(spark, path))
    return again.groupBy("band", "sig").agg(F.count("*").alias("n"), F.min("idx").alias("head"))


def lcs_of_names(spark, sf_dir):
    """The LCS of the names of nations in one region, without leaving Catalyst."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey", R.residue_hex(F.col("n_name")).alias("h"))
    a, b = n.select(F.col("n_nationkey").alias("a"), "n_regionkey", F.col("h").alias("ha")), n.select(F.col("n_nationkey").alias("b"), "n_regionkey", F.col("h").alias("hb"))
    return a.join(b, "n_regionkey").where("a < b").select("a", "b", R.lcs_short(F.col("ha"), F.col("hb")).cast("int").alias("lcs"))


def fast_pending(spark, sf_dir):
    seqs = _ranked(spark, sf_dir)
    cand = _cand(seqs)
    return fast.pending(cand, fast.parents(cand, _hits(seqs, cand, 95))).select("band", "tar", "rep")


QUERIES = {
    f.__name__: f
    for f in (
        seq_lengths, length_filter, seq_stats, length_rank, encode_residues, residue_histogram, pack_bitplanes, kmers, kmer_counts,
        hash_kmers, minhash_signatures, bucket_sizes, candidates_lag, candidate_counts_by_band, distinct_pairs, length_filtered_pairs,
        band_pruned_candidates, running_offsets, similarity_pairs, edges_95, edges_80, fast_parent, fast_roots, fast_cluster_sizes,
        fast_compare_pairs, fast_cluster_table, fast_member_order, fast_report_lines, fast_modularity, leiden_clusters, leiden_report,
        edge_canonicalise, multi_edge_merge, degree, total_degree, neighbour_comm_weight, best_move_step, collapse_step, modularity,
        community_totals, dense_community_ids, composed_communities, connected_components, fasta_round_trip, packed_store, stored_signatures, lcs_of_names, fast_pending,
    )
}
QUERIES.update(parts.QUERIES)

_RAW = f"""raw AS (
  SELECT doc_id AS pos, strlen('>' || doc_id) AS name_len, strlen(seq) AS read_len, seq
  FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^{R.KEPT}]', '', 'g') AS seq FROM documents)
)"""
_PARTS = f"""raw AS (
  SELECT p_partkey AS pos, strlen('>' || p_partkey) AS name_len, strlen(seq) AS read_len, seq
  FROM (SELECT p_partkey, regexp_replace(concat_ws(' ', p_name, p_type, p_brand), '[^{R.KEPT}]', '', 'g') AS seq FROM part)
)"""
_RANKS = """seqs AS (
  SELECT row_number() OVER (ORDER BY read_len DESC, pos) - 1 AS idx, * FROM raw WHERE read_len < 65535
)"""
_SEQS = f"{_RAW}, {_RANKS}"
_CODES = f"translate(seq, '{R._FROM}', '{R._TO}')"
_WORDS = f"""words AS (
  SELECT id, unnest(CASE WHEN length(c) = 0 THEN [] WHEN length(c) < 8 THEN [('0x' || c)::bigint]
           ELSE list_transform(range(1, length(c) - 6), lambda j: ('0x' || substr(c, j, 8))::bigint) END) AS word
  FROM (SELECT {{id}} AS id, {_CODES} AS c FROM {{rel}})
)"""


def _steps(source: str, columns: str) -> str:
    """The hash as a chain of sub-queries, one step each, so that no step is written out twice."""
    q = f"SELECT {columns}, xor(word, seed) AS s FROM {source}"
    for step in (
        "xor(xor(s, 61), s >> 16)", "(s * 9) & 4294967295", "xor(s, s >> 4)", "(s * 668265261) & 4294967295",
        "xor(s, s >> 15)", "(xor(s, s >> 8) * -1640531535) & 4294967295", "xor(s, s >> 14)",
    ):
        q = f"SELECT {columns}, {step} AS s FROM ({q})"
    return q


def _signed(bands: int, raw: str = _RAW) -> str:
    bare = ", ".join(c for c in ("id", "band"))
    return f"""{raw}, {_RANKS}, {_WORDS.format(id="idx", rel="seqs")}, uniq AS (SELECT DISTINCT id, word FROM words),
bands AS (SELECT k AS band, (k * 2654435761 + 2246822507) & 4294967295 AS seed FROM (SELECT unnest(range({bands})) AS k)),
mins AS (SELECT id, band, min(s) AS sig FROM ({_steps("uniq CROSS JOIN bands", bare)}) GROUP BY id, band),
sigs AS (SELECT idx, read_len, bands.band::int AS band, coalesce(sig, 4294967295) AS sig
         FROM seqs CROSS JOIN bands LEFT JOIN mins ON mins.id = seqs.idx AND mins.band = bands.band),
cand AS (SELECT band, idx AS tar, read_len AS tar_len, coalesce(lag(idx) OVER w, idx) AS rep, coalesce(lag(read_len) OVER w, read_len) AS rep_len
         FROM sigs WINDOW w AS (PARTITION BY band, sig ORDER BY idx))"""


_GRAPH = """e0 AS (SELECT (l_partkey + 1000000)::bigint AS u, l_suppkey::bigint AS v, l_quantity AS w FROM lineitem),
canon AS (SELECT least(u, v) AS u, greatest(u, v) AS v, w FROM e0 WHERE w > 0),
e AS (SELECT u, v, sum(w) AS w FROM canon GROUP BY u, v),
ways AS (SELECT u AS node, v AS other, w FROM e UNION ALL SELECT v, u, w FROM e),
deg AS (SELECT node, sum(w) AS degree FROM ways GROUP BY node),
member AS (SELECT node, node % 10 AS comm FROM deg),
ties AS (SELECT b.node, m.comm, sum(b.w) AS w, min(b.other) AS near FROM ways b JOIN member m ON m.node = b.other WHERE b.node <> b.other GROUP BY ALL),
mass AS (SELECT comm, sum(degree) AS mass FROM deg JOIN member USING (node) GROUP BY comm),
tot AS (SELECT sum(degree) AS total FROM deg),
super AS (SELECT least(a.comm, b.comm) AS u, greatest(a.comm, b.comm) AS v, sum(w) AS w FROM e JOIN member a ON a.node = e.u JOIN member b ON b.node = e.v GROUP BY ALL)"""



def _best(member: str, ties: str, deg: str, mass: str, tot: str) -> str:
    """(node, new_comm) of the best moves over the given relations."""
    return f"""SELECT node, new_comm FROM (
  SELECT node, new_comm, row_number() OVER (PARTITION BY node ORDER BY gain DESC, near) AS k FROM (
    SELECT t.node, t.comm AS new_comm, t.near, (t.w - {GAMMA} * d.degree * (a.mass + d.degree) / tot.total) - (coalesce(o.w, 0) - {GAMMA} * d.degree * b.mass / tot.total) AS gain
    FROM {ties} t JOIN {member} m ON m.node = t.node JOIN {deg} d ON d.node = t.node JOIN {mass} a ON a.comm = t.comm JOIN {mass} b ON b.comm = m.comm
    LEFT JOIN {ties} o ON o.node = t.node AND o.comm = m.comm CROSS JOIN {tot} tot WHERE t.comm <> m.comm) WHERE gain > 0) WHERE k = 1"""


ORACLES = {
    "seq_lengths": f"WITH {_RAW} SELECT pos, name_len, read_len FROM raw",
    "length_filter": f"WITH {_RAW} SELECT pos, read_len FROM raw WHERE read_len < 65535",
    "seq_stats": f"WITH {_RAW} SELECT count(*) AS total, count_if(read_len < 65535)::bigint AS valid, max(read_len) FILTER (read_len < 65535) AS longest, min(read_len) FILTER (read_len < 65535) AS shortest FROM raw",
    "length_rank": f"WITH {_SEQS} SELECT idx, pos, read_len FROM seqs",
    "encode_residues": f"""SELECT doc_id AS pos, translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(10), ''),
  '[\\x{{10000}}-\\x{{10FFFF}}]', '....', 'g'), '[\\x{{800}}-\\x{{FFFF}}]', '...', 'g'), '[\\x{{80}}-\\x{{7FF}}]', '..', 'g'), '[^A-Za-z.]', '.', 'g'), '{R._FROM}', '{R._TO}') AS codes FROM documents""",
    "residue_histogram": f"WITH {_RAW}, d AS (SELECT unnest(string_split({_CODES}, '')) AS code FROM raw) SELECT code, count(*) AS n FROM d WHERE code <> '' GROUP BY code",
    "pack_bitplanes": f"""WITH {_RAW}, c AS (SELECT pos, {_CODES} AS codes FROM raw WHERE read_len > 0),
p AS (SELECT pos, chunk::int AS chunk, substr(codes, chunk * 32 + 1, 32) AS c FROM (SELECT pos, codes, unnest(range((length(codes) - 1) // 32 + 1)) AS chunk FROM c))
SELECT pos, chunk, {", ".join(f"list_sum(list_transform(range(length(c)), lambda k: ((('0x' || substr(c, k + 1, 1))::bigint >> {p}) & 1) << k))::bigint AS plane{p}" for p in range(4))} FROM p""",
    "kmers": f"WITH {_RAW}, {_WORDS.format(id='pos', rel='raw')} SELECT id AS pos, count(*) AS n, count(DISTINCT word) AS distinct_words, min(word) AS least, max(word) AS most, sum(word)::bigint AS total FROM words GROUP BY id",
    "kmer_counts": f"WITH {_RAW}, {_WORDS.format(id='pos', rel='raw')} SELECT word, count(*) AS n FROM words GROUP BY word",
    "hash_kmers": f"""WITH {_RAW}, {_WORDS.format(id="pos", rel="raw")}, uniq AS (SELECT DISTINCT id, word FROM words),
seeds AS (SELECT unnest([0, 1, 2, 63]) AS band), seeded AS (SELECT band, (band * 2654435761 + 2246822507) & 4294967295 AS seed FROM seeds),
h AS ({_steps("uniq CROSS JOIN seeded", "id, band")})
SELECT id AS pos, {", ".join(f"min(s) FILTER (band = {k}) AS min_hash_{k}" for k in (0, 1, 2, 63))} FROM h GROUP BY id""",
    "minhash_signatures": f"WITH {_signed(64)} SELECT idx, band, sig FROM sigs",
    "bucket_sizes": f"WITH {_signed(64)} SELECT band, sig, count(*) AS n, min(idx) AS head FROM sigs GROUP BY band, sig",
    "candidates_lag": f"WITH {_signed(64)} SELECT band, tar, rep FROM cand",
    "candidate_counts_by_band": f"WITH {_signed(64)} SELECT band, count(*) AS n FROM cand WHERE rep <> tar GROUP BY band",
    "distinct_pairs": f"WITH {_signed(64)} SELECT rep, tar, min(band) AS band FROM cand WHERE rep <> tar GROUP BY rep, tar",
    "length_filtered_pairs": f"WITH {_signed(64)} SELECT DISTINCT rep, tar, rep_len, tar_len FROM cand WHERE rep <> tar AND tar_len::float >= rep_len::float * (95 / 100.0)::float",
    "band_pruned_candidates": f"WITH {_signed(16)} SELECT band, tar, rep FROM cand WHERE rep <> tar",
    "running_offsets": f"WITH {_SEQS} SELECT idx, name_len + read_len + 2 AS bytes, coalesce(sum(name_len + read_len + 2) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start FROM seqs",
    "edge_canonicalise": f"WITH {_GRAPH} SELECT u, v, w, count(*) AS n FROM canon GROUP BY ALL",
    "multi_edge_merge": f"WITH {_GRAPH} SELECT u, v, w FROM e",
    "degree": f"WITH {_GRAPH} SELECT node, degree FROM deg",
    "total_degree": f"WITH {_GRAPH} SELECT sum(degree) AS total_degree FROM deg",
    "neighbour_comm_weight": f"WITH {_GRAPH} SELECT node, comm, w, near FROM ties",
    "best_move_step": f"""WITH {_GRAPH}, g AS (
  SELECT t.node, m.comm AS old_comm, t.comm AS new_comm, t.near,
         (t.w - {GAMMA} * d.degree * (a.mass + d.degree) / tot.total) - (coalesce(o.w, 0) - {GAMMA} * d.degree * b.mass / tot.total) AS gain
  FROM ties t JOIN member m ON m.node = t.node JOIN deg d ON d.node = t.node JOIN mass a ON a.comm = t.comm JOIN mass b ON b.comm = m.comm
  LEFT JOIN ties o ON o.node = t.node AND o.comm = m.comm CROSS JOIN tot WHERE t.comm <> m.comm
), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, near) AS k FROM g WHERE gain > 0)
SELECT node, old_comm, new_comm, round(gain, 6) AS gain FROM r WHERE k = 1""",
    "collapse_step": f"WITH {_GRAPH} SELECT u, v, w FROM super",
    "modularity": f"WITH {_GRAPH} SELECT round(2 * (SELECT coalesce(sum(w), 0) FROM super WHERE u = v) / sum(mass) - {GAMMA} * sum(mass * mass) / (sum(mass) * sum(mass)), 9) AS modularity FROM mass",
    "community_totals": f"WITH {_GRAPH} SELECT comm, count(*) AS nodes, sum(degree) AS total FROM deg JOIN member USING (node) GROUP BY comm",
    "dense_community_ids": f"""WITH {_GRAPH}, g AS ({_best("member", "ties", "deg", "mass", "tot")}),
now AS (SELECT node, coalesce(new_comm, comm) AS comm FROM member LEFT JOIN g USING (node)), f AS (SELECT comm, min(node) AS first FROM now GROUP BY comm)
SELECT node, comm, id FROM now JOIN (SELECT comm, row_number() OVER (ORDER BY first) - 1 AS id FROM f) USING (comm)""",
    "composed_communities": f"""WITH {_GRAPH}, ways2 AS (SELECT u AS node, v AS other, w FROM super UNION ALL SELECT v, u, w FROM super),
deg2 AS (SELECT node, sum(w) AS degree FROM ways2 GROUP BY node), member2 AS (SELECT DISTINCT comm AS node, comm % 3 + 100 AS comm FROM member),
ties2 AS (SELECT b.node, m.comm, sum(b.w) AS w, min(b.other) AS near FROM ways2 b JOIN member2 m ON m.node = b.other WHERE b.node <> b.other GROUP BY ALL),
mass2 AS (SELECT comm, sum(degree) AS mass FROM deg2 JOIN member2 USING (node) GROUP BY comm), tot2 AS (SELECT sum(degree) AS total FROM deg2),
g AS ({_best("member2", "ties2", "deg2", "mass2", "tot2")})
SELECT m.node, coalesce(g.new_comm, m.comm) AS comm FROM member m LEFT JOIN g ON g.node = m.comm""",
    "connected_components": f"""WITH RECURSIVE {_signed(R.BANDS)}, p AS (SELECT DISTINCT rep AS a, tar AS b FROM cand WHERE rep <> tar),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT DISTINCT a AS node, a AS x FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.x)
SELECT node, min(x) AS root FROM r GROUP BY node""",
    "fasta_round_trip": f"WITH {_RAW} SELECT '>' || pos AS name, md5(seq) AS seq_md5, name_len, read_len FROM raw",
    "packed_store": f"WITH {_signed(16)} SELECT band, tar, rep, '>' || seqs.pos AS name FROM cand JOIN seqs ON seqs.idx = cand.tar WHERE rep <> tar",
    "stored_signatures": f"WITH {_signed(64)} SELECT band, sig, count(*) AS n, min(idx) AS head FROM sigs GROUP BY band, sig",
    "lcs_of_names": f"""WITH n AS (SELECT n_nationkey, n_regionkey, translate(regexp_replace(n_name, '[^A-Za-z.]', '.', 'g'), '{R._FROM}', '{R._TO}') AS h FROM nation),
p AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b, x.h AS ha, y.h AS hb FROM n x JOIN n y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey)
SELECT a, b, (length(ha) - bit_count(list_reduce(list_transform(string_split(hb, ''),
  lambda c: list_sum(list_transform(range(length(ha)), lambda k: CASE WHEN substr(ha, k + 1, 1) = c AND c <> '0' THEN 1::bigint << k ELSE 0 END))::bigint),
  lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::bigint << length(ha)) - 1), (1::bigint << length(ha)) - 1)))::int AS lcs FROM p""",
}
ORACLES.update(parts.oracles(_signed(R.BANDS, _PARTS)))
