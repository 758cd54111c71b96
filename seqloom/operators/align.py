"""Verification of candidate pairs by longest common subsequence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.groups import hits_of_groups, lcs_of_groups
from ..functions.many import hits_of_pairs, may_be_hits
from ..functions.residues import codes_of, pack_codes, threshold
from .base import forget, removed, scratch, spread, written
from .candidates import distinct_pairs


#: An alignment's sequences come together in rounds of so many bytes of targets at least, so that the disk doesn't hold all pairs' at once.
ROUND_BYTES = 64 << 20
#: From this identity on, a pair's beginnings are looked at first: so many times the share of residues that a hit may leave out. Sequences that have nothing
#: to do with each other leave out two fifths of theirs, so most misses are known by then.
LOOK_FROM, LOOK = 70, 1.5
#: Below this identity, pairs whose first sequence has more residues than that are aligned in groups; shorter rows or narrower ones are faster side by side.
GROUPED_BELOW, GROUPED = 90, 2000
#: The driver plans the rounds from so many sums over ranges of representatives at most.
PLAN_ROWS = 4096


def _with_groups(a: list[bytes], b: list[bytes], len_a: np.ndarray, len_b: np.ndarray, t: np.float32, others) -> np.ndarray:
    """hits_of_groups for the pairs that are aligned in groups, others(a, b, len_a, len_b) for the rest."""
    grouped, out = (len_a > GROUPED) & (t < threshold(GROUPED_BELOW)), np.zeros(len(a), np.int64)
    for run, which in ((lambda *x: hits_of_groups(*x, t), grouped), (others, ~grouped)):
        at = np.flatnonzero(which)
        if len(at):
            out[at] = run([a[k] for k in at], [b[k] for k in at], len_a[at], len_b[at])
    return out


def common_lengths(a: list[bytes], b: list[bytes], len_a: np.ndarray, len_b: np.ndarray, t: np.float32 | None = None) -> np.ndarray:
    """The LCS of each pair of packed sequences; with a threshold, -1 or too little for a miss."""
    if t is None:
        return lcs_of_groups(a, b, len_a, len_b)
    return _with_groups(a, b, len_a, len_b, t, lambda *x: hits_of_pairs(*x, t))


def open_pairs(a: list[bytes], b: list[bytes], len_a: np.ndarray, len_b: np.ndarray, t: np.float32, share: float) -> np.ndarray:
    """False for pairs that are misses by their beginnings, which are as long as may_be_hits has them and, of pairs in groups, both as long as the first one's."""
    return _with_groups(a, b, len_a, len_b, t, lambda *x: np.where(may_be_hits(*x, t, share), -2, -1)) != -1


def _packed(texts: pa.Array) -> pa.Array:
    """A sequence as two codes a byte, and how often it has each code but 0."""
    codes = [codes_of(x) for x in texts.to_pylist()]
    tally = [np.bincount(x, minlength=16)[1:].astype(np.uint32).tobytes() for x in codes]
    return pa.StructArray.from_arrays([pa.array([pack_codes(x) for x in codes], pa.binary()), pa.array(tally, pa.binary())], ["codes", "tally"])


def _shared(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many residues two tallies have in common, in any order."""
    x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint32).reshape(-1, 15) for v in (a, b))
    return pa.array(np.minimum(x, y).sum(axis=1, dtype=np.int64), pa.int32())


def _rounds(pairs: DataFrame, most: int) -> list[tuple[int, int, int]]:
    """Ranges (first rep, last rep, last tar) whose targets have about `most` residues each or fewer; one range of reps of the plan is never split."""
    top = pairs.agg(F.max("rep")).first()[0]
    if top is None:
        return []
    sums = pairs.groupBy(F.expr(f"rep div {top // PLAN_ROWS + 1}").alias("k")).agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.max("tar").alias("tar"), F.sum("tar_len").alias("n"))
    out, held = [], 0
    for r in sorted(sums.collect()):
        if out and held + r["n"] <= most:
            out[-1] = out[-1][0], r["last"], max(out[-1][2], r["tar"])
        else:
            out.append((r["first"], r["last"], r["tar"]))
            held = 0
        held += r["n"]
    return out


def _beginning(share: float):
    """The first codes of a packed sequence: its share, and a few."""
    return F.expr("codes") if share >= 1 else F.expr(f"substring(codes, 1, CAST(ceil(read_len * {share!r}D / 2) AS INT) + 2)")


def _in_rounds(pairs: DataFrame, packed: DataFrame, size: int, run, name: str, rep_share: float = 1.0, tar_share: float = 1.0) -> DataFrame:
    """pairs with run(rep_codes, tar_codes, rep_len, tar_len) as a column, written round by round; only the given shares of the sequences are moved."""
    spark, done = pairs.sparkSession, scratch(pairs.sparkSession, name)
    schema = StructType([*pairs.schema.fields, StructField(name, run.returnType)])
    rounds = _rounds(pairs, int(max(2 * ROUND_BYTES, size) / tar_share))
    for k, (first, last, end) in enumerate(rounds):
        rep = packed.where(F.col("idx").between(first, last)).select(F.col("idx").alias("rep"), _beginning(rep_share).alias("rep_codes"))
        tar = packed.where(F.col("idx").between(first, end)).select(F.col("idx").alias("tar"), _beginning(tar_share).alias("tar_codes"))
        held = spread(pairs.where(F.col("rep").between(first, last)).join(tar, "tar"), "rep").join(rep, "rep")
        held.select(*pairs.columns, run("rep_codes", "tar_codes", "rep_len", "tar_len").alias(name)).write.parquet(f"{done}/{k}")
        del rep, tar, held
        forget(spark)
    return spark.read.schema(schema).parquet(*(f"{done}/{k}" for k in range(len(rounds)))) if rounds else spark.createDataFrame([], schema)


def align(pairs: DataFrame, seqs: DataFrame, identity: int | None = None, spent: DataFrame | None = None) -> DataFrame:
    """pairs with lcs; with an identity, only those that may be hits, with -1 or too little for misses among them.

    Sequences are written once as packed codes with tallies. With an identity, pairs whose tallies have too little in common are dropped before any sequence
    is moved, then those whose beginnings leave out more than a hit may. The rest is aligned as a whole. Both is done in rounds over ranges of representatives: each
    moves about as many bytes of targets as all sequences have, and its shuffle files are let go after it, so the disk that is needed follows the sequences
    and not the pairs. Representatives are ranked by length and their targets are a little shorter, so a round reads a range of the sequences. Tables
    are removed with their last reader, as are those of `spent`, which only the pairs come from, once these are written.
    """
    spark, t = seqs.sparkSession, None if identity is None else threshold(identity)
    names = pairs.columns

    def run(a: pa.Array, b: pa.Array, len_a: pa.Array, len_b: pa.Array) -> pa.Array:
        return pa.array(common_lengths(a.to_pylist(), b.to_pylist(), len_a.to_numpy(), len_b.to_numpy(), t), pa.int64()).cast(pa.int32())

    packed = written(seqs.select("idx", "read_len", F.arrow_udf(_packed, "struct<codes: binary, tally: binary>")("seq").alias("p")).select("idx", "read_len", "p.codes", "p.tally"), "codes", "zstd")
    size = packed.agg(F.sum("read_len")).first()[0] or 0
    pairs = written(pairs, "found", "zstd")
    if spent is not None:
        removed(spent)
    forget(spark)
    if identity is not None:
        sides = [packed.select(F.col("idx").alias(k), F.col("tally").alias(f"{k}_tally")) for k in ("rep", "tar")]
        common = pairs.join(sides[0], "rep").join(sides[1], "tar").withColumn("common", F.arrow_udf(_shared, "int")("rep_tally", "tar_tally"))
        found, pairs = pairs, written(common.where(_is_hit("common", identity)).select(*names), "pairs", "zstd")
        removed(found)
        del common, found
        forget(spark)
    if identity is not None and identity >= LOOK_FROM:
        share = LOOK * (1 - identity / 100)

        def look(a: pa.Array, b: pa.Array, len_a: pa.Array, len_b: pa.Array) -> pa.Array:
            return pa.array(open_pairs(a.to_pylist(), b.to_pylist(), len_a.to_numpy(), len_b.to_numpy(), t, share))

        most = share + 1 - identity / 100
        looked = _in_rounds(pairs, packed, size, F.arrow_udf(look, "boolean"), "open", most, most if identity < GROUPED_BELOW else share)
        removed(pairs)
        pairs = looked.where("open").select(*names)
    aligned = _in_rounds(pairs, packed, size, F.arrow_udf(run, "int"), "lcs")
    removed(pairs)
    removed(packed)
    return aligned


def _is_hit(common: str, identity: int):
    """Whether a column of common lengths exceeds the union's share; the test is strict and in single precision."""
    t, union = F.expr(f"CAST({identity} / 100.0D AS FLOAT)"), F.col("rep_len") + F.col("tar_len") - F.col(common)
    return F.col(common).cast("float") > union.cast("float") * t


def scored(aligned: DataFrame, identity: int) -> DataFrame:
    """aligned with score: the whole per cent of similarity for a hit, else 0. The test is strict and in single precision."""
    hit = (F.col("lcs") >= 0) & _is_hit("lcs", identity)
    return aligned.withColumn("score", F.when(hit, F.expr("lcs * 100 div (rep_len + tar_len - lcs)")).otherwise(F.lit(0)).cast("int"))


def edges(cand: DataFrame, seqs: DataFrame, identity: int, spend: bool = False) -> DataFrame:
    """(rep, tar, band, lcs, score, weight): candidate pairs that are similar enough; each pair is aligned once. To spend cand, a table that `candidates` has
    made, is to remove its files once its pairs are written; nothing may read it later."""
    hits = scored(align(distinct_pairs(cand, identity), seqs, identity, cand if spend else None), identity).where("score > 0")
    return hits.select("rep", "tar", "band", "lcs", "score", F.expr("CAST(score / 100.0D AS FLOAT)").alias("weight"))
