"""Sequences, signatures and candidate pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.residues import BANDS, batch_minhashes, codes_of, projected
from .base import InvalidInput, dense_rank_of_rows, forget, removed, spread, written

#: Sequences of so many bytes or more are left out.
LENGTH_LIMIT = 65_535


def sequences_from_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", project: bool = True) -> DataFrame:
    """(pos, name, seq, name_len, read_len) from a table of texts: projected to residues, or as they are but for line ends.

    The projection is declared not deterministic, though it is, so that Spark makes it once and not again for each filter and length that follows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    seq = F.arrow_udf(projected, "string").asNondeterministic()(text) if project else F.replace(text, F.lit("\n"), F.lit(""))
    name = F.concat(F.lit(">"), F.col(id_col).cast("string"))
    return docs.select(F.col(id_col).cast("long").alias("pos"), name.alias("name"), seq.alias("seq")).withColumns(
        {"name_len": F.octet_length("name"), "read_len": F.octet_length("seq")}
    )


def length_filter(seqs: DataFrame) -> DataFrame:
    return seqs.where(F.col("read_len") < LENGTH_LIMIT)


def rank_by_length(seqs: DataFrame) -> DataFrame:
    """seqs with idx: the place by falling length, then by position."""
    return dense_rank_of_rows(length_filter(seqs), [F.col("read_len").desc(), F.col("pos").asc()], "idx")


def signatures(seqs: DataFrame, bands: int = BANDS) -> DataFrame:
    """(idx, read_len, sigs) with `bands` min-hashes each."""

    @F.arrow_udf("array<bigint>")
    def sign(texts: pa.Array) -> pa.Array:
        flat = batch_minhashes([codes_of(t) for t in texts.to_pylist()], bands).astype(np.int64).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), pa.array(flat, pa.int64()))

    # ranked sequences lie by length, the longest together; hashing evens the work out
    return spread(seqs.select("idx", "read_len", "seq"), "idx").select("idx", "read_len", sign("seq").alias("sigs"))


def long_signatures(signed: DataFrame) -> DataFrame:
    """(idx, read_len, band, sig). There is no empty array, so the outer form gives the same; from the inner one Spark infers a filter, for which all would be signed twice."""
    return signed.select("idx", "read_len", F.posexplode_outer("sigs").alias("band", "sig"))


def _predecessors(batches):
    """Sorted rows (band, sig, idx, read_len) of a partition as candidates, with marks of its first and last one."""

    def shifted(column, carried):
        return np.concatenate([[carried], column[:-1]])

    def made(batch, before, first, last):
        band, sig, idx, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        same = (shifted(band, before[0]) == band) & (shifted(sig, before[1]) == sig)
        marks = np.zeros((2, len(band)), bool)
        marks[0, 0], marks[1, -1] = first, last
        edge = marks.any(axis=0)
        columns = (band, np.ma.masked_array(sig, ~edge), idx, size, np.where(same, shifted(idx, before[2]), idx), np.where(same, shifted(size, before[3]), size))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        part = pa.array(np.full(len(band), TaskContext.get().partitionId()), pa.int32())
        return pa.RecordBatch.from_arrays([*arrays, part, *map(pa.array, marks)], ["band", "sig", "tar", "tar_len", "rep", "rep_len", "part", "first", "last"])

    held, before, first = None, (-1, -1, -1, -1), True
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield made(held, before, first, False)
            before, first = tuple(held.column(k)[-1].as_py() for k in range(4)), False
        held = batch
    if held is not None:
        yield made(held, before, first, True)


def candidates(long: DataFrame) -> DataFrame:
    """(band, tar, tar_len, rep, rep_len): each sequence with the one before it in its bucket, or with itself at a bucket's head.

    Signatures are written once, sorted by (band, sig, idx) in ranges, and each row looks at the one before it. A range may end within a
    bucket, so a bucket of any size, like that of all empty sequences, is shared by as many tasks as it needs; a table of two rows a
    range says what the first row of a range follows. Nothing is joined with itself and no bucket is held in memory.
    """
    signed = written(long.select("band", "sig", "idx", "read_len"), "signatures", "zstd")
    order = ["band", "sig", "idx"]
    kinds = "band int, sig long, tar long, tar_len int, rep long, rep_len int, part int, first boolean, last boolean"
    forget(long.sparkSession)
    rows = written(signed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_predecessors, kinds), "candidates", "zstd")
    removed(signed)
    forget(long.sparkSession)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    edges = rows.where("first OR last").groupBy("part").agg(
        F.max(F.when(F.col("first"), F.struct("band", "sig", "tar", "tar_len"))).alias("head"), F.max(F.when(F.col("last"), F.struct("band", "sig", "tar", "tar_len"))).alias("tail")
    )
    follows = F.last("tail").over(earlier).alias("before")
    heads = edges.select("head", follows).select("head.*", "before")
    same = F.coalesce((F.col("before.band") == F.col("band")) & (F.col("before.sig") == F.col("sig")), F.lit(False))
    linked = heads.select(
        "band", "tar", "tar_len", F.when(same, F.col("before.tar")).otherwise(F.col("tar")).alias("rep"), F.when(same, F.col("before.tar_len")).otherwise(F.col("tar_len")).alias("rep_len")
    )
    return rows.where("NOT first").select("band", "tar", "tar_len", "rep", "rep_len").union(linked)


def check_parameters(identity: int = 95, bands: int = BANDS) -> None:
    if not 1 <= identity <= 99:
        raise InvalidInput("identity must be from 1 to 99")
    if not 1 <= bands <= BANDS:
        raise InvalidInput(f"bands must be from 1 to {BANDS}")


def length_fits(identity: int):
    """Whether a target is long enough to be a hit at all."""
    t = F.expr(f"CAST({identity} / 100.0D AS FLOAT)")
    return F.col("tar_len").cast("float") >= F.col("rep_len").cast("float") * t


def distinct_pairs(cand: DataFrame, identity: int | None = None) -> DataFrame:
    """(rep, tar, rep_len, tar_len, band): each pair once with its first band; with an identity, only pairs whose lengths fit."""
    pairs = cand.where("rep <> tar")
    if identity is not None:
        pairs = pairs.where(length_fits(identity))
    return pairs.groupBy("rep", "tar").agg(F.first("rep_len").alias("rep_len"), F.first("tar_len").alias("tar_len"), F.min("band").alias("band"))
