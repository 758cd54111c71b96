"""The words of sequences, counted and hashed without a row for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.residues import STEP, all_words, batch_minhashes, codes_of, kmers, residue_hex
from .base import settled

#: So many words are counted at a time.
COUNTED_WORDS = 1 << 23


def _statistics(seqs: pa.Array) -> pa.Array:
    rows = np.zeros((5, len(seqs)), np.int64)
    for k, seq in enumerate(seqs.to_pylist()):
        words = all_words(codes_of(seq))
        if len(words):
            words.sort()
            rows[:, k] = len(words), 1 + np.count_nonzero(words[1:] != words[:-1]), words[0], words[-1], words.sum(dtype=np.int64)
    return pa.StructArray.from_arrays([*map(pa.array, rows)], ["n", "distinct_words", "least", "most", "total"])


def word_statistics(seqs: DataFrame, pos: DataFrame) -> DataFrame:
    """(pos, n, distinct_words, least, most, total) of each pos that has a word. pos has the column pos of seqs, however it is read cheaply; sequences of a pos that comes twice
    are put together word by word."""
    each = seqs.select("pos", F.arrow_udf(_statistics, "struct<n: long, distinct_words: long, least: long, most: long, total: long>")("seq").alias("w")).select("pos", "w.*").where("n > 0")
    twice = settled(pos.groupBy("pos").count().where("count > 1").select(F.col("pos").alias("again")))
    if twice.isEmpty():
        return each
    words = seqs.join(twice, F.col("pos").eqNullSafe(F.col("again")), "left_semi").select("pos", F.explode(kmers(residue_hex(F.col("seq")))).alias("word"))
    more = words.groupBy("pos").agg(F.count("*").alias("n"), F.countDistinct("word").alias("distinct_words"), F.min("word").alias("least"), F.max("word").alias("most"), F.sum("word").alias("total"))
    return each.join(twice, F.col("pos").eqNullSafe(F.col("again")), "left_anti").union(more)


def word_hashes(seqs: DataFrame, bands: tuple[int, ...]) -> DataFrame:
    """(pos, min_hash_k of each band k) of each pos that has a word."""

    def least(texts: pa.Array) -> pa.Array:
        got = batch_minhashes([codes_of(x) for x in texts.to_pylist()], bands).astype(np.int64)
        return pa.StructArray.from_arrays([pa.array(got[:, k]) for k in range(len(bands))], names)

    names = [f"min_hash_{k}" for k in bands]
    hashed = seqs.where("seq <> ''").select("pos", F.arrow_udf(least, "struct<" + ", ".join(f"{n}: long" for n in names) + ">")("seq").alias("h"))
    return hashed.select("pos", "h.*").groupBy("pos").agg(*[F.min(n).alias(n) for n in names])


def _summed(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(words, kind="stable")
    words, counts = words[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
    return words[first], np.add.reduceat(counts, first)


def word_counts(seqs: DataFrame) -> DataFrame:
    """(word, n): how often each word occurs. Tasks count COUNTED_WORDS at a time and send, for each of many hash buckets, a row with the words and their counts; buckets are summed apart."""
    buckets = 4 * int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            words, counts = np.unique(np.concatenate(held), return_counts=True)
            bucket = ((words * np.uint32(STEP)).astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            words, counts, bucket = words[order], counts[order].astype(np.uint32), bucket[order]
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            parts = [(k, words[i:j].tobytes(), counts[i:j].tobytes()) for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if i < j]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "words", "counts"])

        held, size = [], 0
        for batch in batches:
            for seq in batch.column(0).to_pylist():
                words = all_words(codes_of(seq))
                for at in range(0, len(words), COUNTED_WORDS):
                    held.append(words[at : at + COUNTED_WORDS])
                    size += len(held[-1])
                    if size >= COUNTED_WORDS:
                        yield rows()
                        held, size = [], 0
        if size:
            yield rows()

    def summed(table: pa.Table) -> pa.Table:
        words, counts = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint32) for c in ("words", "counts"))
        words, n = _summed(words, counts.astype(np.int64))
        return pa.table({"word": words.astype(np.int64), "n": n})

    parts = seqs.select("seq").mapInArrow(counted, "bucket int, words binary, counts binary")
    return parts.groupBy("bucket").applyInArrow(summed, "word long, n long")
