"""Signing sequences as they arrive, and looking their buckets up among stored ones.

Ranks by length are global, so a stream can't give the candidates that a batch over all sequences gives; it gives for each
new sequence the stored ones that share a bucket, as one representative per band.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.residues import BANDS
from ..operators.candidates import length_filter, sequences_from_text, signatures


def stream_signatures(texts: DataFrame, bands: int = BANDS, **adapter) -> DataFrame:
    """(pos, read_len, band, sig) of a streaming table of texts; stateless, so every trigger is independent."""
    seqs = length_filter(sequences_from_text(texts, **adapter)).withColumn("idx", F.col("pos"))
    return signatures(seqs, bands).select(F.col("idx").alias("pos"), "read_len", F.posexplode("sigs").alias("band", "sig"))


def write_signatures(signed: DataFrame, path: str, checkpoint: str):
    """Starts the query that appends signatures to a Parquet folder with a subfolder per band, exactly once per input row."""
    return signed.writeStream.format("parquet").partitionBy("band").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start()


def bucket_mates(new: DataFrame, stored: DataFrame) -> DataFrame:
    """(pos, band, mate): the smallest stored position in each bucket that a new sequence falls in. Stored rows are reduced to one per bucket before the join."""
    head = stored.groupBy("band", "sig").agg(F.min("pos").alias("mate"))
    return new.join(head, ["band", "sig"]).select("pos", "band", "mate")
