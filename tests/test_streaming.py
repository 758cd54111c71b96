from pyspark.sql import functions as F

from seqloom.functions.residues import codes_of, minhashes, words_of
from seqloom.streaming.signing import bucket_mates, stream_signatures, write_signatures


def test_stream_signs_what_arrives(spark, tmp_path):
    texts = {1: "the cat sat on the mat and ran away", 2: "the cat sat on the mat and ran away", 3: "completely different words here"}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    query = write_signatures(stream_signatures(stream, 8), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 24
    seq = "".join(c for c in texts[3] if c in "acdefghiklmnpqrstuvwy")
    assert [r["sig"] for r in got.where("pos = 3").orderBy("band").collect()] == minhashes(words_of(codes_of(seq)), 8).tolist()
    mates = bucket_mates(got.where("pos = 2"), got.where("pos <> 2"))
    assert mates.where(F.col("mate") == 1).count() == 8
