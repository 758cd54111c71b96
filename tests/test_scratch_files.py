import os
import random
import time

from pyspark.sql import functions as F

from seqloom.operators import align, base, candidates


def texts(spark, n=60):
    rng = random.Random(3)
    rows = ["".join(rng.choice("ACDEFGHIKL") for _ in range(80)) for _ in range(n // 2)]
    return spark.createDataFrame([(k, x) for k, x in enumerate(rows + [x[:-1] for x in rows])], "doc_id long, text string")


def tables(spark):
    """The written tables that are there, by name."""
    top = base.checkpoint_dir(spark).removeprefix("file://")
    return {f"{top}/{x}" for x in os.listdir(top) if os.listdir(f"{top}/{x}")}


def named(paths):
    return sorted(os.path.basename(p).rsplit("-", 1)[0] for p in paths)


def test_shuffle_files_of_the_last_query_are_let_go(spark):
    """Before, those of the query that had just ended stayed until another one had ended."""
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle")}

    base.forget(spark)
    old = files()
    base.written(spark.range(1000).repartition(3, "id"), "dealt")
    assert files() - old
    base.forget(spark)
    end = time.time() + 10
    while files() - old and time.time() < end:
        time.sleep(0.2)
    assert not files() - old


def test_edges_leave_no_table_behind_but_the_sequences_and_hits(spark):
    seqs = candidates.rank_by_length(candidates.sequences_from_text(texts(spark)))
    old = tables(spark)
    cand = candidates.candidates(candidates.long_signatures(candidates.signatures(seqs)))
    assert named(tables(spark) - old) == ["candidates"]
    want = sorted(map(tuple, align.edges(cand, seqs, 80).collect()))
    assert named(tables(spark) - old) == ["candidates", "lcs"]
    old = tables(spark) - {x for x in tables(spark) - old if "candidates" in x}
    got = align.edges(cand, seqs, 80, spend=True)
    assert named(tables(spark) - old) == ["lcs"]
    assert sorted(map(tuple, got.collect())) == want and len(want) >= 30


def test_tables_in_several_folders_are_removed(spark):
    path = base.scratch(spark, "parts")
    for k in range(3):
        spark.range(5).write.parquet(f"{path}/{k}")
    base.removed(spark.read.parquet(*(f"{path}/{k}" for k in range(3))))
    assert os.listdir(path.removeprefix("file://")) == []


def test_only_the_ends_of_a_range_keep_their_signature(spark):
    seqs = candidates.rank_by_length(candidates.sequences_from_text(texts(spark)))
    old = tables(spark)
    cand = candidates.candidates(candidates.long_signatures(candidates.signatures(seqs)))
    path = next(iter(tables(spark) - old))
    rows = spark.read.parquet(path)
    assert rows.count() == cand.count() == 64 * 60
    assert rows.where((F.col("first") | F.col("last")) != F.col("sig").isNotNull()).isEmpty()


def test_whole_alignment_removes_its_pairs_and_what_they_come_from(spark):
    """As in similarity_pairs, which has no identity to drop pairs by."""
    seqs = candidates.rank_by_length(candidates.sequences_from_text(texts(spark)))
    old = tables(spark)
    cand = candidates.candidates(candidates.long_signatures(candidates.signatures(seqs)))
    pairs = candidates.distinct_pairs(cand, 95)
    n = pairs.count()
    got = align.align(pairs, seqs, spent=cand)
    assert named(tables(spark) - old) == ["lcs"] and got.count() == n > 0
