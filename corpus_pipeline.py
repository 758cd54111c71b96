"""Corpus pipeline: stages over documents, each written and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bpe, toxicity
from seqloom.llm.common import forget, fresh, settled, written
from seqloom.llm.exact_dedup import exact_dedup
from seqloom.llm.mixing import mix, repeat_epochs
from seqloom.llm.ngram_join import similar_sets

#: Ids of dropped documents, up to which they are sent to every executor (17 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 300_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold. The model learns from the documents and labels in sf_dir. Null and empty texts have the score of a
    text without hits and stay; texts count whole; rows that repeat fare alike; nulls in other columns, and further columns, pass through."""
    model = toxicity.model_of(spark, sf_dir)
    return docs.where(toxicity.score(model, spark, F.col("text")) < toxicity.THRESHOLD)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id; of rows that repeat it, one. Null texts count as empty and so are copies of each other; a null id is
    smaller than all others, so of copies that have no other id one stays. Further columns pass through."""
    kept = exact_dedup(docs).where("kept")
    again = settled(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(again, "doc_id", "left_anti")
    twice = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text_sha256"])
    return once.select(*docs.columns).union(twice.select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of word shingles connect, the one with the smallest doc_id. Texts without words link with nothing and stay. A null id counts as
    the largest.

    Rows that share an id and differ in text are told apart by a hash of the text: each stays or goes for itself, and of several in one group that share the smallest id
    the one with the smallest hash stays. Further columns pass through.
    """
    key = fresh(docs, "__row")
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")).alias(key)
    ids = docs.select(row, "text")
    found = similar_sets(ids, key, "text")
    dropped = settled(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key)).distinct())
    rows = docs.select("*", row)
    gone = F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped
    return rows.join(gone, rows[key].eqNullSafe(gone[key]), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; n_chars follows a text that is shortened at its source's cut. A null or empty text has no words, so no mix takes it;
    a null source is a source. Further columns pass through."""
    return repeat_epochs(mix(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their byte-level BPE ids and the number of these: none for a null or empty text."""
    return bpe.encode(docs, bpe.vocabulary()).withColumn("n_tokens", F.size("input_ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", tokenize),
]

#: A trained model's scores and byte-level BPE are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two stages the rows are written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
            forget(spark)
    return docs
