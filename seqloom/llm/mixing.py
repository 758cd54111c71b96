"""Mixing sources to target weights by hash-random order and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, col, fresh, others, settled, word_count

#: Rows that a bucket of the key range holds on average.
BUCKET_ROWS = 512


def random_key(id_col: Column, seed: int) -> Column:
    """60 hash bits of an id: uniform, the same in each run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, no_source, source_size) rows with their target.

    Sources in code-point order, null last, take the weights in turn and share `share` of all sizes; a
    target stops at `cap` times its source's size and the rest is shared again by weight, which is
    water-filling: with sources in the order of cap over weight, the full ones come first. The windows
    run over one row per source.
    """
    order = Window.orderBy("no_source", "source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    full = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "no_source", "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = full.withColumn(
        "level",
        (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / F.sum("weight").over(from_here),
    )
    fits = F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.col("level"))
    # the first level that fits, in the order of ratio; rows after it have the same or more room
    first = level.withColumn("rank", F.row_number().over(by_ratio)).withColumn("fits", fits)
    chosen = first.withColumn("lam", F.min_by("fits", F.when(F.col("fits").isNotNull(), F.col("rank"))).over(everything))
    target = F.when(F.col("lam").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("lam") * F.col("weight")))
    return chosen.select("source", "no_source", "source_size", target.alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, **rule) -> DataFrame:
    """The rows of df with size, source_size, target, start and taken.

    Each document gets a hash-random key. The key range is cut into equal buckets (the hash is uniform, so
    its quantiles are known without sampling), sums of sizes per source and bucket are added up in key order,
    and inside each bucket a window sorts by key and goes on from the bucket's offset. `start` is so the
    prefix sum of a document within its source; a budget of T words is T // S whole epochs and the first
    T % S words in that order. The document at the cut gives only the words that the budget still has.
    No task holds more than a bucket, whatever share of the rows a source has; the tables of buckets and of
    sources are aggregates.

    Nulls: a null text has size 0; a null source is a source, last in order. Ids that repeat share a key and
    are ordered by size; their rows are mixed one by one. Columns of df with the names of added columns, in any case of
    letters, are replaced; all others pass through. An empty table gives an empty one.
    """
    added = ("size", "source_size", "target", "start", "taken")
    kept = others(df, *added)
    key, no, src, bucket, total, offset = (fresh(df, x) for x in ("__key", "__no", "__src", "__bucket", "__sum", "__offset"))
    bits = max(0, (max(1, df.count()) // BUCKET_ROWS).bit_length())
    base = df.select(
        *map(col, kept), word_count(col(text_col).cast("string")).alias("size"), random_key(col(id_col), seed).alias(key),
        col(source_col).isNull().alias(no), F.coalesce(col(source_col).cast("string"), F.lit("")).alias(src),
    ).withColumn(bucket, F.shiftright(key, 60 - bits))
    sums = settled(base.groupBy(no, src, bucket).agg(F.sum("size").alias(total)))
    sizes = sums.groupBy(F.col(no).alias("no_source"), F.col(src).alias("source")).agg(F.sum(total).alias("source_size"))
    targets = source_targets(sizes, **rule).select(F.col("no_source").alias(no), F.col("source").alias(src), "source_size", "target")
    past = Window.partitionBy(no, src).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn(offset, F.coalesce(F.sum(total).over(past), F.lit(0))).drop(total).join(targets, [no, src])
    inside = Window.partitionBy(no, src, bucket).orderBy(F.col(key), col(id_col), F.col("size")).rowsBetween(Window.unboundedPreceding, -1)
    placed = base.join(offsets, [no, src, bucket]).withColumn("start", F.col(offset) + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(budget / F.greatest("source_size", F.lit(1))))
    rest = budget - epochs * F.col("source_size") - F.col("start")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return placed.select(*map(col, kept), "size", "source_size", "target", "start", taken.cast("long").alias("taken"))


def repeat_epochs(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself: each document as often as the mix takes it, the last copy at a source's cut shortened to the words still due."""
    size, taken = F.greatest(F.col("size"), F.lit(1)), F.col("taken")
    copy = fresh(mixed, "__copy")
    copies = mixed.where("taken > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.ceil(taken / size).cast("int"))))
    due = F.least(size, taken - (F.col(copy) - 1) * size)
    pieces = F.split(col(text_col), f"(?<=[^{SPACE_CLASS}])(?=[{SPACE_CLASS}])")  # each word with the space before it
    head = F.array_join(F.slice(pieces, F.lit(1), due.cast("int")), "")
    return copies.select(*[F.when(due < F.col("size"), head).otherwise(col(c)).alias(c) if c == text_col else col(c) for c in mixed.columns])


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source,
         CASE WHEN text IS NULL THEN 0 ELSE length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint AS k
  FROM documents
), s AS (
  SELECT no_source, source, sum(size)::bigint AS source_size FROM d GROUP BY ALL
), w AS (
  SELECT *, [5.0::double, 2.0, 1.0][((row_number() OVER (ORDER BY no_source, source) - 1) % 3 + 1)::int] AS weight,
         source_size * 2.0::double AS cap FROM s
), l AS (
  SELECT *, row_number() OVER o AS rnk,
         (sum(source_size) OVER () * 1.5::double - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM w WINDOW o AS (ORDER BY cap / weight, no_source, source)
), t AS (
  SELECT no_source, source, source_size,
         least(cap, coalesce((SELECT arg_min(lev, rnk) FROM l WHERE cap / weight >= lev), cap) * weight) AS target
  FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::bigint AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.no_source, d.source ORDER BY d.k, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start
  FROM d JOIN t ON d.no_source = t.no_source AND d.source = t.source
)
SELECT doc_id, size::bigint AS size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
         + greatest(0, least(budget - (budget // source_size) * source_size - start, size)) END)::bigint AS taken
FROM p
"""
