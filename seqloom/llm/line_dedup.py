"""Line dedup by a log-template tree: lines of one template that recur across documents are dropped."""

from __future__ import annotations

import re
from array import array
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, col, fresh, others, release, settled, typed, written

#: Words from which a line has a template, documents from which a template recurs, and leading words that a path through the tree has.
WORDS, DOCUMENTS, DEPTH = 5, 3, 3
#: Words from which a line is long, documents from which a long template recurs, and those from which a line of under WORDS words does.
LONG, LONG_DOCUMENTS, SHORT_DOCUMENTS = 20, 2, 10
#: Share of words, place by place, that a line has in common with the first line of its template.
SIMILAR = 0.75
#: Words that a key of a template should span at least.
KEY_WORDS = 3
FIELD = b"<*>"

_DIGIT = re.compile(rb"[0-9]")
_FIELD = re.compile(rb"[^ ]*[0-9][^ ]*")


def masked(line: bytes) -> bytes | None:
    """A line with single spaces between its words and a mark for each word that has a digit; None if it has no words.

    A line of under WORDS words keeps its digits, as it recurs by equality only. bytes.split() splits at the six ASCII spaces, which are those that separate words here.
    """
    words = line.split()
    if not words:
        return None
    plain = b" ".join(words)
    return _FIELD.sub(FIELD, plain) if len(words) >= WORDS and _DIGIT.search(plain) else plain


def line_key(line: bytes) -> int:
    """The signed 64-bit hash of a masked line."""
    h = xxhash.xxh64_intdigest(line)
    return h - (1 << 64) if h >> 63 else h


def lines_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").split(b"\n") if text is not None else []


class Leaf:
    """The templates under one path of the tree: each is its first line and joins lines that are SIMILAR to it.

    All lines of a leaf have the leading words in common. If the places behind these are cut into k + s blocks, a line that differs in
    at most k places has s blocks or more in common with its template, so templates are found by combinations of s blocks. s is the
    least number for which a combination spans KEY_WORDS words. In short lines a block is one place, and then a key has one template at most.
    """

    def __init__(self, n: int):
        rest, off = n - DEPTH, n - ceil(n * SIMILAR)
        s = next(s for s in range(1, rest - off + 1) if s * rest >= KEY_WORDS * (off + s) or s == rest - off)
        blocks = off + s
        self.cuts = [(DEPTH + rest * k // blocks, DEPTH + rest * (k + 1) // blocks) for k in range(blocks)]
        self.combinations = [*enumerate(combinations(range(blocks), s))]
        self.least = n * SIMILAR
        self.number: dict[str, int] = {}
        self.rows = np.empty((16, n), np.int32)
        self.keys: list[int] = []
        self.by_blocks: dict[tuple, array] = {}

    def template(self, tokens: list[str], key: int) -> int:
        """The key of the line's template; among several similar ones the most similar, then the first."""
        number = self.number
        row = np.array([number.setdefault(t, len(number)) for t in tokens], np.int32)
        blocks = [hash((*tokens[a:b],)) for a, b in self.cuts]
        places = [(c, *[blocks[k] for k in chosen]) for c, chosen in self.combinations]
        met = [x for p in places if (x := self.by_blocks.get(p))]
        if met:
            near = np.concatenate([np.frombuffer(x, np.int32) for x in met]) if len(met) > 1 else np.frombuffer(met[0], np.int32)
            same = (self.rows[near] == row).sum(axis=1)
            if (most := same.max()) >= self.least:
                return self.keys[near[same == most].min()]
            del near  # a view of an array that must grow
        at = len(self.keys)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[at] = row
        self.keys.append(key)
        for p in places:
            self.by_blocks.setdefault(p, array("i")).append(at)
        return key


def documents_of(words: int) -> int:
    """Documents from which a template of so many words recurs."""
    return SHORT_DOCUMENTS if words < WORDS else DOCUMENTS if words < LONG else LONG_DOCUMENTS


def _parse(batches):
    """The template of each distinct line and the documents it needs; rows come by path, so one leaf is held at a time.

    The first line of a leaf is its own template, and most leaves have no other, so a leaf is made with its second line.
    """
    path, leaf, first = None, None, None
    for batch in batches:
        out, least = [], []
        for p, key, line in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            words = line.count(" ") + 1
            least.append(documents_of(words))
            if words < WORDS:
                out.append(key)
                continue
            here = (words, *line.split(" ", DEPTH)[:DEPTH])
            if here != path:
                path, leaf, first = here, None, (line, key)
                out.append(key)
                continue
            if leaf is None:
                leaf = Leaf(words)
                leaf.template(first[0].split(" "), first[1])
            out.append(leaf.template(line.split(" "), key))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.int64()), batch.column(3), pa.array(least, pa.int8())], ["key", "template", "docs", "least"])
        release()


def _distinct(batches):
    """The masked lines of a batch with the number of its documents that have them."""
    for batch in batches:
        docs: dict[bytes, int] = {}
        for text in batch.column(0).to_pylist():
            for line in {m for x in lines_of(text) if (m := masked(x)) is not None}:
                docs[line] = docs.get(line, 0) + 1
        path = [line_key(b"%d " % (line.count(b" ") + 1) + b" ".join(line.split(b" ", DEPTH)[:DEPTH])) for line in docs]
        yield pa.RecordBatch.from_arrays(
            [pa.array(path, pa.int64()), pa.array([*map(line_key, docs)], pa.int64()), pa.array([*docs], pa.binary()).cast(pa.string()), pa.array([*docs.values()], pa.int64())],
            ["path", "key", "line", "docs"],
        )
        release()


def _keys(batches):
    """(doc_id, key) of the lines of each document."""
    for batch in batches:
        ids, keys = [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = {line_key(m) for x in lines_of(text) if (m := masked(x)) is not None}
            ids += [i] * len(own)
            keys += own
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(keys, pa.int64())], ["doc_id", "key"])


def recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key): the lines to drop, by the hash of the masked line.

    The tree's path is the number of words and the first DEPTH of them; fields that vary are generalised by the mask and by
    the places in which a template's lines differ. Lines are made distinct first, in each batch and again on the map side, so a
    line that a third of all documents has is one row of its leaf. A template recurs if DOCUMENTS documents have lines of it, or
    LONG_DOCUMENTS if these are long; a line of under WORDS words is its own template and needs SHORT_DOCUMENTS. All
    but the document with the smallest id lose the lines.
    """
    bound_batches(df.sparkSession)
    docs = df.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    keyed = typed("doc_id", docs.schema["doc_id"].dataType, "key long")
    distinct = docs.select("text").mapInArrow(_distinct, "path long, key long, line string, docs long").groupBy("path", "key", "line").agg(F.sum("docs").alias("docs"))
    parsed = distinct.repartition("path").sortWithinPartitions("path", "line").select("path", "key", "line", "docs").mapInArrow(_parse, "key long, template long, docs long, least byte")
    parsed = written(parsed, "line-templates")
    often = parsed.groupBy("template", "least").agg(F.sum("docs").alias("docs")).where("docs >= least").select("template")
    some = settled(parsed.join(often, "template").select("key", "template", "least"))
    held = written(docs.mapInArrow(_keys, keyed).join(some, "key"), "template-lines")
    spread = held.select("template", "least", "doc_id").distinct().groupBy("template", "least").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))
    # settled, so that the join's sides are plain exchanges and a hot template's rows can be split
    spread = settled(spread.where("docs >= least").select("template", "first"))
    drop = held.join(spread, "template").where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return drop.select("doc_id", "key")


def drop_recurring(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with recurring lines taken out of its texts, and with n_lines and n_dropped.

    Lines are split at line feeds and the others stay as they are, in order. Documents stay, empty or not. A null text has no
    lines and stays null. Rows that share an id are one document: they don't make a line recur, and the same lines are dropped
    from both. Rows with a null id are one document, too, which is never the first. Ids may have any type that can be ordered. Columns of df with the names of
    added ones, in any case of letters, are replaced. An empty table gives an empty one.
    """
    kept = others(df, "n_lines", "n_dropped")
    gone, own, done = (fresh(df, x) for x in ("__drop", "__id", "__clean"))
    per_doc = recurring_lines(df, id_col, text_col).groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("key").alias(gone))
    rows = df.select(*map(col, kept)).join(per_doc, col(id_col).eqNullSafe(F.col(own)), "left")

    @F.arrow_udf("struct<text string, n long, gone long>")
    def clean(texts: pa.Array, drops: pa.Array) -> pa.Array:
        out = []
        for text, drop in zip(texts.to_pylist(), drops.to_pylist(), strict=True):
            lines = lines_of(text)
            if not drop or text is None:
                out.append((text, len(lines), 0))
                continue
            drop = set(drop)
            stay = [x for x in lines if (m := masked(x)) is None or line_key(m) not in drop]
            out.append((b"\n".join(stay).decode(), len(lines), len(lines) - len(stay)))
        release()
        kinds = (pa.string(), pa.int64(), pa.int64())
        return pa.StructArray.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["text", "n", "gone"])

    rows = rows.withColumn(done, clean(col(text_col).cast("string"), F.col(gone)))
    return rows.select(*[F.col(done)["text"].alias(c) if c == text_col else col(c) for c in kept], F.col(done)["n"].alias("n_lines"), F.col(done)["gone"].alias("n_dropped"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_recurring(docs.select("doc_id", "text"))
