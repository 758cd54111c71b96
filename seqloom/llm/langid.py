"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, col, fresh, others, release

UND = "und"
BITS = 15
ORDERS = (3, 4)
DIM = 16
#: Bytes of one bucket of a training example: its number and its weight.
EXAMPLE_BYTES = 6

_LETTERS = re.compile(r"[^\W\d_]")
_TO_SPACE = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTERS.finditer(text))


def subwords(text: str) -> np.ndarray:
    """The bucket of every byte n-gram of the whole text in lower case; anything but letters counts as space."""
    raw = f" {text.lower()} ".encode("utf-8", "replace").translate(_TO_SPACE)
    b = np.frombuffer(b" ".join(raw.split()).join((b" ", b" ")), np.uint8).astype(np.uint32)
    out = []
    for n in ORDERS:
        if len(b) >= n:
            gram = b[: len(b) - n + 1].copy()
            for k in range(1, n):
                gram <<= np.uint32(8)
                gram |= b[k : len(b) - n + 1 + k]
            gram += np.uint32(n)
            gram *= np.uint32(0x9E3779B1)
            out.append(gram >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], epochs: int = 6, rate: float = 2.0, seed: int = 3) -> dict:
    """Fits embeddings and softmax by stochastic gradient descent on (buckets, weights, label) examples.

    Every fifth example is kept back: on those the temperature that makes probabilities honest is chosen,
    and the least confidence at which at most 1 % of the accepted ones are wrong.
    """
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(languages)), np.float32)
    held = examples[::5] if len(examples) >= 50 else examples
    fit = [x for k, x in enumerate(examples) if k % 5] if len(examples) >= 50 else examples
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(fit)):
            buckets, weights, label = fit[k]
            mean = weights @ emb[buckets]
            slope = _softmax(mean @ out)
            slope[label] -= 1
            back = out @ slope
            out -= np.outer(mean, slope) * np.float32(step)
            emb[buckets] -= np.outer(weights, back * np.float32(step * 8))
    table = (emb @ out).astype(np.float32)
    logits = np.array([w @ table[b] for b, w, _ in held])
    labels = np.array([y for _, _, y in held])
    rows = np.arange(len(labels))
    heat = min((float(np.exp(t)) for t in np.linspace(-3, 3, 61)), key=lambda t: -np.log(_softmax(logits / t)[rows, labels] + 1e-12).sum())
    prob = _softmax(logits / heat)
    top, right = prob.max(1), prob.argmax(1) == labels
    order = np.argsort(-top)
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= 0.01)
    floor = float(top[order[fine[-1]]]) if len(fine) else 1.0
    return {"languages": languages, "table": table, "heat": heat, "floor": floor}


def predict(model: dict | None, text: str | None) -> tuple[str, float, bool]:
    """(language, probability, accepted); und for null, for no letters, and without a model."""
    if not text or model is None or not has_letter(text):
        return UND, 0.0, False
    grams = subwords(text)
    table = model["table"]
    if len(grams) > len(table):
        logits = (np.bincount(grams, minlength=len(table)).astype(np.float32) @ table) / len(grams)
    else:
        logits = table[grams].mean(axis=0)
    prob = _softmax(logits.astype(np.float64) / model["heat"])
    best = int(prob.argmax())
    return model["languages"][best], float(prob[best]), bool(prob[best] >= model["floor"])


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def held_out(id_col: Column) -> Column:
    """Whether a row is in the fold that nothing is learned from; a null id is not."""
    return F.coalesce(fold(id_col) == 2, F.lit(False))


#: Rows of a language that are learned from, about, and bytes of training examples in all, at most about.
PER_LANGUAGE, SAMPLE_BYTES = 1200, 128 << 20


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most_bytes: int = SAMPLE_BYTES) -> dict | None:
    """A model of all languages in df's rows whose text and language are not null; None if there are none.

    It is fitted on a sample that is bounded by rows, about `per_language` of each language, and by bytes, `most_bytes` shared
    evenly by the languages. A language's rows are taken by a threshold on the hash of the whole text, which follows from its number of
    rows and the bytes that their buckets may take, so that reruns agree. Whole texts are turned into weighted buckets on the executors;
    these come to the driver. The table of languages has one row each, as the model has one column.
    """
    spark = df.sparkSession
    bound_batches(spark)
    rows = df.where(col(text_col).isNotNull() & col(lang_col).isNotNull()).select(col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang"))
    bound = F.least(F.octet_length("text") * len(ORDERS), F.lit(1 << BITS)) * EXAMPLE_BYTES
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(bound.cast("double")).alias("bytes")).orderBy("lang").collect()
    if not counts:
        return None
    languages = [r["lang"] for r in counts]
    share = most_bytes / len(languages)
    picks = [(r["lang"], k, int(min(1.0, per_language / r["n"], share / max(r["bytes"], 1)) * (1 << 40))) for k, r in enumerate(counts)]
    schema = pa.schema([("b", pa.binary()), ("w", pa.binary()), ("label", pa.int32()), ("h", pa.int64())])

    def featurise(batches):
        for batch in batches:
            got = []
            for text, label, h in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                grams = subwords(text)
                if len(grams) and has_letter(text):
                    b, c = np.unique(grams, return_counts=True)
                    got.append((b.astype(np.uint16).tobytes(), (c / c.sum()).astype(np.float32).tobytes(), label, h))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], f.type) for k, f in enumerate(schema)], schema=schema)

    least = spark.createDataFrame(picks, "lang string, label int, below long")
    hashed = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(least), "lang")
    sample = hashed.where(F.pmod("h", F.lit(1 << 40)) < F.col("below")).select("text", "label", "h")
    got = sample.mapInArrow(featurise, "b binary, w binary, label int, h long").collect()
    got.sort(key=lambda r: (r["h"], r["label"]))
    examples = [(np.frombuffer(r["b"], np.uint16), np.frombuffer(r["w"], np.float32), r["label"]) for r in got]
    return train(examples, languages) if examples else None


def identify(df: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """df with lang_pred, score and accepted (false where the calibrated probability is below the rejection limit).

    Null texts and texts without letters are `und` with score 0, as is everything if the model is None. Texts count whole, however long; equal
    texts have equal results, so rows that repeat do too. Columns with the names of added ones, in any case of letters, are replaced; others
    pass through, nulls included. Rows stay in their partitions. The model's size is its number of buckets times that of languages. An empty table gives an empty one.
    """
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred string, score double, accepted boolean>")
    def run(texts: pa.Array) -> pa.Array:
        got = [predict(shared.value, t) for t in texts.to_pylist()]
        release()
        kinds = (pa.string(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate(kinds)], ["lang_pred", "score", "accepted"])

    added = ["lang_pred", "score", "accepted"]
    one = fresh(df, "__lang")
    kept = others(df, *added)
    return df.select(*map(col, kept), run(col(text_col).cast("string")).alias(one)).select(*map(col, kept), *[F.col(one)[c].alias(c) for c in added])


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model).drop("text")
