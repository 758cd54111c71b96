"""The toxicity query against a scorer that tries every term, and odd tables."""

import math

import pytest
from pyspark.sql import functions as F

from seqloom.llm import toxicity as T
from seqloom.llm.queries import QUERIES

from .test_models_and_files import edit_one

SMALL = "/root/testdata/sf0.001"


def near_by_hand(word, words, stems, fuzzy, near):
    """(exact, what an edit counts) of a word."""
    exact = word in words or any(word.startswith(s) for s in stems)
    hits = [near.get(x, T.NEAR) for x in words if x in fuzzy and len(x) >= 4 and edit_one(x, word)]
    hits += [near.get(x, T.NEAR) for x in stems if x in fuzzy and len(x) >= 4 and any(edit_one(x, word[:n]) for n in range(len(x) - 1, len(x) + 2))]
    return exact, max(hits, default=0.0)


def score_by_hand(m, text, known):
    def meet(word):
        if word not in known:
            exact, edit = near_by_hand(word, m["words"], m["stems"], m["fuzzy"], m["near"])
            weak, weak_edit = near_by_hand(word, m["weak_words"], m["weak_stems"], m["weak_fuzzy"], m["near"])
            if word in m["neighbours"]:
                edit = weak_edit = 0.0
            known[word] = (0, 1.0) if exact else (2, 1.0) if weak else (0, edit) if edit else (2, weak_edit)
        return known[word]

    tokens = (text or "").lower().split()
    bare = [t.strip(T._EDGE) for t in tokens]
    found = [meet(w) if w else (0, 0.0) for w in bare]
    places = [k for k, (_, n) in enumerate(found) if n]
    x = [0.0] * 4
    if places:
        sums, marks = [0.0] * 3, [sum(c in T._QUOTES for c in t) for t in tokens]
        for k in places:
            around = range(max(0, k - T.WINDOW), min(len(tokens), k + T.WINDOW + 1))
            addressed = any(bare[j] in T._ADDRESS for j in around)
            quoted = (sum(marks[:k]) % 2 or marks[k] or any(bare[j] in T._REPORT for j in around)) and not addressed
            beside = k - 1 in places or k + 1 in places
            kind, n = found[k]
            sums[1 if quoted else kind] += n * (1 + 0.25 * addressed + 0.25 * beside + 0.1 * ("!" in tokens[k]))
        more = 1 + T.APART * (len({bare[k] for k in places}) - 1)
        x = [*(math.log1p(s * more) for s in sums), min(1.0, 10 * len(places) / len(tokens))]
    return 1 / (1 + math.exp(-(m["bias"] + sum(w * v for w, v in zip(m["weights"], x, strict=True)))))


def test_query_is_brute_force(spark):
    model, known = T.model_of(spark, SMALL), {}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op2_toxicity"](spark, SMALL).collect()
    assert len(got) == len(docs) and model["words"]
    for r in got:
        assert r["score"] == pytest.approx(score_by_hand(model, docs[r["doc_id"]], known), abs=1e-9), r["doc_id"]
        assert r["predicted"] == int(r["score"] >= 0.3)


def test_repeated_rows_long_texts_and_extra_columns(spark):
    bad = "you moron "
    rows = [(k, f"plain words of row {k}", 0) for k in range(40)] + [(k, f"{bad} number {k}", 1) for k in range(40, 60)]
    rows += [(60, "filler words " * 50_000 + bad, 1), (61, None, 1), (62, "", 0), (None, bad, 1), (5, "plain words of row 5", 0), (41, f"{bad} number 41", 1)]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t, _ in rows], "doc_id long, text string, score double, toxic int")
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(7, None, "x")], "doc_id long, toxic int, text string")
    model = T.learn(docs, labels)
    got = docs.withColumn("s", T.score(model, spark, F.col("text"))).collect()
    assert len(got) == len(rows) and all(0 <= r["s"] <= 1 for r in got)
    for r in got:
        assert (r["s"] >= T.THRESHOLD) == ("moron" in (r["text"] or "")[-200:])
    assert docs.limit(0).withColumn("s", T.score(model, spark, F.col("text"))).count() == 0
