"""The quality model against a brute-force expectation-maximisation, and odd tables."""

import math
from collections import Counter

import pytest

from seqloom.llm import quality as Q
from seqloom.llm.queries import QUERIES

MEDIUM = "/root/testdata/sf0.01"


def votes_by_hand(r):
    n, lines, chars = max(1, r["n_words"]), max(1, r["n_lines"]), max(1, r["word_chars"])
    out = []
    for bad, good in (
        (r["n_symbols"] / n > 0.1, r["n_symbols"] / n < 0.02), (r["n_signs"] / chars > 0.12, r["n_signs"] / chars < 0.08),
        (r["n_capitals"] / chars > 0.3, r["n_capitals"] / chars < 0.1), (r["n_bangs"] / n > 0.1, r["n_bangs"] / n < 0.02),
        (r["n_dup_lines"] / lines > 0.3, r["n_dup_lines"] == 0 and r["n_lines"] > 1), (r["n_repeat_words"] / n > 0.3, r["n_repeat_words"] / n < 0.1),
        (r["n_distinct_words"] / math.sqrt(n) < 4 and r["n_words"] >= 20, r["n_distinct_words"] / math.sqrt(n) >= 5), (r["n_words"] < 20, r["n_words"] >= 50),
        (r["word_chars"] / n < 3.5 or r["word_chars"] / n > 7, 4 <= r["word_chars"] / n <= 6), (r["n_stopped_lines"] / lines < 0.5, r["n_stopped_lines"] / lines > 0.8),
    ):
        out.append(-1 if bad else 1 if good else 0)
    return tuple(out)


def posteriors_by_hand(votes):
    """The probability of the good class for each vote pattern: a document at a time, class by class."""
    kinds = [1, 1, 2, 2, 3, 3, 3, 0, 0, 0]
    seed = [[0.05] * 10] + [[0.8 if k == c else 0.1 for k in kinds] for c in (1, 2, 3)]
    share0 = [0.85, 0.05, 0.05, 0.05]
    share, bad = share0, seed
    counts = Counter(votes)

    def belief(v):
        p = [share[c] * math.prod(bad[c][j] if x < 0 else 1 - bad[c][j] for j, x in enumerate(v) if x) for c in range(4)]
        return [x / sum(p) for x in p]

    for _ in range(40):
        b = {v: belief(v) for v in counts}
        bad = [
            [
                (sum(n * b[v][c] for v, n in counts.items() if v[j] < 0) + 10 * seed[c][j]) / (sum(n * b[v][c] for v, n in counts.items() if v[j]) + 10)
                for j in range(10)
            ]
            for c in range(4)
        ]
        share = [(sum(n * b[v][c] for v, n in counts.items()) + 10 * share0[c]) / (len(votes) + 10) for c in range(4)]
    return {v: belief(v)[0] for v in counts}


@pytest.fixture(scope="module")
def counted(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    return Q.features(docs).cache()


def test_query_is_brute_force(spark, counted):
    rows = {r["doc_id"]: r for r in counted.collect()}
    votes = {i: votes_by_hand(r) for i, r in rows.items()}
    want = posteriors_by_hand(list(votes.values()))
    got = QUERIES["op5_quality_rules"](spark, MEDIUM).collect()
    assert len(got) == len(rows)
    for r in got:
        p = want[votes[r["doc_id"]]]
        assert r["posterior"] == pytest.approx(p, abs=1e-6)
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and p >= 0.5)


def test_no_vote_is_a_veto_by_itself(spark, counted):
    rows = {r["doc_id"]: r for r in counted.collect()}
    got = [r for r in QUERIES["op5_quality_rules"](spark, MEDIUM).collect() if not r["base_failed"]]
    bad = [(r, sum(x < 0 for x in votes_by_hand(rows[r["doc_id"]]))) for r in got]
    assert any(r["kept"] and n for r, n in bad)
    assert any(not r["kept"] for r, _ in bad) and all(r["kept"] for r, n in bad if not n)


def test_clashing_columns_nulls_and_repeated_rows(spark):
    texts = [None, "", "One two three four five six seven eight nine ten eleven.", "x"]
    rows = [(k % 3 if k < 5 else None, texts[k % 4], 7, 0.5, "k", "a", "w", True) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_WORDS int, posterior double, `Kept` string, `a.b` string, `__words` string, `__code` boolean")
    got = Q.weigh(Q.features(df))
    assert got.columns == ["doc_id", "a.b", "__words", "__code", *Q.COUNTS, "posterior", "base_failed", "kept"]
    out = got.collect()
    assert len(out) == 8 and Counter(r["n_words"] for r in out) == {0: 4, 11: 2, 1: 2}
    assert all(r["base_failed"] == (r["n_words"] < 10) and 0 <= r["posterior"] <= 1 for r in out)
    assert len({(r["n_words"], r["posterior"]) for r in out}) == 3
    again = Q.weigh(got)
    assert again.columns == got.columns and again.count() == 8
    assert Q.weigh(Q.features(df.limit(0))).count() == 0
