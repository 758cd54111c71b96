import random
from collections import Counter

import pytest

from seqloom.functions import residues as R
from seqloom.operators import candidates, words


@pytest.fixture(scope="module")
def seqs(spark):
    """Some positions come twice, also without a number, and some sequences have no word or a short one."""
    rng = random.Random(6)
    rows = [(k % 25 if k % 9 else None, "".join(rng.choice("ACDEFG .é0") for _ in range(rng.choice([0, 1, 5, 9, 60])))) for k in range(30)] + [(100, None), (101, " .")]
    return candidates.sequences_from_text(spark.createDataFrame(rows, "doc_id long, text string")), rows


def by_position(rows):
    out = {}
    for pos, text in rows:
        found = R.all_words(R.codes_of("".join(c for c in text or "" if c in R.KEPT))).tolist()
        if found:
            out.setdefault(pos, []).extend(found)
    return out


def test_statistics_of_positions(seqs):
    got = words.word_statistics(seqs[0], seqs[0].select("pos")).collect()
    assert {r["pos"]: tuple(r)[1:] for r in got} == {p: (len(w), len({*w}), min(w), max(w), sum(w)) for p, w in by_position(seqs[1]).items()}
    assert len(got) == len({r["pos"] for r in got})


def test_hashes_of_positions(seqs):
    got = {r["pos"]: (r["min_hash_0"], r["min_hash_63"]) for r in words.word_hashes(seqs[0], (0, 63)).collect()}
    assert got == {p: tuple(int(R.minhashes(R.np.array(w, R.np.uint32))[k]) for k in (0, 63)) for p, w in by_position(seqs[1]).items()}


@pytest.mark.parametrize("at_once", [1, 50, 1 << 23])
def test_counts_of_words(seqs, monkeypatch, at_once):
    monkeypatch.setattr(words, "COUNTED_WORDS", at_once)
    want = Counter(w for found in by_position(seqs[1]).values() for w in found)
    got = words.word_counts(seqs[0]).collect()
    assert {r["word"]: r["n"] for r in got} == want and len(got) == len(want)


def test_no_row_for_each_word(seqs):
    """Before, every word was a row that Spark made, dealt and hashed."""
    for df in (words.word_counts(seqs[0]), words.word_hashes(seqs[0], (0,))):
        assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_signed_once(seqs):
    """Before, Spark put a filter on the signatures below the exchange, and so made them twice."""
    plan = candidates.long_signatures(candidates.signatures(seqs[0].withColumn("idx", seqs[0].pos)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sign(") == 1
