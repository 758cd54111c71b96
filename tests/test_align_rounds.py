import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import many
from seqloom.functions import residues as R
from seqloom.operators import align, candidates


def near(rng, letters, n):
    """Two sequences, the second a copy with changes or something else."""
    x = [rng.choice(letters) for _ in range(n)]
    y = list(x) if rng.randrange(4) else [rng.choice(letters) for _ in range(n)]
    for _ in range(rng.randrange(1 + n // rng.choice([4, 8, 20]))):
        k = rng.randrange(len(y)) if y else 0
        y[k : k + rng.randrange(3)] = [rng.choice(letters) for _ in range(rng.randrange(3))]
    return "".join(x), "".join(y)


@pytest.mark.parametrize("few", [1, 64])
def test_hits_of_many_pairs_are_those_one_by_one(monkeypatch, few):
    monkeypatch.setattr(many, "FEW", few)
    monkeypatch.setattr(many, "LONGEST", 500)
    rng = random.Random(few)
    pairs = [near(rng, rng.choice(["AC", "ACDEF", "ACDEFGHIKLNPRST", "ACZ"]), rng.choice([0, 1, 55, 56, 57, 130, 400, 700])) for _ in range(500)]
    codes = [(R.codes_of(x), R.codes_of(y)) for x, y in pairs]
    lengths = np.array([[len(x), len(y)] for x, y in codes])
    whole = [R.lcs(x, y) for x, y in codes]
    hits = 0
    for identity in (1, 50, 80, 95, 99):
        t = R.threshold(identity)
        assert many.least_hits(lengths[:, 0], lengths[:, 1], t).tolist() == [R.least_hit(n, m, t) for n, m in lengths.tolist()]
        got = many.hits_of_pairs([R.pack_codes(x) for x, _ in codes], [R.pack_codes(y) for _, y in codes], lengths[:, 0], lengths[:, 1], t)
        for (n, m), common, g in zip(lengths.tolist(), whole, got.tolist(), strict=True):
            hit = R.is_hit(common, n, m, t)
            hits += hit
            assert g == common if hit else not R.is_hit(max(g, 0), n, m, t)
    assert hits > 800


def test_packed_codes_come_back():
    for n in (0, 1, 2, 7, 8):
        codes = np.arange(n, dtype=np.uint8) + 1
        assert R.unpack_codes(R.pack_codes(codes), n).tolist() == codes.tolist()


def test_rounds_and_one_round_give_the_same(spark, monkeypatch):
    rng = random.Random(8)
    texts = [x for _ in range(40) for x in near(rng, "ACDEFGHIKL", rng.choice([40, 60, 90]))] + ["", ""]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    seqs = candidates.rank_by_length(candidates.sequences_from_text(df))
    rows = {r["idx"]: r["seq"] for r in seqs.collect()}
    pairs = candidates.distinct_pairs(candidates.candidates(candidates.long_signatures(candidates.signatures(seqs))), 80)
    known = {(r["rep"], r["tar"]): R.lcs(R.codes_of(rows[r["rep"]]), R.codes_of(rows[r["tar"]])) for r in pairs.collect()}
    plan = align._rounds
    made = []
    for size in (align.ROUND_BYTES, 10):
        # a round takes as many residues as all sequences have, or ROUND_BYTES if that is more
        monkeypatch.setattr(align, "_rounds", lambda p, most, size=size: made.append(plan(p, most if size > 10 else 300)) or made[-1])
        assert {(r["rep"], r["tar"]): r["lcs"] for r in align.align(pairs, seqs).collect()} == known
        hits = {(r["rep"], r["tar"]) for r in align.edges(candidates.candidates(candidates.long_signatures(candidates.signatures(seqs))), seqs, 80).collect()}
        assert hits == {(a, b) for (a, b), n in known.items() if R.is_hit(n, len(rows[a]), len(rows[b]), R.threshold(80)) and n}
    # once for align, twice for edges, which looks at beginnings first
    assert [len(r) for r in made[:3]] == [1, 1, 1] and len(made) == 6 and min(len(made[3]), len(made[4])) > 1
    assert made[3][0][0] == min(a for a, _ in known) and made[3][-1][1] == max(a for a, _ in known)


def test_no_sequence_is_shuffled_as_text_with_a_pair(spark):
    """The alignment's result is a table that is read: before, each pair was dealt with the texts of both sequences in one plan."""
    df = spark.createDataFrame([(k, "ACDEFGHIKL" * 5 + "A" * (k % 3)) for k in range(20)], "doc_id long, text string")
    seqs = candidates.rank_by_length(candidates.sequences_from_text(df))
    hits = align.edges(candidates.candidates(candidates.long_signatures(candidates.signatures(seqs))), seqs, 80)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "seq" not in plan and hits.agg(F.count("*")).first()[0] > 10
