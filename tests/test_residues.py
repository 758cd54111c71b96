import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import residues as R

VECTORS = [
    ("", (4294967295, 4294967295, 4294967295)),
    ("A", (1494007004, 4237642359, 2876572339)),
    ("ACGT", (3585480654, 2671550081, 2567970707)),
    ("ACGTACGT", (1161160608, 1143330855, 235335148)),
    ("acgtacgt", (1161160608, 1143330855, 235335148)),
    ("ACGTACGTA", (969193910, 1143330855, 235335148)),
    ("MKVLAAGIVGLLLAQWERTYP", (126385733, 162262074, 285106887)),
    ("XXXXXXXX", (4262768445, 3135402153, 936822559)),
]


@pytest.mark.parametrize("seq,want", VECTORS)
def test_signature_vectors(seq, want):
    sig = R.minhashes(R.words_of(R.codes_of(seq)))
    assert tuple(int(sig[k]) for k in (0, 1, 63)) == want


def test_seeds():
    assert [R.seed(k) for k in (0, 1, 2, 63)] == [0x85EBCA6B, 0x2423441C, 0xC25ABDCD, 0x7592BCFA]


def test_catalyst_words_and_hashes_match_numpy(spark):
    seqs = [v[0] for v in VECTORS] + ["naïve 中 text 😀 ACGT", "a\nb", "ACG"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, seq string")
    rows = df.select("i", R.residue_hex(F.col("seq")).alias("h"), R.kmers(R.residue_hex(F.col("seq"))).alias("w")).collect()
    for r in rows:
        codes = R.codes_of(seqs[r["i"]])
        assert r["h"] == "".join(f"{c:x}" for c in codes)
        assert sorted(set(r["w"])) == R.words_of(codes).tolist()
    hashed = df.select("i", F.explode(R.kmers(R.residue_hex(F.col("seq")))).alias("w")).select("i", R.hash_kmer(F.col("w"), F.lit(R.seed(63)).cast("long")).alias("h"))
    for r in hashed.groupBy("i").agg(F.min("h").alias("h")).collect():
        assert r["h"] == int(R.minhashes(R.words_of(R.codes_of(seqs[r["i"]])))[63])


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y and x else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_is_that_of_the_table():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (np.array([rng.randrange(5) for _ in range(rng.randrange(40))], np.uint8) for _ in range(2))
        assert R.lcs(a, b) == table_lcs(a.tolist(), b.tolist())


def test_short_lcs_in_catalyst(spark):
    rng = random.Random(4)
    pairs = [(k, "".join(rng.choice("ACGTX") for _ in range(rng.randrange(1, 62))), "".join(rng.choice("ACGTX") for _ in range(rng.randrange(1, 62)))) for k in range(60)]
    df = spark.createDataFrame(pairs, "k int, a string, b string")
    for r in df.select("k", R.lcs_short(R.residue_hex(F.col("a")), R.residue_hex(F.col("b"))).alias("n")).collect():
        assert r["n"] == R.lcs(R.codes_of(pairs[r["k"]][1]), R.codes_of(pairs[r["k"]][2]))


def test_threshold_is_strict_and_single_precision():
    assert not R.is_hit(95, 100, 95, R.threshold(95))
    assert R.is_hit(53, 100, 53, R.threshold(53))
    r1, r2 = R.codes_of("ACGTACGTACGTACGTACGT"), R.codes_of("ACGTACGTACGTACGTACGA")
    common = R.lcs(r1, r2)
    assert common == 19 and R.is_hit(19, 20, 20, R.threshold(90)) and not R.is_hit(19, 20, 20, R.threshold(91))
    assert not R.is_hit(0, 0, 0, R.threshold(1))


def test_lcs_in_catalyst_of_any_length(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (0, 1, 61, 62, 63, 70, 124, 125, 190) for letters in ("AC", "ACDEFGHIKLMNPQRSTVWY", "A", "AZ")]
    pairs = [(x, y) for x in texts[::2] for y in texts[1::3]]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", R.lcs_short(R.residue_hex(F.col("a")), R.residue_hex(F.col("b"))).alias("n")).collect():
        assert r["n"] == R.lcs(R.codes_of(r["a"]), R.codes_of(r["b"])), (len(r["a"]), len(r["b"]))


def test_banded_lcs_is_that_of_the_table_for_hits():
    rng = random.Random(3)
    hits = 0
    for _ in range(400):
        letters = rng.choice(["AC", "ACDEF", "ACDEFGHIKLNPRST", "ACZ"])
        x = [rng.choice(letters) for _ in range(rng.choice([0, 1, 30, 64, 130, 200]))]
        y = list(x)
        for _ in range(rng.randrange(1 + len(x) // rng.choice([2, 4, 8, 20]))):
            k = rng.randrange(len(y)) if y else 0
            y[k : k + rng.randrange(2)] = [rng.choice(letters) for _ in range(rng.randrange(2))]
        a, b = sorted(("".join(x), "".join(y)), key=len, reverse=True)
        a, b = R.codes_of(a), R.codes_of(b)
        whole = R.lcs(a, b)
        for identity in (1, 50, 80, 95, 99):
            t = R.threshold(identity)
            got = R.lcs_of_hit(len(a), R.masks_of(a), b, t)
            hit = R.is_hit(whole, len(a), len(b), t)
            hits += hit
            assert got == whole if hit else not R.is_hit(max(got, 0), len(a), len(b), t)
            assert all(R.is_hit(c, len(a), len(b), t) == (c >= R.least_hit(len(a), len(b), t)) for c in range(len(b) + 1))
    assert hits > 300


def test_batch_of_signatures_is_one_by_one():
    rng = random.Random(4)
    codes = [R.codes_of("".join(rng.choice("ACDEFGHZ") for _ in range(n))) for n in (0, 1, 5, 8, 9, 300, 0, R.HASHED_WORDS + 7, 2 * R.HASHED_WORDS + 40, 3)]
    got = R.batch_minhashes(codes)
    assert [r.tolist() for r in got] == [R.minhashes(R.words_of(c)).tolist() for c in codes]
