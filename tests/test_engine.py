import random

import pytest
from pyspark.sql import functions as F

from seqloom.__main__ import number, parse
from seqloom.api import SequenceEngine
from seqloom.operators import align, candidates, community, fast
from seqloom.operators.base import dense_rank_of_rows
from seqloom.operators.components import components
from seqloom.sources.fasta import check_fasta, read_fasta

FASTA = """>r1
ACGTACGTACGTACGTACGT
>r2
ACGTACGTACGTACGTACGA
>r3
ACGTACGTACGTACGTACGT
>r4
TTTTGGGGCCCCAAAATTTT
>r5
ACG
>r6
ACG
>r7
>r8
>r9
MKVLAAGIVGLLLAQWERTYPKDE
>r10
MKVLAAGIVALLLAQWERTYPKDE
"""
REPORT = """>r9
MKVLAAGIVGLLLAQWERTYPKDE
  >r10
>r1
ACGTACGTACGTACGTACGT
  >r2
  >r3
>r4
TTTTGGGGCCCCAAAATTTT
>r5
ACG
  >r6
>r7

>r8

"""


@pytest.fixture(scope="module")
def packed(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("packed")
    (d / "in.fasta").write_text(FASTA)
    stats = SequenceEngine(spark).makedb(f"file://{d}/db", fasta_path=f"file://{d}/in.fasta").first()
    assert (stats["total"], stats["valid"], stats["longest"], stats["shortest"]) == (10, 10, 24, 0)
    return f"file://{d}/db", d


def ordered(df):
    return [r[1] for r in sorted(df.collect())]


def test_candidates_of_ten_records(spark, packed):
    cand = spark.read.parquet(packed[0] + "/candidates")
    rep = {k: [r["rep"] for r in cand.where(F.col("band") == k).orderBy("tar").collect()] for k in (0, 1, 63)}
    assert rep[0] == rep[1] == [0, 1, 2, 2, 3, 5, 6, 6, 8, 8]
    assert rep[63] == [0, 1, 2, 3, 2, 5, 6, 6, 8, 8]
    assert cand.where("rep <> tar").count() == 270


@pytest.mark.parametrize("identity,want", [(95, {(2, 4, 100), (6, 7, 100)}), (90, {(0, 1, 92), (2, 3, 90), (2, 4, 100), (3, 4, 90), (6, 7, 100)})])
def test_edges(spark, packed, identity, want):
    seqs, cand = spark.read.parquet(packed[0] + "/sequences"), spark.read.parquet(packed[0] + "/candidates")
    assert {(r["rep"], r["tar"], r["score"]) for r in align.edges(cand, seqs, identity).collect()} == want


def test_fast_and_communities(spark, packed):
    engine = SequenceEngine(spark)
    db, d = packed
    assert ordered(engine.fast(db, 95)) == [0, 1, 2, 3, 2, 5, 6, 6, 8, 9]
    assert ordered(engine.fast(db, 90, result=f"file://{d}/fast")) == [0, 0, 2, 2, 2, 5, 6, 6, 8, 9]
    assert ordered(engine.clustering(db, 90, result=f"file://{d}/leiden")) == [0, 0, 2, 2, 2, 5, 6, 6, 8, 9]
    for kind in ("fast", "leiden"):
        assert "".join(p.read_text() for p in sorted((d / kind).glob("part-*"))) == REPORT
    for bad in ({"identity": 0}, {"identity": 100}, {"bands": 0}, {"bands": 65}):
        with pytest.raises(ValueError):
            engine.fast(db, **bad)


def test_first_hit_is_that_of_rounds(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("ACDEFGHIKL") for _ in range(60)) for _ in range(6)]
    seqs = []
    for k in range(60):
        s = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            s[rng.randrange(len(s))] = rng.choice("ACDEFGHIKL")
        seqs.append((k, ">" + str(k), "".join(s)))
    df = spark.createDataFrame(seqs, "pos long, name string, seq string").withColumns({"name_len": F.octet_length("name"), "read_len": F.octet_length("seq")})
    ranked = candidates.rank_by_length(df).cache()
    cand = candidates.candidates(candidates.long_signatures(candidates.signatures(ranked, 16))).cache()
    hits = align.edges(cand, ranked, 80).cache()
    got = {r["tar"]: (r["parent"], r["band"]) for r in fast.parents(cand, hits).collect()}
    similar = {(r["rep"], r["tar"]) for r in hits.collect()}
    rows = sorted((r["band"], r["tar"], r["rep"]) for r in cand.where("rep <> tar").collect())
    want, compared = {}, 0
    for band in range(16):
        hit = {}
        for b, tar, rep in rows:
            if b == band and tar not in want:
                compared += 1
                if (rep, tar) in similar:
                    hit[tar] = (rep, band)
        want.update(hit)
    assert got == want and len(want) > 5
    assert fast.compare_pairs(cand, fast.parents(cand, hits)).first()[0] == compared
    roots = {r["tar"]: r["root"] for r in fast.roots(fast.parents(cand, hits)).collect()}
    for tar in want:
        up = tar
        while up in want:
            up = want[up][0]
        assert roots[tar] == up


def test_dense_rank_and_components(spark):
    rows = [(i, (i * 7919) % 101) for i in range(500)]
    got = dense_rank_of_rows(spark.createDataFrame(rows, "id long, v long"), [F.col("v").desc(), F.col("id").asc()], "k").collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["k"])] == [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert sorted(r["k"] for r in got) == [*range(500)]


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, one_task):
    import seqloom.operators.components as c

    monkeypatch.setattr(c, "ONE_TASK", one_task)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(500, 500)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k != 500} == {x: root(x) for x in parent if x != 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n,pairs,gamma,want", [
    (6, [(0, 1), (1, 2), (0, 2), (3, 4)], 0.1, [0, 0, 0, 1, 1, 2]),
    (6, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)], 1.0, [0, 0, 0, 1, 1, 1]),
    (3, [], 1.0, [0, 1, 2]),
])
def test_communities_of_small_graphs(n, pairs, gamma, want):
    for seed in range(20):
        assert community.communities(n, pairs, gamma, seed=seed) == want


def test_communities_are_connected_and_gain_modularity():
    rng = random.Random(9)
    pairs = [(u, v) for u in range(60) for v in range(u) if rng.random() < (0.4 if u % 6 == v % 6 else 0.02)]
    label = community.communities(60, pairs, 1.0)
    assert label == community.communities(60, pairs, 1.0)
    m = len(pairs)
    deg = [sum(x in p for p in pairs) for x in range(60)]

    def q(lab):
        inside = sum(lab[u] == lab[v] for u, v in pairs)
        mass = {}
        for x, c in enumerate(lab):
            mass[c] = mass.get(c, 0) + deg[x]
        return inside / m - sum(s * s for s in mass.values()) / (4 * m * m)

    assert q(label) > q([*range(60)])
    for c in set(label):
        nodes = {x for x in range(60) if label[x] == c}
        seen, todo = set(), [min(nodes)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [u + v - x for u, v in pairs if x in (u, v) and u + v - x in nodes]
        assert seen == nodes


@pytest.mark.parametrize("identity,gamma", [(95, 0.1), (90, 0.2), (80, 0.4), (50, 1.0), (1, 0.02), (99, 0.02)])
def test_resolution(identity, gamma):
    assert community.resolution(identity) == pytest.approx(gamma, abs=1e-6)


def test_fasta_rules(spark, tmp_path):
    def read(text, name="x.fa"):
        (tmp_path / name).write_text(text, newline="")
        return [(r["name"], r["seq"]) for r in read_fasta(spark, f"file://{tmp_path}/{name}").orderBy("pos").collect()]

    assert read("first\nAC\nGT\n\n>b\nA>C\nac\n>c\n>d\n", "a.fa") == [("first", "ACGT"), (">b", "A>Cac"), (">c", ""), (">d", "")]
    assert read(">a\nAC\n>b\nA\r\n", "b.fa") == [(">a", "AC"), (">b", "A\r")]
    assert read("", "c.fa") == []
    for bad in (">a\r\nAC\n", ">a\nAC"):
        (tmp_path / "bad.fa").write_text(bad, newline="")
        with pytest.raises(ValueError):
            check_fasta(spark, f"file://{tmp_path}/bad.fa")
    with pytest.raises(ValueError):
        check_fasta(spark, f"file://{tmp_path}/none.fa")
    with pytest.raises(ValueError, match="no valid"):
        SequenceEngine(spark).makedb(f"file://{tmp_path}/db", fasta_path=f"file://{tmp_path}/c.fa")


def test_fasta_in_many_splits(spark, tmp_path):
    rng = random.Random(4)
    want = [(f">n{i}", "".join(rng.choice("ACGT") for _ in range(rng.randrange(200)))) for i in range(2000)]
    (tmp_path / "m.fa").write_text("".join(f"{n}\n{s[:70]}\n{s[70:]}\n" for n, s in want))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = read_fasta(spark, f"file://{tmp_path}/m.fa")
        assert got.rdd.getNumPartitions() > 4
        assert [(r["name"], r["seq"]) for r in got.orderBy("pos").collect()] == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_length_limit(spark):
    df = spark.createDataFrame([(1, 65_534), (2, 65_535)], "pos long, read_len int")
    assert [r["pos"] for r in candidates.length_filter(df).collect()] == [1]


def test_flags():
    assert parse(["-m", "fast", "-i", "80", "-i", "90", "-z", "1"])["-i"] == "90"
    assert (number("12x"), number("abc"), number("-3")) == (12, 0, -3)


def test_candidates_of_a_bucket_over_many_ranges(spark):
    rng = random.Random(12)
    rows = [(k, 9, band, 7 if k % 3 else rng.randrange(40)) for k in range(3000) for band in (0, 1)] + [(k, 0, 2, 0xFFFFFFFF) for k in range(500)]
    rng.shuffle(rows)
    got = candidates.candidates(spark.createDataFrame(rows, "idx long, read_len int, band int, sig long").repartition(7))
    assert got.columns == ["band", "tar", "tar_len", "rep", "rep_len"]
    last, want = {}, set()
    for idx, size, band, sig in sorted(rows):
        rep, rep_len = last.get((band, sig), (idx, size))
        want.add((band, idx, size, rep, rep_len))
        last[band, sig] = idx, size
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(rows) and set(found) == want
    assert candidates.candidates(spark.createDataFrame([], "idx long, read_len int, band int, sig long")).count() == 0


def test_statistics_and_stored_signatures(spark, packed):
    from seqloom.sources import store

    row = SequenceEngine(spark).statistics(packed[0], 90).first()
    assert (row["valid"], row["longest"], row["shortest"], row["edges"], row["clusters"]) == (10, 24, 0, 5, 6)
    signed = store.read_signatures(spark, packed[0])
    again = candidates.candidates(candidates.long_signatures(signed)).select("band", "tar", "rep")
    assert sorted(map(tuple, again.collect())) == sorted((r["band"], r["tar"], r["rep"]) for r in spark.read.parquet(packed[0] + "/candidates").collect())
