import pytest

from seqloom.plans.catalogue import ORACLES, QUERIES

from .helpers import same, tables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, con, name):
    assert same(QUERIES[name](spark, SMALL), con, ORACLES[name])


def test_clusters_of_small_documents(spark):
    assert QUERIES["edges_95"](spark, SMALL).count() == 18
    assert QUERIES["edges_80"](spark, SMALL).count() == 25
    assert QUERIES["fast_cluster_sizes"](spark, SMALL).count() == 182


def test_entry_points_work_without_the_optional_part(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 182


def test_pending_of_documents_is_a_loop(spark):
    from seqloom.operators import align, candidates, fast
    from seqloom.operators.base import settled

    seqs = candidates.rank_by_length(candidates.sequences_from_text(spark.read.parquet(f"{SMALL}/documents.parquet")))
    cand = settled(candidates.candidates(candidates.long_signatures(candidates.signatures(seqs))))
    hits = {(r["rep"], r["tar"]) for r in align.edges(cand, seqs, 95).collect()}
    want, done = set(), set()
    rows = sorted((r["band"], r["tar"], r["rep"]) for r in cand.collect())
    for band in range(64):
        now = [x for x in rows if x[0] == band and x[1] != x[2] and x[1] not in done]
        want |= set(now)
        done |= {tar for _, tar, rep in now if (rep, tar) in hits}
    got = {(r["band"], r["tar"], r["rep"]) for r in QUERIES["fast_pending"](spark, SMALL).collect()}
    assert got == want and len(want) > 100
    assert QUERIES["fast_compare_pairs"](spark, SMALL).first()["compare_pairs"] == len(want)
    sizes = {r["cluster_id"]: r["size"] for r in QUERIES["fast_cluster_sizes"](spark, SMALL).collect()}
    table = QUERIES["fast_cluster_table"](spark, SMALL).collect()
    assert len(table) == seqs.count() and {c: sum(r["cluster_id"] == c for r in table) for c in sizes} == sizes
    assert fast.pending(cand.limit(0), cand.select("tar", "rep", "band").limit(0)).count() == 0
