"""The exact round of the n-gram join by itself, in small blocks, and without broadcasts."""

import random

import pytest

from seqloom.llm import ngram_join as N

from .test_text_ops import brute_links


@pytest.mark.parametrize("partners,rows", [(0, 0), (0, 300_000), (2, 0)])
def test_blocks_of_members_and_probes_lose_no_link(spark, monkeypatch, partners, rows):
    for name, value in (("PARTNERS", partners), ("BLOCK", 5), ("PROBES", 3), ("LARGE", 4), ("FREQUENT", 6), ("BROADCAST_ROWS", rows)):
        monkeypatch.setattr(N, name, value)
    rng = random.Random(20 + partners)
    vocab = [f"w{k}" for k in range(60)]
    texts = ["", None, "a b"]
    for size in (40, 25, 8, 8):
        base = [rng.choice(vocab) for _ in range(rng.randrange(60, 120))]
        for _ in range(size):
            words = [*base]
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words))
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    _, roots = brute_links(texts)
    got = {r["doc_id"]: r["component_id"] for r in N.similar_sets(df).collect()}
    assert got == dict(enumerate(roots)) and len(set(roots)) < len(texts) - 20
