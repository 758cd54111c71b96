"""Exact dedup, mixing, quality rules and the n-gram join against SQL and brute force, with the odd cases."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqloom.llm import exact_dedup as E
from seqloom.llm import mixing as M
from seqloom.llm import ngram_join as N
from seqloom.llm import quality as Q
from seqloom.llm.queries import ORACLES, QUERIES

from ..helpers import same, tables

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, kept string, size string, h string, `key` string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def con():
    return tables(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, con, name):
    assert same(QUERIES[name](spark, SMALL), con, ORACLES[name])


def odd_rows():
    rng = random.Random(8)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta".split()) + str(rng.randrange(30)) for _ in range(60)) for _ in range(4)]
    rows = [(0, None, "a"), (1, "", "a"), (2, " \n\t ", None), (3, "Ä b", "b"), (4, "ä b", "b"), (5, "A b", None), (6, "a B", "c"), (7, "a B", "c"), (7, "a B", "c"), (None, "x y z", "b")]
    for k in range(10, 60):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
        rows.append((k, " ".join(words), rng.choice(["a", "b", None])))
    rows.append((99, "long " * 30_000 + "end", "a"))
    return [(i, t, s, "x", "y", "z", "k") for i, t, s in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


def test_exact_dedup_of_odd_rows(odd):
    got = E.exact_dedup(odd).collect()
    assert len(got) == len(odd_rows())
    groups = defaultdict(list)
    for i, t, *_ in odd_rows():
        groups[low(t)].append(i)
    for r in got:
        ids = groups[low(r["text"])]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)
    assert E.exact_dedup(odd.limit(0)).count() == 0


def plain_targets(sizes, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, full, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return full | {s: level * weight[s] for s in open_}
        for s in over:
            full[s] = cap * sizes[s]
            left -= full[s]
        open_ -= over
    return full


@pytest.mark.parametrize("bucket", [4, 10_000])
def test_mixing_of_odd_rows(odd, monkeypatch, bucket):
    monkeypatch.setattr(M, "BUCKET_ROWS", bucket)
    got = M.mix(odd).collect()
    assert len(got) == len(odd_rows())
    sizes = Counter()
    for _, t, s, *_ in odd_rows():
        sizes[s] += len(WORD.findall(t or ""))
    want = plain_targets(sizes)
    for s in sizes:
        rows = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s] for r in rows)
        assert sum(r["taken"] for r in rows) == int(rows[0]["target"])
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
        assert sum(r["taken"] % max(1, r["size"]) > 0 for r in rows) <= 1
    assert M.mix(odd.limit(0)).count() == 0
    text = M.repeat_epochs(M.mix(odd)).select("text").collect()
    assert sum(len(WORD.findall(r["text"])) for r in text) == sum(r["taken"] for r in got)


def features_by_hand(text):
    w = WORD.findall(text or "")
    places = defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i : i + 5])].append(i)
    again = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_quality_features(spark, odd):
    rng = random.Random(1)
    texts = [t for _, t, *_ in odd_rows()] + ["a b c d e", "a b c d e a b c d e", "a\na\nb\n\n a", "x # y*$ <z>", " a b c", "a a a a a a a"]
    texts += ["".join(rng.choice("ab \n") for _ in range(rng.randrange(80))) for _ in range(60)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in Q.features(df).collect():
        assert tuple(r[n] for n in names) == features_by_hand(texts[r["doc_id"]]), texts[r["doc_id"]][:80]
    assert Q.weigh(Q.features(df.limit(0))).count() == 0


def test_quality_finds_junk_and_keeps_clean_documents(spark):
    got = QUERIES["op5_quality_rules"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = got.join(labels, "doc_id").where(~F.col("base_failed")).select("kept", "quality").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) >= 0.97 * len(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_links(texts):
    sets = []
    for t in texts:
        w = WORD.findall(low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = [*range(len(sets))]

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sets, [root(k) for k in range(len(sets))]


@pytest.mark.parametrize("frequent,large", [(32, 32), (3, 2), (2, 1)])
def test_ngram_join_is_brute_force(spark, monkeypatch, frequent, large):
    monkeypatch.setattr(N, "FREQUENT", frequent)
    monkeypatch.setattr(N, "LARGE", large)
    rng = random.Random(frequent)
    vocab = [f"w{k}" for k in range(40)]
    texts = [None, "", " ", "One two", "one TWO", "a b c d e", "A b c d e"]
    passage = [rng.choice(vocab) for _ in range(60)]
    for _ in range(6):
        base = [rng.choice(vocab) for _ in range(rng.randrange(6, 120))]
        for _ in range(18):
            words = [*base]
            for _ in range(rng.randrange(5)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words))
    for _ in range(20):
        texts.append(" ".join([*passage, *(rng.choice(vocab) for _ in range(rng.randrange(1, 20)))]))
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, node string, tokens int")
    sets, roots = brute_links(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.similar_sets(df).collect()}
    assert got == {k: (len(sets[k]), roots[k]) for k in range(len(texts))}
    assert len(set(roots)) < len(texts) - 40


def test_ngram_join_of_odd_rows(spark, odd):
    got = N.similar_sets(odd).collect()
    assert len(got) == len(odd_rows())
    assert sorted(r["component_id"] for r in got if r["doc_id"] in (0, 1, 2)) == [0, 1, 2]
    assert N.similar_sets(odd.limit(0)).count() == 0
