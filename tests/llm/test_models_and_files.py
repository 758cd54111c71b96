"""WARC, toxicity, language identification, BPE, HTML extraction and the pipeline."""

import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import bpe, html_extract, langid, mixing, toxicity, warc
from seqloom.llm.queries import QUERIES

from .test_text_ops import brute_links, low

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_warc_round_trip_of_odd_pages(spark, tmp_path):
    big = "é" * 700
    tricky = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello" * 30
    rows = [
        (1, "http://a.example/x?y=1#z", big), (2, "https://b.example", big), (3, None, big), (4, "http://c.example/\r\nEvil: 1", tricky), (5, "u", None),
        (6, "u", ""), (7, "u", "small"), (8, "u", "small"), (9, "u", big), (9, "u", big), (None, "n", "null id"),
    ]
    pages = spark.createDataFrame([(*r, "q", 1) for r in rows], "page_id long, url string, html string, first string, n int")
    path = f"file://{tmp_path}/w"
    warc.write_captures(pages, path)
    got = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(got) == len(rows)
    def page(r):
        return (m := re.search(rb"page-id: (\d+)\r\n", r["metadata"]["payload"])) and int(m[1])

    seen = defaultdict(list)
    for r in got:
        seen[page(r)].append(r)
        assert r["request"]["concurrent_to"] == r["metadata"]["concurrent_to"] == r["response"]["record_id"] == r["capture_id"]
        assert r["request"]["payload"] == b"" and r["request"]["http_head"].startswith("GET /")
    for i, _, html in rows:
        raw = (html or "").encode()
        for r in seen[i]:
            assert r["response"]["payload_digest"] == hashlib.sha1(raw).hexdigest()
            if html == big and i != 9:
                assert r["response"]["warc_type"] == "revisit" and bytes(r["response"]["payload"]) == b""
                assert r["response"]["refers_to"] == seen[9][0]["capture_id"]
            else:
                assert r["response"]["warc_type"] == "response" and bytes(r["response"]["payload"]) == raw
    assert len(seen[9]) == 2
    warc.write_captures(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.assemble(warc.read_records(spark, f"file://{tmp_path}/none")).count() == 0


def test_warc_parser_reads_other_layouts():
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Type: application/http\r\nContent-Length: 8\r\n\r\nH\r\n\r\nbody"[:-1]
    one = one.replace(b"Content-Length: 8", b"Content-Length: %d" % len(b"H\r\n\r\nbod"))
    for data in (one + b"\r\n\r\n" + one, gzip.compress(one + b"\r\n\r\n") + gzip.compress(one + b"\r\n\r\n"), gzip.compress(one + b"\r\n\r\n" + one)):
        assert [(r[0], r[1], r[8]) for r in warc.parse_archive(data)] == [("response", "<a>", b"bod")] * 2
    assert [*warc.parse_archive(b"")] == [] and [*warc.parse_archive(one[:-2])] == []


def edit_one(a, b):
    """Whether one insertion, deletion, change or swap of neighbours turns a into b."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        diff = [k for k in range(len(a)) if a[k] != b[k]]
        return len(diff) == 1 or len(diff) == 2 and diff[1] == diff[0] + 1 and a[diff[0]] == b[diff[1]] and a[diff[1]] == b[diff[0]]
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_automaton_is_edit_distance():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 9))) for _ in range(25)]
    stems = ["".join(rng.choice("abc") for _ in range(9)) for _ in range(3)]
    lex = toxicity.FuzzyLexicon(words, stems)
    for _ in range(4000):
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 13)))
        exact = t in words or any(t.startswith(s) for s in stems)
        near = any(len(w) >= toxicity.FUZZY_WORD and edit_one(w, t) for w in words) or any(edit_one(s, t[:n]) for s in stems for n in range(len(t) + 1))
        assert lex.match(t) == (toxicity.EXACT if exact else toxicity.FUZZY if near else 0), t


def test_quotation_counts_less_than_abuse():
    model = {"words": ["idiot", "moron"], "stems": [], "fuzzy": ["idiot", "moron"], "weak_words": [], "weak_stems": [], "neighbours": [], "bias": -3.0, "weights": [2.0, 0.4, 1.0, 1.0]}
    s = toxicity.Scorer(model)
    filler = "the report went on for a while about many other things and then it came to an end "
    quoted, abuse, wrong = (s.score(filler + x + filler) for x in ('He said "idiot" once. ', "you are an idiot and a moron! ", "you are an idoit "))
    assert quoted < wrong < abuse and s.score(filler) < quoted
    assert s.score("") == s.score(None) == s.score(filler)


def test_toxicity_on_the_fold_it_never_saw(spark):
    got = QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").where("held_out").select("predicted", "toxic", "score").collect()
    right = Counter((r["predicted"], r["toxic"]) for r in rows)
    assert right[1, 1] >= 0.88 * (right[1, 1] + right[0, 1]) and right[1, 0] <= 0.02 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "plain words")], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = docs.withColumn("s", toxicity.score(model, spark, F.col("text"))).collect()
    assert len({r["s"] for r in got}) == 1 and got[0]["s"] < toxicity.THRESHOLD


def test_language_on_the_fold_it_never_saw(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op3_language_id"](spark, MEDIUM).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)


def test_language_of_odd_texts(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 40)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "123 ½ ٣ !!", 1), (4, "я", 1), (5, "the dog", 1)], "doc_id long, text string, score int")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in ("en", "de") and got[5][0] == "en"
    assert langid.learn(odd.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}


@pytest.fixture(scope="module")
def spec():
    return bpe.vocabulary()


def test_bpe_is_tiktoken(spec):
    import public_tokenizers as public
    import tiktoken

    codec = bpe.ByteBPE(spec)
    ref = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(public.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rng = random.Random(7)
    parts = [" ", "\n", "\r\n", "\t", "a", "é", "ß", "'s", "'S", "'ll", "1", "٣", "中", "😀", "##", "!!", "\x1c", "\x85", "​", " ", "　", " the", "ing", "<|endoftext|>", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["a" * 5000, " " * 5000, "ab" * 4000, "\n" * 999 + "x"]
    for t in texts:
        ids = codec.encode(t)
        assert ids == ref.encode_ordinary(t) and codec.decode_bytes(ids) == t.encode() and codec.decode(ids) == t
        starts, ends = codec.spans(t, ids)
        assert all(0 <= a < b <= len(t) for a, b in zip(starts, ends, strict=True))


def test_bpe_operators_on_odd_rows(spark, spec):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "naïve 😀", 0), (3, "naïve 😀", 0)], "doc_id long, text string, starts int")
    got = bpe.decode(bpe.encode(df, spec, spans=True), spec).collect()
    assert [r["decoded"] for r in got] == ["", "", "naïve 😀", "naïve 😀"] and got[0]["input_ids"] == []
    codec = bpe.ByteBPE(spec)
    for r in bpe.round_trip(df, spec).collect():
        text = {3: "naïve 😀"}.get(r["doc_id"], "")
        ids = codec.encode(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="site"><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- c -->
<div class="cookie-banner">We use cookies, accept them please.</div><aside class="sidebar"><p>Other news, much of it.</p></aside>
<{box}><h1>Head &amp; line</h1><p>First   paragraph,<br>with <b>bold</b> text &lt;here&gt; &eacute;.<p>Second, unclosed <a href="x">link</a>.</p>
<div class="advert">Buy now!</div><form><input>Your name</form><ul><li>One point.</li><li>Two points.</li></ul></{end}>
<section id="comments"><p>I am a reader and I have a long comment about all of this, yes.</p></section><footer>&copy; Me</footer></body></html>"""


@pytest.mark.parametrize("box", ["article", "main", 'div class="post"'])
def test_html_keeps_the_article(box):
    got = html_extract.main_text(PAGE.replace("{box}", box).replace("{end}", box.split()[0]))
    assert got == "Head & line\nFirst paragraph, with bold text <here> é.\nSecond, unclosed link.\nOne point.\nTwo points."


def test_html_of_other_layouts():
    page = '<body><div id="top" class="menu"><a>A</a></div><div id="content"><h1>Title</h1><div class="entry"><p>Long text, with commas.</p><p>Short.</p></div></div><div class="comments">Nice, I like it!</div></body>'
    assert html_extract.main_text(page) == "Title\nLong text, with commas.\nShort."
    assert html_extract.main_text('<article><header><h1>T</h1></header><p>Body.</p></article><article class="related"><p>Other, much longer story here.</p></article>') == "T\nBody."
    assert html_extract.main_text("<main><article><p>One.</p></article><article><p>Two, longer.</p></article></main>") == "One.\nTwo, longer."


def test_html_of_odd_pages(spark):
    pages = [None, "", "plain words", "<p>", "<article><p>cut off &am", "<<>><a", "<p>x</p>" * 3000, "<b>" * 2000 + "deep"]
    df = spark.createDataFrame([(k, "u", p, "old") for k, p in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert (got[0], got[1], got[2], got[3], got[4]) == ("", "", "plain words", "", "cut off &am")
    assert got[6].count("x") == 3000 and got[7] == "deep"


def test_html_of_the_pages_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in QUERIES["op9_html_extraction"](spark, SMALL).collect()}
    import html

    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?p>|</?h1>", inner))
        assert got[p["page_id"]] == "\n".join(filter(None, blocks))


def test_pipeline_is_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scorer = toxicity.Scorer(toxicity.model_of(spark, SMALL))
    rows = [r for r in docs.collect() if scorer.score(r["text"]) < toxicity.THRESHOLD]
    best = {}
    for r in rows:
        best[low(r["text"])] = max(best.get(low(r["text"]), -1), r["doc_id"])
    rows = sorted((r for r in rows if best[low(r["text"])] == r["doc_id"]), key=lambda r: r["doc_id"])
    _, roots = brute_links([r["text"] for r in rows])
    rows = [r for k, r in enumerate(rows) if roots[k] == k]
    mixed = mixing.repeat_epochs(mixing.mix(spark.createDataFrame(rows, docs.schema))).collect()
    codec = bpe.ByteBPE(bpe.vocabulary())
    want = sorted((r["doc_id"], r["text"], tuple(codec.encode(r["text"]))) for r in mixed)
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r["doc_id"], r["text"], tuple(r["input_ids"])) for r in got) == want
    assert all(r["n_chars"] == len(r["text"]) and r["n_tokens"] == len(r["input_ids"]) for r in got)


def test_pipeline_stages_on_odd_rows(spark):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "same text here", "en", "a", 14), (3, "same text here", "en", "a", 14), (4, "Same text here", "en", None, 14)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SMALL)
            assert out.count() <= 2 * n
            assert k == 4 or out.columns == docs.columns
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_exact_copies(spark, spark.createDataFrame(rows, schema), SMALL).collect()) == [2, 4]
    twice = spark.createDataFrame(rows[2:4], schema)
    assert corpus_pipeline.drop_exact_copies(spark, twice, SMALL).count() == 1
