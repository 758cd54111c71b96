"""Columns with clashing names, ids of other types, rows that share an id, and long texts in operators and pipeline stages."""

import hashlib

import numpy as np

import corpus_pipeline
from seqloom.llm import bpe, exact_dedup, langid, line_dedup, mixing, ngram_join, warc

SMALL = "/root/testdata/sf0.001"
A = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_helper_columns_of_the_user_come_back(spark):
    df = spark.createDataFrame([(k % 3, t, "s", "h", "key", 1.5) for k, t in enumerate([A, A.upper(), None, "", "b c"])], "doc_id int, text string, source string, __h string, __key string, `a.b` double")
    for out in (exact_dedup.exact_dedup(df), mixing.mix(df)):
        assert {(r["__h"], r["__key"], r["a.b"], r["source"]) for r in out.collect()} == {("h", "key", 1.5, "s")} and out.count() == 5
    clash = df.withColumnsRenamed({"__h": "KEEP_ID", "__key": "Size"})
    assert "KEEP_ID" not in exact_dedup.exact_dedup(clash).columns and "Size" not in mixing.mix(clash).columns
    lang = langid.identify(df.withColumnRenamed("__h", "LANG_PRED"), None)
    assert [c.lower() for c in lang.columns].count("lang_pred") == 1 and lang.count() == 5
    lines = line_dedup.drop_recurring(df.withColumnRenamed("__h", "N_LINES"))
    assert [c.lower() for c in lines.columns].count("n_lines") == 1 and lines.count() == 5
    ids = bpe.encode(df.withColumnRenamed("__h", "INPUT_IDS"), bpe.vocabulary(), spans=True)
    assert [c.lower() for c in ids.columns].count("input_ids") == 1 and ids.count() == 5


def test_ids_of_any_type(spark):
    rows = [("x", A), ("b", A + " fifteen"), ("c", "other words altogether, five of them and more"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_sets(df).collect()}
    assert got == {"x": "b", "b": "b", "c": "c", None: None}
    trip = {r["doc_id"]: r for r in bpe.round_trip(df, bpe.vocabulary()).collect()}
    codec = bpe.ByteBPE(bpe.vocabulary())
    for i, t in rows:
        ids = codec.encode(t)
        starts, ends = codec.spans(t or "", ids)
        assert trip[i]["spans_sha256"] == hashlib.sha256(np.array(starts + ends, "<u4").tobytes()).hexdigest()
        assert trip[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    same = "a line of more than twenty words " * 4
    texts = [("k", same + "\nown"), ("j", same), (None, "x")]
    lines = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring(spark.createDataFrame(texts, "doc_id string, text string")).collect()}
    assert lines == {"k": "own", "j": same, None: "x"}


def test_rows_that_share_an_id_stay_or_go_for_themselves(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    rows = [(1, A), (2, A + " fifteen"), (2, "a text of its own, with more than five words"), (3, A + " sixteen"), (3, A + " fifteen sixteen"), (None, A + " seventeen"), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "e") for i, t in rows], schema)
    got = corpus_pipeline.drop_near_copies(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert sorted(got.select("doc_id", "text").collect(), key=str) == sorted([(1, A), (2, "a text of its own, with more than five words"), (4, None)], key=str)


def test_stages_take_long_texts_and_extra_columns(spark):
    long = " ".join(f"w{k % 5000}" for k in range(120_000))
    schema = "doc_id long, text string, lang string, source string, n_chars long, __row string, __copy string, size string"
    rows = [(1, long, "en", "s", len(long), "r", "c", "z"), (2, A, "en", None, 1, "r", "c", "z"), (3, None, None, None, None, None, None, None), (2, A, "en", None, 1, "r", "c", "z")]
    docs = spark.createDataFrame(rows, schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        # a stage keeps the columns that it doesn't make itself
        assert k == 4 or [c for c in out.columns if c != "size"] == [c for c in docs.columns if c != "size"]
        assert any((r["text"] or "").startswith(long[:1000]) for r in out.collect())


def test_archives_roll_over_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_CLASSES", ((100, 4), (1 << 31, 1)))
    pages = spark.createDataFrame([(k, "u", "x" * (30 if k % 2 else 3000) + str(k)) for k in range(12)], "page_id long, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/w"
    warc.write_captures(pages, path)
    records = warc.read_records(spark, path)
    per_file = records.groupBy("archive").count().collect()
    assert sorted(r["count"] for r in per_file) == [3] * 6 + [6, 12] and records.count() == 36
    assert warc.assemble(records).count() == 12
