"""WARC archives: writing captures, reading records, and assembling transactions through concurrent-to identifiers."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, scratch, settled

#: A payload of at least so many bytes is stored once; its copies become revisit records.
REVISIT_BYTES = 1000
#: Up to so many repeated payloads, their table is sent to every executor; beyond, it is joined by a shuffle.
BROADCAST_PAYLOADS = 50_000
#: Bytes of payload up to which a capture is of a class, and captures of that class in one archive file at most: 256 MB, but for the largest ones.
FILE_CLASSES = ((1 << 14, 1 << 14), (1 << 18, 1 << 10), (1 << 22, 1 << 6), (1 << 31, 4))
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType(
    [
        T.StructField("warc_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("concurrent_to", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("warc_date", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("http_head", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
    ]
)


def _line(name: str, value: Column | str) -> Column:
    """A header line; nothing if the value is null. Line breaks in a value would end the header, so they become spaces."""
    v = F.regexp_replace(F.lit(value) if isinstance(value, str) else value.cast("string"), r"[\r\n]", " ")
    return F.coalesce(F.concat(F.lit(name + ": "), v, F.lit("\r\n")), F.lit(""))


def _urn(kind: str, *parts: Column) -> Column:
    h = F.md5(F.to_json(F.struct(F.lit(kind).alias("k"), *[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)])).cast("binary"))
    at = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", at(1, 8), at(9, 4), F.concat(F.lit("3"), at(14, 3)), F.concat(F.lit("a"), at(18, 3)), at(21, 12)), F.lit(">"))


def _record(kind: str, rid: Column, date: str, head: Column, content_type: str, block: Column) -> Column:
    return F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n"), _line("WARC-Record-ID", rid), _line("WARC-Date", date), head,
        _line("Content-Type", content_type), _line("Content-Length", F.octet_length(block)), F.lit("\r\n"), block,
    )


def write_captures(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a request, a response (or revisit) and a metadata record per row into gzipped WARC files under path.

    Of rows with equal payloads of at least REVISIT_BYTES bytes the one with the largest id is the response
    and the others are revisits that refer to it and carry no payload. Digests and ids go through one small
    aggregate; the pages themselves are not shuffled while the repeated payloads number at most
    BROADCAST_PAYLOADS. The records of a capture lie together in one file; every record is followed by two
    line ends, which the text writer puts there as its separator. Files are rolled by FILE_CLASSES, so that a reader can hold one.

    Ids are whole numbers; of repeated rows with one id any is the response, and the others are equal to it. A null url has no target header, a null page an
    empty payload, a null id the page-id of none. Other columns are not read, whatever their names. An empty table gives no records.
    """
    base = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    ).withColumns({"sha": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html")})
    first = (
        base.where(F.col("bytes") >= REVISIT_BYTES).select("sha", "id", "url").groupBy("sha")
        .agg(F.count("*").alias("n"), F.max(F.struct("id", "url")).alias("first")).where("n > 1").select("sha", "first")
    )
    first = settled(first)
    small = first.count() <= BROADCAST_PAYLOADS
    rows = base.join(F.broadcast(first) if small else first, "sha", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    rid = _urn("response", F.col("id"), F.col("url"), F.col("sha"))
    host = F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1), F.lit(""))
    path_part = F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.col("bytes")), F.lit("\r\n"))
    where = _line("WARC-Target-URI", F.col("url"))
    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha")))
    tied = _line("WARC-Concurrent-To", rid)
    request = _record(
        "request", _urn("request", rid), date, F.concat(where, tied), "application/http; msgtype=request",
        F.concat(F.lit("GET "), F.regexp_replace(path_part, r"[\r\n ]", "%20"), F.lit(" HTTP/1.1\r\n"), _line("Host", host), F.lit("\r\n")),
    )
    response = _record("response", rid, date, F.concat(where, digest), "application/http; msgtype=response", F.concat(http, F.col("html")))
    again = _record(
        "revisit", rid, date,
        F.concat(where, digest, _line("WARC-Profile", PROFILE), _line("WARC-Refers-To", _urn("response", F.col("first.id"), F.col("first.url"), F.col("sha"))), _line("WARC-Refers-To-Target-URI", F.col("first.url"))),
        "application/http; msgtype=response", http,
    )
    meta = _record("metadata", _urn("metadata", rid), date, F.concat(where, tied), "application/warc-fields", _line("page-id", F.col("id")))
    size = F.lit(len(FILE_CLASSES) - 1)
    for k in range(len(FILE_CLASSES) - 2, -1, -1):
        size = F.when(F.col("bytes") <= FILE_CLASSES[k][0], F.lit(k)).otherwise(size)
    records = rows.withColumn("class", size).select("class", F.explode(F.array(request, F.when(revisit, again).otherwise(response), meta)).alias("value"))
    found = sorted(r["class"] for r in pages.select(F.octet_length(F.coalesce(F.col(html_col).cast("string"), F.lit(""))).alias("bytes")).select(size.alias("class")).distinct().collect())
    for k in found or [0]:
        records.where(F.col("class") == k).select("value").write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option(
            "maxRecordsPerFile", 3 * FILE_CLASSES[k][1]
        ).text(path)


def parse_archive(data: bytes, archive: str = "") -> Iterator[tuple]:
    """The records of one WARC file, gzipped as a whole, by record, or not at all; by Content-Length, so any payload is safe.

    The file is inflated piece by piece; memory holds the largest record and one piece. A record cut short by
    the end of the file is left out.
    """
    def pieces() -> Iterator[bytes]:
        if data[:2] != b"\x1f\x8b":
            for at in range(0, len(data), 1 << 20):
                yield data[at : at + (1 << 20)]
            return
        rest = data
        while rest:
            z = zlib.decompressobj(31)
            todo = rest
            while todo and not z.eof:
                out = z.decompress(todo, 1 << 20)
                todo = z.unconsumed_tail
                yield out
            rest = z.unused_data

    source, buf, at, offset = pieces(), b"", 0, 0

    def need(n: int) -> bool:
        nonlocal buf, at
        parts = []
        have = len(buf) - at
        while have < n:
            p = next(source, None)
            if p is None:
                break
            parts.append(p)
            have += len(p)
        if parts:
            buf, at = b"".join([buf[at:], *parts]), 0
        return have >= n

    while True:
        while need(1) and buf[at : at + 1] in b"\r\n":
            at += 1
            offset += 1
        if not need(1):
            return
        want = 512
        while (end := buf.find(b"\r\n\r\n", at)) < 0:
            if not need(want):
                return
            want *= 2
        head = {}
        for line in buf[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            head[k.strip().lower()] = v.strip().decode("utf-8", "replace")
        length, start = int(head.get(b"content-length", 0)), end + 4 - at
        if not need(start + length):
            return
        block = buf[at + start : at + start + length]
        http, payload = None, block
        if "application/http" in head.get(b"content-type", ""):
            h, _, payload = block.partition(b"\r\n\r\n")
            http = h.decode("utf-8", "replace")
        get = lambda k: head.get(k)
        digest = get(b"warc-payload-digest")
        yield (
            get(b"warc-type"), get(b"warc-record-id"), get(b"warc-concurrent-to"), get(b"warc-refers-to"), get(b"warc-target-uri"),
            get(b"warc-date"), digest.partition(":")[2] if digest else None, http, payload, archive, offset,
        )
        at += start + length
        offset += start + length


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(f.name, {"binary": pa.binary(), "bigint": pa.int64()}.get(f.dataType.simpleString(), pa.string())) for f in RECORD])
    for batch in batches:
        for path, data in zip(batch.column(0), batch.column(1), strict=True):
            rows, size = [], 0
            for r in parse_archive(data.as_py() or b"", path.as_py()):
                rows.append(r)
                size += len(r[8])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files under path, one row each (schema RECORD)."""
    bound_batches(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parsed, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, response, request, metadata).

    Request and metadata records name their response in WARC-Concurrent-To; a response or revisit is its own
    capture. So all records of a transaction meet under one identifier, whatever files they lie in, with one
    shuffle on it. `response` also holds revisits. A capture without request or metadata has null there;
    requests and metadata whose response is missing are left out, as no capture exists. A response that is
    recorded k times under one identifier gives k equal rows. Further columns of `records` stay in the structs.
    """
    rec = F.struct(*[F.col(c) for c in records.columns])
    main = F.col("warc_type").isin("response", "revisit")
    pick = lambda cond: F.first(F.when(cond, rec), ignorenulls=True)
    return (
        records.where(main | F.col("warc_type").isin("request", "metadata"))
        .groupBy(F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture_id"))
        .agg(pick(main).alias("response"), pick(F.col("warc_type") == "request").alias("request"), pick(F.col("warc_type") == "metadata").alias("metadata"), F.count_if(main).alias("n"))
        .where("n > 0")
        .withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        .drop("n")
    )


def resolve(captures: DataFrame, named: str, value: str, out: str) -> DataFrame:
    """captures, which are settled and have capture_id, with `out`: the `value` of the capture that the column `named` refers to by its identifier; null if
    there is none. As many captures may refer to one, the distinct captures referred to are looked up first, and meet the rows by broadcast up to BROADCAST_PAYLOADS."""
    wanted = captures.where(F.col(named).isNotNull()).select(F.col(named).alias("__id")).distinct()
    known = settled(wanted.join(captures.groupBy(F.col("capture_id").alias("__id")).agg(F.max(value).alias(out)), "__id"))
    small = known.count() <= BROADCAST_PAYLOADS
    return captures.join(F.broadcast(known) if small else known, F.col(named) == F.col("__id"), "left").drop("__id")


def _field(block: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(block, rf"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))


def op1_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch(spark, "warc")
    write_captures(pages.select("page_id", "url", "html"), path)
    records = read_records(spark, path).withColumns(
        {
            "payload_bytes": F.when(F.col("warc_type") == "revisit", _field(F.col("http_head"), "Content-Length").cast("long")).otherwise(F.octet_length("payload").cast("long")),
            "sha": F.when(F.col("warc_type") == "revisit", F.col("payload_digest")).otherwise(F.sha1("payload")),
            "fields": F.when(F.col("warc_type") == "metadata", F.col("payload").cast("string")),
        }
    )
    captures = assemble(records.drop("payload", "http_head", "archive", "offset", "warc_date", "target_uri", "payload_digest"))
    slim = captures.select(
        "capture_id", _field(F.col("metadata.fields"), "page-id").cast("long").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.sha").alias("payload_digest"), F.col("response.warc_type").alias("record_type"), F.col("response.refers_to").alias("named"),
    )
    return resolve(settled(slim), "named", "page_id", "refers_to").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p
)
SELECT page_id, n::bigint AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM f
"""
