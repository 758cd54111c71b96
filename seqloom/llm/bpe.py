"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, col, fresh, others, release, typed

#: Splits that are remembered with their ids; when the memory of results is full, it becomes the older one, from which splits that come again are taken over.
CACHE_SPLITS = 100_000
CACHE_CHARS = 48

#: The splitting pattern of the public vocabulary, with \s as the Unicode property White_Space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it prints in Latin-1, else the next one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that each longer token is merged from: what is left of its bytes once all smaller ranks have been merged."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class ByteBPE:
    """A byte-level BPE codec. `spec` is made once on the driver and travels with the task; its size is that of the vocabulary."""

    def __init__(self, spec: dict):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_str(spec["tokenizer"])
        self.split = regex.compile(spec["pattern"]).findall
        chars = {c: b for b, c in enumerate(byte_characters())}
        vocab = json.loads(spec["tokenizer"])["model"]["vocab"]
        self.bytes_of: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(chars[c] for c in token)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int32)
        self.digits = [str(i) for i in range(len(self.bytes_of))]
        #: The ids of splits, four bytes each.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def spec(path: str, pattern: str) -> dict:
        from tokenizers import Tokenizer, models, pre_tokenizers

        chars = byte_characters()
        name = lambda token: "".join(chars[b] for b in token)
        ranks = read_ranks(path)
        tok = Tokenizer(models.BPE({name(k): v for k, v in ranks.items()}, [(name(a), name(b)) for a, b in merges_of(ranks)]))
        tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        outside = pattern.replace(r"[^\s", rf"[^{_SPACE}").replace(r"\S", rf"[^{_SPACE}]")
        return {"tokenizer": tok.to_str(), "pattern": outside.replace(r"\s", f"[{_SPACE}]")}

    def _ids(self, splits: list[str]) -> list[bytes]:
        """The packed ids of each split. The library takes splits as the words of one sequence and encodes each apart, without a result object each; where a split's ids end is known by their bytes."""
        if not splits:
            return []
        ids = np.array(self.encoder.encode_batch_fast([splits], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32)
        ends = np.searchsorted(np.cumsum(self.lengths[ids], dtype=np.int64), np.cumsum([len(s.encode()) for s in splits])) + 1
        at, raw = [0, *(4 * ends).tolist()], ids.tobytes()
        return [raw[a:b] for a, b in pairwise(at)]

    def packed(self, text: str | None) -> np.ndarray:
        """The ids of a text; none for null."""
        if not text:
            return np.zeros(0, np.int32)
        splits, cache = self.split(text), self.cache
        if new := set(splits).difference(cache):
            if len(cache) > CACHE_SPLITS:
                self.older, self.cache = cache, {}
                cache, new = self.cache, set(splits)
            if self.older:
                cache |= {s: self.older[s] for s in new if s in self.older}
                new = new.difference(cache)
            short = [s for s in new if len(s) <= CACHE_CHARS]
            cache.update(zip(short, self._ids(short), strict=True))
            if len(short) < len(new):
                long = [s for s in new if len(s) > CACHE_CHARS]
                cache = dict(zip(long, self._ids(long), strict=True)) | {s: cache[s] for s in set(splits) if len(s) <= CACHE_CHARS}
        return np.frombuffer(b"".join(map(cache.__getitem__, splits)), np.int32)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text as a list."""
        return self.packed(text).tolist()

    def spans(self, text: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """First and end character of each id's bytes in the text. A token that holds part of a character covers that character."""
        start, end = self._spans(text, ids)
        return start.tolist(), end.tolist()

    def span_bytes(self, text: str, ids: list[int]) -> bytes:
        """First and then end characters, 4 bytes each, the least significant first."""
        return b"".join(x.astype("<i4", copy=False).tobytes() for x in self._spans(text, ids))

    def _spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        end = np.cumsum(self.lengths[np.asarray(ids, np.int32)], dtype=np.int32)
        start = np.concatenate([np.zeros(min(1, len(end)), np.int32), end[:-1]])
        if text.isascii():
            return start, end
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.int8)
        char = np.cumsum(raw >= -0x40, dtype=np.int32)  # characters that have begun by each byte
        return char[start] - 1, char[end - 1]

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        """The text of ids. Characters split between tokens come together, as bytes are joined first; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_codecs: dict[int, ByteBPE] = {}


def _codec(spec: dict) -> ByteBPE:
    key = hash((spec["pattern"], spec["tokenizer"]))
    if key not in _codecs:
        _codecs[key] = ByteBPE(spec)
    return _codecs[key]


def vocabulary(path: str | None = None, pattern: str | None = None) -> dict:
    """The spec of a vocabulary file; by default the public 50k byte vocabulary and its pattern."""
    import public_tokenizers as public

    return ByteBPE.spec(path or public.path("byte_bpe_50k.tiktoken"), pattern or public.PATTERN)


def encode(df: DataFrame, spec: dict, text_col: str = "text", ids_col: str = "input_ids", spans: bool = False) -> DataFrame:
    """df with the ids of each whole text, and with their first and end characters if asked for.

    A null or empty text has no ids. All other columns pass through; columns with the names of added ones are
    replaced. Rows stay in their partitions: there is no shuffle.
    """
    bound_batches(df.sparkSession)
    kind = f"struct<ids array<int>{', starts array<int>, ends array<int>' if spans else ''}>"

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        codec = _codec(spec)
        texts = texts.to_pylist()
        ids = [codec.packed(t) for t in texts]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        cols = {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}
        if spans:
            both = [codec.spans(t or "", i) for t, i in zip(texts, ids, strict=True)]
            cols |= {k: pa.array([b[n] for b in both], pa.list_(pa.int32())) for n, k in enumerate(("starts", "ends"))}
        del ids
        release()
        return pa.StructArray.from_arrays([*cols.values()], [*cols])

    out = {ids_col: "ids", **({"starts": "starts", "ends": "ends"} if spans else {})}
    kept, one = others(df, *out), fresh(df, "__bpe")
    held = df.select(*map(col, kept), run(col(text_col)).alias(one))
    return held.select(*map(col, kept), *[F.col(one)[k].alias(c) for c, k in out.items()])


def decode(df: DataFrame, spec: dict, ids_col: str = "input_ids", text_col: str = "decoded") -> DataFrame:
    """df with the text of each list of ids, in text_col, which replaces a column of that name in any case of letters; null ids give an empty text."""
    bound_batches(df.sparkSession)

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        codec = _codec(spec)
        return pa.array([codec.decode(i or ()) for i in ids.to_pylist()], pa.string())

    return df.select(*map(col, others(df, text_col)), run(col(ids_col)).alias(text_col))


def round_trip(df: DataFrame, spec: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256): encodes, decodes the ids, and digests both in one pass, so that ids needn't leave the worker.

    spans_sha256 is the digest of the first and end characters of the tokens. A null text counts as empty. Rows stay as they are, with ids of any type, null or
    repeated; other columns are left out. An empty table gives an empty one.
    """
    bound_batches(df.sparkSession)
    rows = df.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec)
        for batch in batches:
            n, ids_sha, text_sha, span_sha = [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                packed = codec.packed(text)
                ids = packed.tolist()
                n.append(len(ids))
                span_sha.append(hashlib.sha256(codec.span_bytes(text, packed)).hexdigest())
                ids_sha.append(hashlib.sha256(" ".join(map(codec.digits.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode_bytes(ids)).hexdigest())
            release()
            digests = [pa.array(x, pa.string()) for x in (ids_sha, text_sha, span_sha)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *digests], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return rows.mapInArrow(run, typed("doc_id", rows.schema["doc_id"].dataType, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"))


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
