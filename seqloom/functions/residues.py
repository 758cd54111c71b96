"""Residues, words of eight residues, and their seeded hashes, as Catalyst expressions and as NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The reduced alphabet. Letters of either case; every other byte has code 0 and matches nothing.
CODES = {
    "A": 1, "C": 2, "D": 3, "E": 4, "Q": 4, "F": 5, "W": 5, "Y": 5, "G": 6, "H": 7, "I": 8, "V": 8,
    "K": 9, "L": 10, "M": 10, "N": 11, "P": 12, "R": 13, "S": 14, "T": 15, "U": 15,
}
#: Seeds and multipliers of the hash family.
STEP, OFFSET, MULTIPLIER = 0x9E3779B1, 0x85EBCA6B, 0x27D4EB2D
STEP_SIGNED = STEP - (1 << 32)
NONE = 0xFFFFFFFF
WORD = 8
BANDS = 64

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FROM = _LETTERS + _LETTERS.lower() + "."
_TO = "".join(f"{CODES.get(c, 0):x}" for c in _LETTERS) * 2 + "0"
#: What the residue projection keeps: letters whose code isn't 0.
KEPT = "acdefghiklmnpqrstuvwyACDEFGHIKLMNPQRSTUVWY"

BYTE_CODES = np.zeros(256, np.uint8)
for _c, _k in CODES.items():
    BYTE_CODES[ord(_c)] = BYTE_CODES[ord(_c.lower())] = _k


def project_residues(text: Column) -> Column:
    """Only the letters that can match; prose becomes a sequence."""
    return F.regexp_replace(text, f"[^{KEPT}]", "")


#: The bytes that the residue projection drops.
DROPPED = bytes(k for k in range(256) if chr(k) not in KEPT)


def projected(texts: pa.Array) -> pa.Array:
    """project_residues of an Arrow array."""
    return pa.array([x.encode().translate(None, DROPPED) for x in texts.to_pylist()], pa.binary()).cast(pa.string())


def residue_hex(seq: Column) -> Column:
    """One hex digit per byte: its residue code. A character of k bytes gives k zeros."""
    s = F.regexp_replace(seq, r"[\x{10000}-\x{10FFFF}]", "....")
    s = F.regexp_replace(s, r"[\x{800}-\x{FFFF}]", "...")
    s = F.regexp_replace(s, r"[\x{80}-\x{7FF}]", "..")
    return F.translate(F.regexp_replace(s, "[^A-Za-z.]", "."), _FROM, _TO)


def kmers(hex_codes: Column) -> Column:
    """The 32-bit words of eight codes at every place; one shorter word if there are fewer codes, none if there are none."""

    def of(h: Column) -> Column:
        n = F.length(h)
        word = lambda j: F.conv(F.substring(h, F.greatest(j - WORD + 1, F.lit(1)), F.least(j, F.lit(WORD))), 16, 10).cast("long")
        places = F.sequence(F.least(F.lit(WORD), n), n)
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(places, word))

    # the codes are bound to a lambda's variable, or they would be computed again at every place
    return F.element_at(F.transform(F.array(hex_codes), of), 1)


def seed(band: int) -> int:
    return (band * STEP + OFFSET) & NONE


def hash_kmer(word: Column, seed_: Column) -> Column:
    """The hash of a word under a seed, with 32-bit arithmetic on longs; the last multiplier is taken as its signed residue, so nothing overflows."""
    low = lambda c: c.bitwiseAND(F.lit(NONE))
    right = F.shiftrightunsigned
    s = word.bitwiseXOR(seed_)
    s = s.bitwiseXOR(F.lit(61)).bitwiseXOR(right(s, 16))
    s = low(s * 9)
    s = s.bitwiseXOR(right(s, 4))
    s = low(s * MULTIPLIER)
    s = s.bitwiseXOR(right(s, 15))
    s = low(s.bitwiseXOR(right(s, 8)) * STEP_SIGNED)
    return s.bitwiseXOR(right(s, 14))


#: Bits of a long that a row of the alignment's table uses, so that two words and a carry add up without overflow.
ROW_BITS = 62


def lcs_short(a: Column, b: Column) -> Column:
    """The LCS of two sequences given as residue_hex, of any length, within Catalyst.

    A row of the table is an array of words of ROW_BITS bits, with a carry from word to word. The time is the product of the lengths divided by
    ROW_BITS; as each step makes a new array, long sequences are better aligned by operators.align.
    """
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, v: s + v)
    letters = lambda x: F.filter(F.split(x, ""), lambda c: c != "")

    def of(p: Column) -> Column:
        x, y = p["x"], p["y"]
        words = F.sequence(F.lit(0), F.floor((F.length(x) - 1) / ROW_BITS).cast("int"))
        part = lambda w: letters(F.substring(x, w * ROW_BITS + 1, F.lit(ROW_BITS)))
        hits = lambda code: F.transform(
            words, lambda w: total(F.transform(part(w), lambda d, k: F.when((d == code) & (d != "0"), bit(k)).otherwise(F.lit(0).cast("long"))))
        )
        rows = F.struct(F.transform(words, lambda w: bit(F.size(part(w))) - 1).alias("full"), F.map_from_arrays(F.array_distinct(letters(y)), F.transform(F.array_distinct(letters(y)), hits)).alias("masks"))

        def run(r: Column) -> Column:
            def step(row: Column, c: Column) -> Column:
                mask = F.element_at(r["masks"], c)

                def word(acc: Column, w: Column) -> Column:
                    v, full = F.get(row, w), F.get(r["full"], w)
                    hit = v.bitwiseAND(F.get(mask, w))
                    added = v + hit + acc["carry"]
                    return F.struct(F.when(added > full, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("carry"), F.concat(acc["out"], F.array(added.bitwiseOR(v - hit).bitwiseAND(full))).alias("out"))

                return F.aggregate(words, F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("out")), word)["out"]

            last = F.aggregate(letters(y), r["full"], step)
            return (F.length(x) - total(F.transform(last, lambda v: F.bit_count(v).cast("long")))).cast("int")

        return F.element_at(F.transform(F.array(rows), run), 1)

    pair = F.array(F.struct(a.alias("x"), b.alias("y")))
    empty = (F.length(a) == 0) | (F.length(b) == 0)
    return F.when(empty, F.lit(0)).otherwise(F.element_at(F.transform(pair, of), 1))


def codes_of(seq: str | bytes) -> np.ndarray:
    return BYTE_CODES[np.frombuffer(seq.encode() if isinstance(seq, str) else seq, np.uint8)]


def all_words(codes: np.ndarray) -> np.ndarray:
    """The words of a code array, place by place."""
    c = codes.astype(np.uint32)
    if not len(c):
        return np.zeros(0, np.uint32)
    size = min(WORD, len(c))
    out = c[: len(c) - size + 1].copy()
    for k in range(1, size):
        out <<= np.uint32(4)
        out |= c[k : len(c) - size + 1 + k]
    return out


def words_of(codes: np.ndarray) -> np.ndarray:
    """The distinct words of a code array."""
    return np.unique(all_words(codes))


#: Words that are hashed at a time: they and their hashes stay in the processor's cache.
HASHED_WORDS = 1 << 14


def _hash_into(s: np.ndarray, t: np.ndarray, words: np.ndarray, band: int) -> None:
    """The hashes of words under a band's seed, into s; t is room for what is shifted."""

    def mix(bits: int) -> None:
        np.right_shift(s, np.uint32(bits), out=t)
        np.bitwise_xor(s, t, out=s)

    np.bitwise_xor(words, np.uint32(seed(band) ^ 61), out=s)
    np.right_shift(words, np.uint32(16), out=t)
    np.bitwise_xor(t, np.uint32(seed(band) >> 16), out=t)
    np.bitwise_xor(s, t, out=s)
    np.multiply(s, np.uint32(9), out=s)
    mix(4)
    np.multiply(s, np.uint32(MULTIPLIER), out=s)
    mix(15)
    mix(8)
    np.multiply(s, np.uint32(STEP), out=s)
    mix(14)


def batch_minhashes(codes: list[np.ndarray], bands: int | tuple[int, ...] = BANDS) -> np.ndarray:
    """A row of min-hashes, of the first `bands` bands or of those given, for each code array. Short arrays are hashed together and long ones in pieces, HASHED_WORDS at a time."""
    seeds = range(bands) if isinstance(bands, int) else bands
    out = np.full((len(codes), len(seeds)), NONE, np.uint32)
    s, t = np.empty(HASHED_WORDS, np.uint32), np.empty(HASHED_WORDS, np.uint32)
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def hash_held() -> None:
        nonlocal size
        if held:
            rows, starts = [r for r, _ in held], np.cumsum([0, *[len(w) for _, w in held[:-1]]])
            words = np.concatenate([w for _, w in held])
            a, b = s[: len(words)], t[: len(words)]
            for k, band in enumerate(seeds):
                _hash_into(a, b, words, band)
                out[rows, k] = np.minimum(out[rows, k], np.minimum.reduceat(a, starts))
        held.clear()
        size = 0

    for row, c in enumerate(codes):
        words = all_words(c)
        for at in range(0, len(words), HASHED_WORDS):
            piece = words[at : at + HASHED_WORDS]
            if size + len(piece) > HASHED_WORDS:
                hash_held()
            held.append((row, piece))
            size += len(piece)
    hash_held()
    return out


def minhashes(words: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """The smallest hash of the words under each seed, as uint32; all ones without words."""
    out = np.full(bands, NONE, np.uint32)
    if not len(words):
        return out
    for k in range(bands):
        s = words ^ np.uint32(seed(k))
        s = (s ^ np.uint32(61)) ^ (s >> np.uint32(16))
        s = s * np.uint32(9)
        s ^= s >> np.uint32(4)
        s *= np.uint32(MULTIPLIER)
        s ^= s >> np.uint32(15)
        s = (s ^ (s >> np.uint32(8))) * np.uint32(STEP)
        s ^= s >> np.uint32(14)
        out[k] = s.min()
    return out


def masks_of(a: np.ndarray) -> list[int]:
    """For each code the places that have it, as the bits of one big integer; none for code 0, which matches nothing."""
    out = [0] * 16
    for code in np.unique(a).tolist():
        if code:
            out[code] = int.from_bytes(np.packbits(a == code, bitorder="little").tobytes(), "little")
    return out


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two code arrays, in which code 0 matches nothing. One big integer holds a row of the table."""
    return lcs_of_masks(len(a), masks_of(a), b)


def lcs_of_masks(n: int, masks: list[int], b: np.ndarray) -> int:
    """As lcs, of a sequence of n codes that is given by its masks."""
    full = (1 << n) - 1
    row = full
    for code in b.tolist():
        m = masks[code]
        if m:
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def least_hit(len_a: int, len_b: int, t: np.float32) -> int:
    """The least common length that is a hit for two lengths; a longer one is a hit as well."""
    low, high = 0, len_a + len_b + 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if is_hit(mid, len_a, len_b, t) else (mid + 1, high)
    return low


def lcs_of_hit(n: int, masks: list[int], b: np.ndarray, t: np.float32) -> int:
    """The LCS of a sequence of n codes, given by its masks, and b if it is a hit, else -1.

    A place i of the first sequence is open after j codes of b if what the table has there and the shorter rest add up to a hit. Beginning from
    the places that may be left out at once, b is taken in blocks; the open places reach one further with each code, and after a block the window
    is cut down to those still open. As the sum rises to where both rests are as long and falls from there, its ends are found by halving. What the window leaves
    behind counts and is dropped; without an open place there is no hit.
    """
    m = len(b)
    need = least_hit(n, m, t)
    if n < need or m < need:
        return -1
    lo, hi, found, at = 0, n - need, 0, 0
    row = (1 << hi) - 1
    while at < m:
        end = min(m, at + max(64, (hi - lo) // 4))
        last = min(n, hi + end - at)
        row |= ((1 << (last - hi)) - 1) << (hi - lo)
        hi = last
        full = (1 << (hi - lo)) - 1
        near = [(x >> lo) & full for x in masks]
        for code in b[at:end].tolist():
            x = near[code]
            if x:
                hit = row & x
                row = ((row + hit) | (row - hit)) & full
        at = end

        def open_(i: int) -> bool:
            common = found + i - lo - (row & ((1 << (i - lo)) - 1)).bit_count()  # noqa: B023
            return common + min(n - i, m - at) >= need  # noqa: B023

        top = min(max(n - (m - at), lo), hi)
        if not open_(top):
            return -1
        low, high = lo, top
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if open_(mid) else (mid + 1, high)
        first, low, high = low, top, hi
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if open_(mid) else (low, mid - 1)
        gone = first - lo
        found += gone - (row & ((1 << gone) - 1)).bit_count()
        row = (row >> gone) & ((1 << (low - first)) - 1)
        lo, hi = first, low
    return found + hi - lo - row.bit_count()


def pack_codes(codes: np.ndarray) -> bytes:
    """Two codes a byte; the last half byte is 0 if their number is odd."""
    c = codes if len(codes) % 2 == 0 else np.append(codes, np.uint8(0))
    return ((c[0::2] << 4) | c[1::2]).tobytes()


def unpack_codes(packed: bytes, n: int) -> np.ndarray:
    """The n codes of pack_codes."""
    two = np.frombuffer(packed, np.uint8)
    out = np.empty(2 * len(two), np.uint8)
    out[0::2], out[1::2] = two >> 4, two & 15
    return out[:n]


def threshold(identity: int) -> np.float32:
    return np.float32(identity / 100.0)


def is_hit(common: int, len_a: int, len_b: int, t: np.float32) -> bool:
    """Whether common exceeds the union's share t, in single precision."""
    return bool(np.float32(common) > np.float32(len_a + len_b - common) * t)
