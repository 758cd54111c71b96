"""The alignment of one sequence with several: their rows of the table lie end to end in one big integer, so a step costs little more than its bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .many import least_hits
from .residues import lcs_of_hit, masks_of, unpack_codes

#: Places behind each row that take its carries; they are cleared after as many codes.
GUARD = 32
#: Places of the rows that lie in one integer: what is worked on stays near the processor.
HELD_PLACES = 1 << 18
#: The fewest codes after which rows are cut down to the places still open, and otherwise the share of the open places.
LEAST_CODES, CODES_SHARE = 128, 2 / 3


def groups(a: list[bytes], len_a: np.ndarray) -> Iterator[tuple[bytes, int, np.ndarray]]:
    """Each packed sequence with its length and the places where it is."""
    found: dict[tuple[bytes, int], list[int]] = {}
    for k, key in enumerate(zip(a, len_a.tolist(), strict=True)):
        found.setdefault(key, []).append(k)
    for (x, n), at in found.items():
        yield x, n, np.array(at)


def _integer(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _after(codes: list[int], fields: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rows (0 or 1 by place; the last GUARD of each are free) after more codes, where fields has the codes of their places. Code 0 matches nothing."""
    masks = [0, *(_integer(fields == c) for c in range(1, 16))]
    free = np.zeros(fields.shape, bool)
    free[:, :-GUARD] = True
    clean, row = _integer(free), _integer(rows)
    for at in range(0, len(codes), GUARD):
        for code in codes[at : at + GUARD]:
            hit = row & masks[code]
            row = (row + hit) | (row ^ hit)
        row &= clean
    return np.unpackbits(np.frombuffer(row.to_bytes(fields.size // 8, "little"), np.uint8), bitorder="little").reshape(fields.shape)[:, :-GUARD]


def _places(least: int) -> int:
    return (least + 7) // 8 * 8


def _lcs_with(x: bytes, n: int, y: list[bytes], m: np.ndarray) -> np.ndarray:
    """The LCS of a packed sequence with each of several."""
    out = np.zeros(len(y), np.int64)
    codes = unpack_codes(x, n)
    codes = codes[codes > 0].tolist()
    most = max(1, HELD_PLACES // (int(m.max()) + GUARD))
    for at in range(0, len(y), most):
        sizes = m[at : at + most].tolist()
        width = _places(max(sizes))
        fields = np.zeros((len(sizes), width + GUARD), np.uint8)
        for field, b, size in zip(fields, y[at : at + most], sizes, strict=True):
            field[:size] = unpack_codes(b, size)
        rows = np.ones(fields.shape, np.uint8)
        rows[:, width:] = 0
        out[at : at + most] = width - _after(codes, fields, rows).sum(axis=1, dtype=np.int64)
    return out


def _hits_with(x: bytes, n: int, y: list[bytes], m: np.ndarray, need: np.ndarray) -> np.ndarray:
    """The LCS of a packed sequence with each of several if it is as much as needed, else -1; -2 if the sequences' beginnings, where no more is given, don't tell.

    As residues.lcs_of_hit, for several sequences at once: rows have the open places only, each from its own one on, and all are as wide as the widest.
    """
    out = np.full(len(y), -1, np.int64)
    who = np.flatnonzero((m >= need) & (n >= need))
    if not len(who):
        return out
    codes = unpack_codes(x, n).tolist()
    held = [unpack_codes(b, size) for b, size in zip(y, m.tolist(), strict=True)]
    given = np.array([len(b) for b in held])
    low, found, size = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64), m[who] - need[who]
    old, at = [np.ones(0, np.uint8)] * len(who), 0
    while True:
        step = min(len(codes) - at, max(LEAST_CODES, int(size.max() * CODES_SHARE)))
        # the places that come into reach have to be known
        short = given[who] < np.minimum(m[who], low + size + step)
        if step == 0 or short.any():
            unknown = short if step else np.ones(len(who), bool)
            out[who[unknown]] = -2
            left = np.flatnonzero(~unknown)
            if not len(left):
                return out
            who, low, found, size, old = who[left], low[left], found[left], size[left], [old[k] for k in left.tolist()]
        width = _places(int(size.max()) + step)
        fields, rows = np.zeros((len(who), width + GUARD), np.uint8), np.ones((len(who), width + GUARD), np.uint8)
        rows[:, width:] = 0
        for k, (pair, first) in enumerate(zip(who.tolist(), low.tolist(), strict=True)):
            part = held[pair][first : first + width]
            fields[k, : len(part)] = part
            rows[k, : len(old[k])] = old[k]
        rows = _after(codes[at : at + step], fields, rows)
        at += step
        common = np.zeros((len(who), width + 1), np.int32)
        np.cumsum(rows ^ 1, axis=1, dtype=np.int32, out=common[:, 1:])
        if at == n:
            total = found + common[:, -1]
            out[who] = np.where(total >= need[who], total, -1)
            return out
        rest = np.minimum((m[who] - low).astype(np.int32)[:, None] - np.arange(width + 1, dtype=np.int32), np.int32(n - at))
        is_open = common + rest >= (need[who] - found).astype(np.int32)[:, None]
        first, last = is_open.argmax(axis=1), width - is_open[:, ::-1].argmax(axis=1)
        left = np.flatnonzero(is_open.any(axis=1))
        if not len(left):
            return out
        old = [rows[k, first[k] : last[k]] for k in left.tolist()]
        who, low, found, size = who[left], low[left] + first[left], found[left] + common[left, first[left]], (last - first)[left]


def lcs_of_groups(a: list[bytes], b: list[bytes], len_a: np.ndarray, len_b: np.ndarray) -> np.ndarray:
    """The LCS of each pair of packed sequences; pairs with the same first sequence are worked on together."""
    out = np.zeros(len(a), np.int64)
    for x, n, at in groups(a, len_a):
        out[at] = _lcs_with(x, n, [b[k] for k in at], len_b[at])
    return out


def hits_of_groups(a: list[bytes], b: list[bytes], len_a: np.ndarray, len_b: np.ndarray, t: np.float32) -> np.ndarray:
    """As many.hits_of_pairs, and -2 for pairs of which more than the beginnings that are given would tell; pairs with the same first sequence are worked on together."""
    len_a, len_b = len_a.astype(np.int64), len_b.astype(np.int64)
    out = np.full(len(a), -1, np.int64)
    need = least_hits(len_a, len_b, t)
    for x, n, at in groups(a, len_a):
        if len(at) == 1 and 2 * len(x) >= n and 2 * len(b[at[0]]) >= len_b[at[0]]:
            y, z = sorted((unpack_codes(x, n), unpack_codes(b[at[0]], int(len_b[at[0]]))), key=len, reverse=True)
            out[at] = lcs_of_hit(len(y), masks_of(y), z, t)
            continue
        most = max(1, HELD_PLACES // (2 * int((len_b[at] - need[at]).max()) + LEAST_CODES + GUARD))
        for k in range(0, len(at), most):
            some = at[k : k + most]
            out[some] = _hits_with(x, n, [b[i] for i in some], len_b[some], need[some])
    return out
