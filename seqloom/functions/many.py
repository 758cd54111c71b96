"""The alignment of many pairs at once: the table's rows of all pairs lie side by side in NumPy arrays."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from .residues import lcs_of_hit, masks_of, unpack_codes

#: Places in a word of a row. A word's eighth byte takes the carry.
BITS = 56
FULL, SHIFT = np.uint64((1 << BITS) - 1), np.uint64(BITS)
#: Pairs that are worked on together, the bytes of their sequences, and the fewest for which that pays.
TOGETHER, HELD_BYTES, FEW = 2048, 16 << 20, 64
#: Longer sequences are taken one by one, as their rows are long enough for whole integers.
LONGEST = 16_000


def least_hits(len_a: np.ndarray, len_b: np.ndarray, t: np.float32) -> np.ndarray:
    """residues.least_hit of many pairs of lengths."""
    both = len_a + len_b
    low, high = np.zeros_like(both), both + 1
    while (low < high).any():
        mid = (low + high) // 2
        hit = mid.astype(np.float32) > (both - mid).astype(np.float32) * t
        low, high = np.where(hit | (low >= high), low, mid + 1), np.where(hit & (low < high), mid, high)
    return low


def _matrix(packed: Iterable[bytes], width: int) -> np.ndarray:
    """Codes of sequences as rows, filled up with 0, which matches nothing."""
    rows = [*packed]
    two = np.zeros((len(rows), (width + 1) // 2), np.uint8)
    for row, x in zip(two, rows, strict=True):
        row[: len(x)] = np.frombuffer(x, np.uint8)
    out = np.zeros((len(rows), width), np.uint8)
    out[:, 0::2] = two >> 4
    out[:, 1::2] = two[:, : width // 2] & 15
    return out


def _planes(codes: np.ndarray) -> np.ndarray:
    """(4, pairs, words): the bits of the codes, BITS places in a word."""
    pairs, width = codes.shape
    out = np.zeros((4, pairs, width // BITS, 8), np.uint8)
    for k in range(4):
        out[k, :, :, :7] = np.packbits(((codes >> k) & 1).reshape(pairs, -1, BITS), axis=2, bitorder="little")
    return out.view(np.uint64)[..., 0]


def _places_of_codes(planes: np.ndarray, out: np.ndarray) -> None:
    """out[c]: the places of a word with code c, from its four planes; none for code 0, which matches nothing."""
    out[15] = FULL
    for k in (3, 2, 1, 0):
        step = 1 << k
        for c in range(15, -1, -2 * step):
            np.bitwise_and(out[c], ~planes[k], out=out[c - step])
            np.bitwise_and(out[c], planes[k], out=out[c])
    out[0] = 0


def _chunk(a: list[bytes], b: list[bytes], n: np.ndarray, m: np.ndarray, need: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The LCS of each pair that has `need` residues in common, else -1; -2 for the last few that were left, and for those of which more than the `known` codes of b would tell.
    As residues.lcs_of_hit, with windows of whole words."""
    out = np.full(len(a), -1, np.int64)
    planes = _planes(_matrix(a, (max(2 * max(map(len, a)), int(known.max())) // BITS + 1) * BITS))
    steps = _matrix((x[: (k + 1) // 2] for x, k in zip(b, known.tolist(), strict=True)), (int(known.max()) // BITS + 1) * BITS)
    words = planes.shape[2]
    pair = np.arange(len(a))
    low, found = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    size = int((n - need).max()) // BITS + 2
    row = np.full((size, len(a)), FULL, np.uint64)
    sizes = np.full(len(a), size)  # falling, so that a word is worked on for the first pairs only
    for at in range(0, steps.shape[1], BITS):
        count = len(pair)
        which = steps[pair, at : at + BITS].T.astype(np.int64) * count + np.arange(count)
        carry = np.zeros((BITS, count), np.uint64)
        table, spare = np.empty((16, count), np.uint64), np.empty((2, count), np.uint64)
        flat = table.reshape(-1)
        for w in range(len(row)):
            wide = int(np.searchsorted(-sizes, -w))
            place = low[:wide] + w
            beyond = place >= words
            _places_of_codes(np.where(beyond, np.uint64(0), planes[:, pair[:wide], np.where(beyond, 0, place)]), table[:, :wide])
            now, (hit, total) = row[w, :wide], spare[:, :wide]
            for code, past in zip(which[:, :wide], carry[:, :wide], strict=True):
                flat.take(code, out=hit, mode="clip")
                np.bitwise_and(hit, now, out=hit)
                np.add(now, hit, out=total)
                np.add(total, past, out=total)
                np.right_shift(total, SHIFT, out=past)
                np.bitwise_xor(now, hit, out=now)
                np.bitwise_or(now, total, out=now)
                np.bitwise_and(now, FULL, out=now)
        common = found + np.vstack([np.zeros(count, np.int64), np.cumsum(BITS - np.bitwise_count(row).astype(np.int64), axis=0)])
        size_a, size_b, least = n[pair], m[pair], need[pair]
        left = np.maximum(size_b - (at + BITS), 0)
        done = left == 0
        out[pair[done]] = np.where(common[-1] >= least, common[-1], -1)[done]
        # the sum of what is common and the shorter rest is greatest at `top`
        top = np.clip(size_a - left, low * BITS, (low + len(row)) * BITS)
        w, r = np.divmod(top - low * BITS, BITS)
        inside = row[np.minimum(w, len(row) - 1), np.arange(count)] & ((np.uint64(1) << r.astype(np.uint64)) - np.uint64(1))
        alive = ~done & (common[w, np.arange(count)] + r - np.bitwise_count(inside) + np.minimum(size_a - top, left) >= least)
        edge = (low + np.arange(len(row) + 1)[:, None]) * BITS
        rest = np.minimum(size_a - edge, left)
        shut = common + rest < least
        drop = (shut[1:] & (edge[1:] <= top)).sum(axis=0)
        end = len(row) + 1 - (shut & (edge >= top)).sum(axis=0)  # the first edge that is shut above
        unknown = alive & (known[pair] < np.minimum(size_b, at + 2 * BITS))
        out[pair[unknown]] = -2
        keep = np.flatnonzero(alive & ~unknown)
        if len(keep) < FEW:
            out[pair[keep]] = -2
            return out
        sizes = (end - drop + 1)[keep]
        order = np.argsort(-sizes, kind="stable")
        keep, sizes = keep[order], sizes[order]
        pair, drop = pair[keep], drop[keep]
        at_word = np.arange(sizes[0])[:, None]
        old = row[np.minimum(drop + at_word, len(row) - 1), keep]
        found = common[drop, keep]
        row = np.where((at_word < sizes) & (drop + at_word < len(row)), old, FULL)
        low = low[keep] + drop
    return out


def prefix_of_target(length, share: float):
    """How many codes of a target, by its length, may_be_hits looks at."""
    return np.ceil(np.asarray(length) * share).astype(np.int64)


def may_be_hits(a: list[bytes], b: list[bytes], len_a: np.ndarray, len_b: np.ndarray, t: np.float32, share: float) -> np.ndarray:
    """False for pairs that are misses by their beginnings. b has the first prefix_of_target codes or more, a at least as many and those that a hit may leave out,
    which are 1 - t of its length at most. Where b is longer than a, or its beginning is short, nothing is said."""
    n, m = len_a.astype(np.int64), len_b.astype(np.int64)
    need, known = least_hits(n, m, t), np.minimum(prefix_of_target(m, share), m)
    out = m >= need
    rest = np.flatnonzero(out & (n >= m) & (known >= BITS))
    rest = rest[np.argsort(n[rest], kind="stable")]
    while len(rest):
        width = [2 * len(a[k]) for k in rest[:TOGETHER]]
        most = rest[: max(1, int(np.searchsorted(np.maximum.accumulate(width) * np.arange(1, len(width) + 1), HELD_BYTES, "right")))]
        rest = rest[len(most) :]
        out[most] = _chunk([a[k] for k in most], [b[k] for k in most], n[most], m[most], need[most], known[most]) != -1
    return out


def hits_of_pairs(a: list[bytes], b: list[bytes], len_a: np.ndarray, len_b: np.ndarray, t: np.float32) -> np.ndarray:
    """The LCS of each pair of packed sequences, or -1 for a miss."""
    len_a, len_b = len_a.astype(np.int64), len_b.astype(np.int64)
    need = least_hits(len_a, len_b, t)
    n, m = np.maximum(len_a, len_b), np.minimum(len_a, len_b)
    swap = (len_a < len_b).tolist()
    out = np.full(len(a), -1, np.int64)
    rest = np.flatnonzero((m >= need) & (n <= LONGEST))
    rest = rest[np.argsort(n[rest], kind="stable")]
    single = [*np.flatnonzero((m >= need) & (n > LONGEST))]
    while len(rest):
        most = rest[: max(1, min(TOGETHER, HELD_BYTES // max(1, int(n[rest[0]]))))]
        most = most[: max(1, HELD_BYTES // max(1, int(n[most[-1]])))]
        rest = rest[len(most) :]
        if len(most) < FEW:
            single += [*most]
            continue
        x, y = [b[k] if swap[k] else a[k] for k in most], [a[k] if swap[k] else b[k] for k in most]
        got = _chunk(x, y, n[most], m[most], need[most], m[most])
        out[most] = got
        single += [*most[got == -2]]
    single.sort()
    known, masks = None, []
    for k in single:
        x, y = ((b[k], int(len_b[k])), (a[k], int(len_a[k]))) if swap[k] else ((a[k], int(len_a[k])), (b[k], int(len_b[k])))
        if x == y:
            out[k] = np.count_nonzero(unpack_codes(*x))
            continue
        if x != known:
            known, masks = x, masks_of(unpack_codes(*x))
        out[k] = lcs_of_hit(x[1], masks, unpack_codes(*y), t)
    return out
