import random

import numpy as np
import pytest

from seqloom.functions import groups
from seqloom.functions import residues as R
from seqloom.operators import align


def some_groups(rng, sizes, letters="ACDEFGHIKLNPRST"):
    """(first, other) pairs of codes, several with the same first one: changed copies of it and what has nothing to do with it."""
    out = []
    for n in sizes:
        x = [rng.choice(letters) for _ in range(n)]
        for _ in range(rng.choice([1, 2, 9])):
            y = list(x) if rng.randrange(3) else [rng.choice(letters) for _ in range(rng.choice([0, n, n * 9 // 10, n + 5]))]
            for _ in range(rng.randrange(1 + n // rng.choice([8, 20, 60]))):
                k = rng.randrange(len(y)) if y else 0
                y[k : k + rng.randrange(3)] = [rng.choice(letters) for _ in range(rng.randrange(3))]
            out.append((R.codes_of("".join(x)), R.codes_of("".join(y))))
    rng.shuffle(out)
    return out


def arguments(pairs, share=None):
    first = lambda x: x if share is None else x[: 2 * (int(np.ceil(len(x) * share / 2)) + 2)]
    return *([R.pack_codes(first(p[k])) for p in pairs] for k in (0, 1)), *(np.array([len(p[k]) for p in pairs]) for k in (0, 1))


@pytest.mark.parametrize("held", [1, 1 << 18])
def test_groups_are_aligned_as_pairs_one_by_one(monkeypatch, held):
    monkeypatch.setattr(groups, "HELD_PLACES", held)
    monkeypatch.setattr(groups, "LEAST_CODES", 33)
    rng = random.Random(held)
    hits = told = 0
    for letters in ("AC", "ACDEFGHIKLNPRST", "ACZ", "Z"):
        pairs = some_groups(rng, [0, 1, 7, 8, 31, 32, 33, 200, 300, 450] * 2, letters)
        whole = [R.lcs(x, y) for x, y in pairs]
        assert groups.lcs_of_groups(*arguments(pairs)).tolist() == whole
        for identity in (1, 50, 80, 95, 99):
            t = R.threshold(identity)
            is_hit = [R.is_hit(n, len(x), len(y), t) for n, (x, y) in zip(whole, pairs, strict=True)]
            assert groups.hits_of_groups(*arguments(pairs), t).tolist() == [n if h else -1 for n, h in zip(whole, is_hit, strict=True)]
            for share in (0.2, 0.5):
                got = groups.hits_of_groups(*arguments(pairs, share), t).tolist()
                assert all(g in (-2, n) if h else g in (-2, -1) for g, n, h in zip(got, whole, is_hit, strict=True))
                told += got.count(-1)
            hits += sum(is_hit)
    assert hits > 200 and told > 200


def test_a_sequence_is_gone_through_once_for_all_its_pairs(monkeypatch):
    """Before, each pair took its own pass over its codes (similarity_pairs), and each of the beginnings its own row (fast_modularity)."""
    rng = random.Random(5)
    x, *others = ([R.codes_of("".join(rng.choice("ACDEFGHIKLNPRST") for _ in range(n))) for n in [3000, *range(2990, 2970, -1)]])
    pairs, seen, after = [(x, y) for y in others], [], groups._after
    monkeypatch.setattr(groups, "_after", lambda codes, *rest: seen.append(len(codes)) or after(codes, *rest))
    got = align.common_lengths(*arguments(pairs)).tolist()
    assert got[:2] == [R.lcs(x, y) for y in others[:2]] and sum(seen) == len(x)
    seen.clear()
    assert not align.open_pairs(*arguments(pairs, 0.5), R.threshold(80), 0.3).any() and 0 < sum(seen) < 1500
    seen.clear()
    near = [(x, np.delete(x, range(k, 3000, 40))) for k in range(5)]
    assert align.open_pairs(*arguments(near, 0.5), R.threshold(80), 0.3).all()
    assert align.common_lengths(*arguments(near), R.threshold(80)).tolist() == [len(y) for _, y in near] and sum(seen) > 3000
