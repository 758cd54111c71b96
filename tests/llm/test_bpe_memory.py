import random

import pytest

from seqloom.llm import bpe


class Counting:
    """An encoder that notes what it is given."""

    def __init__(self, own):
        self.own, self.sequences, self.splits = own, 0, []

    def encode_batch_fast(self, batch, **how):
        self.sequences += len(batch)
        for x in batch:
            self.splits += [x] if isinstance(x, str) else x
        return self.own.encode_batch_fast(batch, **how)


@pytest.fixture(scope="module")
def spec():
    return bpe.vocabulary()


def test_new_splits_of_a_text_are_one_sequence(spec):
    """Before, each was a sequence of its own, with an object for its ids."""
    codec = bpe.ByteBPE(spec)
    codec.encoder = Counting(codec.encoder)
    text = "alpha beta gamma alpha, naïve 東京 😀́ \n\n x" + "y" * 100
    ids = codec.encode(text)
    assert codec.decode(ids) == text and codec.encode(text) == ids
    # the long split isn't remembered
    assert codec.encoder.sequences == 3 and len(codec.encoder.splits) == len(set(codec.encoder.splits)) + 1


def test_splits_that_come_again_outlast_a_full_memory(spec, monkeypatch):
    """Before, a full memory was cleared and the commonest splits were encoded anew."""
    monkeypatch.setattr(bpe, "CACHE_SPLITS", 50)
    codec, whole = bpe.ByteBPE(spec), bpe.ByteBPE(spec)
    codec.encoder = Counting(codec.encoder)
    rng = random.Random(1)
    for k in range(40):
        text = " the common words" + "".join(f" {chr(97 + rng.randrange(26)) * 3}{chr(0xE0 + rng.randrange(20))}{chr(97 + k % 26)}" for _ in range(20))
        assert codec.encode(text) == [i for s in whole.split(text) for i in whole.encoder.encode(s, add_special_tokens=False).ids]
    assert codec.encoder.splits.count(" common") == 1
    assert len(codec.cache) <= 50 + 24 and len(codec.older) <= 50 + 24
