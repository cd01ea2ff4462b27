from __future__ import annotations

import math

import numpy as np
import pytest

from twinspan.functions import hashing
from twinspan.params import MIN_SHARED, Params

VECTORS = {
    "A" * 17: (0xB32084A1B32084A1, 0x1A9F564014056B85, 449414123),
    "C" * 17: (0xFE82F9ECFE82F9EC, 0x1E0ECEB91E0ECEB9, 4158850850),
    "ACGTACGTACGTACGTA": (0xE4CED982C0E7A8FE, 0xECF16BB21EB50003, 2126481069),
    "TACGTACGTACGTACGT": (0xECF16BB21EB50003, 0xE4CED982C0E7A8FE, 2126481069),
    "GATTACAGATTACAGAT": (0xADC549323EDCBB9D, 0x51EB99A07832ED95, 3487607193),
    "ACG": (0xD03CD053D03CD053, 0x6A2007DDB92FE78D, 419005701),
    "CGT": (0x6A2007DDB92FE78D, 0xD03CD053D03CD053, 419005701),
}


@pytest.mark.parametrize("kmer", VECTORS)
def test_vectors(kmer):
    forward, reverse = hashing.canonical(hashing.codes(kmer.encode()), len(kmer))
    assert (int(forward[0]), int(reverse[0])) == VECTORS[kmer][:2]
    assert int(hashing.mixed(np.minimum(forward, reverse), 42)[0]) == VECTORS[kmer][2]


def test_mixer():
    assert hashing.mixed(np.array([0, 1], np.uint64), 42).tolist() == [542154026, 819705079]


@pytest.mark.parametrize("k", [1, 2, 5, 17, 31, 64, 70])
def test_doublings_are_the_rotated_sum(k):
    rng = np.random.default_rng(k)
    code = rng.integers(0, 4, 200).astype(np.uint8)
    rol = lambda h, n: ((h << n % 64) | (h >> (64 - n % 64))) % 2**64 if n % 64 else h
    forward, reverse = hashing.canonical(code, k)
    assert len(forward) == 200 - k + 1
    for at in (0, 57, 200 - k):
        f = r = 0
        for i, b in enumerate(code[at : at + k].tolist()):
            f ^= rol(hashing.BASE_SEEDS[b], k - 1 - i)
            r ^= rol(hashing.BASE_SEEDS[b ^ 3], i)
        assert (int(forward[at]), int(reverse[at])) == (f, r)


def test_no_kmer_spans_an_invalid_base_and_the_mask_is_honoured():
    p = Params(k=5, scale=1)
    assert hashing.sampled(b"ACGTANACGTACG", p)[0].tolist() == [0, 6, 7, 8]
    assert len(hashing.sampled(b"acgtacgtac", p)[0]) == 6
    assert len(hashing.sampled(b"acgtacgtac", Params(k=5, scale=1, masked=True))[0]) == 0


def test_strands_are_alike():
    p = Params()
    bases = "".join(np.random.default_rng(1).choice(list("ACGT"), 1024))
    other = bases[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert [s.tolist() for _, s in hashing.sketches(bases.encode(), p)] == [s.tolist() for _, s in hashing.sketches(other.encode(), p)]


def test_windows_with_few_valid_bases_stay_and_are_empty():
    bases = b"ACGTTGCA" * 128 + b"N" * 1024
    found = list(hashing.sketches(bases, Params(scale=1)))
    assert len(found) == (2048 - 1024) // 341 + 1
    assert found[-1][0] == 1024 - 3 * 341 and len(found[-1][1]) == 0 and len(found[0][1]) > 0


def test_the_first_2048_hashes_count():
    bases = "".join(np.random.default_rng(2).choice(list("ACGT"), 4096)).encode()
    p = Params(window=4096, scale=1)
    _, sketch = next(hashing.sketches(bases, p))
    _, h = hashing.sampled(bases, p)
    assert sketch.tolist() == sorted(set(h[:2048].tolist()))


def test_a_kmer_longer_than_the_window_gives_nothing():
    assert [len(s) for _, s in hashing.sketches(b"ACGT" * 10, Params(k=30, window=20, step=5, scale=1))] == [0] * 5


@pytest.mark.parametrize(("k", "needs"), {11: (3, 6, 12, 18, 176), 13: (3, 4, 8, 11, 113), 17: (3, 3, 4, 5, 47), 25: (3, 3, 3, 3, 8)}.items())
def test_required_share(k, needs):
    assert tuple(max(MIN_SHARED, math.ceil(n * Params(k=k).shared_rate)) for n in (16, 63, 134, 200, 2048)) == needs


def test_parameters():
    p = Params()
    assert (p.stride, p.valid_bases, p.threshold, p.copies, Params(min_copies=0).copies) == (341, 256, 268435455, 2, 1)
    for bad in ({"window": 2}, {"k": 0}, {"scale": 0}):
        with pytest.raises(ValueError):
            Params(**bad)
