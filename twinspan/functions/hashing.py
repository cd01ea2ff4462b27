"""Strand-neutral k-mer hashes of nucleotide sequences, for whole sequences at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from twinspan.params import MAX_WINDOW_HASHES, Params

# A 64-bit seed for each of A, C, G and T, and two odd multipliers of the mixer.
BASE_SEEDS = (0x3C8BF4F53C8BF4F5, 0x04C903A704C903A7, 0x2B8104C92B8104C9, 0x2E0600D3FD09E083)
MIX_1, MIX_2 = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB

INVALID = 4
_UPPER = np.full(256, INVALID, np.uint8)
_UPPER[np.frombuffer(b"ACGT", np.uint8)] = range(4)
_BOTH = _UPPER.copy()
_BOTH[np.frombuffer(b"acgt", np.uint8)] = range(4)
_FORWARD = np.array([*BASE_SEEDS, 0], np.uint64)
_REVERSE = np.array([*BASE_SEEDS[::-1], 0], np.uint64)  # of the complement


def codes(bases: bytes, masked: bool = False) -> np.ndarray:
    """0 to 3 for A, C, G and T, 4 for all else; lower case counts unless `masked`."""
    return (_UPPER if masked else _BOTH)[np.frombuffer(bases, np.uint8)]


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    n %= 64
    return x if n == 0 else (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def canonical(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(forward, reverse) hash of the k-mer at each position; meaningless where it holds an invalid base.

    The hash of a k-mer is the XOR of its bases' seeds, each rotated by its place. Hashes of length a and
    b side by side give that of length a + b, so log2 k doublings make all of them.
    """
    have: tuple[int, np.ndarray, np.ndarray] | None = None
    piece = (1, _FORWARD[code], _REVERSE[code])
    while True:
        if k & piece[0]:
            have = piece if have is None else _joined(have, piece)
        if 2 * piece[0] > k:
            return have[1], have[2]
        piece = _joined(piece, piece)


def _joined(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    n = max(0, min(len(a[1]), len(b[1]) - a[0]))
    return a[0] + b[0], _rotated(a[1][:n], b[0]) ^ b[1][a[0] : a[0] + n], a[2][:n] ^ _rotated(b[2][a[0] : a[0] + n], a[0])


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """32 bits, in a uint64, of a 64-bit hash."""
    h = h ^ np.uint64(seed)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(MIX_1)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(MIX_2)
    return (h ^ (h >> np.uint64(33))) & np.uint64(0xFFFFFFFF)


def sampled(bases: bytes, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the k-mers of `bases` without invalid bases whose hash is kept."""
    code = codes(bases, p.masked)
    if len(code) < p.k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = mixed(np.minimum(*canonical(code, p.k)), p.seed)
    bad = np.concatenate(([0], np.cumsum(code == INVALID)))
    at = np.flatnonzero((h < np.uint64(p.threshold)) & (bad[p.k :] == bad[: -p.k]))
    return at, h[at]


def sketches(bases: bytes, p: Params) -> Iterator[tuple[int, np.ndarray]]:
    """(valid bases, sorted distinct hashes) of each window of `bases` in turn.

    At most the first 2048 hashes of a window count, and none of a window with too few valid bases.
    """
    at, h = sampled(bases, p)
    good = np.concatenate(([0], np.cumsum(codes(bases, p.masked) != INVALID)))
    starts = np.arange(0, len(bases) - p.window + 1, p.stride)
    valid = good[starts + p.window] - good[starts]
    low = np.searchsorted(at, starts)
    high = np.searchsorted(at, starts + max(0, p.window - p.k + 1))
    for n, a, b in zip(valid.tolist(), low.tolist(), high.tolist(), strict=True):
        yield n, np.unique(h[a : min(b, a + MAX_WINDOW_HASHES)]) if n >= p.valid_bases else h[:0]
