"""The parameters of a run."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Fixed limits of the method.
MAX_HASH_WINDOWS = 16  # windows that may have a k-mer hash in common
NEXT_WINDOWS = 2  # following windows of a hash's group that each window is paired with
LOOKAHEAD = 8  # windows to either side in which collinear support is sought, and the widest gap within a region
MAX_WINDOW_HASHES = 2048
MIN_SHARED = 3
MIN_IDENTITY = 0.8
MIN_REGION = 1000


@dataclass(frozen=True)
class Params:
    """k-mer length, one hash kept of `scale`, window and step in bases (step 0: a third of the window), valid
    bases that a window needs (0: a quarter), copies that a genome must have (1: the whole duplication map), and
    whether lower-case bases are valid (`masked`: they aren't)."""

    k: int = 17
    scale: int = 16
    window: int = 1024
    step: int = 0
    min_bases: int = 0
    min_copies: int = 2
    masked: bool = False
    seed: int = 42

    def __post_init__(self) -> None:
        if self.k < 1 or self.scale < 1 or self.window < 1 or self.step < 0 or self.min_bases < 0:
            raise ValueError("k, scale and window must be positive, step and min_bases not negative")
        if self.stride < 1:
            raise ValueError("a window under 3 bases needs a step")

    @property
    def stride(self) -> int:
        return self.step or self.window // 3

    @property
    def valid_bases(self) -> int:
        return self.min_bases or self.window // 4

    @property
    def copies(self) -> int:
        return max(1, self.min_copies)

    @property
    def threshold(self) -> int:
        """Hashes under it are kept."""
        return 0xFFFFFFFF // self.scale

    @property
    def shared_rate(self) -> float:
        """The share of k-mers that two windows of the least identity have in common."""
        return math.pow(MIN_IDENTITY, self.k)
