"""Logistic regression on sparse vectors by follow-the-regularised-leader updates (FTRL-Proximal)."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Models side by side on the same features; feature 0 is the intercept, on which no L1 penalty falls.

    An update takes a few examples at a time, whose gradients and squared gradients are summed by feature, and touches
    their features alone; features that no example has cost nothing. A feature whose evidence stays under `l1` has weight 0, so what is learnt is a
    sparse vector whatever the number of dimensions.
    """

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0, together: int = 8):
        self.alpha, self.beta, self.l1, self.l2, self.together = alpha, beta, l1, l2, together

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, taught: np.ndarray | None = None, kept: float = 1.0, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
        """(idx, weights): the features seen, in order, and each model's weights of them, after runs over all rows in an order shuffled anew each epoch.

        rows: distinct features, the intercept first, with their values. taught: for each row, which models learn from it; one
        model learns from all if it isn't given. kept: the share of a row's features, chosen anew each time, that an
        update sees, so that no feature relies on others to be there. The intercept is always seen.
        """
        y = np.asarray(labels, float)
        taught = np.ones((len(rows), 1)) if taught is None else np.asarray(taught, float)
        seen = np.unique(np.concatenate([np.zeros(1, np.int64), *(idx for idx, _ in rows)]))
        places = [np.searchsorted(seen, idx).astype(np.int32) for idx, _ in rows]
        self.z, self.n = np.zeros((len(seen), taught.shape[1])), np.zeros((len(seen), taught.shape[1]))
        self.place = np.zeros(len(seen), np.int32)
        random = np.random.default_rng(seed)
        for _ in range(epochs):
            order = random.permutation(len(rows))
            for first in range(0, len(rows), self.together):
                some = order[first : first + self.together]
                lengths = np.array([len(places[i]) for i in some])
                at, val = np.concatenate([places[i] for i in some]), np.concatenate([rows[i][1] for i in some])
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                if kept < 1:
                    here = random.random(len(at)) < kept
                    here[starts] = True
                    val = val * here
                self._update(at, val, starts, lengths, y[some, None], taught[some])
        return seen, self._weights(self.z, self.n)

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Weights of rows of z and of summed squares, the first of which is the intercept."""
        over = np.maximum(np.abs(z) - self.l1, 0.0)
        over[0] = np.abs(z[0])
        return -np.copysign(over, z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def _update(self, at: np.ndarray, val: np.ndarray, starts: np.ndarray, lengths: np.ndarray, y: np.ndarray, taught: np.ndarray) -> None:
        """Examples one after another in `at` and `val`, from `starts`, with labels `y`."""
        held = np.zeros(len(self.z), bool)
        held[at] = True
        mine = np.flatnonzero(held)  # the intercept is the first of them
        self.place[mine] = np.arange(len(mine), dtype=np.int32)
        at = self.place[at]
        z, n = self.z.take(mine, 0), self.n.take(mine, 0)
        w = self._weights(z, n)
        error = (sigmoids(np.add.reduceat(w.take(at, 0) * val[:, None], starts)) - y) * taught
        for m in range(z.shape[1]):
            g = np.repeat(error[:, m], lengths) * val
            now = n[:, m] + np.bincount(at, g * g, len(mine))
            z[:, m] += np.bincount(at, g, len(mine)) - (np.sqrt(now) - np.sqrt(n[:, m])) / self.alpha * w[:, m]
            n[:, m] = now
        self.z[mine], self.n[mine] = z, n


def sigmoids(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def sigmoid(x: float) -> float:
    return float(sigmoids(x))
