"""Cells of vectors by random projections: each of some Gaussian directions is cut at its median, and the sides of all cuts name the cell."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

CROSSED = 10


@lru_cache(16)
def directions(dim: int, tree: int, levels: int) -> np.ndarray:
    """Gaussian directions; every tree has its own."""
    return np.random.default_rng([20_250_101, tree + 1]).standard_normal((dim, levels))


def tail(z: np.ndarray) -> np.ndarray:
    """The normal distribution beyond z >= 0, to seven digits (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    return np.exp(-z * z / 2) * 0.3989422804 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cells(x: np.ndarray) -> np.ndarray:
    """The cell of each point: x are its places relative to the cuts."""
    return ((x >= 0) << np.arange(x.shape[1])).sum(1, dtype=np.int64)


def probes(x: np.ndarray, radius: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """(point, cell) for all cells a neighbour within the radius may lie in, but for 1 - sure: likeliest first, crossing the CROSSED nearest cuts at most."""
    out, most = [], min(x.shape[1], CROSSED)
    step = max(1, 4_000_000 >> most)
    home = cells(x)
    for s in range(0, len(x), step):
        p = tail(np.abs(x[s : s + step]) / np.maximum(radius[s : s + step, None], 1e-6))
        near = np.argsort(-p, 1, kind="stable")[:, :most]
        share = np.ones((len(p), 1))
        cell = home[s : s + step, None]
        for f in range(most):
            q = np.take_along_axis(p, near[:, f : f + 1], 1)
            share = np.concatenate((share * (1 - q), share * q), 1)
            cell = np.concatenate((cell, cell ^ (1 << near[:, f : f + 1])), 1)
        order = np.argsort(-share, 1, kind="stable")
        share = np.take_along_axis(share, order, 1)
        row, k = np.nonzero(np.cumsum(share, 1) - share < sure)
        out.append((row + s, np.take_along_axis(cell, order, 1)[row, k]))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
