"""Hashed character n-grams of many texts at once, and the training of averaged embeddings with a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Odd multipliers of the rolling and the final hash.
_STEP, _MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


@lru_cache(maxsize=2)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=2)
def inside_words() -> np.ndarray:
    """Whether each code point belongs to a word: all but white space and marks that end words or enclose them."""
    return np.fromiter((not (c.isspace() or c in ".,;:!?\"'()[]{}|") for c in map(chr, range(0x110000))), bool, 0x110000)


class Points:
    """The lower-case code points of some texts in one row, all outside words as zeros, one zero at least before each text."""

    def __init__(self, texts: list[str | None], inside: np.ndarray):
        parts = [(t or "").lower() for t in texts]
        data = ("\n" + "\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(data, np.uint32)
        marks = np.cumsum([0] + [len(p) + 1 for p in parts])
        points = np.where(inside[points], points, np.uint32(0))
        keep = points != 0
        keep[1:] |= points[:-1] != 0
        keep[marks] = True
        places = np.nonzero(keep)[0]
        self.points = points[places]
        self.starts = np.searchsorted(places, marks[:-1])
        self.ends = np.searchsorted(places, marks[1:])
        self.full = self.points != 0

    def grams(self, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place where n points follow: the bucket of these, and whether they lie in one word and its edges."""
        m = len(self.points) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, bool)
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = h * _STEP + self.points[k : k + m]
        ok = self.full[:m] | self.full[n - 1 : n - 1 + m] if n <= 2 else self.full[1 : 1 + m]
        for k in range(2, n - 1):
            ok = ok & self.full[k : k + m]
        return bucket(h, buckets), ok


def bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    h = (h ^ h >> np.uint32(15)) * _MIX
    return ((h ^ h >> np.uint32(13)) & np.uint32(buckets - 1)).astype(np.int64)


def bags(points: Points, sizes: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of all n-grams of each text."""
    found = [points.grams(n, buckets) for n in sizes]
    for i, j in zip(points.starts.tolist(), points.ends.tolist(), strict=True):
        yield np.unique(np.concatenate([ids[i:j][ok[i:j]] for ids, ok in found]), return_counts=True)


def means(points: Points, sizes: tuple[int, ...], table: np.ndarray) -> np.ndarray:
    """The mean of the table's rows over all n-grams of each text; zero for a text without any."""
    total = np.zeros((len(points.starts), table.shape[1]))
    count = np.zeros(len(points.starts))
    for n in sizes:
        ids, ok = points.grams(n, len(table))
        if not len(ids):
            continue
        ids, ok = np.append(ids, np.zeros(n - 1, np.int64)), np.append(ok, np.zeros(n - 1, bool))
        for k in range(table.shape[1]):
            total[:, k] += np.add.reduceat(np.where(ok, table[ids, k], 0), points.starts)
        count += np.add.reduceat(ok.astype(np.float64), points.starts)
    return total / np.maximum(count, 1)[:, None]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Embeddings:
    """Embeddings of buckets, averaged over a bag, into a linear softmax; both are trained together."""

    def __init__(self, buckets: int, classes: int, dim: int, seed: int):
        self.rng = np.random.default_rng(seed)
        self.e = self.rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
        self.w = np.zeros((classes, dim), np.float32)
        self.b = np.zeros(classes, np.float32)

    def step(self, ids: np.ndarray, counts: np.ndarray, label: int, rate: float, total: int = 0) -> None:
        share = (counts / (total or max(counts.sum(), 1))).astype(np.float32)
        mean = share @ self.e[ids]
        p = softmax(self.w @ mean + self.b)
        p[label] -= 1
        back = self.w.T @ p
        self.w -= rate * np.outer(p, mean)
        self.b -= rate * 0.1 * p
        self.e[ids] -= rate * share[:, None] * back[None, :]

    def table(self) -> np.ndarray:
        """Each bucket's part in the scores: averages of its rows, plus the bias, are the logits."""
        return self.e @ self.w.T + self.b


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The factor on the logits under which the labels are likeliest."""
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.05, 50, 121)
    loss = [-np.log(np.maximum(softmax(logits * t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
