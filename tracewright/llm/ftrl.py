"""Follow-the-regularised-leader with elastic-net penalties, in numpy, on sparse rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class FtrlSettings:
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1e-3
    epochs: int = 6
    batch: int = 16
    seed: int = 7


class Ftrl:
    """Weights of shape (features + 1, classes); the last row is the unpenalised bias."""

    def __init__(self, features: int, classes: int, settings: FtrlSettings) -> None:
        self.settings = settings
        self.z = np.zeros((features + 1, classes))
        self.n = np.zeros((features + 1, classes))

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        s, z, n = self.settings, self.z[rows], self.n[rows]
        l1 = np.full(len(z), s.l1)
        l1[(np.arange(len(self.z))[rows]) == len(self.z) - 1] = 0.0
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1[:, None], 0.0)
        return -shrunk / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)

    def update(self, rows: np.ndarray, gradient: np.ndarray) -> None:
        w = self.weights(rows)
        grown = self.n[rows] + gradient**2
        self.z[rows] += gradient - (np.sqrt(grown) - np.sqrt(self.n[rows])) / self.settings.alpha * w
        self.n[rows] = grown


def batches(count: int, settings: FtrlSettings):
    rng = np.random.default_rng(settings.seed)
    for _ in range(settings.epochs):
        order = rng.permutation(count)
        for i in range(0, count, settings.batch):
            yield order[i : i + settings.batch]


def stacked(rows: Sequence[tuple[np.ndarray, np.ndarray]], bias: int):
    """Distinct features of some sparse rows, and (row, local feature, value) triples with a bias."""
    features = np.concatenate([*(np.append(f, bias) for f, _ in rows)])
    values = np.concatenate([*(np.append(v, 1.0) for _, v in rows)])
    owner = np.repeat(np.arange(len(rows)), [len(f) + 1 for f, _ in rows])
    distinct, local = np.unique(features, return_inverse=True)
    return distinct, owner, local, values


def sums(owner: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Column sums of ``values`` by owner."""
    out = np.empty((count, values.shape[1]))
    for c in range(values.shape[1]):
        out[:, c] = np.bincount(owner, weights=values[:, c], minlength=count)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
