"""Small regression trees over binned features, grown on a bounded sample: shared by the forest and the boosting model."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


def borders(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(b, c, "right") for b, c in zip(cuts, x.T)]).astype(np.uint8)


@dataclass
class Tree:
    """Nodes in arrays: feature (-1: leaf), last bin that goes left, left child (right is the next), value."""

    feature: list[int] = field(default_factory=list)
    split: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.split, 0), (self.left, 0), (self.value, value)):
            column.append(x)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, split, left = (np.array(a) for a in (self.feature, self.split, self.left))
        at = np.zeros(len(x), np.int64)
        while (inner := feature[at] >= 0).any():
            rows = np.nonzero(inner)[0]
            node = at[rows]
            at[rows] = left[node] + (x[rows, feature[node]] > split[node])
        return np.array(self.value)[at]


def grow(
    x: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int, least: float, per_node: int, rng: np.random.Generator
) -> Tree:
    """Least-squares tree: a leaf's value is sum(target) / sum(weight); each node tries ``per_node`` random features."""
    tree = Tree()

    def node(rows: np.ndarray, level: int) -> int:
        total, mass = target[rows].sum(), weight[rows].sum()
        me = tree.add(float(total / max(mass, 1e-9)))
        best = (1e-9, -1, 0)
        if level < depth and mass >= 2 * least:
            for f in rng.permutation(x.shape[1])[:per_node]:
                t = np.cumsum(np.bincount(x[rows, f], target[rows], BINS))[:-1]
                m = np.cumsum(np.bincount(x[rows, f], weight[rows], BINS))[:-1]
                fits = (m >= least) & (mass - m >= least)
                gain = t**2 / np.maximum(m, 1e-9) + (total - t) ** 2 / np.maximum(mass - m, 1e-9) - total**2 / max(mass, 1e-9)
                gain[~fits] = 0
                if gain.max() > best[0]:
                    best = (float(gain.max()), int(f), int(gain.argmax()))
        if best[1] >= 0:
            goes = x[rows, best[1]] <= best[2]
            tree.feature[me], tree.split[me] = best[1], best[2]
            pair = [rows[goes], rows[~goes]]
            first = tree.add(0.0)
            tree.add(0.0)
            tree.left[me] = first
            for k, part in enumerate(pair):
                sub = node(part, level + 1)
                for column in (tree.feature, tree.split, tree.left, tree.value):
                    column[first + k] = column[sub]
        return me

    node(np.arange(len(x)), 0)
    return tree


@dataclass
class Forest:
    cuts: list[np.ndarray]
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.trees or not len(x):
            return np.full(len(x), 0.5)
        b = binned(x, self.cuts)
        return np.mean([t.predict(b) for t in self.trees], axis=0)


def random_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, seed: int = 1) -> Forest:
    """Bootstrap rows, the square root of the features at each node; predicts the share of positive votes."""
    if not len(x):
        return Forest([], [])
    cuts = borders(x)
    b, rng = binned(x, cuts), np.random.default_rng(seed)
    grown = []
    for _ in range(trees):
        w = np.bincount(rng.integers(0, len(x), len(x)), minlength=len(x)).astype(float)
        grown.append(grow(b, w * y, w, depth, 1, max(1, round(x.shape[1] ** 0.5)), rng))
    return Forest(cuts, grown)


@dataclass
class Boosted:
    cuts: list[np.ndarray]
    trees: list[Tree]
    base: float
    scale: tuple[float, float]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if len(x) and self.trees:
            b = binned(x, self.cuts)
            for t in self.trees:
                out += 0.2 * t.predict(b)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability."""
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + b, -40, 40)))


def boosting(x: np.ndarray, y: np.ndarray, held: np.ndarray, rounds: int = 60, depth: int = 4, seed: int = 1) -> Boosted:
    """Logistic gradient boosting on the rows not ``held``; the held rows calibrate its scores (Platt scaling)."""
    train = ~held
    if not train.any():
        return Boosted([], [], 0.0, (1.0, 0.0))
    cuts = borders(x[train])
    b, t, rng = binned(x[train], cuts), y[train].astype(float), np.random.default_rng(seed)
    share = np.clip(t.mean(), 0.01, 0.99)
    model = Boosted(cuts, [], float(np.log(share / (1 - share))), (1.0, 0.0))
    score = np.full(len(t), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
        tree = grow(b, t - p, p * (1 - p) + 1e-3, depth, 1.0, x.shape[1], rng)
        score += 0.2 * tree.predict(b)
        model.trees.append(tree)
    if held.any():
        model.scale = _platt(model.raw(x[held]), y[held].astype(float))
    return model


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps on a * score + b with Platt's smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w, s = np.array([1.0, 0.0]), np.column_stack([score, np.ones(len(score))])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(s @ w, -30, 30)))
        h = (s * (p * (1 - p) + 1e-6)[:, None]).T @ s + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, s.T @ (p - goal) + 1e-3 * (w - [1.0, 0.0]))
        w = w - np.clip(step, -1, 1)
    return float(max(w[0], 1e-3)), float(w[1])
