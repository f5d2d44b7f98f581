"""Histogram gradient-boosted trees in numpy: binned training, flat arrays for traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees end to end. A leaf points at itself, so every row takes ``depth`` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            for _ in range(self.depth):
                goes_left = rows[every, self.feature[node]] <= self.threshold[node]
                node = np.where(goes_left, self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(
    rows: np.ndarray,
    labels: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    least_rows: int = 8,
    ridge: float = 1.0,
) -> Forest:
    """Boost trees on the log loss; without rows of both labels the score is constant."""
    labels = labels.astype(float)
    mean = labels.mean() if len(labels) else 0.5
    base = float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    flat: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    if len(labels) and 0 < mean < 1:
        edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(rows.shape[1])]
        binned = np.stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        raw = np.full(len(rows), base)
        for _ in range(trees):
            chance = 1 / (1 + np.exp(-raw))
            gradient, curve = labels - chance, chance * (1 - chance)
            roots.append(len(flat["value"]))
            grow(flat, binned, edges, gradient, curve, np.arange(len(rows)), depth, rate, bins, least_rows, ridge, raw)
    as_int = {k: np.array(flat[k], np.int64) for k in ("feature", "left", "right")}
    return Forest(
        **as_int, threshold=np.array(flat["threshold"], float), value=np.array(flat["value"], float), roots=np.array(roots, np.int64), depth=depth, base=base
    )


def grow(flat, binned, edges, gradient, curve, members, depth, rate, bins, least_rows, ridge, raw) -> int:
    """Add the tree below ``members``; ``raw`` gets its values. Returns the index of its root."""
    node = len(flat["value"])
    for key, empty in (("feature", 0), ("threshold", 0.0), ("left", node), ("right", node), ("value", 0.0)):
        flat[key].append(empty)
    split = best_split(binned[members], edges, gradient[members], curve[members], bins, least_rows, ridge) if depth else None
    if split is None:
        step = rate * gradient[members].sum() / (curve[members].sum() + ridge)
        flat["value"][node] = step
        raw[members] += step
        return node
    feature, cut = split
    left = binned[members, feature] <= cut
    flat["feature"][node], flat["threshold"][node] = feature, edges[feature][cut]
    rest = (depth - 1, rate, bins, least_rows, ridge, raw)
    flat["left"][node] = grow(flat, binned, edges, gradient, curve, members[left], *rest)
    flat["right"][node] = grow(flat, binned, edges, gradient, curve, members[~left], *rest)
    return node


def best_split(binned, edges, gradient, curve, bins, least_rows, ridge) -> tuple[int, int] | None:
    """Feature and last bin of the left side with the largest gain over no split."""
    best, found = 1e-6, None
    whole = gradient.sum() ** 2 / (curve.sum() + ridge)
    for feature, edge in enumerate(edges):
        g = np.bincount(binned[:, feature], gradient, bins + 1).cumsum()
        h = np.bincount(binned[:, feature], curve, bins + 1).cumsum()
        n = np.bincount(binned[:, feature], minlength=bins + 1).cumsum()
        gain = g**2 / (h + ridge) + (g[-1] - g) ** 2 / (h[-1] - h + ridge) - whole
        gain[(n < least_rows) | (n[-1] - n < least_rows)] = -1
        gain = gain[: len(edge)]
        if len(gain) and gain.max() > best:
            best, found = gain.max(), (feature, int(gain.argmax()))
    return found
