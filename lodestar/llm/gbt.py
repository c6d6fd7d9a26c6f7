"""Histogram gradient-boosted trees in numpy, flattened into arrays for traversal, and isotonic calibration.

Trained on the driver over a bounded number of rows (the callers' documented parameter); scoring runs in the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Documents scored at once by all trees.
ROWS_AT_ONCE = 4096


@dataclass
class Forest:
    """All trees in flat arrays. Inner nodes: feature, threshold, left child (the right one follows it); leaves point
    to themselves, so that every row can take ``depth`` steps through every tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Summed leaf values (log-odds) for each row."""
        out = np.full(len(x), self.base)
        for at in range(0, len(x), ROWS_AT_ONCE):
            rows = x[at : at + ROWS_AT_ONCE]
            node = np.broadcast_to(self.roots, (len(rows), len(self.roots))).copy()
            lines = np.arange(len(rows))[:, None]
            for _ in range(self.depth):
                node = self.left[node] + (rows[lines, self.feature[node]] > self.threshold[node])
            out[at : at + ROWS_AT_ONCE] += self.value[node].sum(1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    least: int = 20,
    ridge: float = 1.0,
) -> Forest:
    """Boost on the logistic loss. Without rows, or with one class only, the forest is a constant."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(share / (1 - share)))
    feature, threshold, left, value, roots = [], [], [], [], []

    def leaf(v: float) -> int:
        k = len(feature)
        feature.append(0)
        threshold.append(np.inf)  # nothing is greater: stays here
        left.append(k)
        value.append(v)
        return k

    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)  # bin b: x <= cuts[b]
        cell = binned + np.arange(width) * bins
        score = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            slope, curve = p - y, p * (1 - p)
            roots.append(leaf(0.0))
            at = np.zeros(n, np.int64)  # place of a row's node in ``open_``
            open_ = [roots[-1]]
            for level in range(depth + 1):
                k = len(open_)
                live = at >= 0
                flat = (at[live, None] * (width * bins) + cell[live]).ravel()
                size = k * width * bins
                g = np.bincount(flat, np.repeat(slope[live], width), size).reshape(k, width, bins)
                h = np.bincount(flat, np.repeat(curve[live], width), size).reshape(k, width, bins)
                c = np.bincount(flat, minlength=size).reshape(k, width, bins)
                total_g, total_h, total_c = g[:, 0].sum(1), h[:, 0].sum(1), c[:, 0].sum(1)
                for j, node in enumerate(open_):
                    value[node] = -rate * total_g[j] / (total_h[j] + ridge)
                if level == depth:
                    break
                gl, hl, cl = g.cumsum(2), h.cumsum(2), c.cumsum(2)
                gr, hr, cr = (t[:, None, None] - part for t, part in ((total_g, gl), (total_h, hl), (total_c, cl)))
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (total_g**2 / (total_h + ridge))[:, None, None]
                gain[(cl < least) | (cr < least)] = -1
                for f, cut in enumerate(cuts):
                    gain[:, f, len(cut) :] = -1
                best = gain.reshape(k, -1).argmax(1)
                best_gain = gain.reshape(k, -1)[np.arange(k), best]
                to = np.full((k, 2), -1, np.int64)
                further = []
                for j, node in enumerate(open_):
                    if best_gain[j] > 1e-6:
                        f, b = divmod(int(best[j]), bins)
                        low, high = leaf(0.0), leaf(0.0)
                        feature[node], threshold[node], left[node] = f, cuts[f][b], low
                        to[j] = len(further), len(further) + 1
                        further += [low, high]
                if not further:
                    break
                f, b = np.divmod(best, bins)
                rows = np.flatnonzero(live)
                j = at[rows]
                at[rows] = to[j, (binned[rows, f[j]] > b[j]).astype(np.int64)]
                open_ = further
            # every row's leaf, by the flat arrays made so far
            node = np.full(n, roots[-1])
            fa, ta, la = np.array(feature), np.array(threshold), np.array(left)
            for _ in range(depth):
                node = la[node] + (x[np.arange(n), fa[node]] > ta[node])
            score += np.array(value)[node]
    if not roots:
        roots.append(leaf(0.0))
    return Forest(
        np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots), depth, base
    )


@dataclass
class Isotonic:
    """A rising step function through pooled points, linear between them."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.value) if len(self.at) else score


def isotonic(score: np.ndarray, y: np.ndarray, tilt: float = 1e-3) -> Isotonic:
    """Pool adjacent violators. ``tilt`` of the uncalibrated score is mixed in, so that pooled scores keep their order."""
    if not len(score):
        return Isotonic(np.zeros(0), np.zeros(0))
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # [sum of labels, count, first score, last score]
    for s, label in zip(score[order], y[order], strict=True):
        pools.append([float(label), 1, s, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            total, count, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + count, pools[-1][2], last]
    at = np.array([x for p in pools for x in (p[2], p[3])])
    value = np.array([p[0] / p[1] for p in pools for _ in range(2)])
    return Isotonic(at, np.clip((1 - tilt) * value + tilt * at, 0, 1))
