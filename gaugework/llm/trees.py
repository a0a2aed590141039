"""Boosted regression trees in numpy, with monotonic constraints."""

from __future__ import annotations

import dataclasses

import numpy as np

BINS = 64


@dataclasses.dataclass
class Forest:
    """All trees flattened into node arrays; a leaf points at itself.

    Going `depth` steps from each tree's root ends in a leaf, so scoring has no
    branches: one gather a level for all rows and trees.
    """

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float
    threshold: float = 0.5

    @classmethod
    def constant(cls, _width: int) -> Forest:
        """Gives every row the score 1."""
        none = np.zeros(0, np.int32)
        return cls(none, np.zeros(0), none, none, np.zeros(0), none, 0, np.inf, 0.0)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                below = x[row, self.feature[node]] <= self.cut[node]
                node = np.where(below, self.left[node], self.right[node])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_forest(
    x: np.ndarray,
    y: np.ndarray,
    directions: tuple[int, ...],
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.15,
    ridge: float = 1.0,
    least: float = 2.0,
) -> Forest:
    """Second-order boosting of the logistic loss on binned features.

    A split on a feature with direction d is refused when its children's
    values are in the wrong order, and children are held to the side of the
    middle value that keeps later splits in order.
    """
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)], 1)
    rate_0 = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    bias = float(np.log(rate_0 / (1 - rate_0)))
    margin = np.full(len(y), bias)
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        at = len(feature)
        feature.append(0), cut.append(0.0), left.append(at), right.append(at), value.append(rate * v)
        return at

    def grow(rows: np.ndarray, low: float, high: float, levels: int) -> int:
        g, h = gradient[rows], hessian[rows]
        total_g, total_h = g.sum(), h.sum()
        own = float(np.clip(-total_g / (total_h + ridge), low, high))
        if levels == 0 or total_h < 2 * least:
            return leaf(own)
        best = (1e-6, -1, -1, 0.0, 0.0)
        for f in range(width):
            if not len(cuts[f]):
                continue
            size = len(cuts[f]) + 1
            gl = np.cumsum(np.bincount(binned[rows, f], g, size))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], h, size))[:-1]
            gr, hr = total_g - gl, total_h - hl
            wl = np.clip(-gl / (hl + ridge), low, high)
            wr = np.clip(-gr / (hr + ridge), low, high)
            gain = -(gl * wl + 0.5 * (hl + ridge) * wl**2) - (gr * wr + 0.5 * (hr + ridge) * wr**2)
            gain += total_g * own + 0.5 * (total_h + ridge) * own**2
            ok = (hl >= least) & (hr >= least)
            if directions[f]:
                ok &= directions[f] * (wr - wl) >= 0
            gain = np.where(ok, gain, -np.inf)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k, float(wl[k]), float(wr[k]))
        _, f, k, wl, wr = best
        if f < 0:
            return leaf(own)
        at = leaf(own)
        feature[at], cut[at] = f, float(cuts[f][k])
        middle = (wl + wr) / 2
        side = {0: ((low, high), (low, high)), -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}
        (ll, lh), (rl, rh) = side[directions[f]]
        goes_left = binned[rows, f] <= k
        left[at] = grow(rows[goes_left], ll, lh, levels - 1)
        right[at] = grow(rows[~goes_left], rl, rh, levels - 1)
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, np.maximum(p * (1 - p), 1e-9)
        first = grow(np.arange(len(y)), -np.inf, np.inf, depth)
        roots.append(first)
        node = np.full(len(y), first)
        f_, c_, l_, r_ = map(np.asarray, (feature, cut, left, right))
        for _ in range(depth):
            node = np.where(x[np.arange(len(y)), f_[node]] <= c_[node], l_[node], r_[node])
        margin = margin + np.asarray(value)[node]
    return Forest(
        np.array(feature, np.int32),
        np.array(cut),
        np.array(left, np.int32),
        np.array(right, np.int32),
        np.array(value),
        np.array(roots, np.int32),
        depth,
        bias,
    )
