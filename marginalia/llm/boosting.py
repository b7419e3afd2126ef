"""Gradient-boosted trees fitted on a bounded sample, as plain SQL expressions.

The fit is numpy on the driver over at most a few thousand rows; what comes
out is a nested CASE over feature columns, so scoring stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Node:
    value: float = 0.0
    feature: int = -1
    limit: float = 0.0
    left: Node | None = None
    right: Node | None = None


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, ridge: float, least: int) -> Node:
    total_g, total_h = gradient.sum(), hessian.sum()
    leaf = Node(float(total_g / (total_h + ridge)))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best, gain = None, 1e-6
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v = x[order, j]
        g, h = np.cumsum(gradient[order]), np.cumsum(hessian[order])
        cuts = np.nonzero(v[1:] > v[:-1])[0]
        cuts = cuts[(cuts + 1 >= least) & (len(v) - cuts - 1 >= least)]
        if len(cuts):
            score = g[cuts] ** 2 / (h[cuts] + ridge) + (total_g - g[cuts]) ** 2 / (total_h - h[cuts] + ridge) - total_g**2 / (total_h + ridge)
            k = int(np.argmax(score))
            if score[k] > gain:
                best, gain = (j, float((v[cuts[k]] + v[cuts[k] + 1]) / 2)), float(score[k])
    if best is None:
        return leaf
    side = x[:, best[0]] <= best[1]
    return Node(0.0, best[0], best[1], _grow(x[side], gradient[side], hessian[side], depth - 1, ridge, least), _grow(x[~side], gradient[~side], hessian[~side], depth - 1, ridge, least))


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    side = x[:, node.feature] <= node.limit
    return np.where(side, _apply(node.left, x), _apply(node.right, x))


@dataclass(frozen=True)
class Boosted:
    """A sum of trees in log odds, with the scale and shift that calibrate it."""

    trees: tuple[Node, ...]
    start: float
    scale: float = 1.0
    shift: float = 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(_apply(t, x) for t in self.trees)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.odds(x) + self.shift)))

    def used(self) -> list[int]:
        """The features that some tree asks for."""

        def below(node: Node) -> set[int]:
            return set() if node.feature < 0 else {node.feature} | below(node.left) | below(node.right)

        return sorted(set().union(*map(below, self.trees)))

    def sql(self, at: str) -> str:
        """The calibrated probability as SQL over the fields f0, f1 ... of ``at``: one nested CASE a tree."""

        def of(node: Node) -> str:
            if node.feature < 0:
                return f"{node.value!r}D"
            return f"CASE WHEN {at}.f{node.feature} <= {node.limit!r}D THEN {of(node.left)} ELSE {of(node.right)} END"

        total = " + ".join([f"{self.start!r}D", *map(of, self.trees)])
        return f"1 / (1 + exp(-({self.scale!r}D * ({total}) + {self.shift!r}D)))"


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: int = 10) -> Boosted:
    """Trees for the logistic loss, each a Newton step on what the others leave."""
    start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    score, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, y - p, p * (1 - p), depth, ridge, least)
        tree = _scaled(tree, rate)
        score = score + _apply(tree, x)
        trees.append(tree)
    return Boosted(tuple(trees), start)


def _scaled(node: Node, by: float) -> Node:
    if node.feature < 0:
        return Node(node.value * by)
    return Node(0.0, node.feature, node.limit, _scaled(node.left, by), _scaled(node.right, by))


def calibrated(model: Boosted, x: np.ndarray, y: np.ndarray) -> Boosted:
    """Platt's scale and shift, by Newton steps on rows that the trees have not seen."""
    s, w = model.odds(x), np.array([1.0, 0.0])
    a = np.column_stack([s, np.ones_like(s)])
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ w))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-6 * np.eye(2)
        w = w + np.linalg.solve(h, a.T @ (target - p))
    return Boosted(model.trees, model.start, float(w[0]), float(w[1]))


def threshold(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest cut at which held-out rows reach the precision; 1 if none does."""
    order = np.argsort(-probability, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    p = probability[order]
    last_of_tie = np.append(p[1:] < p[:-1], True)
    good = np.nonzero((right >= precision) & last_of_tie)[0]
    return float(p[good[-1]]) if len(good) else 1.0
