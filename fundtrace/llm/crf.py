"""A linear-chain conditional random field with two states, for many chains at once.

Chains lie one after the other in flat arrays. Both passes of the forward-backward algorithm work on the log odds of
state 1 and take one step for all chains that are long enough, so numpy does the work. A chain longer than a block is cut
into blocks that go side by side: a block's effect on any message that enters it is a product of 2x2 matrices, which is
built first, passed along the chain from block to block, and tells each block what it begins and ends with. So the
marginals are those of the whole chain, whatever its length.
"""

from __future__ import annotations

import numpy as np


class Chains:
    """Chains of the given lengths, in blocks of at most ``block`` positions; empty chains are not allowed."""

    def __init__(self, lengths: np.ndarray, block: int = 256):
        lengths = np.asarray(lengths, np.int64)
        self.begin = np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64)
        parts = (lengths + block - 1) // block
        # Place of each block in its chain, and how long it is.
        self.place = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        sizes = np.minimum(np.repeat(lengths, parts) - self.place * block, block)
        self.first = np.repeat(self.begin, parts) + self.place * block
        self.last = self.first + sizes - 1
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.size = int(lengths.sum())

    def steps(self):
        """Per step the positions of all blocks that reach it."""
        begins = self.first[self.order]
        for t in range(int(self.sizes[0]) if len(self.sizes) else 0):
            live = int(np.searchsorted(-self.sizes, -t))
            yield begins[:live] + t

    def later(self):
        """Blocks by their place in the chain, from the second on."""
        order = np.argsort(self.place, kind="stable")
        ends = np.searchsorted(self.place[order], np.arange(1, int(self.place.max(initial=0)) + 2))
        return [order[a:b] for a, b in zip(ends, ends[1:])]


def _log_ratio(a, x, b, c, d):
    """log((e^(a + x) + e^b) / (e^(c + x) + e^d))."""
    return np.logaddexp(a + x, b) - np.logaddexp(c + x, d)


def _products(scores: np.ndarray, chains: Chains, moves: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Per block the logarithms of its matrix from the state before it to the state at its end: [to, from, block]."""
    blocks = len(chains.first)
    out = np.zeros((2, 2, blocks))
    out[0, 1], out[1, 0] = -np.inf, -np.inf
    for at in steps:
        live = chains.order[: len(at)]
        zero, one = out[0][:, live], out[1][:, live]
        out[0][:, live] = np.logaddexp(zero + moves[0, 0], one + moves[1, 0])
        out[1][:, live] = np.logaddexp(zero + moves[0, 1], one + moves[1, 1]) + scores[at]
    return out


def messages(scores: np.ndarray, chains: Chains, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds; ``moves[i, j]`` is the score of going from state i to j."""
    forward, backward = np.array(scores), np.zeros_like(scores)
    steps = list(chains.steps())
    later = chains.later()
    ahead = lambda f: _log_ratio(moves[1, 1], f, moves[0, 1], moves[1, 0], moves[0, 0])
    if later:
        product = _products(scores, chains, moves, steps)
        # First blocks end as they do alone: nothing enters them but the first score.
        begins = np.flatnonzero(chains.place == 0)
        alone = np.array(scores)
        for at in steps[1:]:
            alone[at] += ahead(alone[at - 1])
        end = np.zeros(len(chains.first))
        end[begins] = alone[chains.last[begins]]
        for blocks in later:
            into = end[blocks - 1]
            forward[chains.first[blocks]] += ahead(into)
            end[blocks] = _log_ratio(product[1, 1, blocks], into, product[1, 0, blocks], product[0, 1, blocks], product[0, 0, blocks])
        for blocks in reversed(later):
            into = backward[chains.last[blocks]]
            backward[chains.last[blocks - 1]] = _log_ratio(product[1, 1, blocks], into, product[0, 1, blocks], product[1, 0, blocks], product[0, 0, blocks])
    for at in steps[1:]:
        forward[at] += ahead(forward[at - 1])
    for at in reversed(steps[1:]):
        backward[at - 1] = _log_ratio(moves[1, 1], scores[at] + backward[at], moves[1, 0], moves[0, 1], moves[0, 0])
    return forward, backward


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def marginals(scores: np.ndarray, chains: Chains, moves: np.ndarray) -> np.ndarray:
    """Probability of state 1 at each position."""
    forward, backward = messages(scores, chains, moves)
    return sigmoid(forward + backward)


def train(emission, pull, size: int, labels: np.ndarray, chains: Chains, rounds: int, rate: float, ridge: float):
    """Weights and moves that make ``labels`` likely, by full-batch AdaGrad.

    ``emission(weights)`` gives the scores of state 1, ``pull(d)`` their gradient by the weights.
    """
    weights, moves = np.zeros(size, np.float32), np.zeros((2, 2), np.float32)
    squares, move_squares = np.full(size, 1e-8, np.float32), np.full((2, 2), 1e-8, np.float32)
    inner = np.ones(chains.size, bool)
    inner[chains.begin] = False
    after = np.flatnonzero(inner)
    y = labels.astype(np.float32)
    seen = np.bincount((2 * labels[after - 1] + labels[after]).astype(int), minlength=4).reshape(2, 2)
    count = max(1, chains.size)
    for _ in range(rounds):
        scores = emission(weights).astype(np.float32)
        forward, backward = messages(scores, chains, moves)
        gradient = (y - sigmoid(forward + backward)).astype(np.float32)
        step = pull(gradient) / count - ridge * weights
        squares += step * step
        weights += rate * step / np.sqrt(squares)
        f, q = forward[after - 1], scores[after] + backward[after]
        pairs = np.stack([np.full(len(after), moves[0, 0]), moves[0, 1] + q, f + moves[1, 0], f + moves[1, 1] + q])
        pairs = np.exp(pairs - pairs.max(axis=0)) if len(after) else pairs
        expected = (pairs / pairs.sum(axis=0)).sum(axis=1).reshape(2, 2) if len(after) else np.zeros((2, 2))
        step = (seen - expected) / count - ridge * moves
        move_squares += step * step
        moves += (rate * step / np.sqrt(move_squares)).astype(np.float32)
    return weights, moves


def logistic(features: np.ndarray, labels: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50):
    """Weights of a logistic regression (the last is the constant), by Newton's method."""
    x = np.column_stack([features, np.ones(len(features))]).astype(np.float64)
    beta = np.zeros(x.shape[1])
    total = max(weight.sum(), 1e-9)
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        gradient = x.T @ (weight * (labels - p)) / total - ridge * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x / total + (ridge + 1e-9) * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta
