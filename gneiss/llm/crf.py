"""A linear-chain conditional random field in numpy: training by maximum likelihood, decoding by Viterbi."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Chain:
    """Emission weights (features x labels), transition scores (labels x labels) and start scores."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def viterbi(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best label of every row; ``features`` holds all sequences one after another.

        Sequences are decoded together, position by position, the longest first, so the work per position is
        one vector operation over the sequences that are still running.
        """
        scores = features @ self.emit
        total, labels = len(scores), scores.shape[1]
        out = np.zeros(total, np.int8)
        lengths = np.asarray(lengths, np.int64)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        if not len(order):
            return out
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
        size = lengths[order]
        back = np.zeros((total, labels), np.int8)
        best = scores[first] + self.start
        running = len(order)
        for t in range(1, int(size[0])):
            running = int(np.searchsorted(-size, -t, side="left"))  # sequences longer than t
            step = best[:running, :, None] + self.move[None]
            back[first[:running] + t] = step.argmax(1)
            best[:running] = step.max(1) + scores[first[:running] + t]
        label = best.argmax(1).astype(np.int8)
        out[first + size - 1] = label
        for t in range(int(size[0]) - 1, 0, -1):
            running = int(np.searchsorted(-size, -t, side="left"))
            at = first[:running] + t
            label[:running] = back[at, label[:running]]
            out[at - 1] = label[:running]
        return out


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], labels: int = 2, steps: int = 200, rate: float = 0.1, l2: float = 1e-3, settled: float = 1e-4) -> Chain:
    """Fit by full-batch Adam on the exact conditional likelihood; deterministic.

    Sequences lie one after another, the longest first, so that each position is one vector operation over the
    sequences that reach it. Ends early once the mean log-likelihood moves by less than ``settled`` over ten steps.
    """
    sequences = sorted(((x, y) for x, y in sequences if len(y)), key=lambda p: -len(p[1]))
    x, y = np.concatenate([a for a, _ in sequences]), np.concatenate([b for _, b in sequences])
    size = np.array([len(b) for _, b in sequences])
    first = np.cumsum(size) - size
    at = [first[: int(np.searchsorted(-size, -t, side="left"))] + t for t in range(int(size[0]))]  # sequences longer than t
    last = first + size - 1
    rows = len(y)
    seen_emit = np.stack([x[y == k].sum(0) for k in range(labels)], 1)
    inside = np.ones(rows, bool)
    inside[last] = False
    here = np.flatnonzero(inside)
    seen_move = np.bincount(y[here] * labels + y[here + 1], minlength=labels * labels).reshape(labels, labels).astype(np.float64)
    seen_start = np.bincount(y[first], minlength=labels).astype(np.float64)
    weights = [np.zeros((x.shape[1], labels)), np.zeros((labels, labels)), np.zeros(labels)]
    mean, spread = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    before: list[float] = []
    for step in range(1, steps + 1):
        emit, move, start = weights
        score = x @ emit
        ahead, behind = np.empty((rows, labels)), np.zeros((rows, labels))
        ahead[at[0]] = score[at[0]] + start
        for t in range(1, len(at)):
            n = len(at[t])
            ahead[at[t]] = _lse(ahead[at[t - 1][:n], :, None] + move, 1) + score[at[t]]
        for t in range(len(at) - 2, -1, -1):
            n = len(at[t + 1])
            behind[at[t][:n]] = _lse(move + (score[at[t + 1]] + behind[at[t + 1]])[:, None, :], 2)
        norm = np.repeat(_lse(ahead[last], 1), size)
        gamma = np.exp(ahead + behind - norm[:, None])
        pairs = np.exp(ahead[here, :, None] + move + (score[here + 1] + behind[here + 1])[:, None, :] - norm[here, None, None]).sum(0)
        before.append(float(score[np.arange(rows), y].sum() + (move * seen_move).sum() + (start * seen_start).sum() - norm[last].sum()) / rows)
        if step > 30 and abs(before[-1] - before[-11]) < settled:
            break
        slope = [seen_emit - x.T @ gamma, seen_move - pairs, seen_start - gamma[first].sum(0)]
        for w, g, m, v in zip(weights, slope, mean, spread):
            g = g / rows - l2 * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(*weights)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))
