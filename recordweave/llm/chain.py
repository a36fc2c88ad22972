"""Exact forward-backward over many linear chains at once.

Chains of any length are cut into segments of at most `step` positions (STEP unless told otherwise).  A segment maps the
weights at its first position to those at its last by one matrix, scaled every few steps; along each chain these
matrices give every segment its entering and leaving weights, and then all segments run
side by side, so the number of steps is that, not the length of the longest chain.
"""

from __future__ import annotations

import numpy as np

STEP = 512


class Chains:
    """e: (positions, states), the weight of each state at each position, chain after chain; lengths: positions of each chain, none 0."""

    def __init__(self, e: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, step: int | None = None):
        step = step or STEP
        self.e, self.start, self.move, self.k = e, start, move, len(start)
        self.first = np.cumsum(lengths) - lengths
        many = -(-lengths // step)
        of = np.repeat(np.arange(len(lengths)), many)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        at, size = self.first[of] + nth * step, np.minimum(step, lengths[of] - nth * step)
        order = np.argsort(-size, kind="stable")
        self.at, self.size, self.many = at[order], size[order], many
        # place[c] is where the first segment of chain c was put, and its others follow in `where`.
        self.where = np.empty(len(of), np.int64)
        self.where[order] = np.arange(len(of))
        self.begin = np.cumsum(many) - many
        self.running = np.searchsorted(-self.size, -np.arange(step + 1), side="left")  # segments longer than t
        # Positions step by step, so that those of a step lie side by side: of step t from step[t] on.
        self.step = np.concatenate([[0], np.cumsum(self.running)])
        t = np.repeat(np.arange(step + 1), self.running)
        self.by_step = self.at[np.arange(len(t)) - self.step[t]] + t
        self.ones = np.ones(self.k)
        self.enter = np.tile(start, (len(of), 1))
        self.leave = np.ones((len(of), self.k))
        if (many > 1).any():
            self._join()

    def _join(self) -> None:
        """Entering and leaving weights of the segments of chains that have several."""
        long = np.flatnonzero(self.many > 1)
        rows = np.sort(np.concatenate([self.where[self.begin[c] : self.begin[c] + self.many[c]] for c in long]))
        place = np.full(len(self.at), -1)
        place[rows] = np.arange(len(rows))
        at, size, k = self.at[rows], self.size[rows], self.k
        m = self.e[at][:, :, None] * np.eye(k)
        ones = np.ones(k * k)
        for t in range(1, int(size[0])):
            n = int(np.searchsorted(-size, -t, side="left"))
            x = (m[:n].reshape(-1, k) @ self.move).reshape(n, k, k)
            x *= self.e[at[:n] + t][:, None, :]
            if t % 4 == 0:
                x /= (x.reshape(n, -1) @ ones)[:, None, None]
            m[:n] = x
        most = int(self.many[long].max())
        for j in range(1, most):
            c = long[self.many[long] > j]
            before, now = self.where[self.begin[c] + j - 1], self.where[self.begin[c] + j]
            p = np.einsum("ni,nij->nj", self.enter[before], m[place[before]])
            self.enter[now] = (p / p.sum(1, keepdims=True)) @ self.move
        for j in range(most - 1, 0, -1):
            c = long[self.many[long] > j]
            now, before = self.where[self.begin[c] + j], self.where[self.begin[c] + j - 1]
            f = np.einsum("nij,nj->ni", m[place[now]], self.leave[now]) @ self.move.T
            self.leave[before] = f / f.sum(1, keepdims=True)

    def forward(self) -> np.ndarray:
        """Fills alpha (scaled to sum 1) and scale; the logarithm of each chain's total weight."""
        e, scale = self.e[self.by_step], np.empty(len(self.e))
        p = self.enter
        for t in range(int(self.size[0]) if len(self.size) else 0):
            lo, hi = self.step[t], self.step[t + 1]
            a = e[lo:hi]
            a *= p if t == 0 else p[: hi - lo] @ self.move
            np.matmul(a, self.ones, out=scale[lo:hi])
            a /= scale[lo:hi, None]
            p = a
        self.alpha, self.scale = np.empty_like(self.e), np.empty_like(scale)
        self.alpha[self.by_step], self.scale[self.by_step] = e, scale
        return np.add.reduceat(np.log(self.scale), self.first) if len(self.first) else np.zeros(0)

    def backward(self) -> np.ndarray:
        """After forward(): each position's state probabilities; self.beta is kept for pairs()."""
        beta = (self.e / self.scale[:, None])[self.by_step]
        last = self.at + self.size - 1
        leave = self.leave / (self.leave * self.alpha[last]).sum(1, keepdims=True)
        back = self.move.T
        # What a step holds is replaced once the step before has been made of it.
        later = None
        for t in range(int(self.size[0]) - 1 if len(self.size) else -1, -1, -1):
            lo, hi = self.step[t], self.step[t + 1]
            x = leave[: hi - lo].copy()
            if later is not None:
                np.matmul(later, back, out=x[: len(later)])
            later = beta[lo:hi] * x
            beta[lo:hi] = x
        self.beta = np.empty_like(self.e)
        self.beta[self.by_step] = beta
        return self.alpha * self.beta

    def pairs(self) -> np.ndarray:
        """After backward(): expected number of moves from state to state."""
        later = np.ones(len(self.e), bool)
        later[self.first] = False
        i = np.flatnonzero(later)
        return (self.alpha[i - 1].T @ (self.e[i] * self.beta[i] / self.scale[i][:, None])) * self.move


def batches(lengths: np.ndarray, most: int):
    """Slices of chains of about `most` positions each."""
    total, lo = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            yield lo, i
            total, lo = 0, i
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)
