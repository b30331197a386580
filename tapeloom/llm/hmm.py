"""A hidden Markov model of text in numpy: scaled forward recursion and Baum-Welch expectations.

Sequences of classes are worked on side by side, in time-major order, so that a
step is a few operations on arrays over all sequences that are long enough.
"""

from __future__ import annotations

import numpy as np


class TimeMajor:
    """Sequences ``offsets[d]:offsets[d + 1]`` of ``values``, longest first, step by step."""

    def __init__(self, offsets: np.ndarray):
        n = np.diff(offsets)
        order = np.argsort(-n, kind="stable")
        self.order = order[n[order] > 0]
        self.begin, n = offsets[:-1][self.order], n[self.order]
        steps = int(n[0]) if len(n) else 0
        #: Sequences that have a step t.
        self.active = np.searchsorted(-n, -np.arange(steps), side="left")
        self.at = np.concatenate([[0], np.cumsum(self.active)])

    def places(self) -> np.ndarray:
        """Of each value in time-major order, its place in the plain order."""
        t = np.repeat(np.arange(len(self.active)), self.active)
        return self.begin[np.arange(self.at[-1]) - self.at[t]] + t


def log10_likelihood(model: dict[str, np.ndarray], classes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 of each whole sequence's probability; 0 for an empty one."""
    out = np.zeros(len(offsets) - 1)
    tm = TimeMajor(offsets)
    emit, trans = model["emit"].T.astype(np.float64), model["trans"]
    total = np.zeros(len(tm.order))
    alpha = None
    for t, n in enumerate(tm.active.tolist()):
        e = emit[classes[tm.begin[:n] + t]]
        alpha = (alpha[:n] @ trans if t else model["first"]) * e
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log10(scale)
    out[tm.order] = total
    return out


#: Steps between which forward and backward values are scaled; emissions are scaled to a largest of 1 for each token.
SCALED_EVERY = 4


def expectations(model: dict[str, np.ndarray], classes: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Expected counts of first states, transitions and emissions over all whole sequences, and their log likelihood."""
    states, kinds = model["emit"].shape
    got = {"first": np.zeros(states), "trans": np.zeros((states, states)), "emit": np.zeros((states, kinds)), "loglik": np.zeros(1)}
    tm = TimeMajor(offsets)
    if not len(tm.order):
        return got
    own = classes[tm.places()]
    top = model["emit"].max(axis=0)
    after = (model["emit"] / top).T.astype(np.float32)[own]  # emissions; times the backward value below
    trans, back = model["trans"].astype(np.float32), np.ascontiguousarray(model["trans"].T.astype(np.float32))
    alpha, beta, scale = np.empty_like(after), np.ones_like(after), np.ones(len(after), np.float32)
    at, active = tm.at.tolist(), tm.active.tolist()
    room = np.empty((active[0], states), np.float32)
    np.multiply(after[: active[0]], model["first"].astype(np.float32), out=alpha[: active[0]])
    for t, n in enumerate(active[1:], 1):
        here, before = alpha[at[t] : at[t + 1]], at[t - 1]
        np.matmul(alpha[before : before + n], trans, out=room[:n])
        np.multiply(room[:n], after[at[t] : at[t + 1]], out=here)
        if t % SCALED_EVERY == 0:
            s = scale[at[t] : at[t + 1]] = here.sum(axis=1)
            here /= s[:, None]
    for t in range(len(active) - 1, -1, -1):
        here, b = after[at[t] : at[t + 1]], beta[at[t] : at[t + 1]]
        if t % SCALED_EVERY == 0:
            b /= b.sum(axis=1)[:, None]
        np.multiply(here, b, out=here)
        if t:
            np.matmul(here, back, out=beta[at[t - 1] : at[t - 1] + active[t]])
    steps = np.diff(offsets)[tm.order]
    ends = alpha[tm.at[steps - 1] + np.arange(len(steps))].sum(axis=1, dtype=np.float64)
    got["loglik"][0] = np.log(top)[own].sum() + np.log(scale, dtype=np.float64).sum() + np.log(ends).sum()
    beta *= alpha  # posteriors, but for their sum
    total = np.maximum(beta.sum(axis=1), np.float32(1e-37))
    beta /= total[:, None]
    if len(active) > 1:
        later = slice(active[0], None)
        total[later] *= scale[later]
        after[later] /= total[later, None]
        t = np.repeat(np.arange(1, len(active)), active[1:])
        source = np.arange(active[0], len(alpha)) - tm.at[t] + tm.at[t - 1]
        got["trans"] = model["trans"] * (alpha[source].T @ after[later]).astype(np.float64)
    got["first"] = beta[: active[0]].sum(axis=0, dtype=np.float64)
    for k in range(states):
        got["emit"][k] = np.bincount(own, weights=beta[:, k], minlength=kinds)
    return got


def maximized(got: dict[str, np.ndarray], prior: np.ndarray, unknown: int, p_unknown: float, weight: float = 100.0) -> dict[str, np.ndarray]:
    """Parameters from expected counts, emissions smoothed towards ``prior``; the unknown class has one probability in all states."""
    emit = got["emit"] + weight * prior
    emit[:, unknown] = 0
    emit *= (1 - p_unknown) / emit.sum(axis=1, keepdims=True)
    emit[:, unknown] = p_unknown
    trans, first = got["trans"] + 0.01, got["first"] + 0.01
    return {"emit": emit, "trans": trans / trans.sum(axis=1, keepdims=True), "first": first / first.sum()}


def random_model(states: int, prior: np.ndarray, unknown: int, p_unknown: float, seed: int = 11) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    emit = prior * r.gamma(1.0, 1.0, (states, len(prior))) + 1e-9
    got = {"emit": emit * 1e4, "trans": np.eye(states) * 20 + 1.0, "first": np.ones(states)}
    return maximized(got, prior, unknown, p_unknown, weight=1.0)
