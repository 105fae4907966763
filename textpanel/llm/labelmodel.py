"""A generative model over the votes of many heuristic matching functions.

Each function looks at a candidate pair and votes 1 (same), -1 (different) or 0 (can't tell). Nobody has labelled a pair. The model
holds a hidden truth behind the votes and learns, by expectation maximisation, how often each function votes which way for true and
for false pairs, and which functions repeat each other: from the first round on, the strongest dependencies given the truth (conditional
mutual information) form a tree, and each vote is modelled given its parent's vote. The posterior of a pair's votes is its confidence. Abstaining carries no evidence: an unnamed line is not a wrong one.

Only the counts of the vote patterns are needed: at most 3 ** functions rows, however many pairs there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

VOTES = 3  # -1, 0, 1
ABSTAIN = 1  # index of vote 0
SMOOTHING, BACK_OFF = 0.5, 20.0
#: Rounds after which the dependencies are learned anew.
RELEARN = 10


@dataclass
class LabelModel:
    prior: float
    parent: list[int]  # -1: none
    tables: np.ndarray  # (class, function, parent's vote, vote): probability of the vote if it is one; the first row if there is no parent

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Of rows of votes (-1, 0, 1), the probability that the pair is a true one."""
        v = np.asarray(patterns, dtype=int).reshape(-1, len(self.parent)) + 1
        logs = np.tile(np.log([1 - self.prior, self.prior])[:, None], (1, len(v)))
        for i, p in enumerate(self.parent):
            given = v[:, p] if p >= 0 else np.zeros(len(v), dtype=int)
            logs += np.where(v[:, i] == ABSTAIN, 0, np.log(self.tables[:, i][:, given, v[:, i]]))
        top = logs.max(axis=0)
        e = np.exp(logs - top)
        return e[1] / e.sum(axis=0)


def _tables(v: np.ndarray, weight: np.ndarray, parent: list[int]) -> np.ndarray:
    """weight: (class, pattern). A row for each vote of the parent, drawn towards the function's own distribution as if BACK_OFF pairs
    had been seen there; where the parent abstains, that distribution itself."""
    n = v.shape[1]
    out = np.zeros((2, n, VOTES, VOTES))
    for y in range(2):
        for i, p in enumerate(parent):
            own = np.full(VOTES, SMOOTHING)
            np.add.at(own, v[:, i], weight[y])
            own[ABSTAIN] = 0  # whether a function can tell at all says nothing about the truth
            own /= own.sum()
            out[y, i] = BACK_OFF * own
            if p >= 0:
                seen = np.zeros((VOTES, VOTES))
                np.add.at(seen, (v[:, p], v[:, i]), weight[y])
                seen[ABSTAIN] = seen[:, ABSTAIN] = 0
                out[y, i] += seen
    out /= out.sum(axis=3, keepdims=True)
    out[..., ABSTAIN] = 1
    return out


def _tree(v: np.ndarray, weight: np.ndarray) -> list[int]:
    """Parents of a maximum spanning tree over the mutual information of two votes given the truth."""
    n = v.shape[1]
    info = np.zeros((n, n))
    total = weight.sum()
    for y in range(2):
        for i in range(n):
            for j in range(i):
                joint = np.full((VOTES, VOTES), 1e-9)
                np.add.at(joint, (v[:, i], v[:, j]), weight[y])
                share = joint.sum() / total
                joint /= joint.sum()
                info[i, j] += share * (joint * np.log(joint / np.outer(joint.sum(1), joint.sum(0)))).sum()
    info += info.T
    parent, inside = [-1] * n, {0} if n else set()
    while len(inside) < n:
        _, i, j = max((info[i, j], i, j) for i in inside for j in range(n) if j not in inside)
        parent[j] = i
        inside.add(j)
    return parent


def _shares(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights of the functions for the start, n in all: a function that others agree with beyond chance shares its weight with them."""
    n = patterns.shape[1]
    both = (patterns != 0).astype(float)
    cross, seen = (patterns * counts[:, None]).T @ patterns, (both * counts[:, None]).T @ both
    agree = np.where(seen > 0, cross / np.maximum(seen, 1), 0.0)
    w = 1 / np.maximum((np.clip(agree, 0, 1) ** 4).sum(axis=1), 1.0)
    return w * n / w.sum()


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> LabelModel:
    """patterns: rows of votes (-1, 0, 1); counts: pairs with that pattern. The start is each pattern's balance of votes, repeated ones sharing
    their weight; the result
    doesn't depend on the order of the rows. Without rows the model knows nothing: posterior one half."""
    patterns = np.asarray(patterns, dtype=int)
    n = patterns.shape[1]
    if not len(patterns):
        return LabelModel(0.5, [-1] * n, np.full((2, n, VOTES, VOTES), 1 / VOTES))
    order = np.lexsort(patterns.T)
    patterns, counts = patterns[order], np.asarray(counts, dtype=float)[order]
    v = patterns + 1
    truth = 1 / (1 + np.exp(-1.5 * (patterns @ _shares(patterns, counts) - 1)))
    parent = [-1] * n
    model = None
    for k in range(rounds):
        weight = np.stack([(1 - truth) * counts, truth * counts])
        if k % RELEARN == 0:
            parent = _tree(v, weight)
        prior = (weight[1].sum() + SMOOTHING) / (counts.sum() + 2 * SMOOTHING)
        model = LabelModel(float(prior), parent, _tables(v, weight, parent))
        truth = model.posterior(patterns)
    return model
