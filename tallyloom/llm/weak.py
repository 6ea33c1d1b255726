"""Weak supervision: reliabilities of labellers by expectation-maximisation, and a small linear model.

Labellers vote -1 (no), 0 (nothing to say) or 1 (yes). Only the number of rows
per combination of votes is needed, so the estimate covers all rows of a table
while the driver sees a bounded table of combinations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Reliability:
    """What expectation-maximisation found: prior of "yes" per group, chance of each vote given the truth."""

    prior: np.ndarray
    chance: np.ndarray  # [truth, labeller, vote + 1]

    def posterior(self, group: np.ndarray, votes: np.ndarray) -> np.ndarray:
        """The probability of "yes" for rows of votes."""
        logs = []
        for truth in (0, 1):
            prior = np.where(truth, self.prior[group], 1 - self.prior[group])
            terms = np.log(self.chance[truth][np.arange(votes.shape[1])[None, :], votes + 1])
            logs.append(np.log(np.clip(prior, 1e-9, 1)) + terms.sum(axis=1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))

    def accuracy(self) -> np.ndarray:
        """Chance that a labeller's vote is right where it votes, for an even truth."""
        yes, no = self.chance[1], self.chance[0]
        right = yes[:, 2] + no[:, 0]
        return right / np.maximum(right + yes[:, 0] + no[:, 2], 1e-9)


def estimate(
    group: np.ndarray, votes: np.ndarray, rows: np.ndarray, groups: int, prior: float = 0.5, strength: float = 2.0, rounds: int = 50
) -> Reliability:
    """Fit to ``rows`` counts of vote combinations (``votes``: combinations by labellers).

    Starts from labellers that object less often than they should; pseudo-counts keep labellers that
    never vote, or agree with everything, from running off. With no rows the
    result is the starting point.
    """
    labellers = votes.shape[1]
    start = np.empty((2, labellers, 3))
    start[1] = [0.05, 0.6, 0.35]
    start[0] = [0.4, 0.45, 0.15]
    model = Reliability(np.full(groups, prior), start.copy())
    if not len(rows):
        return model
    total = rows.sum()
    for _ in range(rounds):
        yes = model.posterior(group, votes)
        chance = start * strength * max(1.0, 0.002 * total)
        for truth, weight in ((1, yes * rows), (0, (1 - yes) * rows)):
            for vote in (-1, 0, 1):
                chance[truth, :, vote + 1] += ((votes == vote) * weight[:, None]).sum(axis=0)
        chance /= chance.sum(axis=2, keepdims=True)
        hit = np.bincount(group, weights=yes * rows, minlength=groups)
        seen = np.bincount(group, weights=rows, minlength=groups)
        model = Reliability((hit + prior * strength) / (seen + strength), chance)
    return model


def train_linear(
    indices: list[np.ndarray],
    values: list[np.ndarray],
    target: np.ndarray,
    size: int,
    rounds: int = 30,
    rate: float = 0.5,
    decay: float = 1e-4,
    bias: float | None = None,
) -> np.ndarray:
    """Logistic regression on hashed features with soft targets; the last weight is the bias.

    Full-batch steps with a rate per feature (AdaGrad): the same rows in any
    order give the same weights up to rounding. A given ``bias`` is kept: rows
    with little to tell then stay close to it.
    """
    weights = np.zeros(size + 1)
    weights[-1] = bias or 0.0
    if not len(target):
        return weights
    row = np.repeat(np.arange(len(target)), [len(i) for i in indices])
    column, value = np.concatenate(indices), np.concatenate(values)
    grown = np.full(size + 1, 1e-8)
    for _ in range(rounds):
        score = np.bincount(row, weights=weights[column] * value, minlength=len(target)) + weights[-1]
        gap = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - target
        slope = np.bincount(column, weights=gap[row] * value, minlength=size + 1) / len(target)
        slope[-1] = gap.mean() if bias is None else 0.0
        slope[:-1] += decay * weights[:-1]
        grown += slope**2
        weights -= rate * slope / np.sqrt(grown)
    return weights


def sigmoid(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))
