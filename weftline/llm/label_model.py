"""Generative label models: what overlapping, noisy voters say about a hidden class.

The input is the table of distinct vote patterns with their numbers of rows; all rows of a corpus
are in it, and its size is bounded by the number of patterns, not of rows.
"""

from __future__ import annotations

import numpy as np


def fit(
    votes: np.ndarray,
    counts: np.ndarray,
    known: np.ndarray | None = None,
    start: np.ndarray | None = None,
    correlated: bool = False,
    false_alarm: float | None = None,
    rounds: int = 60,
) -> np.ndarray:
    """Posterior of class 1 for each pattern, by expectation-maximisation.

    ``votes`` (patterns x voters) holds small integers; each voter has a distribution over its
    values in either class; with ``false_alarm``, the lowest value has at most this chance in class
    1, for voters that speak only against something. ``known`` is 1 or 0 where the class was observed, -1 where not. ``start``
    is a first guess. With ``correlated``, the correlation of voters within the classes is
    estimated too, and a voter that repeats what others say counts for less.
    """
    n, n_voters = votes.shape
    if not n:
        return np.zeros(0)
    seen = known if known is not None else np.full(n, -1)
    guess = np.full(n, 0.5) if start is None else start.astype(float)
    guess = np.where(seen >= 0, seen, guess)
    values = votes - votes.min()
    width = int(values.max()) + 1
    share = np.ones(n_voters)
    for step in range(rounds):
        logs = np.zeros((n, 2))
        for y, weight in enumerate((counts * (1 - guess), counts * guess)):
            mass = weight.sum()
            logs[:, y] = np.log((mass + 1) / (counts.sum() + 2))
            for j in range(n_voters):
                table = np.bincount(values[:, j], weights=weight, minlength=width) + 0.5
                chance = table / table.sum()
                if y and false_alarm is not None:
                    chance[0] = min(chance[0], false_alarm)
                logs[:, y] += share[j] * np.log(chance)[values[:, j]]
        odds = np.clip(logs[:, 1] - logs[:, 0], -60, 60)
        guess = np.where(seen >= 0, seen, 1 / (1 + np.exp(-odds)))
        if correlated and step == rounds // 2:
            share = 1 / (1 + overlap(values, counts, guess))
    return guess


def overlap(values: np.ndarray, counts: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each voter, the sum of its positive correlations with the others within the classes."""
    residual = np.zeros(values.shape)
    for weight in (counts * (1 - guess), counts * guess):
        mean = (values * weight[:, None]).sum(axis=0) / max(weight.sum(), 1e-9)
        residual += (values - mean) * (weight / np.maximum(counts, 1e-9))[:, None]
    cross = (residual * counts[:, None]).T @ residual
    scale = np.sqrt(np.maximum(np.diag(cross), 1e-9))
    related = np.clip(cross / np.outer(scale, scale), 0, 1)
    np.fill_diagonal(related, 0)
    return related.sum(axis=1)
