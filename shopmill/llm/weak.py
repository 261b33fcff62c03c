"""Weak supervision: reliabilities of voters by expectation-maximisation.

A voter says 1 (for), -1 (against) or 0 (abstains).  The corpus is reduced to a
histogram of vote patterns first, by a map-side combined count over all rows;
with R voters it has at most 3**R rows, whatever the size of the corpus, and
only this histogram reaches the driver.  All sums there are over exact counts
in a fixed order, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Reliability:
    """Log-odds of each voter's votes and of the class itself."""

    bias: float
    weights: tuple[tuple[float, float], ...]  # (vote for, vote against) of each voter

    def log_odds(self, votes: Iterable[int]) -> float:
        return self.bias + sum(w[0] if v > 0 else w[1] if v < 0 else 0.0 for v, w in zip(votes, self.weights))

    def posterior(self, votes: Iterable[int]) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.log_odds(votes)))))

    def posterior_column(self, votes: list[Column]) -> Column:
        total = F.lit(self.bias)
        for vote, (plus, minus) in zip(votes, self.weights):
            total = total + F.when(vote > 0, F.lit(plus)).when(vote < 0, F.lit(minus)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(patterns: list[tuple[tuple[int, ...], int]], voters: int, prior: float,
        rounds: int = 50, smoothing: float = 2.0) -> Reliability:
    """Estimate what every voter's vote is worth.

    ``patterns`` are (votes, rows).  A voter that does not abstain is right with
    one probability where the class holds and with another where it does not.
    Both stay between 0.5 and 0.999: voters are better than chance by design,
    which also keeps the two classes from changing places.  No rows: all
    voters keep the starting accuracy.
    """
    patterns = sorted(patterns)
    accuracy = [[0.8, 0.8] for _ in range(voters)]  # where the class holds, where it does not

    def model() -> Reliability:
        return Reliability(
            round(math.log(prior / (1 - prior)), 6),
            tuple((round(math.log(a / (1 - b)), 6), round(math.log((1 - a) / b), 6)) for a, b in accuracy))

    for _ in range(rounds):
        current = model()
        held = [(votes, n, current.posterior(votes)) for votes, n in patterns]
        total = sum(n for _, n, _ in held)
        if not total:
            break
        for k in range(voters):
            for_right = sum(n * p for votes, n, p in held if votes[k] > 0)
            for_all = sum(n * p for votes, n, p in held if votes[k] != 0)
            against_right = sum(n * (1 - p) for votes, n, p in held if votes[k] < 0)
            against_all = sum(n * (1 - p) for votes, n, p in held if votes[k] != 0)
            accuracy[k] = [
                min(0.999, max(0.5, (for_right + 0.8 * smoothing) / (for_all + smoothing))),
                min(0.999, max(0.5, (against_right + 0.8 * smoothing) / (against_all + smoothing))),
            ]
        prior = min(0.99, max(0.01, sum(n * p for _, n, p in held) / total))
        if model() == current:
            break
    return model()


@dataclass(frozen=True)
class Kinds:
    """Log-odds of every kind of bad against good: the kind's own, and those of each voter's two votes."""

    kinds: tuple[tuple[float, tuple[tuple[float, float], ...]], ...]

    def posterior(self, votes: Iterable[int]) -> float:
        votes = list(votes)
        odds = [bias + sum(w[0] if v > 0 else w[1] if v < 0 else 0.0 for v, w in zip(votes, weights))
                for bias, weights in self.kinds]
        return 1 / (1 + sum(math.exp(min(500.0, o)) for o in odds))

    def posterior_column(self, votes: list[Column]) -> Column:
        bad = F.lit(0.0)
        for bias, weights in self.kinds:
            odds = F.lit(bias)
            for vote, (plus, minus) in zip(votes, weights):
                odds = odds + F.when(vote > 0, F.lit(plus)).when(vote < 0, F.lit(minus)).otherwise(F.lit(0.0))
            bad = bad + F.exp(F.least(odds, F.lit(500.0)))
        return 1 / (1 + bad)


def fit_kinds(patterns: list[tuple[tuple[int, ...], int]], voters: int, prior: float = 0.8,
              passes: tuple[float, float] = (0.95, 0.9), rounds: int = 200, smoothing: float = 2.0) -> Kinds:
    """Estimate good and one kind of bad for every voter.

    What makes a text bad varies, and junk of one kind passes the other voters: with a single bad
    class, their votes for it would outweigh the one against it.  So kind k starts as what voter k
    votes against nine times in ten; ``passes`` are the starting shares of votes for, of good
    and of the other voters of a kind.  Each class then has its own share for every voter, so what a
    vote is worth, in both directions, is estimated from how votes go together.  Abstentions
    say nothing.  No rows: the starting shares stay.
    """
    patterns = sorted(patterns)
    start = np.full((voters + 1, voters), passes[1])
    start[0] = passes[0]
    start[1:][np.eye(voters, dtype=bool)] = 1 - passes[1]
    share = start.copy()
    weight = np.array([prior, *[(1 - prior) / voters] * voters])
    votes = np.array([v for v, _ in patterns], np.int64).reshape(-1, voters)
    plus, minus = (votes > 0).astype(float), (votes < 0).astype(float)
    count = np.array([n for _, n in patterns], float)
    for _ in range(rounds if count.sum() else 0):
        score = np.log(weight) + plus @ np.log(share).T + minus @ np.log(1 - share).T
        held = np.exp(score - score.max(1, keepdims=True))
        held *= (count / held.sum(1))[:, None]
        fresh = np.clip((held.T @ plus + smoothing * start) / (held.T @ (plus + minus) + smoothing), 0.001, 0.999)
        moved = np.abs(fresh - share).max()
        share = fresh
        weight = np.maximum(held.sum(0) / count.sum(), 1e-4)
        weight /= weight.sum()
        if moved < 1e-6:
            break
    bias = np.log(weight[1:] / weight[0]).round(6)
    gain, loss = np.log(share[1:] / share[0]).round(6), np.log((1 - share[1:]) / (1 - share[0])).round(6)
    return Kinds(tuple(
        (float(b), tuple(zip(g.tolist(), l.tolist()))) for b, g, l in zip(bias, gain, loss)))
