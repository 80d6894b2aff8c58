"""Weak supervision shared by the operators: voters with unknown reliabilities, fitted by EM.

A voter says good (1), bad (-1) or abstains (0). EM for the two-class model with a table of
P(vote | class) a voter runs over the counts of vote patterns. Their number is bounded by 3 to the number of
voters and not by the data, so they may come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOTES = (-1, 0, 1)


@dataclass(frozen=True)
class Reliability:
    """Prior log odds of class 1, and for every voter the log odds that each vote adds."""

    prior: float
    weights: list[dict[int, float]]

    def posterior(self, votes: list[int]) -> float:
        return logistic(self.prior + sum(w[v] for w, v in zip(self.weights, votes)))


def logistic(x: float) -> float:
    return 1 / (1 + exp(-max(-500.0, min(500.0, x))))


def fit(
    patterns: list[tuple[list[int], float]], voters: int, prior: float = 0.8, rounds: int = 100,
    pseudo: float = 0.05, tolerance: float = 1e-7,
) -> Reliability:
    """EM over vote patterns and their counts.

    It starts from beliefs in which a bad vote counts more than a good one. ``pseudo`` is the weight,
    as a share of all rows, of a prior that says a vote is right more often than wrong; a bad vote never adds
    to good and a good one never to bad. Both keep the meaning of the classes fixed.
    """
    base = log(prior / (1 - prior))
    rows = sum(n for _, n in patterns)
    belief = [logistic(base + sum(-3.0 if v < 0 else 0.5 * v for v in votes)) for votes, _ in patterns]
    found = Reliability(base, [{-1: -3.0, 0: 0.0, 1: 0.5} for _ in range(voters)])
    for _ in range(rounds if rows else 0):
        weight = pseudo * rows
        good = sum(b * n for b, (_, n) in zip(belief, patterns)) + weight * prior
        bad = sum((1 - b) * n for b, (_, n) in zip(belief, patterns)) + weight * (1 - prior)
        weights = []
        for j in range(voters):
            seen = {
                v: [weight * prior * g, weight * (1 - prior) * b]
                for v, g, b in ((-1, 0.02, 0.3), (0, 0.5, 0.5), (1, 0.48, 0.2))
            }
            for b, (votes, n) in zip(belief, patterns):
                seen[votes[j]][0] += b * n
                seen[votes[j]][1] += (1 - b) * n
            totals = [sum(s[k] for s in seen.values()) for k in (0, 1)]
            odds = {v: log(s[0] / totals[0]) - log(s[1] / totals[1]) for v, s in seen.items()}
            weights.append({-1: min(odds[-1], 0.0), 0: odds[0], 1: max(odds[1], 0.0)})
        found = Reliability(log(good / bad), weights)
        now = [found.posterior(votes) for votes, _ in patterns]
        moved = max((abs(a - b) for a, b in zip(now, belief)), default=0.0)
        belief = now
        if moved < tolerance:
            break
    return found


def fit_frame(votes: DataFrame, names: list[str], **settings) -> Reliability:
    rows = votes.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).collect()
    patterns = sorted(([int(r[n]) for n in names], float(r["_n"])) for r in rows)
    return fit(patterns, len(names), **settings)


def posterior(found: Reliability, names: list[str]) -> Column:
    """P(class 1 | votes) as a column."""
    total = F.lit(found.prior)
    for name, weight in zip(names, found.weights):
        col = F.col(name)
        total = total + F.when(col > 0, weight[1]).when(col < 0, weight[-1]).otherwise(weight[0])
    return 1 / (1 + F.exp(-total))
