"""Bayes' rule: for one hypothesis, and for many in log space."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.core import with_stats


def _unit(*values: float) -> bool:
    return all(math.isfinite(v) and 0 <= v <= 1 for v in values)


def posterior(prior: float, likelihood: float, evidence: float) -> float | None:
    if not _unit(prior, likelihood, evidence) or evidence == 0:
        return None
    value = prior * likelihood / evidence
    return value if value <= 1 else None


def posterior_from_rates(prior: float, true_rate: float, false_positive_rate: float) -> float | None:
    if not _unit(prior, true_rate, false_positive_rate):
        return None
    evidence = prior * true_rate + (1 - prior) * false_positive_rate
    return prior * true_rate / evidence if evidence else None


def posterior_column(prior: Column, likelihood: Column, evidence: Column) -> Column:
    fine = prior.between(0, 1) & likelihood.between(0, 1) & evidence.between(0, 1) & (evidence != 0)
    value = F.try_divide(prior * likelihood, evidence)
    return F.when(fine & (value <= 1), value)


def log_sum_exp(values: list[float]) -> float:
    if not values:
        return -math.inf
    top = max(values)
    return top if math.isinf(top) else top + math.log(sum(math.exp(v - top) for v in values))


@dataclass(frozen=True)
class Weights:
    """Named numbers: a prior, a likelihood or a posterior."""

    names: tuple[str, ...]
    values: tuple[float, ...]
    title: str = "Probability"

    def markdown(self) -> str:
        return "\n".join([f"| Hypothesis | {self.title} |", "| --- | --- |", *(f"| {n} | {v:.6f} |" for n, v in zip(self.names, self.values))])

    def csv(self) -> list[str]:
        return [f"hypothesis,{self.title.lower()}", *(f"{n},{v:.6f}" for n, v in zip(self.names, self.values))]

    def __str__(self) -> str:
        width = max(map(len, self.names), default=0)
        return "\n".join(f"{n.ljust(width)}  {v:.4f}" for n, v in zip(self.names, self.values))


def prior(names: list[str], values: list[float]) -> Weights | None:
    """None unless the values are probabilities that add up to 1."""
    fine = names and len(names) == len(values) and _unit(*values) and abs(sum(values) - 1) <= 1e-9
    return Weights(tuple(names), tuple(values), "Prior") if fine else None


def likelihood(names: list[str], values: list[float]) -> Weights | None:
    return Weights(tuple(names), tuple(values), "Likelihood") if names and len(names) == len(values) and _unit(*values) else None


def posterior_of(before: Weights, evidence: Weights) -> Weights | None:
    """Posterior of all hypotheses; None if they aren't as many, or none is possible."""
    if len(before.values) != len(evidence.values):
        return None
    logs = [math.log(p) + math.log(v) if p and v else -math.inf for p, v in zip(before.values, evidence.values)]
    whole = log_sum_exp(logs)
    return None if math.isinf(whole) else Weights(before.names, tuple(math.exp(x - whole) for x in logs), "Posterior")


def posteriors(df: DataFrame, prior_column: str, likelihood_column: str, name: str = "posterior") -> DataFrame:
    """df, one row a hypothesis, with the posterior; null if no hypothesis is possible."""
    joint = F.col(prior_column) * F.col(likelihood_column)
    return with_stats(df, _all=F.sum(joint)).withColumn(name, F.try_divide(joint, F.col("_all"))).drop("_all")
