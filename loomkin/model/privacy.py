"""Gaussian mechanism: budget from (epsilon, delta), noise scales, frozen releases, and a ledger.

A budget is the sum over releases of sensitivity ** 2 / sigma ** 2.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def total_budget(epsilon: float, delta: float) -> float:
    """The largest budget that is (epsilon, delta)-differentially private, by bisection of

    erfc(b - a) - e ** epsilon * erfc(a + b) = 2 delta with a = sqrt(x / 8), b = epsilon / sqrt(2 x).
    """

    def spent(x: float) -> float:
        a, b = math.sqrt(x) / (2 * math.sqrt(2)), epsilon / math.sqrt(2 * x)
        return math.erfc(b - a) - math.exp(epsilon) * math.erfc(a + b)

    low, high = 0.0, max(epsilon, 1e-12)
    while spent(high) < 2 * delta:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if spent(mid) < 2 * delta else (low, mid)
    return (low + high) / 2


def sigma(sensitivity: float, budget: float, releases: float = 1) -> float:
    """Noise of each of several releases that share a budget."""
    return sensitivity * math.sqrt(releases / budget) if budget > 0 else math.inf


def domain_limit(rows: float, noise: float, theta: float) -> float:
    """Cells up to which the mean absolute noise of a table stays under 1 / theta of its rows."""
    return math.inf if noise == 0 else rows / (noise * math.sqrt(2 / math.pi)) / theta


class Overspent(ValueError):
    pass


@dataclass
class Ledger:
    """What a budget was spent on. charge() is called before a draw and refuses what would overspend."""

    budget: float
    entries: list[tuple[str, float, float]] = field(default_factory=list)

    @property
    def spent(self) -> float:
        return sum(x[2] for x in self.entries)

    def charge(self, what: str, sensitivity: float, noise: float, releases: int = 1) -> None:
        cost = releases * sensitivity**2 / noise**2 if noise > 0 else math.inf
        if math.isinf(self.budget):
            cost = 0.0 if math.isinf(cost) else cost
        if self.spent + cost > self.budget * (1 + 1e-9):
            raise Overspent(f"{what} costs {cost:.6g}; {self.budget - self.spent:.6g} is left")
        self.entries.append((what, noise, cost))


def noisy(values: np.ndarray, noise: float, rng: np.random.Generator, kind: str = "normal") -> np.ndarray:
    """Noise on every cell of a dense table, those without rows included."""
    return values + (rng.laplace(scale=noise, size=np.shape(values)) if kind == "laplace" else rng.normal(scale=noise, size=np.shape(values)))


def noisy_table(dense: DataFrame, name: str, noise: float, seed: int, path: str) -> DataFrame:
    """A dense table with noise, drawn once and frozen in Parquet: a plan with randn() would draw anew at each use."""
    dense.withColumn(name, F.col(name) + F.lit(noise) * F.randn(seed)).write.mode("overwrite").parquet(path)
    return dense.sparkSession.read.parquet(path)


def exponential_choice(scores: Sequence[float], epsilon: float, sensitivity: float, rng: np.random.Generator) -> int:
    """Index drawn with weight exp(score * epsilon / 2 / sensitivity)."""
    x = np.asarray(scores, float) * epsilon / 2 / sensitivity
    p = np.exp(x - x.max())
    return int(rng.choice(len(p), p=p / p.sum()))


def tvd_sensitivity(rows: float) -> float:
    return 2 / rows


def group_model_shares() -> dict[str, float]:
    """Shares of the budget of the group model; they sum to 1."""
    learn, synthesis = 0.80, 0.20
    marginal = learn * 0.90
    model, observed = marginal * 0.80, marginal * 0.20
    other, latent = model * 0.20, model * 0.80
    return {
        "graph": learn * 0.10,
        "prior": other * 0.20,
        "sizes_in_training": other * 0.80,
        "types": latent * 0.10,
        "latent_marginals": latent * 0.80,
        "latent_selection": latent * 0.10,
        "marginals": observed * 0.90,
        "selection": observed * 0.10,
        "type_sizes": synthesis * 0.80,
        "group_sizes": synthesis * 0.20,
    }


def single_table_shares() -> dict[str, float]:
    """Shares of the single-table model: graph, candidate distances, marginals."""
    return {"graph": 0.10, "selection": 0.10, "marginals": 0.80}


def group_sensitivities(rows_changed: float, groups_changed: float, most_in_group: int) -> dict[str, float]:
    """How far one person's change moves each kind of release of the group model."""
    group = 2 * groups_changed
    return {"graph": 2 * rows_changed, "marginals": rows_changed, "selection": rows_changed / 2, "types": group * most_in_group, "latent_marginals": group * most_in_group, "latent_selection": group, "prior": group, "sizes_in_training": group, "type_sizes": group, "group_sizes": group}


def latent_sizes(limit: float, largest_attr: int, groups: float, size_noise: float, cap: int, theta: float = 6.0, most_types: int = 256, most_size: int = 50, most_variables: int = 2) -> list[int]:
    """Sizes of the latent variables that the noise leaves room for, two types each at least."""
    size = max(2.0, min(limit / largest_attr, most_size))
    types = max(4, min(most_types, int(groups / size_noise / theta / cap))) if size_noise > 0 else most_types
    count = max(1, min(int(math.log(types) / math.log(size)) + 1, most_variables))
    return [max(2, min(int(types ** (1 / count)), int(size)))] * count


def smoothed(histogram: np.ndarray, noise: float, rng: np.random.Generator, low: float) -> np.ndarray:
    """Cells under `low` grouped by value share one noisy mean, truncated; the others get noise of their own."""
    out = noisy(histogram, noise, rng)
    for v in np.unique(histogram[histogram < low]):
        own = histogram == v
        out[own] = int((histogram[own].sum() + rng.normal(scale=noise)) / own.sum())
    return out


def total_noise_loss(sizes: Iterable[int], noise: float) -> float:
    """Expected loss of the true tables against their noisy ones: half the cells' variance."""
    return 0.5 * sum(sizes) * noise**2


def with_preset(measured: Mapping, preset: Mapping | None) -> dict:
    """Measured tables, with those given from another budget in their place."""
    return {**measured, **(preset or {})}
