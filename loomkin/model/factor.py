"""Dense factors over a domain, potentials, and belief propagation on a junction tree.

Everything here has a bounded number of cells and lives on the driver in numpy.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np

from loomkin.model.domain import Domain

Clique = tuple[str, ...]


class Factor:
    """An array with one axis for each attribute of its domain."""

    def __init__(self, domain: Domain, values: np.ndarray) -> None:
        self.domain, self.values = domain, np.asarray(values, dtype=float)
        if self.values.shape != domain.shape:
            raise ValueError(f"{self.values.shape} is not the shape of {domain}")

    @staticmethod
    def zeros(domain: Domain) -> Factor:
        return Factor(domain, np.zeros(domain.shape))

    def copy(self) -> Factor:
        return Factor(self.domain, self.values.copy())

    def to(self, attrs: Sequence[str]) -> Factor:
        """The same factor with its axes in the order of attrs."""
        attrs = [a for a in attrs if a in self.domain]
        return Factor(self.domain.project(attrs), np.transpose(self.values, self.domain.axes(attrs)))

    def expand(self, domain: Domain) -> np.ndarray:
        """Values with an axis (of one cell where the attribute is not its own) for each attribute of a larger domain."""
        own = self.to(domain.attrs)
        return own.values.reshape([x.size if a in self.domain else 1 for a, x in domain.items()])

    def _with(self, other, op) -> Factor:
        if not isinstance(other, Factor):
            return Factor(self.domain, op(self.values, other))
        both = self.domain + other.domain
        return Factor(both, np.broadcast_to(op(self.expand(both), other.expand(both)), both.shape).copy())

    def __add__(self, other) -> Factor:
        return self._with(other, np.add)

    def __sub__(self, other) -> Factor:
        return self._with(other, np.subtract)

    def __mul__(self, other) -> Factor:
        return self._with(other, np.multiply)

    def __truediv__(self, other) -> Factor:
        """Division; 0 / 0 is 0."""

        def div(a, b):
            a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
            return np.divide(a, b, out=np.zeros(a.shape), where=b != 0)

        return self._with(other, div)

    __radd__, __rmul__ = __add__, __mul__

    def exp(self) -> Factor:
        return Factor(self.domain, np.exp(self.values))

    def sum(self) -> float:
        return float(self.values.sum())

    def project(self, attrs: Iterable[str]) -> Factor:
        """Sums out all other attributes; the axes follow attrs."""
        attrs = [a for a in attrs if a in self.domain]
        out = self.values.sum(axis=self.domain.axes(a for a in self.domain if a not in attrs))
        return Factor(self.domain.project(a for a in self.domain if a in attrs), out).to(attrs)

    def logsumexp(self, attrs: Iterable[str] | None = None) -> Factor | float:
        """ln sum exp over all other attributes, or over all cells; shifted by the largest value."""
        keep = [] if attrs is None else [a for a in self.domain if a in set(attrs)]
        axes = self.domain.axes(a for a in self.domain if a not in keep)
        top = self.values.max(axis=axes, keepdims=True)
        top = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            out = np.log(np.exp(self.values - top).sum(axis=axes)) + top.squeeze(axis=axes)
        return float(out) if attrs is None else Factor(self.domain.project(keep), out)

    def at(self, given: Mapping[str, int]) -> Factor:
        """The slice at given codes, without their axes."""
        index = tuple(given.get(a, slice(None)) for a in self.domain)
        return Factor(self.domain.without(given), self.values[index])

    def scaled(self, totals: Factor) -> Factor:
        """Rescaled so that its projection on totals' attributes equals totals (cells without mass stay 0)."""
        return self * (totals / self.project(totals.domain.attrs))


class Potential(dict):
    """Factors by clique, with elementwise arithmetic over equal keys."""

    def _with(self, other, op) -> Potential:
        return Potential({c: op(f, other[c]) if isinstance(other, dict) else op(f, other) for c, f in self.items()})

    def __add__(self, other) -> Potential:
        return self._with(other, lambda a, b: a + b)

    def __sub__(self, other) -> Potential:
        return self._with(other, lambda a, b: a - b)

    def __mul__(self, other) -> Potential:
        return self._with(other, lambda a, b: a * b)

    __rmul__ = __mul__

    def copy(self) -> Potential:
        return Potential({c: f.copy() for c, f in self.items()})

    def dot(self, other: Mapping[Clique, Factor]) -> float:
        return float(sum((f * other[c]).sum() for c, f in self.items()))

    @staticmethod
    def zeros(domain: Domain, cliques: Iterable[Clique]) -> Potential:
        return Potential({c: Factor.zeros(domain.project(c)) for c in cliques})


def l2_loss(model: Mapping[Clique, Factor], measured: Mapping[Clique, Factor]) -> tuple[float, Potential]:
    """Half the squared distance over the measured marginals, and its gradient in the model's marginals."""
    gradient = Potential({c: model[c].to(m.domain.attrs) - m for c, m in measured.items()})
    return 0.5 * gradient.dot(gradient), gradient


def propagate(potential: Potential, messages: Sequence[tuple[Clique, Clique]], total: float = 1.0, log: bool = False) -> tuple[Potential, float]:
    """Clique marginals of the model exp(sum of potentials), scaled to total, and the log partition function.

    Each message is the sender's belief without what the receiver sent it, summed onto their separator.
    """
    belief, sent = potential.copy(), {}
    for a, b in messages:
        own = belief[a] - sent[b, a] if (b, a) in sent else belief[a]
        sent[a, b] = own.logsumexp(set(a) & set(b))
        belief[b] = (belief[b] + sent[a, b]).to(belief[b].domain.attrs)
    # a forest's trees each have their own sum
    z = {c: f.logsumexp() for c, f in belief.items()}
    out = Potential({c: Factor(f.domain, f.values - z[c] + np.log(total)) for c, f in belief.items()})
    return (out if log else Potential({c: f.exp() for c, f in out.items()})), _log_partition(z, messages)


def _log_partition(z: Mapping[Clique, float], messages: Sequence[tuple[Clique, Clique]]) -> float:
    """Sum over the forest's trees of their common log partition function."""
    root = {c: c for c in z}

    def find(c: Clique) -> Clique:
        while root[c] != c:
            c = root[c]
        return c

    for a, b in messages:
        if (x := find(a)) != (y := find(b)):
            root[x] = y
    return float(sum(z[c] for c in z if find(c) == c))


def marginals_of(beliefs: Mapping[Clique, Factor], wanted: Iterable[Clique]) -> Potential:
    """Each wanted marginal from the smallest clique that holds it."""
    out = Potential()
    for w in wanted:
        holder = min((c for c in beliefs if set(w) <= set(c)), key=lambda c: beliefs[c].values.size, default=None)
        if holder is None:
            raise KeyError(f"no clique holds {w}")
        out[w] = beliefs[holder].project(w)
    return out
