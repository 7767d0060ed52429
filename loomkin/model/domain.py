"""Domains (attributes with their sizes) and table layouts."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Attribute:
    """A categorical attribute with codes 0 .. size - 1."""

    size: int
    kind: str = "discrete"
    latent: bool = False


class Domain(Mapping):
    """Ordered attributes. Set algebra keeps the order of the left side."""

    def __init__(self, attributes: Mapping[str, Attribute | int] | Iterable[tuple[str, Attribute | int]] = ()) -> None:
        self._of = {a: x if isinstance(x, Attribute) else Attribute(int(x)) for a, x in dict(attributes).items()}

    def __getitem__(self, attr: str) -> Attribute:
        return self._of[attr]

    def __iter__(self) -> Iterator[str]:
        return iter(self._of)

    def __len__(self) -> int:
        return len(self._of)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Domain) and list(self._of.items()) == list(other._of.items())

    def __repr__(self) -> str:
        return f"Domain({ {a: x.size for a, x in self._of.items()} })"

    __hash__ = None

    @property
    def attrs(self) -> tuple[str, ...]:
        return tuple(self._of)

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(x.size for x in self._of.values())

    def cells(self, attrs: Iterable[str] | None = None) -> int:
        """Cells of the contingency table over attrs (all by default)."""
        out = 1
        for a in self._of if attrs is None else attrs:
            out *= self._of[a].size
        return out

    def project(self, attrs: Iterable[str]) -> Domain:
        return Domain((a, self._of[a]) for a in attrs)

    def without(self, attrs: Iterable[str]) -> Domain:
        gone = set(attrs)
        return Domain((a, x) for a, x in self._of.items() if a not in gone)

    __sub__ = without

    def __add__(self, other: Domain) -> Domain:
        return Domain({**self._of, **{a: x for a, x in other._of.items() if a not in self._of}})

    def with_attribute(self, name: str, size: int, kind: str = "discrete", latent: bool = False) -> Domain:
        return Domain({**self._of, name: Attribute(size, kind, latent)})

    def axes(self, attrs: Iterable[str]) -> tuple[int, ...]:
        at = {a: i for i, a in enumerate(self._of)}
        return tuple(at[a] for a in attrs)

    def pairs(self) -> list[tuple[str, str]]:
        return list(combinations(self._of, 2))

    def latent(self) -> tuple[str, ...]:
        return tuple(a for a, x in self._of.items() if x.latent)

    def observed(self) -> tuple[str, ...]:
        return tuple(a for a, x in self._of.items() if not x.latent)

    def violations(self, df: DataFrame) -> DataFrame:
        """One row: for each attribute the rows with a code outside 0 .. size - 1 (nulls included)."""
        out = [F.sum(F.when(F.col(a).between(0, x.size - 1), 0).otherwise(1)).cast("long").alias(a) for a, x in self._of.items()]
        return df.agg(*(F.coalesce(c, F.lit(0).cast("long")).alias(a) for c, a in zip(out, self._of, strict=True)))

    def check(self, df: DataFrame) -> None:
        row = self.violations(df).first()
        if bad := {a: row[a] for a in self._of if row[a]}:
            raise ValueError(f"codes outside their domain: {bad}")

    @staticmethod
    def inferred(df: DataFrame, attrs: Iterable[str]) -> Domain:
        """Sizes of max + 1. The data decide here, so don't use it where a domain must be public."""
        attrs = list(attrs)
        row = df.agg(*(F.max(a).alias(a) for a in attrs), *(F.min(a).alias(f"{a} least") for a in attrs)).first()
        if any(row[f"{a} least"] is not None and row[f"{a} least"] < 0 for a in attrs):
            raise ValueError("negative code")
        return Domain((a, int(row[a] if row[a] is not None else 0) + 1) for a in attrs)

    def to_json(self) -> str:
        return json.dumps({a: {"size": x.size, "type": x.kind, "latent": x.latent} for a, x in self._of.items()})

    @staticmethod
    def from_json(text: str) -> Domain:
        """From {name: {"size": ..., "type": ..., "latent": ...}} or {name: {"domain": size}}."""
        raw = json.loads(text)
        return Domain((a, Attribute(int(x.get("size", x.get("domain"))), x.get("type", "discrete"), bool(x.get("latent", False)))) for a, x in raw.items())


@dataclass(frozen=True)
class TableSpec:
    """A table's layout by name: primary key, attributes, and the foreign key of a child table."""

    pk: str
    attrs: tuple[str, ...]
    fk: str | None = None
    domain: Domain = field(default_factory=Domain)

    def columns(self) -> list[str]:
        return [self.pk, *self.attrs, *([self.fk] if self.fk else [])]

    def select(self, df: DataFrame) -> DataFrame:
        return df.select(*self.columns())
