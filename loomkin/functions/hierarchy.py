"""Attribute hierarchies: a tree of bins over an attribute's codes, and codes mapped to a level and back."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Node:
    """A bin: its codes if it is a leaf, else smaller bins in order."""

    codes: list[int] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)

    def leaves(self) -> list[int]:
        return [c for n in self.children for c in n.leaves()] if self.children else list(self.codes)

    def depth(self) -> int:
        return 1 + max((c.depth() for c in self.children), default=0)

    def count(self) -> int:
        return 1 + sum(c.count() for c in self.children)

    def to_obj(self) -> dict:
        return {"children": [c.to_obj() for c in self.children]} if self.children else {"codes": self.codes}

    @staticmethod
    def from_obj(x: dict) -> Node:
        return Node(list(x.get("codes", ())), [Node.from_obj(c) for c in x.get("children", ())])


def flat(size: int) -> Node:
    """One level: all codes in one bin."""
    return Node(list(range(size)))


def by_mass(masses: list[float], bins: int = 10, most: int = 1000, depth: int = 2, codes: list[int] | None = None) -> Node:
    """Bins of about equal mass, cut again while a bin has more than `most` codes and depth is left.

    Each bin takes one code at least; the last takes what is left; bins for which no code is left are not made.
    """
    codes = list(range(len(masses))) if codes is None else codes
    if depth <= 0 or len(codes) <= most and codes == list(range(len(masses))) and depth == 2:
        return Node(codes)
    total, run, at, out = sum(masses[c] for c in codes), 0.0, 0, []
    for b in range(bins):
        if at >= len(codes):
            break
        first = at
        while at < len(codes):
            run += masses[codes[at]]
            at += 1
            if run >= total * (b + 1) / bins:
                break
        own = codes[first : len(codes) if b == bins - 1 else at]
        out.append(by_mass(masses, bins, most, depth - 1, own) if len(own) > most else Node(own))
    return Node(children=out)


def equal_width(size: int, bins: int = 10, most: int = 1000, depth: int = 2) -> Node:
    return by_mass([1.0] * size, bins, most, depth)


def parse(text: str) -> Node:
    """A nested `{ {0 1 2} {3 4} }` description."""
    words = re.findall(r"[{}]|[^\s{},]+", text)
    stack: list[Node] = [Node()]
    for w in words:
        if w == "{":
            stack.append(Node())
        elif w == "}":
            done = stack.pop()
            stack[-1].children.append(done)
        else:
            stack[-1].codes.append(int(w))
    if len(stack) != 1:
        raise ValueError("braces do not match")
    top = stack[0]
    return top.children[0] if len(top.children) == 1 and not top.codes else top


def dumps(trees: dict[str, Node]) -> str:
    return json.dumps({a: n.to_obj() for a, n in trees.items()})


def loads(text: str) -> dict[str, Node]:
    return {a: Node.from_obj(x) for a, x in json.loads(text).items()}


def level_sizes(tree: Node) -> list[int]:
    """Bins at each level, a leaf standing for itself on deeper levels; then the codes."""
    out, level = [], [tree]
    while any(n.children for n in level):
        out.append(len(level))
        level = [c for n in level for c in (n.children or [n])]
    return [*out, len(level), len(tree.leaves())]


def bins_at(tree: Node, level: int) -> list[Node]:
    nodes = [tree]
    for _ in range(level):
        nodes = [c for n in nodes for c in (n.children or [n])]
    return nodes


def level_table(spark: SparkSession, tree: Node, level: int) -> DataFrame:
    """(code, bin, inner): each code's bin at a level and its place in the bin. One row a code of the domain."""
    rows = [(c, b, i) for b, n in enumerate(bins_at(tree, level)) for i, c in enumerate(n.leaves())]
    return spark.createDataFrame(rows, "code int, bin int, inner int")


def to_level(df: DataFrame, attr: str, table: DataFrame) -> DataFrame:
    """attr replaced by attr (its bin) and attr_inner."""
    own = F.broadcast(table.select(F.col("code").alias(attr), F.col("bin").alias("_bin"), F.col("inner").alias(f"{attr}_inner")))
    return df.join(own, attr).withColumn(attr, F.col("_bin")).drop("_bin")


def from_level(df: DataFrame, attr: str, table: DataFrame) -> DataFrame:
    own = F.broadcast(table.select(F.col("bin").alias(attr), F.col("inner").alias(f"{attr}_inner"), F.col("code").alias("_code")))
    return df.join(own, [attr, f"{attr}_inner"]).withColumn(attr, F.col("_code")).drop("_code", f"{attr}_inner")


def impossible_cells(tree: Node, level: int) -> list[tuple[int, int]]:
    """(bin, inner) pairs that no code has: structural zeros of the split attribute."""
    sizes = [len(n.leaves()) for n in bins_at(tree, level)]
    return [(b, i) for b, n in enumerate(sizes) for i in range(n, max(sizes, default=0))]


def deepest_fitting(trees: dict[str, Node], attrs: list[str], limit: float) -> dict[str, int]:
    """Levels for a set of attributes: refined in turn, the attribute with fewest bins first, while the cells stay under the limit."""
    level = dict.fromkeys(attrs, 0)

    def cells(of: dict[str, int]) -> int:
        out = 1
        for a in attrs:
            sizes = level_sizes(trees[a])
            out *= sizes[min(of[a], len(sizes) - 1)]
        return out

    while True:
        trials = [{**level, a: level[a] + 1} for a in attrs if level[a] + 1 < len(level_sizes(trees[a]))]
        fits = [t for t in trials if cells(t) <= limit]
        if not fits:
            return level
        level = min(fits, key=cells)
