"""Stratified sampling: rounded counts, and conditional columns over DataFrames.

A column is drawn by giving each conditioning cell's rows, in a seeded hash order, the codes of the
cell's rounded counts: rank and running count meet in a range. There is no row-wise Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomkin.lineage import discard, materialize
from loomkin.model.factor import Factor
from loomkin.model.graph import Clique, depth_first

#: Code counts broadcast up to this many rows (cells with a code); they are bounded by a clique's cells.
MOST_CELLS = 1_000_000


def random_round(weights: np.ndarray, total: int, rng: np.random.Generator, replace: bool = True) -> np.ndarray:
    """Whole numbers that sum to total, near total * weights / sum: floors, and the rest drawn by the fractions."""
    w = np.maximum(np.asarray(weights, float), 0)
    flat = w.ravel()
    if flat.sum() <= 0:
        flat = np.ones_like(flat)
    want = flat * (total / flat.sum())
    whole = np.floor(want + 1e-9).astype(np.int64)
    part = np.maximum(want - whole, 0)
    left = int(total - whole.sum())
    if left > 0:
        p = part if part.sum() > 0 else flat
        if not replace and (p > 0).sum() < left:
            replace = True
        np.add.at(whole, rng.choice(len(p), left, p=p / p.sum(), replace=replace), 1)
    return whole.reshape(w.shape)


def expand_counts(counts: np.ndarray) -> np.ndarray:
    """Codes repeated by their counts; index rows for tables of several attributes."""
    cells = np.repeat(np.arange(counts.size), counts.ravel())
    return cells if counts.ndim == 1 else np.stack(np.unravel_index(cells, counts.shape), axis=1)


def split_evenly(counts: np.ndarray, parts: int) -> np.ndarray:
    """Integer counts dealt over parts, no two parts further apart than one in any cell."""
    base, more = counts // parts, counts % parts
    return np.stack([base + (np.arange(parts)[k] < more) for k in range(parts)])


def explode_types(spark, type_size: np.ndarray, names: Sequence[str]) -> DataFrame:
    """One row a group (gid, types..., size) from a table [types..., size - 1]; ids are dense in order of type and size."""
    cells = np.argwhere(type_size > 0)
    rows, at = [], 0
    for c in cells:
        n = int(type_size[tuple(c)])
        rows.append((*(int(x) for x in c[:-1]), int(c[-1]) + 1, n, at))
        at += n
    schema = ", ".join([*(f"{t} int" for t in names), "size int", "_n long", "_at long"])
    frame = spark.createDataFrame(rows, schema)
    each = frame.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_k"), "_at", *names, "size")
    return each.select((F.col("_k") + F.col("_at")).alias("gid"), *names, "size")


def _code_ranges(table: Factor, given: Sequence[str], target: str, sizes: dict[tuple[int, ...], int], rng: np.random.Generator) -> list[tuple]:
    """(codes of given..., target code, first rank, end rank) for the rows that each conditioning cell has."""
    own = table.project([*given, target])
    out = []
    for cell, n in sorted(sizes.items()):
        counts = random_round(own.values[cell], n, rng)
        ends = np.cumsum(counts)
        out += [(*cell, v, int(e - c), int(e)) for v, (c, e) in enumerate(zip(counts, ends, strict=True)) if c]
    return out


def draw_column(df: DataFrame, table: Factor, given: Sequence[str], target: str, key: str, seed: int) -> DataFrame:
    """df with `target` drawn from a clique's marginal given other columns; counts in each cell are rounded, not independent.

    Only the cells' row counts come to the driver: at most MOST_CELLS of them, or one for each cell where a
    clique has more. Cells are numbered in seeded hash order of the key. The window runs over (cell,
    block): a large cell is dealt over blocks by hash, and each block takes its own stretch of the cell's ranks.
    """
    blocks = max(1, min(64, MOST_CELLS // max(1, math.prod(table.domain[g].size for g in given))))
    rng = np.random.default_rng([seed, *(ord(c) for c in target)])
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(blocks)).cast("int"))
    counts = dealt.groupBy(*given, "_b").agg(F.count("*").alias("n")).collect()
    cells: dict[tuple[int, ...], dict[int, int]] = {}
    for r in counts:
        cells.setdefault(tuple(int(r[g]) for g in given), {})[r["_b"]] = r["n"]
    ranges = _code_ranges(table, given, target, {c: sum(b.values()) for c, b in cells.items()}, rng)
    by_cell: dict[tuple[int, ...], list[tuple[int, int, int]]] = {}
    for *cell, v, a, e in ranges:
        by_cell.setdefault(tuple(cell), []).append((v, a, e))
    rows = []
    for cell, own in cells.items():
        # the cell's codes in random order over its blocks: each block gets a rounded share of what is left
        left = np.zeros(table.domain[target].size, np.int64)
        for v, a, e in by_cell.get(cell, ()):
            left[v] += e - a
        for b, n in sorted(own.items()):
            take = rng.multivariate_hypergeometric(left, n)
            left -= take
            ends = np.cumsum(take)
            codes = [(v, int(e - c), int(e)) for v, (c, e) in enumerate(zip(take, ends, strict=True)) if c]
            rows.append((*cell, b, [c[0] for c in codes], [c[2] for c in codes]))
    schema = ", ".join([*(f"{g} int" for g in given), "_b int", "_codes array<int>", "_ends array<long>"])
    codes = df.sparkSession.createDataFrame(rows, schema)
    codes = F.broadcast(codes) if len(rows) <= MOST_CELLS else codes
    rank = F.row_number().over(W.partitionBy(*given, "_b").orderBy(F.xxhash64(F.lit(seed + 2), F.col(key)), key)) - 1
    met = dealt.withColumn("_r", rank).join(codes, [*given, "_b"])
    at = F.size(F.filter("_ends", lambda e: e <= F.col("_r")))
    return met.withColumn(target, F.get("_codes", at)).drop("_b", "_r", "_codes", "_ends")


def draw_from_tree(df: DataFrame, beliefs: dict[Clique, Factor], tree: Sequence[tuple[Clique, Clique]], key: str, seed: int, fixed: Sequence[str] = ()) -> DataFrame:
    """df with all attributes of a junction tree drawn; `fixed` ones are already there and stay."""
    cliques = sorted(beliefs)
    done = set(fixed)
    start = next((c for c in cliques if done <= set(c)), cliques[0])
    step, written = 0, None
    for _, clique in depth_first(tree, cliques, start):
        for a in clique:
            if a not in done:
                given = [x for x in clique if x in done]
                df = materialize(draw_column(df, beliefs[clique], given, a, key, seed + 17 * step), "drawn")
                if written is not None:
                    discard(written)
                written = df
                done.add(a)
                step += 1
    return df


def draw_members(groups: DataFrame, beliefs: dict[Clique, Factor], tree: Sequence[tuple[Clique, Clique]], types: Sequence[str], attrs: Sequence[str], seed: int, which: str | None = None) -> DataFrame:
    """Member rows (gid, member, types..., attrs...) of groups (gid, types..., size), all groups at once.

    The members of a group share its types, so drawing within the type cells over all groups gives each
    type its rounded marginal; no group is rounded on its own. which: only the first members, or the rest.
    """
    span = (groups.agg(F.max("size")).first()[0] or 0) + 1
    first, last = {"first": (F.lit(0), F.lit(0)), "rest": (F.lit(1), F.col("size") - 1)}.get(which, (F.lit(0), F.col("size") - 1))
    members = groups.where(last >= first).select("gid", *types, F.explode(F.sequence(first, last)).alias("member"))
    members = members.withColumn("_key", F.col("gid") * F.lit(span).cast("long") + F.col("member"))
    out = draw_from_tree(members, beliefs, tree, "_key", seed, fixed=types)
    return out.select("gid", "member", *types, *attrs)
