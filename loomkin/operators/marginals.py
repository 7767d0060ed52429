"""Contingency tables, group statistics, dependence scores and distances over DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkin.functions.encode import flat_cell, mixed_radix
from loomkin.lineage import materialize
from loomkin.model.domain import Domain

#: Cells up to which a table may be made dense or brought to the driver.
MOST_CELLS = 1_000_000


def marginal(df: DataFrame, attrs: Sequence[str], weight: str | Column | None = None, name: str = "n") -> DataFrame:
    """Sparse contingency table: counts, or sums of a weight."""
    value = F.count("*") if weight is None else F.sum(weight if isinstance(weight, Column) else F.col(weight))
    return df.groupBy(*attrs).agg(value.alias(name))


def dense(sparse: DataFrame, domain: Domain, name: str = "n") -> DataFrame:
    """All cells of the domain, zero where the table has none. Cells are counted out of one number, without a cross join."""
    if domain.cells() > MOST_CELLS:
        raise ValueError(f"{domain.cells()} cells are too many to be dense")
    cells = sparse.sparkSession.range(domain.cells()).select(*mixed_radix(F.col("id"), domain))
    return cells.join(sparse, list(domain), "left").select(*domain, F.coalesce(name, F.lit(0)).alias(name))


def marginals(df: DataFrame, sets: Iterable[Sequence[str]], weight: Column | None = None) -> DataFrame:
    """Many tables in one scan (GROUPING SETS): id of the set, the attributes (null where not in the set), n."""
    sets = [tuple(s) for s in sets]
    attrs = list(dict.fromkeys(a for s in sets for a in s))
    value = F.count("*") if weight is None else F.sum(weight)
    own = df.select(*attrs, *([weight.alias("_w")] if weight is not None else []))
    value = F.count("*") if weight is None else F.sum("_w")
    out = own.groupingSets([[F.col(a) for a in s] for s in sets], *attrs).agg(value.alias("n"), F.grouping_id(*attrs).alias("_g"))
    ids = {sum(1 << (len(attrs) - 1 - attrs.index(a)) for a in attrs if a not in s): i for i, s in enumerate(sets)}
    number = F.coalesce(*(F.when(F.col("_g") == g, F.lit(i)) for g, i in ids.items()))
    return out.select(number.alias("set_id"), *attrs, "n")


def collect_marginals(df: DataFrame, sets: Iterable[Sequence[str]], domain: Domain, weight: Column | None = None) -> dict[tuple[str, ...], np.ndarray]:
    """Dense arrays on the driver for tables of bounded size, in one scan."""
    sets = [tuple(s) for s in sets]
    if not sets:
        return {}
    if (cells := max(domain.cells(s) for s in sets)) > MOST_CELLS:
        raise ValueError(f"{cells} cells are too many for the driver")
    out = {s: np.zeros(domain.project(s).shape) for s in sets}
    for r in marginals(df, sets, weight).collect():
        s = sets[r["set_id"]]
        out[s][tuple(int(r[a]) for a in s)] += float(r["n"])
    return out


def latent_marginal(child: DataFrame, fk: str, q: DataFrame, attrs: Sequence[str], types: Sequence[str], weight: str = "p", name: str = "n") -> DataFrame:
    """Child rows weighted by their group's type distribution q (fk, types..., p); the type columns asked for are kept, the rest summed."""
    keep = [t for t in types if t in attrs]
    own = [a for a in attrs if a not in types]
    weights = q.groupBy(fk, *keep).agg(F.sum(weight).alias("_p"))
    counts = child.groupBy(fk, *own).agg(F.count("*").alias("_c"))
    return counts.join(weights, fk).groupBy(*attrs).agg(F.sum(F.col("_c") * F.col("_p")).alias(name))


def group_sizes(child: DataFrame, fk: str, cap: int | None = None, parents: DataFrame | None = None, pk: str | None = None) -> DataFrame:
    """(size, n): groups by their number of rows, sizes over the cap counted as the cap; with parents, size 0 for the childless."""
    size = child.groupBy(fk).agg(F.count("*").alias("size"))
    if parents is not None:
        size = parents.select(F.col(pk).alias(fk)).join(size, fk, "left").select(fk, F.coalesce("size", F.lit(0)).alias("size"))
    held = F.col("size") if cap is None else F.least(F.col("size"), F.lit(cap))
    return size.groupBy(held.alias("size")).agg(F.count("*").alias("n"))


def block_smoothed(sizes: DataFrame, blocks: Sequence[tuple[int, int]], most: int, noise: dict[int, float] | None = None) -> DataFrame:
    """Sizes 1 .. most smoothed: from each block's first bin on, stretches of its width share their mean.

    blocks: (first bin, width), in order, bins counted from 0. Bins before the first block stay as they
    are. noise: one drawn number for each stretch (by its first bin; -1 for the bins before the first
    block), added to the stretch's sum.
    """
    stretch: dict[int, int] = {}
    for k, (first, width) in enumerate(blocks):
        last = blocks[k + 1][0] if k + 1 < len(blocks) else most
        stretch |= {b: first + (b - first) // width * width for b in range(first, last)}
    rows = [(b + 1, stretch.get(b, -1 - b), float((noise or {}).get(stretch.get(b, -1), 0.0))) for b in range(most)]
    bins = sizes.sparkSession.createDataFrame(rows, "size long, stretch long, noise double")
    full = bins.join(sizes, "size", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    means = full.groupBy("stretch").agg(((F.sum("n") + F.max("noise")) / F.count("*")).alias("smoothed"))
    return full.join(means, "stretch").select("size", "smoothed")


def rows_in_groups(sizes: DataFrame) -> DataFrame:
    """Rows that a size histogram stands for."""
    return sizes.agg(F.sum(F.col("size") * F.col("n")).alias("n_rows"))


def type_sizes(child: DataFrame, fk: str, q: DataFrame, types: Sequence[str], cap: int, weight: str = "p") -> DataFrame:
    """(types..., size, n): type mass by capped group size."""
    size = child.groupBy(fk).agg(F.least(F.count("*"), F.lit(cap)).alias("size"))
    return q.join(size, fk).groupBy(*types, "size").agg(F.sum(weight).alias("n"))


def type_rows(child: DataFrame, fk: str, q: DataFrame, types: Sequence[str], weight: str = "p") -> DataFrame:
    """(types..., n): rows by type, each group's rows split by its type distribution."""
    size = child.groupBy(fk).agg(F.count("*").alias("_size"))
    return q.join(size, fk).groupBy(*types).agg(F.sum(F.col("_size") * F.col(weight)).alias("n"))


def value_counts(df: DataFrame, attr: str) -> DataFrame:
    return df.groupBy(F.col(attr).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def coverage(df: DataFrame, attr: str, top: int = 100) -> DataFrame:
    """Share of the rows whose value is among the `top` most frequent (a report)."""
    counts = value_counts(df, attr)
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.limit(top).agg((F.sum("n") / F.lit(total)).alias("coverage"))


def entropy(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Shannon entropy in nats of the joint distribution, sparse whatever the domain's size."""
    return entropy_of(marginal(df, attrs))


def entropy_of(sparse: DataFrame, name: str = "n") -> DataFrame:
    """ln N - sum(n ln n) / N."""
    return sparse.where(F.col(name) > 0).agg((F.ln(F.sum(name)) - F.sum(F.col(name) * F.ln(name)) / F.sum(name)).alias("entropy"))


def total_correlation(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Sum of the attributes' entropies less their joint entropy; for two attributes the mutual information. One scan."""
    sets = [tuple(attrs), *((a,) for a in attrs)]
    each = marginals(df, sets).groupBy("set_id").agg((F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias("h"))
    return each.agg(F.sum(F.when(F.col("set_id") == 0, -F.col("h")).otherwise(F.col("h"))).alias("mutual_information"))


def r_scores(df: DataFrame, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """(a, b, r_score): half the sum over all cells of |n_a n_b / N - n_ab|, for all pairs in one scan.

    Cells without a row need not be made: their expected counts add up to N less those of the others.
    """
    pairs = [tuple(p) for p in pairs]
    singles = list(dict.fromkeys(a for p in pairs for a in p))
    sets = [*pairs, *((a,) for a in singles)]
    counts = materialize(marginals(df, sets), "pairs")  # small, and read three times
    # one row a cell of a pair, with the codes by position, meets the two single counts by (attribute, code)
    ones = counts.where(F.col("set_id") >= len(pairs)).select((F.col("set_id") - len(pairs)).alias("attr"), F.coalesce(*singles).alias("code"), F.col("n").alias("m"))
    at = {a: i for i, a in enumerate(singles)}
    number = lambda k: F.element_at(F.array(*(F.lit(at[p[k]]) for p in pairs)), F.col("set_id") + 1)
    code = lambda k: F.coalesce(*(F.when(F.col("set_id") == i, F.col(p[k])) for i, p in enumerate(pairs)))
    cells = counts.where(F.col("set_id") < len(pairs)).select("set_id", "n", number(0).alias("a"), code(0).alias("ca"), number(1).alias("b"), code(1).alias("cb"))
    met = cells.join(ones.select(F.col("attr").alias("a"), F.col("code").alias("ca"), F.col("m").alias("na")), ["a", "ca"])
    met = met.join(ones.select(F.col("attr").alias("b"), F.col("code").alias("cb"), F.col("m").alias("nb")), ["b", "cb"])
    product = F.col("na") * F.col("nb")
    # expected counts are product / rows, so the sums below are whole numbers, to be divided once
    out = met.join(met.groupBy("set_id").agg(F.sum("n").alias("rows")), "set_id").groupBy("set_id").agg(
        F.max("rows").alias("rows"), F.sum(F.abs(product - F.col("n") * F.col("rows"))).alias("off"), F.sum(product).alias("seen")
    )
    score = 0.5 * (F.col("off") / F.col("rows") + (F.col("rows") - F.col("seen") / F.col("rows")))
    name = lambda k: F.element_at(F.array(*(F.lit(p[k]) for p in pairs)), F.col("set_id") + 1)
    return out.select(name(0).alias("a"), name(1).alias("b"), score.alias("r_score"), (score / F.col("rows")).alias("tvd"))


def tvd_count(one: DataFrame, other: DataFrame, attrs: Sequence[str], name: str = "n", rescale: bool = False) -> DataFrame:
    """Half the sum of |h1 - h2| over the cells of either table, and that over the first table's sum (1 if that is 0).

    rescale: the second table is first brought to the first one's sum.
    """
    a, b = one.select(*attrs, F.col(name).cast("double").alias("x")), other.select(*attrs, F.col(name).cast("double").alias("y"))
    if rescale:
        sums = (a.agg(F.sum("x")).first()[0] or 0.0, b.agg(F.sum("y")).first()[0] or 0.0)
        b = b.withColumn("y", F.col("y") * (sums[0] / sums[1] if sums[1] else 0.0))
    both = a.join(b, list(attrs), "full").select(F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    out = both.agg((F.sum(F.abs(F.col("x") - F.col("y"))) / 2).alias("tvd_count"), F.sum("x").alias("_n"))
    return out.select("tvd_count", F.when(F.col("_n") == 0, F.lit(1.0)).otherwise(F.col("tvd_count") / F.col("_n")).alias("tvd"))


def group_tvd(one: DataFrame, other: DataFrame, fk: str, attrs: Sequence[str]) -> DataFrame:
    """(fk, tvd_count): within each group, the distance of its two histograms, the second brought to the first's size."""
    a = one.groupBy(fk, *attrs).agg(F.count("*").alias("x"))
    b = other.groupBy(fk, *attrs).agg(F.count("*").alias("y"))
    size = lambda df, c, s: df.groupBy(fk).agg(F.sum(c).alias(s))
    both = a.join(b, [fk, *attrs], "full").join(size(a, "x", "_sx"), fk, "left").join(size(b, "y", "_sy"), fk, "left")
    scaled = F.coalesce("y", F.lit(0)) * F.coalesce(F.col("_sx") / F.col("_sy"), F.lit(0.0))
    return both.groupBy(fk).agg((F.sum(F.abs(F.coalesce("x", F.lit(0)) - scaled)) / 2).alias("tvd_count"))


def dispersion(child: DataFrame, fk: str, attrs: Sequence[str], q: DataFrame, types: Sequence[str], weight: str = "p") -> DataFrame:
    """(types..., dispersion): type mass times the distance of each group's own histogram from the type's mean one.

    Cells that a group lacks are not made: over them the distance adds the mean's mass that the group's cells don't hold.
    """
    cells = child.groupBy(fk, *attrs).agg(F.count("*").alias("_c"))
    sizes = child.groupBy(fk).agg(F.count("*").alias("_s"))
    own = cells.join(sizes, fk).select(fk, *attrs, (F.col("_c") / F.col("_s")).alias("h"))
    weighted = own.join(q, fk).select(fk, *types, *attrs, "h", F.col(weight).alias("w"))
    mass = q.join(sizes.select(fk), fk, "left_semi").groupBy(*types).agg(F.sum(weight).alias("mass"))
    mean = weighted.groupBy(*types, *attrs).agg(F.sum(F.col("w") * F.col("h")).alias("m")).join(mass, list(types)).select(*types, *attrs, (F.col("m") / F.col("mass")).alias("mean"))
    near = weighted.join(mean, [*types, *attrs]).groupBy(fk, *types).agg((F.sum(F.abs(F.col("h") - F.col("mean")) - F.col("mean")) + 1).alias("d"), F.max("w").alias("w"))
    return near.groupBy(*types).agg((F.sum(F.col("w") * F.col("d")) / 2).alias("dispersion"))


def group_multisets(child: DataFrame, fk: str, attrs: Sequence[str]) -> DataFrame:
    """(members, n): groups by the sorted multiset of their rows' attributes. Groups are collected as (row, count) cells."""
    cells = child.groupBy(fk, *attrs).agg(F.count("*").alias("times"))
    sets = cells.groupBy(fk).agg(F.sort_array(F.collect_list(F.struct(*attrs, "times"))).alias("members"))
    return sets.groupBy("members").agg(F.count("*").alias("n"))


def argmax_types(q: DataFrame, fk: str, types: Sequence[str], weight: str = "p") -> DataFrame:
    """(fk, types...): each group's most likely type, the first in code order on ties."""
    best = F.max_by(F.struct(*types), F.struct(F.col(weight), *(-F.col(t) for t in types)))
    return q.groupBy(fk).agg(best.alias("_t")).select(fk, *(F.col(f"_t.{t}").alias(t) for t in types))


def undetermined(q: DataFrame, fk: str, types: Sequence[str], weight: str = "p") -> DataFrame:
    """(ratio, collapsed): entries below 0.9 but above an even share, over groups; types with under a tenth of the mean mass."""
    counts = q.agg(F.count_distinct(fk).alias("groups"), F.count_distinct(*types).alias("types")).first()
    even = 1 / max(counts["types"], 1)
    of_type = q.groupBy(*types).agg(F.sum(F.when((F.col(weight) < 0.9) & (F.col(weight) > even), 1).otherwise(0)).alias("open"), F.sum(weight).alias("m"))
    small = F.sum(F.when(F.col("m") < 0.1 * counts["groups"] * even, 1).otherwise(0)).cast("long")
    return of_type.agg((F.sum("open") / max(counts["groups"], 1)).alias("ratio"), small.alias("collapsed"))


def cell_counts(df: DataFrame, domain: Domain, weight: Column | None = None) -> DataFrame:
    """(cell, n) with the attributes packed into one number: a narrow key for wide tables."""
    value = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(flat_cell(domain).alias("cell")).agg(value.alias("n"))
