"""Scores of synthetic data: intra-group count queries, their relative error, marginal distances."""

from __future__ import annotations

from collections.abc import Sequence
from copy import copy
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkin.lineage import materialize
from loomkin.model.domain import Domain
from loomkin.operators import marginals as M
from loomkin.operators.relational import SMALL_ROWS

Needs = tuple[tuple[str, tuple[int, ...]], ...]


@dataclass(frozen=True)
class GroupQuery:
    """Groups with low <= size < high, whose parent satisfies `parent` and which have two different members for `first` and `second`."""

    low: int
    high: int
    parent: Needs = ()
    first: Needs = ()
    second: Needs = ()

    def to_json(self) -> dict:
        return {"size": [self.low, self.high], "parent": self.parent, "first": self.first, "second": self.second}


def _needs(rng: np.random.Generator, domain: Domain, ratio: float, count: int, attrs: Sequence[str] | None = None) -> Needs:
    """Random requirements: a range of a continuous attribute's codes, a random subset of a discrete one's."""
    picked = attrs if attrs is not None else [str(a) for a in rng.choice(list(domain), count, replace=False)]
    out = []
    for a in picked:
        n = max(1, int(domain[a].size * ratio))
        if domain[a].kind == "continuous":
            start = int(rng.random() * (domain[a].size - n))
            out.append((a, tuple(range(start, start + n))))
        else:
            out.append((a, tuple(sorted(int(x) for x in rng.choice(domain[a].size, n, replace=False)))))
    return tuple(out)


def random_queries(count: int, child: Domain, parent: Domain, child_attrs: int, parent_attrs: int, seed: int = 0, selectivity: float = 0.2, most_size: int = 7, size_ratio: float = 0.2) -> list[GroupQuery]:
    """Queries whose members share attributes; the selectivity is spread evenly over parent and both members' attributes."""
    rng = np.random.default_rng(seed)
    ratio = selectivity ** (1 / (parent_attrs + 2 * child_attrs))
    out = []
    for _ in range(count):
        width = int(most_size * size_ratio)
        low = int(most_size * rng.random()) - width + 2
        first = _needs(rng, child, ratio, child_attrs)
        second = _needs(rng, child, ratio, child_attrs, [a for a, _ in first])
        out.append(GroupQuery(low, low + width, _needs(rng, parent, ratio, parent_attrs), first, second))
    return out


class QueryBits:
    """One bit a query: for each attribute and code the queries that it leaves open, for `first`, `second` and `parent`."""

    def __init__(self, queries: Sequence[GroupQuery]) -> None:
        self.count, self.words = len(queries), -(-len(queries) // 64)
        self.tables = {part: self._tables(queries, part) for part in ("first", "second", "parent")}
        self.most = max((q.high for q in queries), default=0)
        self.sizes = self._pack(np.array([[q.low <= n < q.high for q in queries] for n in range(self.most)], bool).reshape(self.most, len(queries)))

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        whole = np.zeros((len(bits), self.words * 64), bool)
        whole[:, : self.count] = bits
        return np.packbits(whole, axis=1, bitorder="little").view(np.uint64)

    def _tables(self, queries: Sequence[GroupQuery], part: str) -> dict[str, np.ndarray]:
        """By attribute: a row of bits for each code, and a last one for all other codes."""
        needs = [dict(getattr(q, part)) for q in queries]
        out = {}
        for a in sorted({a for n in needs for a in n}):
            size = 1 + max(max(n[a], default=0) for n in needs if a in n)
            bits = np.ones((size + 1, len(queries)), bool)
            for i, n in enumerate(needs):
                if a in n:
                    bits[:, i] = False
                    bits[list(n[a]), i] = True
            out[a] = self._pack(bits)
        return out

    def attrs(self, *parts: str) -> list[str]:
        return sorted({a for p in parts for a in self.tables[p]})

    def named(self, child: str, parent: str) -> QueryBits:
        """With these prefixes before the attributes' names."""
        out = copy(self)
        out.tables = {p: {(parent if p == "parent" else child) + a: t for a, t in own.items()} for p, own in self.tables.items()}
        return out

    def satisfied(self, part: str, codes: dict[str, np.ndarray], rows: int) -> np.ndarray:
        """[rows, words]: the queries whose requirements each row meets. A missing or unknown code meets none."""
        out = np.full((rows, self.words), np.uint64(0xFFFFFFFFFFFFFFFF))
        for a, table in self.tables[part].items():
            c = codes[a]
            known = (c >= 0) & (c < len(table) - 1)
            out &= table[np.where(known, c, len(table) - 1).astype(np.int64)]
        return out

    def counts(self, bits: np.ndarray) -> np.ndarray:
        """Rows with each query's bit."""
        out = np.zeros(self.words * 64, np.int64)
        for a in range(0, len(bits), 1024):
            out += np.unpackbits(bits[a : a + 1024].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return out[: self.count]


#: Rows whose bits are made at once (divided by the queries' words), and rows of a group too many for any query's size.
ROWS_AT_ONCE, HUGE = 1 << 20, 100_000


def _count_in_groups(shared, child_attrs: Sequence[str], parent_attrs: Sequence[str]):
    """Rows sorted by key to (query, n). A row is a child's (parent false) or a parent's."""

    def run(batches):
        own: QueryBits = shared.value
        total = np.zeros(own.count, np.int64)
        step = max(1024, ROWS_AT_ONCE // max(own.words, 1))

        def judge(cols: dict[str, np.ndarray]) -> None:
            key = cols["_k"]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
            is_parent = cols["_p"]
            size = np.bincount(group[~is_parent], minlength=len(first))
            fits = (size < own.most) & (np.bincount(group[is_parent], minlength=len(first)) > 0)
            some = np.zeros(len(size), bool)
            some[fits] = own.sizes[size[fits]].any(axis=1)
            rows = np.flatnonzero(~is_parent & some[group])
            if not len(rows):
                return
            groups, at = np.unique(group[rows], return_inverse=True)
            codes = {a: cols[a][rows] for a in child_attrs}
            x, y = (own.satisfied(p, codes, len(rows)) for p in ("first", "second"))
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            hit = np.bitwise_or.reduceat(x, starts, axis=0) & np.bitwise_or.reduceat(y, starts, axis=0)
            # both met together by two rows or more: member by member, what was seen once and is seen again
            either, once, twice = x | y, np.zeros_like(hit), np.zeros_like(hit)
            rank = np.arange(len(rows)) - starts[at]
            for r in range(int(rank.max()) + 1):
                k = np.flatnonzero(rank == r)
                g = at[k]
                twice[g] |= once[g] & either[k]
                once[g] |= either[k]
            hit &= twice & own.sizes[size[groups]]
            place = np.full(len(first), -1)
            place[groups] = np.arange(len(groups))
            p_rows = np.flatnonzero(is_parent & (place[group] >= 0))
            total[:] += own.counts(hit[place[group[p_rows]]] & own.satisfied("parent", {a: cols[a][p_rows] for a in parent_attrs}, len(p_rows)))

        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            cols = {n: batch.column(k).fill_null(-1).to_numpy(zero_copy_only=False) if n not in ("_k", "_p") else batch.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(batch.schema.names)}
            if held is not None:
                cols = {n: np.concatenate([held[n], c]) for n, c in cols.items()}
            key = cols["_k"]
            if len(key) < step:
                held = cols
                continue
            cut = int(np.searchsorted(key, key[-1], side="left"))
            ends = [0]
            while ends[-1] < cut:  # pieces of about `step` rows that end between groups
                to = min(ends[-1] + step, cut)
                left = int(np.searchsorted(key, key[to], side="left"))
                ends.append(left if left > ends[-1] else int(np.searchsorted(key, key[to], side="right")))
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                judge({n: c[a:b] for n, c in cols.items()})
            held = {n: c[ends[-1] :] for n, c in cols.items()}
        if held is not None and len(held["_k"]):
            judge(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(own.count)), pa.array(total)], names=["query", "n"])

    return run


def count_groups(child: DataFrame, parent: DataFrame, fk: str, pk: str, queries: Sequence[GroupQuery]) -> DataFrame:
    """(query, n): groups that satisfy each query.

    Two different members exist if both requirements are met by someone and together by two rows or more,
    so members need not be paired. All queries are answered in one pass: children and parents meet by
    one narrow shuffle, and each row meets all queries at once, as bits that its codes look up. Groups of
    HUGE rows or more than any query asks for are left out before the shuffle.
    """
    spark = child.sparkSession
    own = QueryBits(queries)
    c_attrs, p_attrs = own.attrs("first", "second"), own.attrs("parent")
    key = lambda c: F.col(c).cast("long").alias("_k")
    rows = child.where(F.col(fk).isNotNull()).select(key(fk), F.lit(False).alias("_p"), *(F.col(a).cast("int").alias(f"c_{a}") for a in c_attrs), *(F.lit(None).cast("int").alias(f"p_{a}") for a in p_attrs))
    huge = rows.groupBy("_k").agg(F.count("*").alias("_n")).where(F.col("_n") >= max(own.most, HUGE)).select("_k")
    if n := (huge := materialize(huge, "huge")).count():
        rows = rows.join(F.broadcast(huge) if n <= SMALL_ROWS else huge, "_k", "left_anti")
    owners = parent.where(F.col(pk).isNotNull()).select(key(pk), F.lit(True).alias("_p"), *(F.lit(None).cast("int").alias(f"c_{a}") for a in c_attrs), *(F.col(a).cast("int").alias(f"p_{a}") for a in p_attrs))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.unionByName(owners).repartition(parts, "_k").sortWithinPartitions("_k")
    shared = spark.sparkContext.broadcast(own.named("c_", "p_"))
    found = dealt.mapInArrow(_count_in_groups(shared, [f"c_{a}" for a in c_attrs], [f"p_{a}" for a in p_attrs]), "query long, n long")
    every = spark.range(len(queries)).select(F.col("id").alias("query"), F.lit(0).cast("long").alias("n"))
    return found.unionByName(every).groupBy("query").agg(F.sum("n").alias("n"))


def relative_error(truth: DataFrame, synthetic: DataFrame, n_truth: int, n_synthetic: int, base: float = 0.001) -> DataFrame:
    """(query, truth, synthetic, error): synthetic counts scaled to the true number of groups; |difference| over max(base * groups, truth)."""
    both = truth.withColumnRenamed("n", "truth").join(synthetic.withColumnRenamed("n", "synthetic"), "query")
    scaled = F.col("synthetic") * n_truth / n_synthetic
    return both.select("query", "truth", "synthetic", (F.abs(F.col("truth") - scaled) / F.greatest(F.lit(base * n_truth), F.col("truth").cast("double"))).alias("error"))


def mean_error(errors: DataFrame) -> DataFrame:
    return errors.agg(F.avg("error").alias("mean_error"))


def k_way_tvd(one: DataFrame, other: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """(set_id, tvd): distances of the given marginals, all of a table in one scan; the second table scaled to the first."""
    sets = [tuple(s) for s in sets]
    attrs = list(dict.fromkeys(a for s in sets for a in s))
    a = M.marginals(one, sets).withColumnRenamed("n", "x")
    b = M.marginals(other, sets).withColumnRenamed("n", "y")
    keys = ["set_id", *attrs]
    sums = a.groupBy("set_id").agg(F.sum("x").alias("sx")).join(b.groupBy("set_id").agg(F.sum("y").alias("sy")), "set_id")
    fill = [F.coalesce(F.col(k).cast("long"), F.lit(-1)).alias(k) for k in attrs]
    both = a.select("set_id", *fill, "x").join(b.select("set_id", *fill, "y"), keys, "full").join(F.broadcast(sums) if len(sets) < 10_000 else sums, "set_id")
    share = F.coalesce(F.col("x"), F.lit(0)) / F.col("sx") - F.coalesce(F.col("y"), F.lit(0)) / F.col("sy")
    return both.groupBy("set_id").agg((F.sum(F.abs(share)) / 2).alias("tvd"))


def random_sets(attrs: Sequence[str], k: int, count: int, seed: int = 0) -> list[tuple[str, ...]]:
    """Up to `count` different k-subsets."""
    every = list(combinations(attrs, k))
    rng = np.random.default_rng(seed)
    return [every[i] for i in sorted(rng.choice(len(every), min(count, len(every)), replace=False))]


def model_distance(model, df: DataFrame, sets: Sequence[Sequence[str]], domain: Domain) -> dict[tuple[str, ...], float]:
    """Distance of the data's marginals from a model's, by set."""
    truth, own = M.collect_marginals(df, sets, domain), model.marginals([tuple(s) for s in sets])
    return {s: float(np.abs(t / t.sum() - own[s].to(s).values / own[s].sum()).sum() / 2) for s, t in truth.items()}


def merge_results(*results: dict) -> dict:
    """Sum of nested result dictionaries over equal keys."""
    out: dict = {}
    for r in results:
        for k, v in r.items():
            out[k] = merge_results(out.get(k, {}), v) if isinstance(v, dict) else out.get(k, 0) + v
    return out


def divide_result(result: dict, by: float) -> dict:
    return {k: divide_result(v, by) if isinstance(v, dict) else v / by for k, v in result.items()}


def marginal_experiment(df: DataFrame, domain: Domain, synthesize, budgets: Sequence[float], ways: Sequence[int] = (3, 4, 5), count: int = 300, repeats: int = 1, seed: int = 0) -> dict:
    """Mean distance of k-way marginals for each budget, over repeats; `synthesize(df, budget, seed)` gives the rows to judge."""
    results = []
    for r in range(repeats):
        one: dict = {}
        for budget in budgets:
            made = synthesize(df, budget, seed + r)
            for k in (k for k in ways if k <= len(domain)):
                one.setdefault(budget, {})[k] = k_way_tvd(df, made, random_sets(list(domain), k, count, seed + r)).agg(F.avg("tvd")).first()[0]
        results.append(one)
    return divide_result(merge_results(*results), repeats)
