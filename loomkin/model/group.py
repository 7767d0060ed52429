"""The parent/child model: each group has latent types, its members are independent given them.

The data stay in Spark: the E-step scores rows against broadcast potentials and sums them by group;
the M-step sees only tables of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkin.lineage import discard, materialize
from loomkin.model import graph as G
from loomkin.model.domain import Domain
from loomkin.model.factor import Factor, Potential, marginals_of, propagate
from loomkin.model.mrf import Settings, mirror_descent
from loomkin.model.privacy import Ledger, domain_limit, group_model_shares, group_sensitivities, latent_sizes, noisy, sigma
from loomkin.model.sampler import draw_members, explode_types, random_round
from loomkin.operators import marginals as M
from loomkin.operators.relational import dense_ids


@dataclass(frozen=True)
class GroupSettings:
    budget: float = math.inf
    #: None: as many as the noise leaves room for (latent_sizes).
    types: int | None = 4
    steps: int = 4
    cap: int = 8
    rows_changed: float = 6.0
    groups_changed: float = 0.5
    sharpness: float = 10.0
    singles_are_type0: bool = False
    seed: int = 0
    #: Rounds that add the observed marginals the model misses most, and how many each.
    marginal_rounds: int = 1
    marginals_a_round: int = 2
    candidates_queried: int = 400
    most_attrs: int = 3
    #: Rounds that add latent marginals of several attributes, and how many each.
    latent_rounds: int = 0
    latent_a_round: int = 1
    most_clique: float = 1e6
    most_cells: float = 1e7
    fit: Settings = Settings(iterations=60)


TYPE = "y"


def initial_types(child: DataFrame, fk: str, types: int, seed: int, one_hot: bool = False) -> DataFrame:
    """(fk, q): a start for each group by hash - a normalised random vector, or one certain type."""
    own = child.select(fk).distinct()
    if one_hot:
        pick = F.pmod(F.xxhash64(F.lit(seed), F.col(fk)), F.lit(types))
        return own.select(fk, F.array(*(F.when(pick == k, 1.0).otherwise(0.0) for k in range(types))).alias("q"))
    u = [(F.pmod(F.xxhash64(F.lit(seed), F.col(fk), F.lit(k)), F.lit(1_000_003)) + 1) / 1_000_004.0 for k in range(types)]
    raw = own.select(fk, F.array(*(-F.ln(x) for x in u)).alias("r"))
    total = F.aggregate("r", F.lit(0.0), lambda a, x: a + x)
    return raw.withColumn("_t", total).select(fk, F.transform("r", lambda x: x / F.col("_t")).alias("q"))


def long_types(q: DataFrame, fk: str) -> DataFrame:
    """(fk, y, p) from (fk, q array)."""
    return q.select(fk, F.posexplode("q").alias(TYPE, "p"))


def type_partition(potential: Potential, messages, domain: Domain, types: int) -> np.ndarray:
    """Log partition function with the type held at each value."""
    out = np.empty(types)
    for y in range(types):
        cut = Potential()
        for c, f in potential.items():
            mask = np.full(f.domain.shape, 0.0)
            if TYPE in f.domain:
                axis = f.domain.attrs.index(TYPE)
                block = np.full(types, -np.inf)
                block[y] = 0.0
                mask = mask + block.reshape([types if i == axis else 1 for i in range(len(f.domain))])
            cut[c] = Factor(f.domain, np.where(np.isneginf(mask), -1e300, f.values))
        out[y] = propagate(cut, messages)[1]
    return out


def expectation(child: DataFrame, fk: str, potential: Potential, messages, domain: Domain, types: int, size_prior: np.ndarray | None, cap: int, sharpness: float = 10.0, singles_are_type0: bool = False) -> DataFrame:
    """(fk, q): q proportional to exp(sharpness * (ln P(size | type) + sum over rows of ln P(row | type))).

    Rows are counted by cell first; each distinct (group, cell) is scored once, in Arrow batches, against
    broadcast potentials. The sum by group combines before its shuffle.
    """
    spark = child.sparkSession
    attrs = [a for a in domain if a != TYPE]
    log_z = type_partition(potential, messages, domain, types)
    shared = spark.sparkContext.broadcast([(c, f.domain.attrs, f.values) for c, f in potential.items()])
    cells = child.groupBy(fk, *attrs).agg(F.count("*").alias("_c"))
    kind = child.schema[fk].dataType.simpleString()

    def score(batches):
        for pdf in batches:
            total = np.tile(-log_z, (len(pdf), 1))
            for _, order, values in shared.value:
                own = [a for a in order if a != TYPE]
                if TYPE in order:
                    table = np.moveaxis(values, order.index(TYPE), -1)
                    total += table[tuple(pdf[a].to_numpy() for a in own)] if own else table
                else:
                    total += values[tuple(pdf[a].to_numpy() for a in own)][:, None]
            total *= pdf["_c"].to_numpy()[:, None]
            out = pd.DataFrame(total, columns=[f"s{k}" for k in range(types)])
            out.insert(0, "n", pdf["_c"].to_numpy())
            out.insert(0, fk, pdf[fk].to_numpy())
            yield out

    rows = cells.mapInPandas(score, f"{fk} {kind}, n long, " + ", ".join(f"s{k} double" for k in range(types)))
    sums = rows.groupBy(fk).agg(F.sum("n").alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(types)))
    raw = [F.col(f"s{k}") for k in range(types)]
    if size_prior is not None:
        logs = np.log(np.maximum(size_prior, 1e-12) / np.maximum(size_prior, 1e-12).sum(axis=1, keepdims=True))
        size = F.least("n", F.lit(size_prior.shape[1])).cast("int")
        raw = [r + F.element_at(F.array(*(F.lit(float(x)) for x in logs[k])), size) for k, r in enumerate(raw)]
    scaled = sums.select(fk, "n", F.array(*(r * sharpness for r in raw)).alias("s"))
    if singles_are_type0:
        none = F.array_min("s") - 10
        scaled = scaled.withColumn("s", F.when(F.col("n") > 1, F.transform("s", lambda x, i: F.when(i == 0, none).otherwise(x))).otherwise(F.array(F.lit(0.0), *(F.lit(-1e6) for _ in range(types - 1)))))
    return scaled.select(fk, _softmax(F.col("s")).alias("q"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it for each element of an array."""
    return F.transform(F.array(value), body)[0]


def _softmax(scores: Column) -> Column:
    """exp(x) over the sum of all, shifted by the largest."""
    shares = lambda e: _bound(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda t: F.transform(e, lambda x: x / t))
    return _bound(scores, lambda s: _bound(F.array_max(s), lambda m: _bound(F.transform(s, lambda x: F.exp(x - m)), shares)))


def prior(masses: np.ndarray, noise: float, rng: np.random.Generator, singles_are_type0: bool) -> np.ndarray:
    """Type prior from noisy masses; type 0 is ruled out where single groups have it to themselves."""
    a = np.maximum(noisy(masses, noise, rng) if noise else masses.astype(float), 0.0)
    if singles_are_type0:
        a[0] = 1e-16
    return a / a.sum() if a.sum() > 0 else np.full(len(a), 1 / len(a))


@dataclass
class GroupModel:
    domain: Domain
    fk: str
    types: int
    potential: Potential
    tree: list
    messages: list
    type_size: np.ndarray
    alpha: np.ndarray
    ledger: Ledger
    q: DataFrame
    history: list = field(default_factory=list)

    def report(self) -> dict:
        """What a run did, for save_json: structure, types, releases and the loss of each step."""
        return {"types": self.types, "alpha": self.alpha.tolist(), "type_size": self.type_size.tolist(), "cliques": sorted(self.potential), "tree": [list(e) for e in self.tree], "loss": self.history, "releases": self.ledger.entries, "spent": self.ledger.spent}

    def observed(self) -> list[str]:
        return [a for a in self.domain if a != TYPE]

    def synthesize(self, spark: SparkSession, groups: int | None = None, types: np.ndarray | None = None, seed: int = 0, rows: int | None = None, head: tuple[str, int] | None = None) -> DataFrame:
        """(gid, member, y, attributes...) for a number of groups, or for a histogram of types.

        rows: sizes are moved until the groups have so many members, or one each if that is more.
        head: an attribute and a code that member 0 of each group has and no other; both kinds of members are
        drawn from the model under that condition.
        """
        rng = np.random.default_rng(seed)
        sizes = np.maximum(self.type_size, 0.0)
        if types is not None:
            table = np.stack([random_round(sizes[k] if sizes[k].sum() else sizes.sum(axis=0), int(types[k]), rng) for k in range(self.types)])
        else:
            table = random_round(sizes, int(groups if groups is not None else round(sizes.sum())), rng)
        if rows is not None and table.sum():
            table = fill_rows(table, max(rows, int(table.sum())), rng)
        frame = explode_types(spark, table, [TYPE])
        draw = lambda potential, which, shift: draw_members(frame, propagate(potential, self.messages, 1.0)[0], self.tree, [TYPE], self.observed(), seed + shift, which)
        if head is None:
            return draw(self.potential, None, 0)
        attr, code = head
        is_head = np.arange(self.domain[attr].size) == code
        return draw(allowing(self.potential, attr, is_head), "first", 0).unionByName(draw(allowing(self.potential, attr, ~is_head), "rest", 7919))


def allowing(potential: Potential, attr: str, codes: np.ndarray) -> Potential:
    """The potential given that attr has one of the codes (a mask): one clique with attr rules the others out."""
    out, clique = Potential(potential), next(c for c in potential if attr in c)
    f = potential[clique]
    shape = [-1 if a == attr else 1 for a in f.domain.attrs]
    out[clique] = Factor(f.domain, f.values + np.where(codes, 0.0, -1e6).reshape(shape))
    return out


def normalize_by_group_size(type_size: np.ndarray, group_size: np.ndarray) -> np.ndarray:
    """Each size's column rescaled to the released number of groups of that size."""
    out = np.maximum(np.asarray(type_size, float), 0.0)
    sums = out.sum(axis=tuple(range(out.ndim - 1)))
    return out * np.divide(np.maximum(group_size, 0), sums, out=np.zeros(len(sums)), where=sums > 0)


def clean_type_size(type_size: np.ndarray) -> np.ndarray:
    """Type 0 holds all groups of one and nothing else; other types' groups of one go evenly to their larger sizes."""
    out = np.asarray(type_size, float).copy()
    flat = out.reshape(-1, out.shape[-1])
    flat[0] = [flat[0].sum(), *[0.0] * (out.shape[-1] - 1)]
    flat[1:, 1:] += flat[1:, :1] / (out.shape[-1] - 1)
    flat[1:, 0] = 0.0
    return out


def is_clean(type_size: np.ndarray) -> bool:
    flat = np.asarray(type_size).reshape(-1, type_size.shape[-1])
    return not flat[0, 1:].any() and not flat[1:, 0].any()


def rows_of(type_size: np.ndarray) -> float:
    """Rows that a table [types..., size - 1] of groups stands for."""
    return float((type_size.reshape(-1, type_size.shape[-1]).sum(axis=0) * (np.arange(type_size.shape[-1]) + 1)).sum())


def match_rows(type_size: np.ndarray, rows: int, rng: np.random.Generator, singles_fixed: bool = True) -> np.ndarray:
    """Whole counts moved by one size at a time until they stand for `rows` rows; groups keep type and number."""
    out = np.asarray(type_size).astype(np.int64).copy()
    flat = out.reshape(-1, out.shape[-1])
    low, last = (1 if singles_fixed else 0), out.shape[-1] - 1
    while (gap := int(rows - rows_of(out))) != 0:
        up = gap > 0
        movable = flat[:, low:last] if up else flat[:, low + 1 : last + 1]
        if not movable.sum():
            raise ValueError("no group can change size any more")
        take = min(abs(gap), int(movable.sum()))
        moved = rng.multivariate_hypergeometric(movable.ravel(), take).reshape(movable.shape)
        if up:
            flat[:, low:last] -= moved
            flat[:, low + 1 : last + 1] += moved
        else:
            flat[:, low + 1 : last + 1] -= moved
            flat[:, low:last] += moved
    return out


def fill_rows(type_size: np.ndarray, rows: int, rng: np.random.Generator) -> np.ndarray:
    """match_rows without a largest size: what the sizes can't hold is first dealt evenly over all groups."""
    more = max(0, int(rows - rows_of(type_size)) // int(type_size.sum()))
    wide = np.pad(np.asarray(type_size), [*[(0, 0)] * (type_size.ndim - 1), (more, 1)])
    return match_rows(wide, rows, rng, singles_fixed=False)


def round_by_types(type_size: np.ndarray, types: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Each type's sizes rounded to its number of groups."""
    return np.stack([random_round(t, int(n), rng) for t, n in zip(type_size.reshape(-1, type_size.shape[-1]), np.ravel(types), strict=True)]).reshape(type_size.shape)


def types_for(settings: GroupSettings, domain: Domain, rows: float, groups: float, sens: dict[str, float], shares: dict[str, float]) -> int:
    """How many types the latent tables' noise leaves room for, as one variable: the product of latent_sizes."""
    if math.isinf(settings.budget):
        return math.prod(latent_sizes(math.inf, max((x.size for x in domain.values()), default=1), groups, 0.0, settings.cap))
    of = lambda what, releases: sigma(sens[what], shares[what] * settings.budget, releases)
    every = settings.steps * (1 + settings.latent_rounds)
    limit = domain_limit(rows, of("latent_marginals", every * max(1, len(domain))), 6.0)
    return math.prod(latent_sizes(limit, max((x.size for x in domain.values()), default=1), groups, of("type_sizes", 1), settings.cap))


def fit_groups(child: DataFrame, fk: str, domain: Domain, settings: GroupSettings = GroupSettings()) -> GroupModel:
    """Expectation-maximisation of the latent type with noisy tables.

    First the observed marginals, some of them chosen in rounds; then steps of noisy latent tables, prior,
    fit and E-step; with latent_rounds, more steps after each choice of further latent marginals. Each
    step's q is written once, so a lost executor costs one step.
    """
    rng = np.random.default_rng(settings.seed)
    infinite = math.isinf(settings.budget)
    ledger, shares = Ledger(settings.budget), group_model_shares()
    sens = group_sensitivities(settings.rows_changed, settings.groups_changed, settings.cap)
    own = child.select(fk, *domain).persist()
    steps = settings.steps
    rows = float(own.count())
    if not infinite:
        # the number of rows steers the fit, so it is a release too: a hundredth of the graph's share
        s = sigma(settings.rows_changed, shares["graph"] * 0.01 * settings.budget)
        ledger.charge("rows", settings.rows_changed, s)
        shares = {**shares, "graph": shares["graph"] * 0.99}
        rows = max(1.0, rows + rng.normal(scale=s))

    def noise(what: str, releases: int) -> float:
        if infinite:
            return 0.0
        s = sigma(sens[what], shares[what] * settings.budget, releases)
        ledger.charge(what, sens[what], s, releases)
        return s

    # the sizes of groups are released first, since the number of types may depend on them
    group_noise = noise("group_sizes", 1)
    counts = np.zeros(settings.cap)
    for r in M.group_sizes(own, fk, settings.cap).collect():
        counts[r["size"] - 1] = r["n"]
    counts = noisy(counts, group_noise, rng) if group_noise else counts
    if settings.types is None:
        settings = replace(settings, types=types_for(settings, domain, rows, float(np.maximum(counts, 0).sum()), sens, shares))
    full = domain.with_attribute(TYPE, settings.types, latent=True)
    pairs = domain.pairs()
    pair_noise = noise("graph", max(1, len(pairs)))
    scores = {G.edge(r["a"], r["b"]): r["r_score"] + (rng.normal(scale=pair_noise) if pair_noise else 0.0) for r in M.r_scores(own, pairs).collect()} if pairs else {}
    graph = G.grow_by_score(full, scores, settings.most_clique, settings.most_cells)
    cliques = G.maximal_cliques(graph)
    tree = G.junction_tree(cliques)
    messages = G.message_order(cliques, tree)
    observed = [m for m in G.marginals_by_feature(graph, full, {e: s / rows for e, s in scores.items()}, settings.most_attrs, 1e5) if m]
    rounds = settings.marginal_rounds
    fixed_noise = noise("marginals", max(1, len(observed) + rounds * settings.marginals_a_round))

    def release(sets) -> Potential:
        return Potential({s: Factor(domain.project(s), noisy(t, fixed_noise, rng) if fixed_noise else t) for s, t in M.collect_marginals(own, sets, domain).items()})

    # observed marginals: the first ones, then in rounds those that the model misses most
    measured = release(observed)
    potential = Potential.zeros(full, cliques)
    options = [m for m, _ in G.candidates([tuple(a for a in c if a != TYPE) for c in cliques], domain, settings.most_attrs, 1e5, measured)]
    gap_noise = noise("selection", rounds * min(len(options), settings.candidates_queried)) if rounds and options else 0.0
    for _ in range(rounds if options else 0):
        potential, _ = mirror_descent(potential, measured, messages, rows, settings.fit, 0.0)
        pick = rng.choice(len(options), min(settings.candidates_queried, len(options)), replace=False)
        asked = sorted(options[i] for i in pick)
        truth, now = M.collect_marginals(own, asked, domain), marginals_of(propagate(potential, messages, rows)[0], asked)
        gaps = {s: float(np.abs(truth[s] - now[s].values).sum() / 2 + (rng.normal(scale=gap_noise) if gap_noise else 0.0)) for s in asked}
        best = sorted(asked, key=lambda s: (-gaps[s], s))[: settings.marginals_a_round]
        measured |= release(best)
        options = [m for m in options if m not in measured]
        if not options:
            break
    latent = [tuple(sorted((a, TYPE))) for a in domain]
    latent_noise = noise("latent_marginals", (settings.steps * (1 + settings.latent_rounds)) * max(1, len(latent) + settings.latent_rounds * settings.latent_a_round))
    every = settings.steps * (1 + settings.latent_rounds)
    type_noise, size_noise, prior_noise = noise("types", every), noise("sizes_in_training", every), noise("prior", every)
    q = initial_types(own, fk, settings.types, settings.seed)
    alpha, size_table, history, written = np.full(settings.types, 1 / settings.types), None, [], None
    score_noise = 0.0

    def sized(q: DataFrame, sigma_: float) -> np.ndarray:
        table = np.zeros((settings.types, settings.cap))
        for r in M.type_sizes(own, fk, long_types(q, fk), [TYPE], settings.cap).collect():
            table[r[TYPE], r["size"] - 1] = r["n"]
        return noisy(table, sigma_, rng) if sigma_ else table

    for step in range(every):
        if step and step % steps == 0:  # another round of latent structure: sets of attributes that the types should explain
            so_far = GroupModel(full, fk, settings.types, potential, tree, messages, size_table, alpha, ledger, q, history)
            sets = [m for m in {tuple(sorted(x for x in c if x != TYPE)) for c in cliques} if len(m) > 1]
            pairs_of = sorted({p for m in sets for p in G.n_way(m, 2) if tuple(sorted((*p, TYPE))) not in latent})
            if pairs_of:
                if not score_noise:
                    score_noise = noise("latent_selection", settings.latent_rounds * len(pairs_of))
                latent += [tuple(sorted((*p, TYPE))) for p in select_latent(so_far, own, pairs_of, size_table.sum(axis=0), settings.latent_a_round, score_noise, settings.seed + step)]
        q = materialize(q, "types")
        if written is not None:
            discard(written)
        written = q
        wide = long_types(q, fk)
        tables = Potential(measured)
        for s in latent:
            seen = [x for x in s if x != TYPE]
            t = np.zeros((*(domain[x].size for x in seen), settings.types))
            for r in M.latent_marginal(own, fk, wide, [*seen, TYPE], [TYPE]).collect():
                t[(*(r[x] for x in seen), r[TYPE])] = r["n"]
            t = noisy(t, latent_noise, rng) if latent_noise else t
            tables[s] = Factor(full.project([*seen, TYPE]), t).to(s)
        masses = np.array([float(x) for x in wide.groupBy(TYPE).agg(F.sum("p").alias("p")).orderBy(TYPE).toPandas()["p"]])
        alpha = prior(masses, prior_noise, rng, settings.singles_are_type0)
        y_mass = sum(tables[s].project([TYPE]).values for s in latent) / len(latent)
        tables[(TYPE,)] = Factor(full.project([TYPE]), noisy(y_mass, type_noise, rng) if type_noise else y_mass)
        potential, loss = mirror_descent(potential, tables, messages, rows, settings.fit, 0.0)
        size_table = np.maximum(sized(q, size_noise), 0.0)
        new = expectation(own, fk, potential, messages, full, settings.types, size_table + 1e-6, settings.cap, settings.sharpness, settings.singles_are_type0)
        history.append(loss)
        q = new
    q = materialize(q, "types")
    if written is not None:
        discard(written)
    final = sized(q, noise("type_sizes", 1))
    own.unpersist()
    return GroupModel(full, fk, settings.types, potential, tree, messages, normalize_by_group_size(final, counts), alpha, ledger, q, history)


def fit_mixture(df: DataFrame, domain: Domain, settings: GroupSettings = GroupSettings()) -> GroupModel:
    """A mixture over single records: each is a group of its own, and its type the component it comes from.

    synthesize() of the result makes a record (of gid) for each group asked for.
    """
    own = dense_ids(df.select(*domain), "record", list(domain))
    return fit_groups(own, "record", domain, replace(settings, cap=1, rows_changed=1.0, singles_are_type0=False))


def multiset_likelihood(model: GroupModel, attrs: Sequence[str], observed: DataFrame, sizes: np.ndarray) -> float:
    """How many groups the model lacks: sum over observed multisets of the attributes of max(seen - expected, 0).

    observed: (members, n) of group_multisets. sizes: groups by size - 1. Multisets are scored in Arrow
    batches on the executors; larger groups than `sizes` has are left out.
    """
    clique = tuple(sorted((*attrs, TYPE)))
    table = marginals_of(propagate(model.potential, model.messages, 1.0)[0], [clique])[clique].to((*attrs, TYPE)).values
    given = np.log(np.maximum(table / np.maximum(table.sum(axis=tuple(range(len(attrs))), keepdims=True), 1e-300), 1e-300))
    log_alpha, names = np.log(np.maximum(model.alpha, 1e-300)), list(attrs)

    def lacking(batches):
        for pdf in batches:
            total = 0.0
            for members, n in zip(pdf["members"], pdf["n"], strict=True):
                times = [m["times"] for m in members]
                size = sum(times)
                if size <= len(sizes):
                    ways = math.lgamma(size + 1) - sum(math.lgamma(t + 1) for t in times)
                    logs = log_alpha + sum(t * given[tuple(m[a] for a in names)] for m, t in zip(members, times, strict=True))
                    total += max(n - sizes[size - 1] * float(np.exp(logs + ways).sum()), 0.0)
            yield pd.DataFrame({"lacking": [total]})

    return float(observed.mapInPandas(lacking, "lacking double").agg(F.sum("lacking")).first()[0] or 0.0)


def select_latent(model: GroupModel, child: DataFrame, sets: Sequence[Sequence[str]], sizes: np.ndarray, count: int, noise: float = 0.0, seed: int = 0) -> list[tuple[str, ...]]:
    """The attribute sets whose groups the model explains worst."""
    rng = np.random.default_rng(seed)
    scores = {tuple(a): multiset_likelihood(model, a, M.group_multisets(child, model.fk, a), sizes) + (rng.normal(scale=noise) if noise else 0.0) for a in sets}
    return sorted(scores, key=lambda a: (-scores[a], a))[:count]


def all_types(shape: Sequence[int]) -> list[tuple[int, ...]]:
    return list(product(*(range(s) for s in shape)))
