"""A single-table model: noisy marginals, a junction tree fitted to them, candidates added round by round, and sampling."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkin.functions.hierarchy import Node, bins_at, deepest_fitting, from_level, impossible_cells, level_table, to_level
from loomkin.model import graph as G
from loomkin.model.domain import Attribute, Domain
from loomkin.model.factor import Factor, Potential, l2_loss, marginals_of, propagate
from loomkin.model.privacy import Ledger, domain_limit, noisy, sigma, single_table_shares, total_noise_loss
from loomkin.model.sampler import draw_from_tree
from loomkin.operators import marginals as M


@dataclass(frozen=True)
class Settings:
    budget: float = math.inf
    sensitivity: float = 1.0
    seed: int = 0
    theta_pair: float = 3.0
    theta_many: float = 6.0
    most_attrs: int = 6
    most_clique: float = 1e6
    most_cells: float = 1e7
    rounds: int | None = None
    candidates_queried: int = 400
    #: Whether candidates are drawn with replacement (then some are drawn twice, and fewer are queried).
    replacement: bool = False
    iterations: int = 300
    stop_ratio: float = 1.3
    check_every: int = 20
    method: str = "mirror"


def mirror_descent(potential: Potential, measured: Potential, messages, total: float, settings: Settings, noise_loss: float) -> tuple[Potential, float]:
    """Steps on the potentials against the marginals' gradient, halved until they help enough; returns the last loss."""
    wanted = list(measured)
    mu = marginals_of(propagate(potential, messages, total)[0], wanted)
    loss, gradient = l2_loss(mu, measured)
    step = 2.0 / total**2
    for it in range(settings.iterations):
        if it % settings.check_every == 0 and it and loss <= max(settings.stop_ratio * noise_loss, 1e-9 * total):
            break
        for _ in range(25):
            trial = potential - expanded(gradient, potential) * step
            new_mu = marginals_of(propagate(trial, messages, total)[0], wanted)
            new_loss, new_gradient = l2_loss(new_mu, measured)
            if loss - new_loss >= 0.5 * step * gradient.dot(mu - new_mu):
                break
            step *= 0.5
        if new_loss >= loss:
            break
        potential, mu, loss, gradient = trial, new_mu, new_loss, new_gradient
        step *= 2.0
    return potential, loss


def dual_averaging(potential: Potential, measured: Potential, messages, total: float, settings: Settings, noise_loss: float) -> tuple[Potential, float]:
    """Nesterov's averaged dual steps with the marginal map's Lipschitz constant."""
    wanted, first = list(measured), potential
    smooth = total * max(1, len(wanted))
    mean = Potential({c: Factor.zeros(f.domain) for c, f in potential.items()})
    nu = marginals_of(propagate(potential, messages, total)[0], wanted)
    mu, loss = nu, math.inf
    for t in range(1, settings.iterations + 1):
        c = 2.0 / (t + 1)
        omega = nu * (1 - c) + mu * c
        _, gradient = l2_loss(omega, measured)
        mean = mean * (1 - c) + expanded(gradient, mean) * c
        potential = first - mean * (t * (t + 1) / (4.0 * smooth))
        mu = marginals_of(propagate(potential, messages, total)[0], wanted)
        nu = nu * (1 - c) + mu * c
        loss, _ = l2_loss(nu, measured)
        if t % settings.check_every == 0 and loss <= max(settings.stop_ratio * noise_loss, 1e-9 * total):
            break
    return potential, loss


def accelerated(potential: Potential, measured: Potential, messages, total: float, settings: Settings, noise_loss: float) -> tuple[Potential, float]:
    """Mirror descent with momentum on the potentials, restarted whenever the loss rises."""
    wanted, last, momentum = list(measured), potential, 0
    step, best = 1.0 / total**2, math.inf
    for it in range(settings.iterations):
        ahead = potential + (potential - last) * (momentum / (momentum + 3))
        mu = marginals_of(propagate(ahead, messages, total)[0], wanted)
        loss, gradient = l2_loss(mu, measured)
        if loss > best and momentum:
            momentum, step, last, best = 0, step / 2, potential, math.inf
            continue
        if it % settings.check_every == 0 and loss <= max(settings.stop_ratio * noise_loss, 1e-9 * total):
            break
        last, potential, best, momentum = potential, ahead - expanded(gradient, potential) * step, loss, momentum + 1
        step *= 1.2
    return potential, best


METHODS = {"mirror": mirror_descent, "dual": dual_averaging, "accelerated": accelerated}


def expanded(gradient: Potential, cliques: Potential) -> Potential:
    """The measured marginals' gradients added into the cliques that hold them."""
    out = Potential({c: Factor.zeros(f.domain) for c, f in cliques.items()})
    for m, g in gradient.items():
        c = min((c for c in cliques if set(m) <= set(c)), key=lambda c: cliques[c].values.size)
        out[c] = (out[c] + g).to(out[c].domain.attrs)
    return out


@dataclass
class MarkovModel:
    """Fitted model of one table."""

    domain: Domain
    total: float
    potential: Potential
    tree: list
    messages: list
    measured: Potential
    noise: float
    ledger: Ledger
    loss: float = math.inf
    log: list = field(default_factory=list)

    def report(self) -> dict:
        """What a run did, for save_json: structure, measured marginals, releases and loss."""
        return {"rows": self.total, "cliques": sorted(self.potential), "tree": [list(e) for e in self.tree], "measured": sorted(self.measured), "noise": self.noise, "loss": self.loss, "releases": self.ledger.entries, "spent": self.ledger.spent}

    def beliefs(self) -> Potential:
        return propagate(self.potential, self.messages, self.total)[0]

    def marginals(self, wanted) -> Potential:
        return marginals_of(self.beliefs(), wanted)

    def entropy(self) -> float:
        """Of the model, in nats: log Z less the mean potential."""
        belief, z = propagate(self.potential, self.messages, 1.0)
        return z - sum((self.potential[c] * belief[c]).sum() for c in belief)

    def log_probability(self, record: dict[str, int]) -> float:
        return sum(f.at(record).sum() for f in self.potential.values()) - propagate(self.potential, self.messages)[1]

    def synthesize(self, spark, rows: int | None = None, seed: int = 0, fixed: DataFrame | None = None, key: str = "id") -> DataFrame:
        """Rows (key, attributes). With `fixed`, its rows and columns stay and only the other attributes are drawn."""
        beliefs = self.beliefs()
        if fixed is None:
            n = int(round(self.total)) if rows is None else rows
            return draw_from_tree(spark.range(n).withColumnRenamed("id", key), beliefs, self.tree, key, seed).select(key, *self.domain)
        held = [a for a in self.domain if a in fixed.columns]
        return draw_from_tree(fixed, beliefs, self.tree, key, seed, fixed=held)


def drawn_candidates(options: Sequence[tuple[tuple[str, ...], float]], count: int, replacement: bool, rng: np.random.Generator) -> list[tuple[str, ...]]:
    """Up to count different attribute sets, drawn by weight."""
    weights = np.array([w for _, w in options])
    n = count if replacement else min(count, len(options))
    return sorted({options[i][0] for i in rng.choice(len(options), n, p=weights / weights.sum(), replace=replacement)})


def decayed(options: Sequence[tuple[tuple[str, ...], float]], gaps: Mapping[tuple[str, ...], float]) -> list[tuple[tuple[str, ...], float]]:
    """The options, with half the weight for those of the lower half of the gaps asked for."""
    ranked = sorted(gaps, key=lambda s: (-gaps[s], s))
    low = set(ranked[len(ranked) // 2 :])
    return [(s, w / 2 if s in low else w) for s, w in options]


@dataclass
class LeveledModel:
    """A model of codes split into (bin, place in the bin) at a level of their hierarchies."""

    model: MarkovModel
    tables: dict[str, DataFrame]
    attrs: list[str]

    def synthesize(self, spark, rows: int | None = None, seed: int = 0, key: str = "id") -> DataFrame:
        """Rows (key, attributes) in the codes of the data; pairs of a bin and a place that no code has are never drawn."""
        out = self.model.synthesize(spark, rows, seed, key=key)
        for a, t in self.tables.items():
            out = from_level(out, a, t)
        return out.select(key, *self.attrs)


def fit_in_levels(df: DataFrame, domain: Domain, trees: Mapping[str, Node], settings: Settings = Settings(), levels: Mapping[str, int] | None = None, most_cells: float = 1e4) -> LeveledModel:
    """fit() with wide attributes as (bin, place): their hierarchies' levels are given, or the deepest that keep the bins' cells under most_cells.

    A bin and a place that no code has together are structural zeros: impossible in the potential, whatever the noise.
    """
    levels = dict(levels) if levels is not None else deepest_fitting(dict(trees), list(trees), most_cells)
    spark, coded, sizes, zeros = df.sparkSession, df.select(*domain), {}, {}
    tables: dict[str, DataFrame] = {}
    for a in domain:
        bins = bins_at(trees[a], levels[a]) if a in trees else []
        most = max((len(b.leaves()) for b in bins), default=1)
        if len(bins) < 2 or most < 2:  # a level of one bin or of single codes splits nothing
            sizes[a] = domain[a]
            continue
        tables[a] = level_table(spark, trees[a], levels[a])
        coded = to_level(coded, a, tables[a])
        sizes |= {a: Attribute(len(bins)), f"{a}_inner": Attribute(most)}
        zeros[a] = impossible_cells(trees[a], levels[a])
    split = Domain(sizes)
    model = fit(coded, split, settings, require=[(a, f"{a}_inner") for a in tables])
    for a, cells in zeros.items():
        clique = next(c for c in model.potential if a in c and f"{a}_inner" in c)
        f = model.potential[clique]
        mask = Factor(split.project([a, f"{a}_inner"]), np.zeros((split[a].size, split[f"{a}_inner"].size)))
        for b, i in cells:
            mask.values[b, i] = -1e6
        model.potential[clique] = f + mask
    return LeveledModel(model, tables, list(domain))


def fit(df: DataFrame, domain: Domain, settings: Settings = Settings(), require: Sequence[Sequence[str]] = (), preset: dict | None = None) -> MarkovModel:
    """Noisy pair scores, a graph, noisy marginals, then rounds that add the marginals the model misses most.

    The table is scanned once for the pair scores, once for the first marginals and once a round; only
    tables of bounded size reach the driver. `require` names attribute sets that must share a clique;
    `preset` gives marginals released under another budget.
    """
    rng = np.random.default_rng(settings.seed)
    ledger, shares, infinite = Ledger(settings.budget), single_table_shares(), math.isinf(settings.budget)
    held = df.select(*domain).persist()
    own = lambda s, m=1: 0.0 if infinite else sigma(settings.sensitivity, shares[s] * settings.budget, m)
    n = held.count()
    count_noise = 0.0 if infinite else sigma(1, shares["graph"] * 0.01 * settings.budget)
    if not infinite:
        ledger.charge("rows", 1, count_noise)
    total = max(1.0, n + rng.normal(scale=count_noise) if count_noise else float(n))
    pairs = domain.pairs()
    pair_noise = 0.0 if infinite else sigma(2 * settings.sensitivity, shares["graph"] * 0.99 * settings.budget, max(1, len(pairs)))
    if pairs and not infinite:
        ledger.charge("pair scores", 2 * settings.sensitivity, pair_noise, len(pairs))
    tvd = {G.edge(r["a"], r["b"]): (r["r_score"] + rng.normal(scale=pair_noise)) / total for r in M.r_scores(held, pairs).collect()} if pairs else {}
    start = G.Graph(domain)
    for s in require:
        for a, b in combinations(s, 2):
            start.add(a, b)
    graph = G.search_edges(domain, G.pairwise_score(domain, tvd, settings.most_clique, settings.most_cells), start)
    rounds = min(len(domain) // 2, 8) if settings.rounds is None else settings.rounds
    extra = int(0.8 * len(domain))
    guess = own("marginals", len(domain) + extra) or 0.0
    limits = domain_limit(total, guess, settings.theta_pair), domain_limit(total, guess, settings.theta_many)
    first = G.initial_measures(graph, domain, tvd, settings.most_attrs, *(min(x, settings.most_clique) for x in limits))
    noise = own("marginals", len(first) + extra)
    cliques = G.maximal_cliques(graph)
    tree = G.junction_tree(cliques)
    messages = G.message_order(cliques, tree)
    measured = Potential()

    def release(sets) -> None:
        sets = [s for s in sets if s not in measured]
        for s, table in M.collect_marginals(held, [s for s in sets if not (preset and s in preset)], domain).items():
            if not infinite:
                ledger.charge(f"marginal {s}", settings.sensitivity, noise)
            measured[s] = Factor(domain.project(s), noisy(table, noise, rng) if noise else table)
        for s in sets:
            if preset and s in preset:
                measured[s] = Factor(domain.project(s), np.asarray(preset[s], float))

    release(first)
    potential, solve = Potential.zeros(domain, cliques), METHODS[settings.method]
    refit = lambda p: solve(p, measured, messages, total, settings, total_noise_loss((f.values.size for f in measured.values()), noise))
    potential, loss = refit(potential)
    options = G.candidates(cliques, domain, settings.most_attrs, min(limits[1], settings.most_clique), measured)
    added = 0
    for k in range(rounds):
        if not options or added >= extra:
            break
        asked = drawn_candidates(options, settings.candidates_queried, settings.replacement, rng)
        gap_noise = 0.0 if infinite else sigma(settings.sensitivity, shares["selection"] * settings.budget / rounds, len(asked))
        if not infinite:
            ledger.charge(f"distances, round {k}", settings.sensitivity, gap_noise, len(asked))
        truth = M.collect_marginals(held, asked, domain)
        model = marginals_of(propagate(potential, messages, total)[0], asked)
        gaps = {s: float(np.abs(truth[s] - model[s].values).sum() / 2 + (rng.normal(scale=gap_noise) if gap_noise else 0.0)) for s in asked}
        take = max(1, -(-extra // max(rounds, 1)))
        best = sorted(asked, key=lambda s: (-gaps[s], s))[: min(take, extra - added)]
        release(best)
        added += len(best)
        options = [(s, w) for s, w in decayed(options, gaps) if s not in measured]
        potential, loss = refit(potential)
    held.unpersist()
    return MarkovModel(domain, total, potential, tree, messages, measured, noise, ledger, loss)
