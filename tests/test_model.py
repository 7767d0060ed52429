"""Domains, factors, propagation, graphs, rounding, budget and tree utilities on small cases."""

import itertools
import math

import numpy as np
import pytest

from loomkin.functions import hierarchy as H
from loomkin.model import graph as G
from loomkin.model import group, privacy, sampler
from loomkin.model.domain import Attribute, Domain
from loomkin.model.factor import Factor, Potential, l2_loss, marginals_of, propagate

#: Epsilon and the budget at delta 1e-5.
BUDGETS = {
    0.050: 0.0002996297553181648, 0.060: 0.0004171067848801613, 0.070: 0.0005520181730389595, 0.080: 0.0007039634510874748, 0.090: 0.0008725887164473534,
    0.095: 0.0009630667045712471, 0.098: 0.0010192999616265297, 0.100: 0.0010576052591204643, 0.120: 0.0014757690951228142, 0.140: 0.0019566575065255165,
    0.160: 0.002498799003660679, 0.180: 0.003100908361375332, 0.200: 0.003761877305805683, 0.240: 0.005256538279354572, 0.280: 0.006975927390158176,
    0.320: 0.008914261125028133, 0.360: 0.011066538281738758, 0.400: 0.013428307138383389, 0.480: 0.01876466441899538, 0.560: 0.02489518839865923,
    0.640: 0.031795711256563663, 0.720: 0.039444915018975735, 0.800: 0.047823661006987095, 0.960: 0.0667015416547656, 1.120: 0.08830544073134661,
    1.280: 0.11252749245613813, 1.440: 0.13927177991718054, 1.600: 0.16845174599438906, 1.920: 0.23380873259156942, 2.240: 0.3080356167629361,
    2.560: 0.39064376149326563, 2.880: 0.48120140563696623, 3.040: 0.5293390108272433, 3.200: 0.5793221713975072,
}


@pytest.mark.parametrize("epsilon", sorted(BUDGETS))
def test_budget(epsilon):
    assert abs(privacy.total_budget(epsilon, 1e-5) - BUDGETS[epsilon]) < 1e-8


def test_ledger_refuses_overspending():
    book = privacy.Ledger(1.0)
    book.charge("a", 1.0, math.sqrt(2), 1)
    book.charge("b", 1.0, 2.0, 2)
    assert abs(book.spent - 1.0) < 1e-12
    with pytest.raises(privacy.Overspent):
        book.charge("c", 1.0, 10.0)


def test_shares_sum_to_one():
    assert abs(sum(privacy.group_model_shares().values()) - 1) < 1e-12
    assert abs(sum(privacy.single_table_shares().values()) - 1) < 1e-12


def test_noise_scale_spends_its_share():
    s = privacy.sigma(2.0, 0.3, 5)
    assert abs(5 * 4 / s**2 - 0.3) < 1e-12


def test_exponential_choice_prefers_high_scores():
    rng = np.random.default_rng(0)
    picks = [privacy.exponential_choice([0, 10], 4, 1, rng) for _ in range(200)]
    assert sum(picks) > 190


def test_domain_algebra():
    d = Domain({"a": 2, "b": 3, "c": Attribute(4, latent=True)})
    assert d.cells() == 24 and d.project(["b"]).shape == (3,) and (d - ["a"]).attrs == ("b", "c")
    assert (d.project(["a"]) + d).attrs == ("a", "b", "c") and d.axes(["c", "a"]) == (2, 0)
    assert d.latent() == ("c",) and d.observed() == ("a", "b") and len(d.pairs()) == 3
    assert Domain.from_json(d.to_json()) == d


def chain():
    d = Domain({"a": 2, "b": 3, "c": 2, "d": 4})
    rng = np.random.default_rng(1)
    return d, Potential({c: Factor(d.project(c), rng.normal(size=d.project(c).shape)) for c in (("a", "b"), ("b", "c"), ("c", "d"))})


def test_propagation_equals_enumeration():
    d, p = chain()
    cliques = sorted(p)
    messages = G.message_order(cliques, G.junction_tree(cliques))
    beliefs, log_z = propagate(p, messages, total=100.0)
    joint = np.zeros(d.shape)
    for cell in itertools.product(*map(range, d.shape)):
        at = dict(zip(d, cell, strict=True))
        joint[cell] = math.exp(sum(f.at({a: at[a] for a in c}).sum() for c, f in p.items()))
    whole = Factor(d, 100 * joint / joint.sum())
    assert abs(log_z - math.log(joint.sum())) < 1e-9
    for c in cliques:
        assert np.allclose(beliefs[c].values, whole.project(c).values)
    assert np.allclose(marginals_of(beliefs, [("c",)])[("c",)].values, whole.project(["c"]).values)


def test_forest_of_independent_cliques():
    d = Domain({"a": 2, "b": 3})
    p = Potential({("a",): Factor(d.project(["a"]), [0.0, 1.0]), ("b",): Factor(d.project(["b"]), [0.0, 2.0, 1.0])})
    beliefs, log_z = propagate(p, [], total=10.0)
    assert all(abs(f.sum() - 10) < 1e-9 for f in beliefs.values())
    assert abs(log_z - (math.log(1 + math.e) + math.log(1 + math.e**2 + math.e))) < 1e-9


def test_factor_operations():
    d = Domain({"a": 2, "b": 2})
    f, g = Factor(d, [[1, 2], [3, 4]]), Factor(d.project(["b"]), [10, 0])
    assert (f * g).values.tolist() == [[10, 0], [30, 0]] and (f / g).values[0, 1] == 0
    assert f.scaled(Factor(d.project(["a"]), [6, 14])).values.tolist() == [[2, 4], [6, 8]]
    assert abs(Factor(d, np.full((2, 2), 1000.0)).logsumexp() - (1000 + math.log(4))) < 1e-9
    assert f.project(["b"]).values.tolist() == [4, 6] and f.at({"a": 1}).values.tolist() == [3, 4]
    loss, gradient = l2_loss(Potential({("a", "b"): f}), Potential({("a", "b"): f * 2.0}))
    assert loss == 15 and gradient[("a", "b")].values[1, 1] == -4


def cycle(n):
    names = [f"x{i}" for i in range(n)]
    return G.Graph(names, [(names[i], names[(i + 1) % n]) for i in range(n)])


def test_triangulation_is_chordal():
    for n in range(3, 9):
        full = G.triangulate(cycle(n))
        assert G.is_chordal(full) and set(cycle(n).edges()) <= set(full.edges())
    assert not G.is_chordal(cycle(5))


def test_cliques_and_tree():
    g = G.Graph("abcde", [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")])
    cliques = G.maximal_cliques(g)
    assert cliques == [("a", "b", "c"), ("c", "d"), ("e",)]
    tree = G.junction_tree(cliques)
    assert tree == [(("a", "b", "c"), ("c", "d"))]
    order = G.message_order(cliques, tree)
    assert len(order) == 2 and order[0] == order[1][::-1]
    assert [c for _, c in G.depth_first(tree, cliques, ("c", "d"))] == [("c", "d"), ("a", "b", "c"), ("e",)]


def test_growth_respects_the_limits():
    d = Domain({"a": 10, "b": 10, "c": 10})
    scores = {("a", "b"): 3.0, ("b", "c"): 2.0, ("a", "c"): 1.0}
    assert G.maximal_cliques(G.grow_by_score(d, scores, 1e6, 1e6)) == [("a", "b", "c")]
    assert G.maximal_cliques(G.grow_by_score(d, scores, 100, 1e6)) == [("a", "b"), ("b", "c")]
    assert G.maximal_cliques(G.search_edges(d, G.pairwise_score(d, scores, 100, 1e6))) == [("a", "b"), ("b", "c")]


def test_latent_attributes_are_tied_to_all():
    d = Domain({"a": 2, "b": 2, "y": Attribute(3, latent=True)})
    g = G.grow_by_score(d, {("a", "b"): -1.0})
    assert g.has("a", "y") and g.has("b", "y")


def test_measures():
    d = Domain({"a": 2, "b": 2, "c": 2})
    tvd = {("a", "b"): 0.4, ("a", "c"): 0.1, ("b", "c"): 0.05}
    full = G.triangulate(G.Graph(d, list(tvd)))
    measures = G.initial_measures(full, d, tvd, 3, 100, 100)
    assert {a for m in measures for a in m} == {"a", "b", "c"}
    assert G.without_contained([("a",), ("b", "a"), ("c",)]) == [("a", "b"), ("c",)]
    assert G.with_latent(("b",), ["y"]) == [("b", "y")] and len(G.n_way("abcd", 2)) == 6
    assert all(set(m) <= {"a", "b", "c"} for m, _ in G.candidates([("a", "b", "c")], d, 3, 100, [("a", "b")]))


def test_random_round():
    rng = np.random.default_rng(0)
    assert sampler.random_round(np.zeros(4), 8, rng).tolist() == [2, 2, 2, 2]
    assert sampler.random_round(np.array([5.0]), 3, rng).tolist() == [3]
    assert sampler.random_round(np.array([1, 2, 3]), 12, rng).tolist() == [2, 4, 6]
    for replace in (True, False):
        for _ in range(50):
            w = rng.random((3, 4))
            out = sampler.random_round(w, 17, rng, replace)
            assert out.sum() == 17 and (out >= np.floor(w * 17 / w.sum())).all()
    assert sampler.expand_counts(np.array([2, 0, 1])).tolist() == [0, 0, 2]
    assert sampler.split_evenly(np.array([5, 2]), 3).sum(axis=0).tolist() == [5, 2]


def test_type_size_tables():
    rng = np.random.default_rng(0)
    t = np.array([[4.0, 1.0, 1.0], [2.0, 6.0, 2.0]])
    clean = group.clean_type_size(t)
    assert group.is_clean(clean) and clean.sum() == t.sum() and not group.is_clean(t)
    assert np.allclose(group.normalize_by_group_size(t, np.array([3.0, 14.0, 9.0])).sum(axis=0), [3, 14, 9])
    whole = group.round_by_types(t, np.array([6, 10]), rng)
    assert whole.sum(axis=1).tolist() == [6, 10]
    for rows in (27, 31, 35):
        moved = group.match_rows(whole, rows, rng)
        assert group.rows_of(moved) == rows and moved.sum(axis=1).tolist() == [6, 10] and (moved >= 0).all()
        assert (moved[:, 0] == whole[:, 0]).all()


def test_hierarchies():
    tree = H.parse("{ {0 1 2} {3 4 5} }")
    assert tree.leaves() == [0, 1, 2, 3, 4, 5] and H.level_sizes(tree) == [1, 2, 6]
    assert H.loads(H.dumps({"a": tree}))["a"].leaves() == tree.leaves()
    assert H.impossible_cells(H.Node(children=[H.Node([0, 1]), H.Node([2])]), 1) == [(1, 1)]
    cut = H.by_mass([1.0] * 100, bins=10, most=5, depth=2)
    assert cut.leaves() == list(range(100)) and all(len(n.leaves()) == 10 for n in cut.children)
    skewed = H.by_mass([50.0] + [1.0] * 9, bins=5, most=1, depth=1)
    assert skewed.leaves() == list(range(10)) and skewed.children[0].leaves() == [0]
    assert H.deepest_fitting({"a": tree, "b": H.flat(4)}, ["a", "b"], 8) == {"a": 2, "b": 0}


def test_graph_neighbours_and_objectives():
    domain = Domain({"a": 2, "b": 2, "c": 2})
    one = G.Graph(domain, [("a", "b")])
    assert one.toggled("a", "b").edges() == [] and one.toggled("b", "c").edges() == [("a", "b"), ("b", "c")]
    start = G.Graph(domain, [("a", "c")])
    score = G.mutual_information_score(domain, {("a", "b"): 0.5, ("a", "c"): -0.1, ("b", "c"): 0.2}, 100, 100)
    assert G.search_edges(domain, score, start, remove=True).edges() == [("a", "b"), ("b", "c")]
    h = {("a",): 1.0, ("b",): 1.0, ("c",): 1.0, ("a", "b"): 1.2, ("b", "c"): 1.9, (): 0.0, ("a", "b", "c"): 2.1}
    assert abs(G.entropy_score(G.Graph(domain, [("a", "b"), ("b", "c")]), h.__getitem__) - 2.1) < 1e-12
    assert abs(G.divergence_score(G.Graph(domain, [("a", "b")]), h.__getitem__, ("a", "b", "c")) - 0.1) < 1e-12


def test_noise_helpers():
    rng = np.random.default_rng(0)
    laplace = privacy.noisy(np.zeros(20_000), 2.0, rng, "laplace")
    assert abs(laplace.std() - 2 * 2**0.5) < 0.1 and abs(np.abs(laplace).mean() - 2) < 0.1
    assert privacy.tvd_sensitivity(50) == 0.04
    out = privacy.smoothed(np.array([1, 1, 1, 9, 40.0]), 1e-9, rng, 5)
    assert out[:3].tolist() == [int(out[0])] * 3 and np.allclose(out[3:], [9, 40])
    assert privacy.with_preset({"a": 1, "b": 2}, {"b": 3}) == {"a": 1, "b": 3} and privacy.with_preset({"a": 1}, None) == {"a": 1}
    assert privacy.latent_sizes(1000, 10, 10_000, 0.0, 8) == [16, 16]
    assert privacy.latent_sizes(30, 10, 100, 2.0, 8) == [2, 2]
    # noise that allows fewer than two types still leaves two
    assert min(privacy.latent_sizes(1, 50, 10, 100.0, 8)) == 2


def test_conditioned_potential():
    domain = Domain({"a": 3, "b": 2, "c": 2})
    rng = np.random.default_rng(1)
    cliques = [("a", "b"), ("b", "c")]
    potential = Potential({c: Factor(domain.project(c), rng.normal(size=domain.project(c).shape)) for c in cliques})
    messages = G.message_order(cliques, G.junction_tree(cliques))
    full = propagate(potential, messages, 1.0)[0]
    own = propagate(group.allowing(potential, "a", np.array([False, True, True])), messages, 1.0)[0]
    cut = full[("a", "b")].values.copy()
    cut[0] = 0
    assert np.allclose(own[("a", "b")].values, cut / cut.sum())
    given_b = full[("b", "c")].values / full[("b", "c")].values.sum(axis=1, keepdims=True)
    assert np.allclose(own[("b", "c")].values, given_b * own[("a", "b")].values.sum(axis=0)[:, None])


def test_entropy_of_a_model():
    from loomkin.model.mrf import MarkovModel

    domain = Domain({"a": 3, "b": 2})
    p = Factor(domain, np.array([[0.1, 0.2], [0.05, 0.25], [0.3, 0.1]]))
    model = MarkovModel(domain, 1.0, Potential({("a", "b"): Factor(domain, np.log(p.values))}), [], G.message_order([("a", "b")], []), Potential(), 0.0, privacy.Ledger(math.inf))
    assert abs(model.entropy() + float((p.values * np.log(p.values)).sum())) < 1e-9
    assert abs(model.log_probability({"a": 1, "b": 0}) - math.log(0.05)) < 1e-9


def test_candidates_by_weight():
    from loomkin.model.mrf import decayed, drawn_candidates

    options = [(("a",), 1.0), (("b",), 0.0), (("c",), 3.0), (("d",), 1.0)]
    rng = np.random.default_rng(0)
    assert drawn_candidates(options, 3, False, rng) == [("a",), ("c",), ("d",)]
    seen = [drawn_candidates(options, 1, True, rng)[0] for _ in range(2000)]
    assert ("b",) not in seen and abs(seen.count(("c",)) / 2000 - 0.6) < 0.05
    assert len(drawn_candidates(options, 50, True, rng)) == 3
    assert decayed(options, {("a",): 5.0, ("c",): 1.0, ("d",): 2.0}) == [(("a",), 1.0), (("b",), 0.0), (("c",), 1.5), (("d",), 0.5)]
