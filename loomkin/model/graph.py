"""Attribute graphs: triangulation, cliques, junction trees, and choice of structure from scores."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from itertools import combinations

from loomkin.model.domain import Domain

Clique = tuple[str, ...]
Edge = tuple[str, str]
#: Score of a graph with a clique over the limit.
FORBIDDEN = -1e7


def edge(a: str, b: str) -> Edge:
    return (a, b) if a <= b else (b, a)


class Graph:
    """An undirected graph over few nodes."""

    def __init__(self, nodes: Iterable[str], edges: Iterable[Edge] = ()) -> None:
        self.near: dict[str, set[str]] = {n: set() for n in nodes}
        for a, b in edges:
            self.add(a, b)

    def add(self, a: str, b: str) -> None:
        self.near[a].add(b)
        self.near[b].add(a)

    def plus(self, a: str, b: str) -> Graph:
        out = Graph(self.near, self.edges())
        out.add(a, b)
        return out

    def toggled(self, a: str, b: str) -> Graph:
        """The neighbouring graph with this edge added, or taken away if it is there."""
        if not self.has(a, b):
            return self.plus(a, b)
        return Graph(self.near, [e for e in self.edges() if e != edge(a, b)])

    def edges(self) -> list[Edge]:
        return sorted({edge(a, b) for a, near in self.near.items() for b in near})

    def has(self, a: str, b: str) -> bool:
        return b in self.near[a]


def triangulate(graph: Graph) -> Graph:
    """Chordal completion: nodes are eliminated in the order of their first degree, neighbours completed."""
    out = Graph(graph.near, graph.edges())
    left = {n: set(x) for n, x in graph.near.items()}
    for n in sorted(left, key=lambda n: (len(graph.near[n]), n)):
        for a, b in combinations(sorted(left[n]), 2):
            out.add(a, b)
            left[a].add(b)
            left[b].add(a)
        for a in left.pop(n):
            left[a].discard(n)
    return out


def is_chordal(graph: Graph) -> bool:
    """Maximum-cardinality search: earlier neighbours of each node must be complete."""
    order: list[str] = []
    weight = dict.fromkeys(graph.near, 0)
    while weight:
        n = max(sorted(weight), key=weight.get)
        earlier = [x for x in order if x in graph.near[n]]
        if any(not graph.has(a, b) for a, b in combinations(earlier, 2)):
            return False
        order.append(n)
        del weight[n]
        for x in graph.near[n]:
            if x in weight:
                weight[x] += 1
    return True


def maximal_cliques(graph: Graph) -> list[Clique]:
    """Bron-Kerbosch with pivots; cliques and their attributes in order."""
    out: list[Clique] = []

    def grow(r: set[str], p: set[str], x: set[str]) -> None:
        if not p and not x:
            out.append(tuple(sorted(r)))
            return
        pivot = max(sorted(p | x), key=lambda n: len(graph.near[n] & p))
        for n in sorted(p - graph.near[pivot]):
            grow(r | {n}, p & graph.near[n], x & graph.near[n])
            p = p - {n}
            x = x | {n}

    if graph.near:
        grow(set(), set(graph.near), set())
    return sorted(out)


def junction_tree(cliques: Sequence[Clique]) -> list[tuple[Clique, Clique]]:
    """Edges of a maximum-weight spanning forest by separator size; cliques without a common attribute stay apart."""
    root = {c: c for c in cliques}

    def find(c: Clique) -> Clique:
        while root[c] != c:
            c = root[c]
        return c

    out = []
    for a, b in sorted(combinations(cliques, 2), key=lambda p: (-len(set(p[0]) & set(p[1])), p)):
        if set(a) & set(b) and find(a) != find(b):
            root[find(a)] = find(b)
            out.append((a, b))
    return out


def message_order(cliques: Sequence[Clique], tree: Sequence[tuple[Clique, Clique]]) -> list[tuple[Clique, Clique]]:
    """Each tree edge in both directions, a message after those it is made of."""
    near: dict[Clique, list[Clique]] = {c: [] for c in cliques}
    for a, b in tree:
        near[a].append(b)
        near[b].append(a)
    up, seen = [], set()
    for top in cliques:
        if top in seen:
            continue
        seen.add(top)
        stack, order = [top], []
        while stack:
            c = stack.pop()
            for d in near[c]:
                if d not in seen:
                    seen.add(d)
                    order.append((d, c))
                    stack.append(d)
        up += [*reversed(order), *((c, d) for d, c in order)]
    return up


def depth_first(tree: Sequence[tuple[Clique, Clique]], cliques: Sequence[Clique], start: Clique) -> list[tuple[Clique | None, Clique]]:
    """(parent, clique) from start through its tree, then the other trees."""
    near: dict[Clique, list[Clique]] = {c: [] for c in cliques}
    for a, b in tree:
        near[a].append(b)
        near[b].append(a)
    out, seen = [], set()
    for top in [start, *cliques]:
        stack = [(None, top)]
        while stack:
            parent, c = stack.pop()
            if c in seen:
                continue
            seen.add(c)
            out.append((parent, c))
            stack += [(c, d) for d in reversed(near[c]) if d not in seen]
    return out


def limited_score(graph: Graph, scores: Mapping[Edge, float], domain: Domain, most_clique: float, most_cells: float) -> float:
    """Sum of the triangulated graph's edge scores, or FORBIDDEN if a clique or all cliques together are too large."""
    full = triangulate(graph)
    sizes = [domain.cells(c) for c in maximal_cliques(full)]
    if max(sizes, default=0) > most_clique or sum(sizes) > most_cells:
        return FORBIDDEN
    return sum(scores.get(e, 0.0) for e in full.edges())


def feature_score(target: str, attrs: Sequence[str], scores: Mapping[Edge, float]) -> float:
    """Correlation feature score of a marginal for one of its attributes."""
    others = [a for a in attrs if a != target]
    inner = sum(scores[edge(a, b)] for a, b in combinations(others, 2))
    below = 2 * (len(attrs) + inner)
    return sum(scores[edge(target, a)] for a in others) / math.sqrt(below) if below > 0 else 0.0


def grow_by_score(domain: Domain, scores: Mapping[Edge, float], most_clique: float = 1e6, most_cells: float = 1e7) -> Graph:
    """Adds, best edge first, the first edge that raises the score, until none does. Latent attributes are tied to all."""
    scores = {edge(*e): s for e, s in scores.items()}
    graph = Graph(domain)
    for l in domain.latent():
        for a in domain:
            if a != l:
                graph.add(a, l)
                scores.setdefault(edge(a, l), 1e-5)
    ranked = sorted((e for e in scores if not graph.has(*e)), key=lambda e: (-scores[e], e))
    best = limited_score(graph, scores, domain, most_clique, most_cells)
    while True:
        for e in ranked:
            if not graph.has(*e) and (s := limited_score(trial := graph.plus(*e), scores, domain, most_clique, most_cells)) > best:
                graph, best = trial, s
                break
        else:
            return triangulate(graph)


def search_edges(domain: Domain, score: Callable[[Graph], float], start: Graph | None = None, rounds: int = 10_000, remove: bool = False) -> Graph:
    """Adds the edge that gives the best legal score each round, until none is legal.

    remove: edges may also be taken away, and the search ends where no toggled edge scores higher.
    """
    graph = start or Graph(domain)
    own = score(graph)
    for _ in range(rounds):
        trials = [(score(g), e, g) for e in domain.pairs() if (remove or not graph.has(*e)) and (g := graph.toggled(*e))]
        best = max(trials, key=lambda t: (t[0], t[1]), default=None)
        if best is None or best[0] <= FORBIDDEN or (remove and best[0] <= own):
            break
        own, _, graph = best
    return triangulate(graph)


def pairwise_score(domain: Domain, tvd: Mapping[Edge, float], most_clique: float, most_cells: float) -> Callable[[Graph], float]:
    """Sum of pairwise distances over the triangulated edges, less a little for size."""

    def score(graph: Graph) -> float:
        full = triangulate(graph)
        sizes = [domain.cells(c) for c in maximal_cliques(full)]
        if max(sizes, default=0) > most_clique or sum(sizes) > most_cells:
            return FORBIDDEN
        return sum(tvd.get(e, 0.0) for e in full.edges()) - 1e-8 * sum(sizes)

    return score


def entropy_score(graph: Graph, entropies: Callable[[Clique], float]) -> float:
    """Entropy of the junction-tree model: cliques' entropies less their separators' (smaller is closer to the data)."""
    cliques = maximal_cliques(triangulate(graph))
    tree = junction_tree(cliques)
    return sum(map(entropies, cliques)) - sum(entropies(tuple(sorted(set(a) & set(b)))) for a, b in tree)


def mutual_information_score(domain: Domain, information: Mapping[Edge, float], most_clique: float, most_cells: float) -> Callable[[Graph], float]:
    """Sum of the pairwise mutual information over the triangulated edges, less a little for size."""
    return pairwise_score(domain, information, most_clique, most_cells)


def divergence_score(graph: Graph, entropies: Callable[[Clique], float], attrs: Clique) -> float:
    """Kullback-Leibler divergence of the data from the junction-tree model."""
    return entropy_score(graph, entropies) - entropies(attrs)


def marginals_by_feature(graph: Graph, domain: Domain, scores: Mapping[Edge, float], most_attrs: int, most_cells: float) -> list[Clique]:
    """For each observed attribute its best-scored marginal within a clique, under the cell limit."""
    scores = {edge(*e): s for e, s in scores.items()}
    best: dict[str, tuple[float, Clique]] = {}
    for c in maximal_cliques(graph):
        seen = [a for a in c if not domain[a].latent]
        for k in range(1, most_attrs + 1):
            for m in combinations(seen, k):
                if domain.cells(m) <= most_cells:
                    for a in m:
                        if (s := feature_score(a, m, scores)) > best.get(a, (-math.inf, ()))[0]:
                            best[a] = (s, m)
    return sorted({m for _, m in best.values()})


def parents_for(target: str, clique: Sequence[str], domain: Domain, tvd: Mapping[Edge, float], most_attrs: int, limit_pair: float, limit_many: float) -> tuple[Clique, float]:
    """The best parent set of an attribute within its clique, by correlation against redundancy."""
    best, top = (), -math.inf
    others = [a for a in clique if a != target]
    for k in range(1, most_attrs):
        for group in combinations(others, k):
            if domain.cells(group) * domain[target].size > (limit_pair if k == 1 else limit_many):
                continue
            gain = sum(tvd[edge(target, a)] for a in group)
            twice = max(1.0, k + sum(tvd[edge(a, b)] for a, b in combinations(group, 2)))
            if (s := gain / math.sqrt(twice)) > top:
                best, top = group, s
    return best, top


def without_contained(sets: Iterable[Sequence[str]]) -> list[Clique]:
    """Attribute sets that are not part of another one."""
    unique = sorted({tuple(sorted(s)) for s in sets}, key=lambda s: (-len(s), s))
    out: list[Clique] = []
    for s in unique:
        if not any(set(s) <= set(o) for o in out):
            out.append(s)
    return sorted(out)


def initial_measures(graph: Graph, domain: Domain, tvd: Mapping[Edge, float], most_attrs: int, limit_pair: float, limit_many: float) -> list[Clique]:
    """Each attribute with its best parents; attributes left over alone."""
    chosen: dict[str, tuple[float, Clique]] = {}
    for c in maximal_cliques(graph):
        for a in c:
            group, s = parents_for(a, c, domain, tvd, most_attrs, limit_pair, limit_many)
            if group and s > chosen.get(a, (-math.inf, ()))[0]:
                chosen[a] = (s, tuple(sorted((a, *group))))
    out = without_contained(m for _, m in chosen.values())
    covered = {a for m in out for a in m}
    return sorted([*out, *((a,) for a in domain if a not in covered)])


def n_way(attrs: Sequence[str], n: int) -> list[Clique]:
    return [tuple(sorted(c)) for c in combinations(attrs, n)]


def with_latent(marginal: Sequence[str], latent: Sequence[str]) -> list[Clique]:
    """The marginal with each latent attribute."""
    return [tuple(sorted((*marginal, l))) for l in latent]


def candidates(cliques: Iterable[Clique], domain: Domain, most_attrs: int, most_cells: float, chosen: Iterable[Clique] = ()) -> list[tuple[Clique, float]]:
    """Subsets of cliques under the cell limit that are not chosen yet, weighted by size ** 2 over their number."""
    found: dict[int, set[Clique]] = {}
    gone = {tuple(sorted(c)) for c in chosen}
    for c in cliques:
        for k in range(2, most_attrs + 1):
            found.setdefault(k, set()).update(m for m in combinations(sorted(c), k) if domain.cells(m) <= most_cells and m not in gone)
    return [(m, k * k / len(ms)) for k, ms in sorted(found.items()) for m in sorted(ms)]
