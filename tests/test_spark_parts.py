"""DataFrame parts on hand-made tables: two-member queries, matching, encodings, sources, sampling, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomkin.functions import encode as E
from loomkin.model.domain import Attribute, Domain, TableSpec
from loomkin.model.factor import Factor
from loomkin.model.group import GroupSettings, fit_groups, initial_types, long_types
from loomkin.model.mrf import Settings, fit
from loomkin.model.sampler import draw_column, explode_types
from loomkin.operators import evaluate as V
from loomkin.operators import marginals as M
from loomkin.operators import matching as J
from loomkin.operators import relational as R
from loomkin.sources import io
from loomkin.streaming import incremental


@pytest.fixture(scope="module")
def groups(spark):
    """Groups {R}, {R, N}, {R, R}, {N, N}, {} with R = 1 and N = 0."""
    child = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, 1), (3, 1), (4, 0), (4, 0)], "fk int, x int")
    return child, spark.createDataFrame([(k, k % 2) for k in range(1, 6)], "pk int, z int")


@pytest.mark.parametrize(("first", "second", "size", "parent", "want"), [((1,), (0,), (2, 3), (), 1), ((1,), (1,), (2, 3), (), 1), ((0, 1), (0, 1), (1, 9), (), 3), ((1,), (1,), (1, 2), (), 0), ((0, 1), (0, 1), (1, 9), (("z", (0,)),), 2)])
def test_two_members(groups, first, second, size, parent, want):
    q = V.GroupQuery(*size, parent, (("x", first),), (("x", second),))
    assert V.count_groups(*groups, "fk", "pk", [q]).first().n == want


def test_query_generator_is_seeded_and_in_range():
    child, parent = Domain({"a": Attribute(10, "continuous"), "b": 4}), Domain({"z": 5})
    some = V.random_queries(50, child, parent, 1, 1, seed=3)
    assert some == V.random_queries(50, child, parent, 1, 1, seed=3)
    assert all(1 <= q.low <= 7 and q.high == q.low + 1 and [a for a, _ in q.first] == [a for a, _ in q.second] for q in some)
    assert all(0 <= v < child[a].size for q in some for a, vs in q.first for v in vs)


def test_relative_error_scales_and_floors(spark):
    t, s = spark.createDataFrame([(0, 100), (1, 0)], "query long, n long"), spark.createDataFrame([(0, 40), (1, 5)], "query long, n long")
    got = {r["query"]: r["error"] for r in V.relative_error(t, s, 1000, 500, base=0.01).collect()}
    assert got == {0: 0.2, 1: 1.0}


def test_independent_pair_has_no_r_score(spark):
    both = spark.createDataFrame([(a, b) for a in range(3) for b in range(4)], "a int, b int")
    same = spark.createDataFrame([(a, a) for a in range(4)], "a int, b int")
    assert M.r_scores(both, [("a", "b")]).first().r_score == 0
    assert abs(M.r_scores(same, [("a", "b")]).first().tvd - 0.75) < 1e-12


def test_projection_of_a_marginal_is_the_marginal(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_linenumber").alias("a"), F.col("l_quantity").cast("int").alias("b"))
    two = M.marginal(t, ["a", "b"]).groupBy("a").agg(F.sum("n").alias("n"))
    assert sorted(two.collect()) == sorted(M.marginal(t, ["a"]).collect())


def test_dense_refuses_too_many_cells(spark):
    with pytest.raises(ValueError, match="too many"):
        M.dense(spark.createDataFrame([], "a int, n long"), Domain({"a": M.MOST_CELLS + 1}))


def test_integrity_reports_both_sides(spark, groups):
    child = groups[0].unionByName(spark.createDataFrame([(99, 0)], "fk int, x int"))
    row = R.integrity(child, groups[1], "fk", "pk").first()
    assert (row.orphans, row.childless, row.child_rows, row.parents) == (1, 1, 8, 5)


def test_sampled_parents_keep_their_childless(groups):
    some, rows = R.sample_parents(groups[1], groups[0], "pk", "fk", 5)
    assert some.count() == 5 and rows.count() == 7


@pytest.mark.parametrize("seed", range(3))
def test_greedy_match_against_a_plain_version(spark, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 3, (40, 2)).tolist(), rng.integers(0, 3, (40, 2)).tolist()
    left = spark.createDataFrame([(i, *r) for i, r in enumerate(a)], "l long, x int, y int")
    right = spark.createDataFrame([(i, *r) for i, r in enumerate(b)], "r long, x int, y int")
    out = J.greedy_match(left, right, ["x", "y"], "l", "r").collect()
    assert sorted(p.l for p in out) == sorted(p.r for p in out) == list(range(40))
    agree = sum(a[p.l][0] == b[p.r][0] for p in out)
    one = J.greedy_match(left, right, ["x"], "l", "r", keep=True)
    best = sum(min([r[0] for r in a].count(v), [r[0] for r in b].count(v)) for v in range(3))
    assert J.agreement(one, ["x"]).first().x == best
    assert agree == best  # later columns only re-pair within a node


def test_equal_tables_match_fully(spark):
    rows = [(i, i % 3, i % 5) for i in range(30)]
    left, right = spark.createDataFrame(rows, "l long, x int, y int"), spark.createDataFrame([(99 - i, x, y) for i, x, y in rows], "r long, x int, y int")
    got = J.agreement(J.greedy_match(left, right, ["x", "y"], "l", "r", keep=True), ["x", "y"]).first()
    assert (got.pairs, got.x, got.y) == (30, 30, 30)


def test_refine_and_match_is_a_bijection(spark):
    child = spark.createDataFrame([(i, i % 2, i % 3) for i in range(24)], "id long, x int, y int")

    def sample(members, column):
        if column is None:
            return spark.range(24).select(F.col("id").alias("m"))
        return members.withColumn(column, F.pmod(F.xxhash64("m", F.lit(column)), F.lit(2)).cast("int"))

    out = J.refine_and_match(child, ["x", "y"], "id", sample, "m").collect()
    assert len({r.id for r in out}) == len({r.m for r in out}) == 24


def test_digits_round_trip_and_clamp(spark):
    d = Domain({"a": 35, "b": 5})
    t = spark.createDataFrame([(34, 4), (0, 0), (29, 1)], "a int, b int")
    cut = E.split_digits(t, d)
    assert cut.columns == ["a_hi", "a_lo", "b"] and E.split_domain(d) == Domain({"a_hi": 4, "a_lo": 10, "b": 5})
    assert sorted(E.merge_digits(cut, d).collect()) == sorted(t.collect())
    assert E.merge_digits(spark.createDataFrame([(3, 9, 1)], "a_hi int, a_lo int, b int"), d).first().a == 34


def test_cell_numbers_round_trip(spark):
    d = Domain({"a": 3, "b": 4, "c": 2})
    cells = spark.range(24).select("id", *E.mixed_radix(F.col("id"), d))
    assert cells.where(E.flat_cell(d) != F.col("id")).count() == 0


def test_sources_round_trip(spark, sf, tmp_path):
    nation = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_name")
    io.write_csv(nation, f"{tmp_path}/n")
    assert sorted(io.read_csv(spark, f"{tmp_path}/n", "n_nationkey int, n_name string").collect()) == sorted(nation.collect())
    (tmp_path / "t.tbl").write_text("1|x|c|\n2|y|c|\n")
    assert io.read_tbl(spark, f"{tmp_path}/t.tbl", "a int, b string, c string, d string").collect() == [(1, "x"), (2, "y")]
    io.convert_delimited(spark, f"{tmp_path}/t.tbl", f"{tmp_path}/t.csv", "|")
    assert spark.read.csv(f"{tmp_path}/t.csv").count() == 2
    io.save_json(spark, {"edges": [["a", "b"]]}, f"{tmp_path}/j")
    assert io.load_json(spark, f"{tmp_path}/j") == {"edges": [["a", "b"]]}
    (tmp_path / "d.json").write_text('{"a": {"size": 3, "type": "continuous"}, "b": {"domain": 2}}')
    assert io.load_domain(f"{tmp_path}/d.json", spark) == Domain({"a": Attribute(3, "continuous"), "b": 2})


def test_read_table_checks_its_key(spark):
    t = spark.createDataFrame([(1, 5, 9), (2, 6, 9), (3, 7, 8)], "id int, x int, f int")
    spec = TableSpec("id", ("x",), "f")
    assert io.read_table(t, spec).count() == 3 and io.read_table(t, spec, ratio=0.5).select("f").distinct().count() == 1
    with pytest.raises(ValueError, match="not unique"):
        io.read_table(t.unionByName(t), spec)


def test_model_is_saved_and_loaded(spark, tmp_path):
    d = Domain({"a": 2, "b": 3})
    f = {("a", "b"): Factor(d, np.arange(6.0).reshape(2, 3))}
    io.save_model(spark, f, d, f"{tmp_path}/m")
    got, domain = io.load_model(spark, f"{tmp_path}/m")
    assert domain == d and np.array_equal(got["a", "b"].values, f["a", "b"].values)


def test_drawn_column_has_the_rounded_counts(spark):
    d = Domain({"a": 2, "b": 2})
    t = Factor(d, [[3.0, 1.0], [1.0, 1.0]])
    rows = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("a"))
    out = draw_column(rows, t, ["a"], "b", "id", 1)
    counts = {(r.a, r.b): r["count"] for r in out.groupBy("a", "b").count().collect()}
    assert counts == {(0, 0): 150, (0, 1): 50, (1, 0): 100, (1, 1): 100}


def test_groups_are_made_from_a_table(spark):
    t = np.array([[2, 0, 1], [0, 3, 0]])
    made = explode_types(spark, t, ["y"])
    assert sorted((r.y, r["size"]) for r in made.collect()) == [(0, 1), (0, 1), (0, 3), (1, 2), (1, 2), (1, 2)]
    assert sorted(r.gid for r in made.collect()) == list(range(6))


@pytest.mark.parametrize("method", ["mirror", "dual", "accelerated"])
def test_methods_fit_the_marginals(spark, method):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 3, 600)
    b = (a + (rng.random(600) < 0.2)) % 3
    t = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a int, b int")
    d = Domain({"a": 3, "b": 3})
    model = fit(t, d, Settings(method=method, iterations=400))
    assert max(V.model_distance(model, t, [("a", "b")], d).values()) < 0.03


def test_noisy_fit_stays_in_its_budget(spark, sf):
    t = spark.read.parquet(f"{sf}/orders.parquet").select((F.year("o_orderdate") - 1995).alias("y"), (F.month("o_orderdate") - 1).alias("m"))
    model = fit(t, Domain({"y": 7, "m": 12}), Settings(budget=0.5, iterations=30))
    assert 0 < model.ledger.spent <= 0.5 * (1 + 1e-9) and model.noise > 0


def test_group_model_separates_types(spark):
    rng = np.random.default_rng(0)
    rows = [(g, int(v)) for g in range(300) for v in rng.choice(2, 4, p=[0.95, 0.05] if g < 150 else [0.05, 0.95])]
    child = spark.createDataFrame(rows, "fk long, x int")
    model = fit_groups(child, "fk", Domain({"x": 2}), GroupSettings(types=2, steps=6, seed=1))
    types = {r.fk: r.y for r in M.argmax_types(long_types(model.q, "fk"), "fk", ["y"]).collect()}
    agree = sum(types[g] == types[0] for g in range(150)) + sum(types[g] != types[0] for g in range(150, 300))
    assert agree > 280 and abs(model.type_size.sum() - 300) < 1e-6


def test_group_model_keeps_its_budget(spark):
    child = spark.createDataFrame([(g, g % 3) for g in range(200)], "fk long, x int")
    model = fit_groups(child, "fk", Domain({"x": 3}), GroupSettings(budget=1.0, types=2, steps=2))
    assert 0 < model.ledger.spent <= 1.0 + 1e-9


def test_latent_rounds_add_marginals(spark):
    rng = np.random.default_rng(1)
    rows = [(g, int(a), int(a) if g % 2 else int(b)) for g in range(80) for a, b in rng.integers(0, 2, (3, 2))]
    child = spark.createDataFrame(rows, "fk long, a int, b int")
    model = fit_groups(child, "fk", Domain({"a": 2, "b": 2}), GroupSettings(types=2, steps=1, latent_rounds=1, marginal_rounds=1))
    assert len(model.history) == 2 and abs(model.type_size.sum() - 80) < 1e-6


def test_experiment_averages_over_repeats(spark):
    t = spark.createDataFrame([(i % 2, i % 3, i % 2) for i in range(60)], "a int, b int, c int")
    got = V.marginal_experiment(t, Domain({"a": 2, "b": 3, "c": 2}), lambda df, budget, seed: df, [0.1, 1.0], ways=(2, 3), repeats=2)
    assert got == {0.1: {2: 0.0, 3: 0.0}, 1.0: {2: 0.0, 3: 0.0}}


def test_initial_types_are_distributions(spark):
    child = spark.range(50).withColumnRenamed("id", "fk")
    for hot in (True, False):
        q = initial_types(child, "fk", 4, 3, one_hot=hot).select(F.aggregate("q", F.lit(0.0), lambda a, x: a + x).alias("s"))
        assert q.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/event[s].parquet")
    query = incremental.to_memory(incremental.running_marginal(stream, ["event_type"]), "running")
    assert query.exception() is None
    assert sorted(spark.table("running").collect()) == sorted(M.marginal(events, ["event_type"]).collect())


def test_filters_and_columns_reach_the_scan(spark, sf):
    from loomkin.plans import catalog

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "ReadSchema: struct<l_returnflag:string>" in plan(catalog.queries()["marginal_1way"](spark, sf))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,P)" in plan(catalog.queries()["semi_join_groups"](spark, sf))


def test_dense_numbers_and_running_totals(spark):
    df = spark.createDataFrame([(i * 7 % 101, i % 3) for i in range(101)], "k int, t int")
    got = R.dense_ids(df, "i", ["k"], 5).collect()
    assert sorted((r.k, r.i) for r in got) == [(k, k + 5) for k in range(101)]
    got = R.running_total(df, "k", "before", ["k"]).collect()
    assert all(r.before == r.k * (r.k - 1) // 2 for r in got) and len(got) == 101
    own = {}
    for r in R.numbered_within(df, ["t"], "k", "i").collect():
        own.setdefault(r.t, []).append((r.k, r.i))
    assert len(own) == 3 and all([i for _, i in sorted(x)] == list(range(len(x))) for x in own.values())
    assert R.dense_ids(df.limit(0), "i", ["k"]).count() == 0


def test_keys_beyond_doubles(spark):
    df = spark.createDataFrame([(27021597764222981,), (-7,), (0,), (None,)], "k long")
    high, low = E.unpack_key(F.col("k"), 3)
    assert [(r[0], r[1]) for r in df.select(high, low).collect()] == [(9007199254740993, 2), (-3, 2), (0, 0), (None, None)]
    wide = spark.createDataFrame([(1 << 40, 5), (2, 5)], "a long, b long")
    assert [r[0] for r in wide.select(E.pack_key(F.col("a"), F.col("b"), 1 << 40)).collect()] == [None, (2 << 40) + 5]
    assert [r[0] for r in df.select(E.clip_negative(F.col("k"))).collect()][1:] == [0, 0, 0]


def test_very_large_groups_are_left_out_of_queries(spark, groups, monkeypatch):
    monkeypatch.setattr(V, "HUGE", 3)
    child, parent = groups
    more = child.unionByName(spark.createDataFrame([(5, i % 2) for i in range(50)], "fk int, x int"))
    q = [V.GroupQuery(2, 3, (), (("x", (1,)),), (("x", (0,)),)), V.GroupQuery(1, 9, (), (("x", (0, 1, 7)),), (("x", (0, 1)),))]
    assert sorted((r["query"], r.n) for r in V.count_groups(more, parent, "fk", "pk", q).collect()) == [(0, 1), (1, 3)]


def test_household_rule_draws_both_kinds(spark):
    rng = np.random.default_rng(0)
    rows = [(g, 0 if m == 0 else 1 + int(rng.integers(2)), int(rng.integers(3))) for g in range(300) for m in range(1 + g % 3)]
    domain = Domain({"r": 3, "z": 3})
    model = fit_groups(spark.createDataFrame(rows, "fk int, r int, z int"), "fk", domain, GroupSettings(types=2, steps=1, cap=3))
    made = model.synthesize(spark, seed=2, head=("r", 0)).collect()
    assert {r.r for r in made if r.member == 0} == {0} and {r.r for r in made if r.member > 0} == {1, 2}
    assert sum(domain.violations(spark.createDataFrame(made).select("r", "z")).first()) == 0
    share = sum(r.r == 2 for r in made if r.member) / max(1, sum(r.member > 0 for r in made))
    truth = sum(r == 2 for _, r, _ in rows) / sum(r > 0 for _, r, _ in rows)
    assert abs(share - truth) < 0.05  # others keep their distribution, without the head's code


def test_levels_and_structural_zeros(spark):
    from loomkin.functions import hierarchy as H
    from loomkin.model.mrf import fit_in_levels

    rng = np.random.default_rng(0)
    rows = [(int(a), int(a) % 2) for a in np.minimum(rng.geometric(0.2, 2000) - 1, 10)]
    df, domain = spark.createDataFrame(rows, "a int, b int"), Domain({"a": 11, "b": 2})
    tree = H.Node(children=[H.Node([0, 1, 2, 3]), H.Node([4, 5, 6, 7]), H.Node([8, 9, 10])])
    made = fit_in_levels(df, domain, {"a": tree}, Settings(iterations=60), levels={"a": 1})
    assert list(made.model.domain) == ["a", "a_inner", "b"]
    out = made.synthesize(spark, seed=1)
    assert out.columns == ["id", "a", "b"] and out.count() == 2000 and sum(domain.violations(out).first()) == 0
    assert V.k_way_tvd(df, out, [("a",)]).first().tvd < 0.08
    assert fit_in_levels(df, domain, {"a": tree}, Settings(iterations=5), most_cells=1).tables == {}


def test_types_follow_the_noise(spark, groups):
    child, _ = groups
    model = fit_groups(child, "fk", Domain({"x": 2}), GroupSettings(budget=0.5, types=None, steps=1, cap=3))
    assert model.types >= 4 and model.ledger.spent <= 0.5 * (1 + 1e-9)
    assert [e[0] for e in model.ledger.entries][0] == "rows"


def test_propagation_over_long_tables(spark):
    from loomkin.model import graph as G
    from loomkin.model.factor import Potential, propagate
    from loomkin.operators import longfactor as L

    domain = Domain({"a": 2, "b": 3, "c": 2, "d": 2})
    rng = np.random.default_rng(2)
    cliques = [("a", "b"), ("b", "c"), ("b", "d")]
    dense = Potential({c: Factor(domain.project(c), rng.normal(size=domain.project(c).shape)) for c in cliques})
    messages = G.message_order(cliques, G.junction_tree(cliques))
    beliefs, log_z = propagate(dense, messages, 10.0)
    long = {c: spark.createDataFrame([(*(int(x) for x in i), float(v)) for i, v in np.ndenumerate(f.values)], ", ".join([*(f"{x} int" for x in c), "value double"])) for c, f in dense.items()}
    got = L.propagate_tree(long, messages, 10.0)
    for c, f in got.items():
        assert all(abs(r["value"] - beliefs[c].values[tuple(r[x] for x in c)]) < 1e-9 for r in f.collect())
    rows = spark.createDataFrame([(1, 0, 2, 1, 0), (1, 1, 0, 0, 1), (2, 0, 0, 0, 0)], "g int, a int, b int, c int, d int")
    want = lambda *x: sum(dense[c].values[tuple(dict(zip("abcd", x, strict=True))[n] for n in c)] for c in cliques) - log_z
    by_group = {r.g: r.log_p for r in L.log_probabilities(rows, long, log_z, "g").collect()}
    assert abs(by_group[1] - want(0, 2, 1, 0) - want(1, 0, 0, 1)) < 1e-9 and abs(by_group[2] - want(0, 0, 0, 0)) < 1e-9


def test_preprocessed_tables_by_task(spark, tmp_path):
    from loomkin.functions import hierarchy as H

    df = spark.createDataFrame([(i, i % 4) for i in range(200)], "id int, a int")
    domain, trees = Domain({"a": 4}), {"a": H.Node(children=[H.Node([0, 1]), H.Node([2, 3])])}
    io.write_preprocessed(df, domain, trees, str(tmp_path / "t"))
    rows, own, found = io.read_preprocessed(spark, str(tmp_path / "t"), "TVD", "id")
    assert rows.count() == 200 and own["a"].size == 4 and found["a"].leaves() == [0, 1, 2, 3]
    train = io.read_preprocessed(spark, str(tmp_path / "t"), "SVM", "id", fold=1)[0]
    assert 120 < train.count() < 190 and train.columns == ["id", "a"]


def test_a_shared_folder_must_be_named_on_a_cluster(spark):
    from types import SimpleNamespace

    from loomkin.lineage import shared_dir

    conf = SimpleNamespace(get=lambda key, default: default, set=lambda key, value: None)
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[4]"))).startswith("file:")


def test_windowed_counts_over_a_stream(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    time = next(n for n, t in events.dtypes if t.startswith("timestamp"))
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/event[s].parquet")
    incremental.to_memory(incremental.windowed_marginal(stream, ["event_type"], time, "1 day", "1 hour"), "windowed")
    want = events.withColumn(time, F.col(time).cast("timestamp")).groupBy(F.window(time, "1 day").alias("window"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(spark.table("windowed").collect()) == sorted(want.collect())


def test_columns_side_by_side_and_random_order(spark):
    a, b = spark.createDataFrame([(k, k * 2) for k in range(50)], "k int, x int"), spark.createDataFrame([(k, k * 3) for k in range(49, -1, -1)], "k int, y int")
    assert sorted(tuple(r) for r in R.zip_columns(a, b, "k").collect()) == [(k, 2 * k, 3 * k) for k in range(50)]
    one, again, other = ([r.k for r in R.shuffled(d, ["k"], seed).collect()] for d, seed in ((a, 1), (a.repartition(7), 1), (a, 2)))
    assert one == again != other and sorted(one) == sorted(other) == list(range(50)) != one


def test_synthesis_reports_what_it_did(spark, tmp_path):
    from loomkin.plans.synthesis import Plan, two_tables

    parents = spark.createDataFrame([(k, k % 3) for k in range(60)], "pk int, z int")
    child = spark.createDataFrame([(k, (k + m) % 2) for k in range(50) for m in range(k % 3)], "fk int, x int")
    plan = Plan(("x",), ("z",), Domain({"x": 2}), Domain({"z": 3}), budget=50.0, cap=3, types=2, steps=1, reports=str(tmp_path / "reports"), fitting=Settings(iterations=10))
    made = two_tables(child, parents, plan)
    assert set(made.models) == {"singles", "groups", "parents", "childless"} and made.spent <= 50 * (1 + 1e-9)
    for name, model in made.models.items():
        found = io.load_json(spark, str(tmp_path / "reports" / name))
        assert found["spent"] == model.ledger.spent and [tuple(c) for c in found["cliques"]] == sorted(model.potential)


def test_mixture_of_records(spark):
    from loomkin.model.group import fit_mixture

    rng = np.random.default_rng(0)
    kind = rng.integers(0, 2, 600)
    flip = lambda: np.where(rng.random(600) < 0.1, 1 - kind, kind)
    rows = spark.createDataFrame([tuple(map(int, r)) for r in zip(flip(), flip(), flip(), strict=True)], "a int, b int, c int")
    domain = Domain({"a": 2, "b": 2, "c": 2})
    model = fit_mixture(rows, domain, GroupSettings(types=2, steps=3, marginal_rounds=0, sharpness=1.0))
    made = model.synthesize(spark, groups=600, seed=1)
    assert made.count() == 600 == made.select("gid").distinct().count()
    assert V.k_way_tvd(rows, made, [("a", "b", "c")]).first().tvd < 0.1


def test_misclassification(spark):
    from loomkin.operators import classify

    rng = np.random.default_rng(0)
    x = rng.integers(0, 7, (500, 2))
    ring = (np.abs(x - 3).max(axis=1) >= 2).astype(int)  # no line divides it
    rows = spark.createDataFrame([(i, int(a), int(b), int(y)) for i, ((a, b), y) in enumerate(zip(x, ring, strict=True))], "id int, a int, b int, y int")
    train, test = rows.where("id < 400"), rows.where("id >= 400")
    assert classify.misclassification(train, test, "y", ["a", "b", "y"]) < 0.1
    shuffled = train.withColumn("y", F.lit(1))
    base = test.where("y <> 1").count() / test.count()
    assert classify.misclassification(shuffled, test, "y", ["a", "b", "y"]) == base
    z = classify.kernel_features(test.select("a", "b"), ["a", "b"], np.zeros(2), np.ones(2), count=4000).collect()
    for p, q in ((0, 1), (2, 3), (4, 9)):
        kernel = np.exp(-0.5 * ((z[p].a - z[q].a) ** 2 + (z[p].b - z[q].b) ** 2))
        assert abs(float(z[p].features.dot(z[q].features)) - kernel) < 0.08
