"""Registered queries of the fitted models: random or iterative, so they return invariants instead of values."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from loomkin.functions import hierarchy as H
from loomkin.lineage import materialize, shared_dir
from loomkin.model import privacy
from loomkin.model.group import GroupSettings, fit_groups, long_types
from loomkin.model.mrf import Settings, fit
from loomkin.operators import evaluate as V
from loomkin.operators import marginals as M
from loomkin.operators import matching as J
from loomkin.operators import relational as R
from loomkin.plans.catalog import query
from loomkin.plans.fixtures import CHILD, CHILD_DOMAIN, PARENT_DOMAIN, child, parent
from loomkin.sources.io import read_parquet

SMALL = CHILD_DOMAIN.project(["rf", "ls", "disc"])


@query(f"WITH {CHILD} SELECT fk, disc, CAST(disc >= 5 AS INT) AS bin, disc - CASE WHEN disc >= 5 THEN 5 ELSE 0 END AS inner_ FROM c")
def hierarchy_level(spark, sf):
    """A two-bin hierarchy of the discount, applied and kept beside the code."""
    tree = H.Node(children=[H.Node([0, 1, 2, 3, 4]), H.Node([5, 6, 7, 8, 9, 10])])
    table = H.level_table(spark, tree, 1)
    coded = H.to_level(child(spark, sf).select("fk", "disc", F.col("disc").alias("d")), "d", table)
    return coded.select("fk", "disc", F.col("d").alias("bin"), F.col("d_inner").alias("inner_"))


@query(f"WITH {CHILD} SELECT fk, disc AS back, disc // 4 AS bin, disc % 4 AS inner_ FROM c")
def hierarchy_round_trip(spark, sf):
    """Three bins of equal mass over eleven codes: bin, place in it, and the code made of both."""
    table = H.level_table(spark, H.by_mass([1.0] * 11, bins=3, most=4, depth=1), 1)
    coded = H.to_level(child(spark, sf).select("fk", "disc", F.lit(None).cast("int").alias("kept")), "disc", table).withColumn("bin", F.col("disc")).withColumn("inner_", F.col("disc_inner"))
    return H.from_level(coded, "disc", table).select("fk", F.col("disc").alias("back"), "bin", "inner_")


@query("SELECT CAST(33 AS BIGINT) AS cells, TRUE AS near, TRUE AS spread, TRUE AS frozen")
def noisy_marginal(spark, sf):
    """Noise on all 33 cells of a dense table: cells, whether its sum and its spread are near what they should be, and whether a second look sees the same draw."""
    own = CHILD_DOMAIN.project(["rf", "disc"])
    table = M.dense(M.marginal(child(spark, sf), list(own)), own)
    drawn = privacy.noisy_table(table.withColumn("noisy", F.col("n").cast("double")), "noisy", 3.0, 7, f"{shared_dir(spark)}/loomkin/noisy-{uuid.uuid4().hex}")
    noise = F.col("noisy") - F.col("n")
    once, again = (drawn.agg(F.sum("noisy")).first()[0] for _ in range(2))
    return drawn.agg(F.count("*").alias("cells"), (F.abs(F.sum(noise)) < 6 * 3.0 * 33**0.5).alias("near"), F.stddev(noise).between(1.5, 4.5).alias("spread"), F.lit(once == again).alias("frozen"))


#: Budgets of the Gaussian mechanism at delta 1e-5, to six places.
BUDGETS = {0.1: 0.001058, 0.2: 0.003762, 0.4: 0.013428, 0.8: 0.047824, 1.6: 0.168452, 3.2: 0.579322}


@query(f"SELECT * FROM (VALUES {', '.join(f'(CAST({e} AS DOUBLE), CAST({b} AS DOUBLE))' for e, b in BUDGETS.items())}) AS t(epsilon, budget)")
def privacy_budget(spark, sf):
    """The Gaussian mechanism's budget at delta 1e-5."""
    return spark.createDataFrame([(e, round(privacy.total_budget(e, 1e-5), 6)) for e in BUDGETS], "epsilon double, budget double")


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS violations, TRUE AS near FROM orders")
def mrf_synthesis(spark, sf):
    """A single-table model without noise: rows drawn, codes in their domain, distance of the fitted pairs."""
    own = PARENT_DOMAIN.project(["st", "pri", "yr"])
    data = parent(spark, sf).select(*own)
    model = fit(data, own, Settings(iterations=100))
    made = model.synthesize(spark, seed=3)
    bad = own.violations(made).first()
    tvd = V.k_way_tvd(data, made, [("st", "yr"), ("pri", "yr")]).agg(F.max("tvd").alias("t")).first()["t"]
    return spark.createDataFrame([(made.count(), int(sum(bad)), bool(tvd < 0.1))], "n long, violations long, near boolean")


@query("SELECT count(DISTINCT l_orderkey) AS n_groups, TRUE AS normal FROM lineitem")
def e_step(spark, sf):
    """Types of groups after two steps: groups, and the largest error of a group's total probability."""
    model = fit_groups(child(spark, sf), "fk", SMALL, GroupSettings(types=3, steps=2))
    sums = long_types(model.q, "fk").groupBy("fk").agg(F.sum("p").alias("s"))
    return sums.agg(F.count("*").alias("n_groups"), (F.max(F.abs(F.col("s") - 1)) < 1e-9).alias("normal"))


#: Factors that make the 16 types' potentials, by attribute: code v and type y have ((v + 1) * (y + 2) * factor % 11) / 11.
FACTORS = {"rf": 3, "ls": 5, "disc": 7}
_THETA = " + ".join(f"((({a} + 1) * (y + 2) * {k}) % 11) / 11.0::DOUBLE" for a, k in FACTORS.items())
_LOG_Z = " + ".join(f"ln((SELECT sum(exp((((v + 1) * (y + 2) * {k}) % 11) / 11.0::DOUBLE)) FROM (SELECT unnest(range({SMALL[a].size})) AS v)))" for a, k in FACTORS.items())


@query(
    f"WITH {CHILD}, t AS (SELECT unnest(range(16)) AS y), z AS (SELECT y, {_LOG_Z} AS z FROM t), "
    f"s AS (SELECT fk, y, 10 * sum({_THETA} - z) AS s FROM c CROSS JOIN z GROUP BY fk, y), "
    "e AS (SELECT fk, y, exp(s - max(s) OVER (PARTITION BY fk)) AS e FROM s), q AS (SELECT fk, y, e / sum(e) OVER (PARTITION BY fk) AS q FROM e) "
    "SELECT CAST(y AS INT) AS y, count(*) AS n_groups, round(sum(q), 4) AS mass, count(*) FILTER (WHERE q > 0.9) AS sure FROM q GROUP BY y"
)
def e_step_16_types(spark, sf):
    """One E-step over all groups with 16 types, from fixed potentials: each type's mass, and the groups that are surely of it."""
    from loomkin.model import graph as G
    from loomkin.model.factor import Factor, Potential
    from loomkin.model.group import TYPE, expectation

    full = SMALL.with_attribute(TYPE, 16, latent=True)
    theta = {a: ((np.arange(SMALL[a].size)[:, None] + 1) * (np.arange(16) + 2) * FACTORS[a] % 11) / 11 for a in SMALL}
    potential = Potential({(a, TYPE): Factor(full.project((a, TYPE)), theta[a]) for a in SMALL})
    cliques = list(potential)
    q = expectation(child(spark, sf), "fk", potential, G.message_order(cliques, G.junction_tree(cliques)), full, 16, np.ones((16, 8)), 8)
    each = q.select("fk", F.posexplode("q").alias("y", "p"))
    return each.groupBy("y").agg(F.count("*").alias("n_groups"), F.round(F.sum("p"), 4).alias("mass"), F.sum((F.col("p") > 0.9).cast("long")).alias("sure"))


@query("SELECT count(DISTINCT l_orderkey) AS n_groups, CAST(0 AS BIGINT) AS orphans, CAST(0 AS BIGINT) AS childless, CAST(0 AS BIGINT) AS violations, TRUE AS sizes_near FROM lineitem")
def group_synthesis(spark, sf):
    """The parent/child model end to end, as many groups as there are: foreign keys of their members, codes, and the distribution of sizes."""
    c = child(spark, sf)
    model = fit_groups(c, "fk", SMALL, GroupSettings(types=3, steps=2))
    made = model.synthesize(spark, seed=1)
    n = made.agg(F.count_distinct("gid")).first()[0]
    check = R.integrity(made, spark.range(n).withColumnRenamed("id", "pk"), "gid", "pk").first()
    true_sizes, sizes = ({r["size"]: r["n"] for r in M.group_sizes(d, key, 8).collect()} for d, key in ((c, "fk"), (made, "gid")))
    gap = sum(abs(true_sizes.get(k, 0) - sizes.get(k, 0)) for k in {*true_sizes, *sizes}) / max(1, n)
    return spark.createDataFrame([(n, check["orphans"], check["childless"], int(sum(SMALL.violations(made).first())), gap < 0.02)], "n_groups long, orphans long, childless long, violations long, sizes_near boolean")


@query("SELECT count(*) AS n_rows, count(*) AS n_distinct, CAST(0 AS BIGINT) AS orphans FROM lineitem")
def match_by_model(spark, sf):
    """Foreign keys for all existing rows of orders of one type histogram: rows, distinct rows, orphans."""
    c = child(spark, sf)
    c = R.dense_ids(c, "id", c.columns)
    model = fit_groups(c.select("fk", *SMALL), "fk", SMALL, GroupSettings(types=3, steps=1))
    types = M.argmax_types(long_types(model.q, "fk"), "fk", ["y"])
    got = J.match_by_model(model, c.select("id", *SMALL), types.select(F.col("fk").alias("pk"), "y"), "id", "pk", "y", seed=2)
    out = got.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).first()
    return spark.createDataFrame([(out["n"], out["ids"], R.orphans(got, types, "pk", "fk").count())], "n_rows long, n_distinct long, orphans long")


@query("SELECT CAST(0 AS BIGINT) AS orphans, CAST(0 AS BIGINT) AS violations, TRUE AS parents_near, TRUE AS flags_near")
def two_table_synthesis(spark, sf):
    """Lineitem and orders made anew without noise: rows of both, orphans, and whether counts and marginals are near the truth."""
    from loomkin.plans.synthesis import Plan, two_tables

    c_dom, p_dom = CHILD_DOMAIN.project(["rf", "ls", "qty"]), PARENT_DOMAIN.project(["st", "pri"])
    c, p = child(spark, sf), parent(spark, sf)
    made = two_tables(c, p, Plan(tuple(c_dom), tuple(p_dom), c_dom, p_dom, cap=8, types=3, steps=2))
    check = R.integrity(made.child, made.parent, "fk", "pk").first()
    near_parents = abs(check["parents"] - p.count()) <= 3
    tvd = V.k_way_tvd(c, made.child, [("rf", "ls")]).first()["tvd"]
    bad = int(sum(c_dom.violations(made.child).first())) + int(sum(p_dom.violations(made.parent).first()))
    return spark.createDataFrame([(check["orphans"], bad, near_parents, bool(tvd < 0.15))], "orphans long, violations long, parents_near boolean, flags_near boolean")


@query("SELECT TRUE AS orders_near, TRUE AS lines_near, CAST(0 AS BIGINT) AS order_orphans, CAST(0 AS BIGINT) AS line_orphans")
def chain_synthesis(spark, sf):
    """Orders and lines made for public customers: whether there are as many as in the truth (within 3 %), and orphans at both levels."""
    from loomkin.model.domain import Domain
    from loomkin.plans.synthesis import chain

    line_dom, order_dom, customer_dom = SMALL.project(["rf", "ls"]), PARENT_DOMAIN.project(["st", "yr", "pri"]), Domain({"nat": 25})
    customers = read_parquet(spark, sf, "customer").select(F.col("c_custkey").alias("ck"), F.col("c_nationkey").alias("nat"))
    orders, lines = chain(child(spark, sf).select("fk", *line_dom), parent(spark, sf).select("pk", "cust", *order_dom), customers, line_dom, order_dom, customer_dom, ["st", "yr"], steps=1)
    up, low = R.integrity(orders, customers, "cust", "ck").first(), R.integrity(lines, orders, "fk", "pk").first()
    near = lambda made, table: abs(made / max(1, read_parquet(spark, sf, table).count()) - 1) < 0.03
    return spark.createDataFrame([(near(up["child_rows"], "orders"), near(low["child_rows"], "lineitem"), up["orphans"], low["orphans"])], "orders_near boolean, lines_near boolean, order_orphans long, line_orphans long")


@query("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS orphans, TRUE AS types_kept FROM lineitem")
def second_foreign_key(spark, sf):
    """Lines that have an order get a part as their second parent: the pair (part, supplier) is public, its type comes from the lines it has."""
    from loomkin.plans.synthesis import second_parent

    t = read_parquet(spark, sf, "lineitem")
    coded = t.select(
        (F.col("l_partkey").cast("long") * F.lit(1_000_000) + F.col("l_suppkey")).alias("fk"),
        (F.expr("instr('ANR', l_returnflag)") - 1).cast("int").alias("rf"), (F.expr("instr('FO', l_linestatus)") - 1).cast("int").alias("ls"),
    )
    own = CHILD_DOMAIN.project(["rf", "ls"])
    c = R.dense_ids(coded, "id", coded.columns)
    cap = coded.groupBy("fk").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    model = fit_groups(c.select("fk", *own), "fk", own, GroupSettings(types=2, steps=1, cap=cap))
    types = M.argmax_types(long_types(model.q, "fk"), "fk", ["y"]).select(F.col("fk").alias("pair"), "y")
    got = materialize(second_parent(model, c.select("id", *own), "id", types, "pair", "y", seed=4), "second")
    kept = got.join(types, "pair").groupBy("y").agg(F.count_distinct("pair").alias("used")).count() <= 2
    out = got.agg(F.count_distinct("id").alias("n")).first()["n"]
    return spark.createDataFrame([(out, R.orphans(got, types, "pair", "pair").count(), kept)], "n_rows long, orphans long, types_kept boolean")
