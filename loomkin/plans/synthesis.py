"""End-to-end synthesis of tables with foreign keys.

The budget is split by fixed shares over the models; groups of one row and larger groups are disjoint
populations with models of their own. A change of one parent's group can move it between the two, so
both draw on the same budget instead of each taking all of it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkin.functions import encode as E
from loomkin.lineage import materialize
from loomkin.model.domain import Domain
from loomkin.model.group import TYPE, GroupModel, GroupSettings, fit_groups, long_types
from loomkin.model.mrf import MarkovModel, Settings, fit
from loomkin.operators import marginals as M
from loomkin.operators import matching as J
from loomkin.operators import relational as R
from loomkin.sources.io import save_json


@dataclass(frozen=True)
class Plan:
    """How to synthesise: layout, caps and budget shares."""

    child_attrs: tuple[str, ...]
    parent_attrs: tuple[str, ...]
    child_domain: Domain
    parent_domain: Domain
    fk: str = "fk"
    pk: str = "pk"
    budget: float = math.inf
    cap: int = 15
    types: int = 4
    steps: int = 3
    seed: int = 0
    shares: dict = field(default_factory=lambda: {"singles": 0.2, "groups": 0.4, "parents": 0.3, "childless": 0.1})
    head: str | None = None
    #: Where the models' reports are written as JSON, if anywhere.
    reports: str | None = None
    fitting: Settings = Settings(iterations=100)

    def of(self, share: str) -> float:
        return self.budget if math.isinf(self.budget) else self.budget * self.shares[share]


@dataclass
class Synthesis:
    child: DataFrame
    parent: DataFrame
    spent: float
    models: dict


def group_sizes_by_type(model: GroupModel, q: DataFrame, fk: str) -> np.ndarray:
    hist = np.zeros(model.types, np.int64)
    for r in M.argmax_types(q, fk, [TYPE]).groupBy(TYPE).agg(F.count("*").alias("n")).collect():
        hist[r[TYPE]] = r["n"]
    return hist


def children_for(spark: SparkSession, model: GroupModel, parents: DataFrame, pk: str, types: str, seed: int, head: tuple[str, int] | None = None) -> DataFrame:
    """(parent key as fk, member, attributes): a synthetic group for each parent, of the parent's type."""
    hist = np.zeros(model.types, np.int64)
    for r in parents.groupBy(types).agg(F.count("*").alias("n")).collect():
        hist[r[types]] = r["n"]
    members = materialize(model.synthesize(spark, types=hist, seed=seed, head=head), "members")
    owner = R.zip_by_type(members.select("gid", TYPE).distinct(), parents.select(pk, F.col(types).alias(TYPE)), [TYPE], "gid", pk)
    return members.join(owner.select("gid", F.col(pk).alias("fk")), "gid").drop("gid", TYPE)


def two_tables(child: DataFrame, parent: DataFrame, plan: Plan) -> Synthesis:
    """A synthetic parent and child table. Wide attributes are split into digits for the models and merged at the end."""
    spark = child.sparkSession
    fk, pk = plan.fk, plan.pk
    c_dom, p_dom = E.split_domain(plan.child_domain), plan.parent_domain
    own = E.split_digits(child.select(fk, *plan.child_attrs), plan.child_domain)
    own = R.dense_ids(own, "_key", own.columns)
    own = materialize(R.cap_groups(own, fk, plan.cap, seed=plan.seed, key=["_key"]).drop("_key"), "capped")
    one, more = R.split_singles(own, fk)
    parents = parent.select(pk, *plan.parent_attrs)
    models: dict[str, object] = {}
    tables_c, tables_p, at, spent = [], [], 0, 0.0

    def number(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, F.col(name) + at)

    # groups of one: parent and child attributes side by side in one model
    joined = R.join_parent(one, parents, fk, pk).select(*c_dom, *p_dom)
    if joined.limit(1).count():
        m = models["singles"] = fit(joined, c_dom + p_dom, replace(plan.fitting, budget=plan.of("singles"), sensitivity=float(min(plan.cap, 6)), seed=plan.seed))
        made = materialize(m.synthesize(spark, seed=plan.seed + 1, key="pk"), "singles")
        tables_p.append(made.select("pk", *p_dom))
        tables_c.append(made.select(F.col("pk").alias("fk"), F.lit(0).alias("member"), *c_dom))
        at += made.count()
        spent += m.ledger.spent

    # larger groups: the group model gives types, the parents' model their joint distribution with the attributes
    if more.limit(1).count():
        g = models["groups"] = fit_groups(more, fk, c_dom, GroupSettings(budget=plan.of("groups"), types=plan.types, steps=plan.steps, cap=plan.cap, seed=plan.seed))
        types = M.argmax_types(long_types(g.q, fk), fk, [TYPE])
        typed, _ = R.attach_types(parents, types, pk, fk, [TYPE])
        m = models["parents"] = fit(typed.select(*p_dom, TYPE), p_dom.with_attribute(TYPE, plan.types), replace(plan.fitting, budget=plan.of("parents"), seed=plan.seed + 2))
        made = materialize(number(m.synthesize(spark, seed=plan.seed + 3, key="pk"), "pk"), "parents")
        members = children_for(spark, g, made, "pk", TYPE, plan.seed + 4, (plan.head, 0) if plan.head else None)
        tables_p.append(made.select("pk", *p_dom))
        tables_c.append(members.select("fk", "member", *c_dom))
        at += made.count()
        spent += g.ledger.spent + m.ledger.spent

    # parents without a child keep their own share of the table
    bare = R.childless(parents, own, pk, fk)
    if bare.limit(1).count():
        m = models["childless"] = fit(bare.select(*p_dom), p_dom, replace(plan.fitting, budget=plan.of("childless"), seed=plan.seed + 5))
        tables_p.append(number(m.synthesize(spark, seed=plan.seed + 6, key="pk"), "pk"))
        spent += m.ledger.spent
    if not tables_p:
        raise ValueError("both tables are empty")
    if plan.reports:
        for name, model in models.items():
            save_json(spark, model.report(), f"{plan.reports}/{name}")
    made_c = R.union_tables(*tables_c) if tables_c else own.limit(0).select(F.col(fk).alias("fk"), F.lit(0).alias("member"), *c_dom)
    made_c = E.merge_digits(made_c, plan.child_domain)
    return Synthesis(made_c.select("fk", "member", *plan.child_attrs), R.union_tables(*tables_p).select("pk", *plan.parent_attrs), spent, models)


def with_types(public: DataFrame, model: MarkovModel, key: str, types: str, seed: int) -> DataFrame:
    """Public rows, kept as they are, with only their types drawn."""
    held = [a for a in model.domain if a != types]
    return model.synthesize(public.sparkSession, fixed=public.select(key, *held), seed=seed, key=key)


def chain(lines: DataFrame, orders: DataFrame, customers: DataFrame, line_domain: Domain, order_domain: Domain, customer_domain: Domain, group_by: Sequence[str], types: int = 3, steps: int = 2, cap: int | None = None, budget: float = math.inf, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(orders, lines) for public customers: lines (fk, attrs) belong to orders (pk, cust, attrs), those to customers (ck, attrs).

    Line groups give orders a type; groups of orders, seen through `group_by` and that type, give
    customers one. Customers keep their attributes and get a drawn type; their orders are made for it,
    completed by a model of the orders given what they already have, and filled with lines.

    cap: the largest group that is modelled and made. Without a budget to keep it is by default the largest
    one there is, so that no group is cut.
    """
    spark = lines.sparkSession
    if cap is None:
        largest = lambda df, key: df.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
        low_cap, up_cap = (largest(lines, "fk"), largest(orders, "cust")) if math.isinf(budget) else (10, 10)
    else:
        low_cap = up_cap = cap
    share = (lambda x: math.inf) if math.isinf(budget) else (lambda x: budget * x)
    low = fit_groups(lines, "fk", line_domain, GroupSettings(budget=share(0.3), types=types, steps=steps, cap=low_cap, seed=seed))
    t1 = M.argmax_types(long_types(low.q, "fk"), "fk", [TYPE]).select(F.col("fk").alias("pk"), F.col(TYPE).alias("t1"))
    typed = materialize(orders.join(t1, "pk"), "typed")
    up_domain = order_domain.project(group_by).with_attribute("t1", types)
    up = fit_groups(typed.withColumnRenamed("cust", "fk"), "fk", up_domain, GroupSettings(budget=share(0.3), types=types, steps=steps, cap=up_cap, seed=seed + 1))
    t2 = M.argmax_types(long_types(up.q, "fk"), "fk", [TYPE]).select(F.col("fk").alias("ck"), F.col(TYPE).alias("t2"))
    known = fit(customers.join(t2, "ck").select(*customer_domain, "t2"), customer_domain.with_attribute("t2", types), Settings(budget=share(0.2), iterations=60, seed=seed))
    drawn = with_types(customers, known, "ck", "t2", seed + 2)
    made = children_for(spark, up, drawn, "ck", "t2", seed + 3).drop("member")
    made = materialize(R.dense_ids(made, "pk", ["fk", *up_domain]).withColumnRenamed("fk", "cust"), "orders")
    rest = [a for a in order_domain if a not in group_by]
    if rest:
        full = order_domain.with_attribute("t1", types)
        m = fit(typed.select(*full), full, Settings(budget=share(0.2), iterations=60, seed=seed + 4), require=[tuple(up_domain)])
        done = m.synthesize(spark, fixed=made.select("pk", *up_domain), seed=seed + 5, key="pk")
        made = materialize(done.join(made.select("pk", "cust"), "pk"), "orders")
    filled = children_for(spark, low, made, "pk", "t1", seed + 6)
    return made.select("pk", "cust", *order_domain), filled.select("fk", "member", *line_domain)


def second_parent(model: GroupModel, lines: DataFrame, line_key: str, parents: DataFrame, parent_key: str, types: str, seed: int = 0) -> DataFrame:
    """(line_key, parent_key): a second foreign key for lines that exist already."""
    return J.match_by_model(model, lines, parents, line_key, parent_key, types, seed)
