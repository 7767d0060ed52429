"""Factors as long tables (attributes..., value): natural joins, projections, log-sum-exp, propagation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkin.lineage import materialize
from loomkin.model.domain import Domain
from loomkin.operators.marginals import dense

VALUE = "value"


def attrs_of(f: DataFrame) -> list[str]:
    return [c for c in f.columns if c != VALUE]


def combine(f: DataFrame, g: DataFrame, op: str) -> DataFrame:
    """Natural join on the shared attributes; `op` is one of + - * /, where 0 / 0 is 0. There must be a shared attribute."""
    shared = [a for a in attrs_of(f) if a in attrs_of(g)]
    if not shared:
        raise ValueError("factors without a common attribute are multiplied in the driver's dense form")
    met = f.withColumnRenamed(VALUE, "_x").join(g.withColumnRenamed(VALUE, "_y"), shared)
    x, y = F.col("_x"), F.col("_y")
    value = {"+": x + y, "-": x - y, "*": x * y, "/": F.when(y != 0, x / F.when(y != 0, y)).otherwise(0.0)}[op]
    return met.withColumn(VALUE, value).drop("_x", "_y")


def project(f: DataFrame, attrs: Sequence[str]) -> DataFrame:
    return f.groupBy(*attrs).agg(F.sum(VALUE).alias(VALUE))


def logsumexp(f: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """ln sum exp by attrs, shifted by the largest value of each cell."""
    top = f.groupBy(*attrs).agg(F.max(VALUE).alias("_m"))
    met = f.join(top, list(attrs)) if attrs else f.withColumn("_m", F.lit(f.agg(F.max(VALUE)).first()[0]))
    return met.groupBy(*attrs).agg((F.max("_m") + F.ln(F.sum(F.exp(F.col(VALUE) - F.col("_m"))))).alias(VALUE))


def at(f: DataFrame, given: Mapping[str, int]) -> DataFrame:
    for a, v in given.items():
        f = f.where(F.col(a) == v).drop(a)
    return f


def scaled(f: DataFrame, totals: DataFrame) -> DataFrame:
    """Rescaled so that its projection on totals' attributes equals totals."""
    return combine(f, combine(totals, project(f, attrs_of(totals)), "/"), "*")


def dot(f: DataFrame, g: DataFrame) -> DataFrame:
    return combine(f, g, "*").agg(F.sum(VALUE).alias(VALUE))


def mapped(f: DataFrame, fn) -> DataFrame:
    return f.withColumn(VALUE, fn(F.col(VALUE)))


def zeros(spark, domain: Domain) -> DataFrame:
    empty = spark.createDataFrame([], ", ".join([*(f"{a} int" for a in domain), "n long"]))
    return dense(empty, domain).withColumnRenamed("n", VALUE).withColumn(VALUE, F.col(VALUE).cast("double"))


def propagate_tree(potentials: Mapping[tuple[str, ...], DataFrame], messages: Sequence[tuple[tuple[str, ...], tuple[str, ...]]], total: Column | float = 1.0) -> dict[tuple[str, ...], DataFrame]:
    """Clique marginals, scaled to total, of log-potentials over a junction tree, as long tables.

    messages: directed (from, to) in an order in which every message has those it needs before it. Each is
    the sender's belief, less what came from the receiver, summed onto their shared attributes.
    """
    beliefs, sent = dict(potentials), {}
    for a, b in messages:
        sep = [x for x in a if x in b]
        out = beliefs[a] if (b, a) not in sent else combine(beliefs[a], mapped(sent[b, a], lambda v: -v), "+")
        sent[a, b] = materialize(logsumexp(out, sep), "message")
        beliefs[b] = materialize(combine(beliefs[b], sent[a, b], "+"), "belief")

    def normal(b: DataFrame) -> DataFrame:
        z = logsumexp(b, []).first()[0]
        return mapped(b, lambda v: F.exp(v - z) * total)

    return {c: normal(b) for c, b in beliefs.items()}


def log_probabilities(rows: DataFrame, potentials: Mapping[tuple[str, ...], DataFrame], log_z: float, key: str | None = None) -> DataFrame:
    """rows with `log_p`, the log-probability of each record; with a key (key, n, log_p) of its group, the sum over its records.

    Each clique's long table is joined on its attributes, one after the other; a record outside a table has none.
    """
    out = rows.withColumn("log_p", F.lit(-float(log_z)))
    for f in potentials.values():
        own = attrs_of(f)
        met = out.join(f.withColumnRenamed(VALUE, "_f"), own, "left")
        out = met.withColumn("log_p", F.col("log_p") + F.col("_f")).drop("_f")
    if key is None:
        return out.select(*rows.columns, "log_p")
    return out.groupBy(key).agg(F.count("*").alias("n"), F.when(F.count("log_p") == F.count("*"), F.sum("log_p")).alias("log_p"))


def propagate_pair(f: DataFrame, g: DataFrame, total: Column | float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Clique marginals, scaled to total, of two log-potentials that share a separator."""
    sep = [a for a in attrs_of(f) if a in attrs_of(g)]
    belief_g = combine(g, logsumexp(f, sep), "+")
    belief_f = combine(f, combine(logsumexp(belief_g, sep), logsumexp(f, sep), "-"), "+")

    def normal(b: DataFrame) -> DataFrame:
        z = logsumexp(b, []).first()[0]
        return mapped(b, lambda v: F.exp(v - z) * total)

    return normal(belief_f), normal(belief_g)
