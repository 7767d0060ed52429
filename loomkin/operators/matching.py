"""Foreign keys for existing rows: greedy multi-column matching, and matching through a fitted group model."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkin.lineage import materialize
from loomkin.operators.relational import numbered_within


def greedy_match(left: DataFrame, right: DataFrame, columns: Sequence[str], left_key: str, right_key: str, keep: bool = False) -> DataFrame:
    """(left_key, right_key): a bijection of two tables with equally many rows, close column by column.

    All rows start in one node. For each column, rows of a node with equal values pair up as far as they
    go; what is left over of the node pairs up in key order. A right row takes its partner's value as its
    node, so after the last column a node's rows are paired. One shuffle a column and side, on the node.

    The node of a row is a digest of its partner's values so far; a first column with few values makes
    large nodes, whose value runs are numbered in ranges of the whole table and need no single task.

    keep: the matched values of both sides are returned too.
    """
    a = left.select(left_key, *columns).withColumn("_node", F.lit(0).cast("long"))
    b = right.select(right_key, *columns).withColumn("_node", F.lit(0).cast("long"))
    matched = None
    for k, c in enumerate(columns):
        last = k == len(columns) - 1
        a = numbered_within(a, ["_node", c], left_key, "_i")
        b = numbered_within(b, ["_node", c], right_key, "_i")
        pairs = a.select("_node", c, "_i", F.col(left_key).alias("_l")).join(b.select("_node", c, "_i", F.col(right_key).alias("_r")), ["_node", c, "_i"], "full")
        pairs = materialize(pairs, "pairs")
        hit = pairs.where(F.col("_l").isNotNull() & F.col("_r").isNotNull()).select("_l", "_r", "_node", F.col(c).alias("_v"))
        rest_l = numbered_within(pairs.where(F.col("_r").isNull()).select("_node", F.col(c).alias("_v"), "_l"), ["_node"], "_l", "_j")
        rest_r = numbered_within(pairs.where(F.col("_l").isNull()).select("_node", "_r"), ["_node"], "_r", "_j")
        matched = hit.unionByName(rest_l.join(rest_r, ["_node", "_j"]).select("_l", "_r", "_node", "_v"))
        if not last:
            # the pairing is only a step: sides keep the node (the left row's value) and pair anew on the next column
            node = F.xxhash64("_node", "_v")
            held = materialize(matched.select("_l", "_r", node.alias("_next")), "matched")
            a = a.drop("_i", "_node").join(held.select(F.col("_l").alias(left_key), F.col("_next").alias("_node")), left_key)
            b = b.drop("_i", "_node").join(held.select(F.col("_r").alias(right_key), F.col("_next").alias("_node")), right_key)
            a, b = materialize(a, "left"), materialize(b, "right")
    out = matched.select(F.col("_l").alias(left_key), F.col("_r").alias(right_key))
    if keep:
        out = out.join(left.select(left_key, *(F.col(c).alias(f"left_{c}") for c in columns)), left_key)
        out = out.join(right.select(right_key, *(F.col(c).alias(f"right_{c}") for c in columns)), right_key)
    return out


def agreement(matched: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: pairs, and for each column the pairs that agree on it."""
    same = lambda c: F.sum(F.when(F.col(f"left_{c}") == F.col(f"right_{c}"), 1).otherwise(0)).cast("long").alias(c)
    return matched.agg(F.count("*").alias("pairs"), *(same(c) for c in columns))


def match_by_model(model, child: DataFrame, parents: DataFrame, child_key: str, parent_key: str, type_column: str, seed: int = 0) -> DataFrame:
    """(child_key, parent_key): foreign keys for existing child rows.

    Groups are synthesised for the parents' type histogram with as many members as there are rows, each
    synthetic group is given to a parent of its type, and the real rows are matched to the synthetic
    members; a row takes its member's parent. With fewer rows than parents some parents get none.
    """
    spark = child.sparkSession
    hist = np.zeros(model.types, np.int64)
    for r in parents.groupBy(type_column).agg(F.count("*").alias("n")).collect():
        hist[r[type_column]] = r["n"]
    members = model.synthesize(spark, types=hist, seed=seed, rows=child.count())
    groups = numbered_within(members.select("gid", "y").distinct(), ["y"], "gid", "_i")
    given = numbered_within(parents.select(parent_key, F.col(type_column).alias("y")), ["y"], parent_key, "_i")
    owner = groups.join(given, ["y", "_i"]).select("gid", parent_key)
    span = (members.agg(F.max("member")).first()[0] or 0) + 1
    keyed = members.withColumn("_m", F.col("gid") * F.lit(span).cast("long") + F.col("member"))
    found = greedy_match(child, keyed, model.observed(), child_key, "_m")
    return found.join(keyed.select("_m", "gid"), "_m").join(owner, "gid").select(child_key, parent_key)


def refine_and_match(child: DataFrame, columns: Sequence[str], child_key: str, sample, member_key: str, given: Sequence[str] = ()) -> DataFrame:
    """(child_key, member_key): the top-down form of the matcher.

    `sample(assigned, column)` draws the next column for all members, given the real values of the columns
    before it; the drawn rows are matched to real ones of the same values so far, and their drawn value
    is overwritten with the real one. `sample(None, None)` gives the members with the columns of `given`.
    """
    members, done = sample(None, None), list(given)
    pairs = None
    for c in columns:
        drawn = sample(members, c)
        pairs = greedy_match(child, drawn, [*done, c], child_key, member_key)
        real = pairs.join(child.select(child_key, F.col(c).alias("_real")), child_key).select(member_key, "_real")
        members = drawn.drop(c).join(real, member_key).withColumnRenamed("_real", c)
        done.append(c)
    return pairs
