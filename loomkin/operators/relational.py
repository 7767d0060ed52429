"""Keys, joins, group filters and matching of parent and child tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomkin.lineage import materialize


def project(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    return df.select(*attrs)


def drop_attrs(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    return df.drop(*attrs)


def requires(needs: Mapping[str, Sequence]) -> Column:
    """Conjunction of set memberships, one an attribute."""
    out = F.lit(True)
    for attr, values in needs.items():
        out = out & F.col(attr).isin(list(values))
    return out


#: Rows up to which a counted side is broadcast.
SMALL_ROWS = 200_000
#: monotonically_increasing_id() has the partition above these bits and the row's place in it below.
_PLACE_BITS = 33


def _in_ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df written in sorted ranges of a total order, with `_at` (range << _PLACE_BITS | place): a lost executor can't renumber it."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")


def _starts(ranged: DataFrame, what: Column) -> DataFrame:
    """(_part, _start): the sum of `what` over the ranges before each one; one number a range passes the driver."""
    rows, at = [], 0
    for r in ranged.groupBy(F.shiftright("_at", _PLACE_BITS).alias("_part")).agg(F.sum(what).alias("n")).orderBy("_part").collect():
        rows.append((r["_part"], at))
        at += r["n"] or 0
    return F.broadcast(ranged.sparkSession.createDataFrame(rows or [(0, 0)], "_part long, _start long"))


def dense_ids(df: DataFrame, name: str, order: Sequence[str], offset: int = 0) -> DataFrame:
    """Ids offset, offset + 1, ... in a total order.

    Rows are written in ranges of the order; each numbers its own rows and starts where the ranges before
    it end, so no task sees all rows.
    """
    ranged = _in_ranges(df, order)
    met = ranged.withColumn("_part", F.shiftright("_at", _PLACE_BITS)).join(_starts(ranged, F.lit(1)), "_part")
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return met.withColumn(name, (F.col("_start") + place + offset).cast("long")).drop("_part", "_at", "_start")


def running_total(df: DataFrame, value: str, name: str, order: Sequence[str]) -> DataFrame:
    """df with the sum of `value` over the rows before each one in a total order, added up range by range."""
    ranged = _in_ranges(df, order)
    met = ranged.withColumn("_part", F.shiftright("_at", _PLACE_BITS)).join(_starts(ranged, F.col(value)), "_part")
    own = F.sum(value).over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    return met.withColumn(name, F.col("_start") + F.coalesce(own, F.lit(0))).drop("_part", "_at", "_start")


def numbered_within(df: DataFrame, by: Sequence[str], key: str, name: str) -> DataFrame:
    """df with a gapless number from 0 in each group of `by`, in order of a unique key.

    Groups may be few and as large as the table, so no task takes a group: rows are numbered in ranges of
    (by, key) over the whole table, less the number at which their group begins.
    """
    ids = dense_ids(df, name, [*by, key])
    first = ids.groupBy(*by).agg(F.min(name).alias("_first"))
    return ids.join(F.broadcast(first) if first.count() <= SMALL_ROWS else first, list(by)).withColumn(name, F.col(name) - F.col("_first")).drop("_first")


def with_group_size(child: DataFrame, fk: str, name: str = "group_size") -> DataFrame:
    return child.join(child.groupBy(fk).agg(F.count("*").alias(name)), fk)


def split_singles(child: DataFrame, fk: str) -> tuple[DataFrame, DataFrame]:
    """Rows of groups of one, and the rest."""
    sized = with_group_size(child, fk)
    return sized.where("group_size = 1").drop("group_size"), sized.where("group_size > 1").drop("group_size")


def cap_groups(child: DataFrame, fk: str, most: int, order: Sequence[str] | None = None, seed: int = 0, key: Sequence[str] = ()) -> DataFrame:
    """At most `most` rows a group: the first in a given order, or a uniform subset by a seeded hash of the key.

    Hash order does not depend on partitioning. Spark keeps only the first rows of a group per task
    before the shuffle (a group limit), so a very large group is cut where it lies.
    """
    by = [F.col(c) for c in order] if order else [F.xxhash64(F.lit(seed), *(F.col(k) for k in key)), *(F.col(k) for k in key)]
    return child.withColumn("_rn", F.row_number().over(W.partitionBy(fk).orderBy(*by))).where(F.col("_rn") <= most).drop("_rn")


def first_of_group(child: DataFrame, fk: str, order: Sequence[str]) -> DataFrame:
    """One row a group: its first in a total order, by an aggregate that combines before the shuffle."""
    rest = [c for c in child.columns if c != fk and c not in order]
    first = child.groupBy(fk).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return first.select(fk, *(F.col(f"_r.{c}").alias(c) for c in (*order, *rest)))


def join_parent(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows with their parent's attributes (inner)."""
    return child.join(parent, child[fk] == parent[pk]).drop(parent[pk])


def childless(parent: DataFrame, child: DataFrame, pk: str, fk: str) -> DataFrame:
    return parent.join(child.select(F.col(fk).alias("_fk")), F.col(pk) == F.col("_fk"), "left_anti")


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    return child.join(parent.select(F.col(pk).alias("_pk")), F.col(fk) == F.col("_pk"), "left_anti")


def integrity(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """One row: child rows without a parent, parents without a child, and both totals."""
    c = child.groupBy(F.col(fk).alias("k")).agg(F.count("*").alias("rows"))
    both = parent.select(F.col(pk).alias("k")).withColumn("p", F.lit(1)).join(c, "k", "full")
    count = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return both.agg(
        count(F.when(F.col("p").isNull(), F.col("rows"))).alias("orphans"), count(F.when(F.col("rows").isNull(), 1)).alias("childless"),
        count(F.col("rows")).alias("child_rows"), count(F.col("p")).alias("parents"),
    )


def keep_groups(child: DataFrame, keys: DataFrame, fk: str, key: str) -> DataFrame:
    """Groups whose key is among keys."""
    return child.join(keys.select(F.col(key).alias("_k")), F.col(fk) == F.col("_k"), "left_semi")


def sample_parents(parent: DataFrame, child: DataFrame, pk: str, fk: str, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """n parents by a seeded hash of their key, and their groups; a childless parent stays, with an empty group."""
    some = parent.orderBy(F.xxhash64(F.lit(seed), F.col(pk)), pk).limit(n)
    return some, keep_groups(child, some, fk, pk)


def attach_types(parent: DataFrame, types: DataFrame, pk: str, fk: str, columns: Sequence[str], types_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parents extended by their group's types, and the parents without a group."""
    own = types.select(F.col(fk).alias("_fk"), *columns)
    met = parent.join(own, F.col(pk) == F.col("_fk")).drop("_fk")
    rest = [c for c in parent.columns if c != pk]
    ordered = [pk, *columns, *rest] if types_first else [pk, *rest, *columns]
    return met.select(*ordered), parent.join(own, F.col(pk) == F.col("_fk"), "left_anti")


def zip_by_type(left: DataFrame, right: DataFrame, types: Sequence[str], left_key: str, right_key: str) -> DataFrame:
    """(left_key, right_key, types...): within a type the i-th left key with the i-th right key."""
    a = numbered_within(left.select(left_key, *types), types, left_key, "_i")
    b = numbered_within(right.select(right_key, *types), types, right_key, "_i")
    return a.join(b, [*types, "_i"]).select(left_key, right_key, *types)


def zip_sorted(left: DataFrame, right: DataFrame, columns: Sequence[str], left_key: str, right_key: str) -> DataFrame:
    """(left_key, right_key): both sides in order of all columns, i-th with i-th."""
    a = dense_ids(left.select(left_key, *columns), "_i", [*columns, left_key]).select("_i", left_key)
    b = dense_ids(right.select(right_key, *columns), "_i", [*columns, right_key]).select("_i", right_key)
    return a.join(b, "_i").select(left_key, right_key)


def union_tables(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def zip_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The columns of both tables side by side, by key."""
    return left.join(right, key)


def top_k(df: DataFrame, score: str, k: int, tie: Sequence[str]) -> DataFrame:
    return df.orderBy(F.desc(score), *tie).limit(k)


def shuffled(df: DataFrame, key: Sequence[str], seed: int) -> DataFrame:
    """Rows in a reproducible random order."""
    return df.orderBy(F.xxhash64(F.lit(seed), *(F.col(k) for k in key)), *key)
