"""The star schema in the roles of this engine: lineitem rows are children of orders, orders of customers.

Codes are whole numbers from 0. The child's key is its place in its group under a total order of all
columns, since (order, line number) repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomkin.model.domain import Attribute, Domain
from loomkin.sources.io import read_parquet

CHILD_DOMAIN = Domain({"rf": 3, "ls": 2, "qty": Attribute(50, "continuous"), "disc": Attribute(11, "continuous"), "tax": Attribute(9, "continuous"), "ln": Attribute(7)})
PARENT_DOMAIN = Domain({"st": 3, "pri": 5, "yr": 7, "mon": 12, "day": Attribute(31, "continuous")})
TOTAL_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def child(spark: SparkSession, folder: str) -> DataFrame:
    """fk and the coded attributes."""
    t = read_parquet(spark, folder, "lineitem")
    return t.select(
        F.col("l_orderkey").alias("fk"),
        (F.expr("instr('ANR', l_returnflag)") - 1).cast("int").alias("rf"),
        (F.expr("instr('FO', l_linestatus)") - 1).cast("int").alias("ls"),
        (F.col("l_quantity").cast("int") - 1).alias("qty"),
        F.round(F.col("l_discount") * 100).cast("int").alias("disc"),
        F.round(F.col("l_tax") * 100).cast("int").alias("tax"),
        (F.col("l_linenumber") - 1).cast("int").alias("ln"),
    )


def keyed_child(spark: SparkSession, folder: str) -> DataFrame:
    """child with rn, the row's place in its group, and pk."""
    t = read_parquet(spark, folder, "lineitem")
    own = t.withColumn("rn", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*TOTAL_ORDER)))
    return own.select(
        F.col("l_orderkey").alias("fk"), F.col("rn").cast("int").alias("rn"), (F.col("l_orderkey") * 100 + F.col("rn")).alias("pk"),
        (F.expr("instr('ANR', l_returnflag)") - 1).cast("int").alias("rf"), (F.expr("instr('FO', l_linestatus)") - 1).cast("int").alias("ls"),
        (F.col("l_quantity").cast("int") - 1).alias("qty"), F.round(F.col("l_discount") * 100).cast("int").alias("disc"),
    )


def parent(spark: SparkSession, folder: str) -> DataFrame:
    t = read_parquet(spark, folder, "orders")
    return t.select(
        F.col("o_orderkey").alias("pk"), F.col("o_custkey").alias("cust"), (F.expr("instr('FOP', o_orderstatus)") - 1).cast("int").alias("st"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("pri"), (F.year("o_orderdate") - 1995).cast("int").alias("yr"),
        (F.month("o_orderdate") - 1).cast("int").alias("mon"), (F.dayofmonth("o_orderdate") - 1).cast("int").alias("day"),
    )


#: The same tables in SQL, as common table expressions.
CHILD = """c AS (
  SELECT l_orderkey AS fk, instr('ANR', l_returnflag) - 1 AS rf, instr('FO', l_linestatus) - 1 AS ls, CAST(l_quantity AS INT) - 1 AS qty,
         CAST(round(l_discount * 100) AS INT) AS disc, CAST(round(l_tax * 100) AS INT) AS tax, l_linenumber - 1 AS ln FROM lineitem)"""
KEYED = """k AS (
  SELECT l_orderkey AS fk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn,
         instr('ANR', l_returnflag) - 1 AS rf, instr('FO', l_linestatus) - 1 AS ls, CAST(l_quantity AS INT) - 1 AS qty, CAST(round(l_discount * 100) AS INT) AS disc FROM lineitem)"""
PARENT = """p AS (
  SELECT o_orderkey AS pk, o_custkey AS cust, instr('FOP', o_orderstatus) - 1 AS st, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS pri,
         CAST(year(o_orderdate) - 1995 AS INT) AS yr, CAST(month(o_orderdate) - 1 AS INT) AS mon, CAST(day(o_orderdate) - 1 AS INT) AS day FROM orders)"""
