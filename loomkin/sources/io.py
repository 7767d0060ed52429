"""Reading and writing tables, domains, artefacts and models."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomkin.functions.hierarchy import Node, dumps, loads
from loomkin.model.domain import Domain, TableSpec

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", header: bool = True) -> DataFrame:
    """CSV with a given schema; without one all columns are strings (no pass over the data to infer types)."""
    reader = spark.read.option("header", header).option("sep", sep)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_tbl(spark: SparkSession, path: str, schema: str, drop_last: int = 2) -> DataFrame:
    """Pipe-delimited rows without a header; the last columns (a comment and the empty one after the last bar) go."""
    df = read_csv(spark, path, schema, sep="|", header=False)
    return df.drop(*df.columns[len(df.columns) - drop_last :]) if drop_last else df


def convert_delimited(spark: SparkSession, source: str, target: str, sep: str) -> None:
    """A delimited text file to CSV, column by column as text."""
    df = spark.read.option("sep", sep).csv(source)
    df.write.mode("overwrite").csv(target)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def read_table(df: DataFrame, spec: TableSpec, ratio: float = 1.0, check: bool = True) -> DataFrame:
    """The table's own columns, its key checked; with ratio < 1 the first rows in key order, or the first groups of a child.

    The share is taken by a hash-free rule (order of the key), so a larger ratio always holds the smaller one.
    """
    out = spec.select(df)
    if check and duplicate_keys(out, spec.pk).limit(1).count():
        raise ValueError(f"{spec.pk} is not unique")
    if ratio >= 1:
        return out
    key = spec.fk or spec.pk
    keys = out.select(key).distinct()
    cut = keys.approxQuantile(key, [ratio], 0.0)
    return out.where(F.col(key) <= cut[0]) if cut else out


def load_domain(path: str, spark: SparkSession) -> Domain:
    """A domain from a JSON file wherever Spark can read it."""
    return Domain.from_json("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def save_json(spark: SparkSession, value: object, path: str) -> None:
    """A small run artefact (edge scores, graph, marginal list, query list, counts) as one JSON line."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path).first()[0])


def save_model(spark: SparkSession, factors: Mapping[tuple[str, ...], object], domain: Domain, path: str) -> None:
    """A model as long factors in Parquet beside its domain in JSON; nothing is pickled."""
    import numpy as np

    rows = [("\x1f".join(c), int(i), float(v)) for c, f in factors.items() for i, v in enumerate(np.asarray(f.values).ravel())]
    spark.createDataFrame(rows, "clique string, cell long, value double").write.mode("overwrite").parquet(f"{path}/factors")
    save_json(spark, json.loads(domain.to_json()), f"{path}/domain")


def load_model(spark: SparkSession, path: str):
    """(factors by clique, domain) as saved."""
    import numpy as np

    from loomkin.model.factor import Factor

    domain = Domain.from_json(json.dumps(load_json(spark, f"{path}/domain")))
    factors = {}
    for r in spark.read.parquet(f"{path}/factors").groupBy("clique").agg(F.sort_array(F.collect_list(F.struct("cell", "value"))).alias("cells")).collect():
        clique = tuple(r["clique"].split("\x1f"))
        own = domain.project(clique)
        factors[clique] = Factor(own, np.array([c["value"] for c in r["cells"]]).reshape(own.shape))
    return factors, domain


def read_preprocessed(spark: SparkSession, path: str, task: str, key: str, folds: int = 5, fold: int = 0, seed: int = 0):
    """(rows, domain, hierarchies) of a table that write_preprocessed left in path; all rows for the task `TVD`, else those outside the test fold."""
    domain = Domain.from_json(json.dumps(load_json(spark, f"{path}/domain")))
    trees = loads(json.dumps(load_json(spark, f"{path}/hierarchy")))
    rows = spark.read.parquet(f"{path}/rows")
    if task != "TVD":
        rows = train_test(rows, key, seed, folds).where(F.col("fold") != fold).drop("fold")
    return rows, domain, trees


def write_preprocessed(df: DataFrame, domain: Domain, trees: Mapping[str, Node], path: str) -> None:
    """Coded rows, their domain and their attributes' hierarchies, for read_preprocessed."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    save_json(df.sparkSession, json.loads(domain.to_json()), f"{path}/domain")
    save_json(df.sparkSession, json.loads(dumps(dict(trees))), f"{path}/hierarchy")


def train_test(df: DataFrame, key: str, seed: int = 0, folds: int = 5) -> DataFrame:
    """df with `fold` 0 .. folds - 1 by a digest of the key: the same split on any cluster and engine, without a shuffle."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return df.withColumn("fold", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % folds).cast("int"))


def first_rows(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group in a total order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")
