"""What the training-data operators share: tables, shared-folder tables, checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkin.lineage import discard, materialize, shared_dir

__all__ = ["ascii_lower", "checked_broadcast", "discard", "let", "materialize", "numbered", "shared_dir", "shuffle_parts", "table"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows up to which a counted side may be broadcast; above it the join shuffles.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def checked_broadcast(small: DataFrame, rows: int | None = None) -> DataFrame:
    """small, marked for broadcast only if its counted rows are within BROADCAST_ROWS."""
    n = small.count() if rows is None else rows
    return F.broadcast(small) if n <= BROADCAST_ROWS else small


def ascii_lower(text: Column) -> Column:
    """A-Z only; a text of ASCII alone takes the faster built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def numbered(docs: DataFrame, *content: str) -> DataFrame:
    """docs with `row`: a long for each row that orders the rows by doc_id, nulls last.

    Where no doc_id is null or repeated (one narrow count tells), row is doc_id. Otherwise rows of one
    doc_id stand in order of a digest of `content`; the table is written once with its numbers, in ranges
    that split among equal rows too, so that no task gets all rows without an id.
    """
    key = F.col("doc_id").cast("long")
    rows, ids = docs.agg(F.count("*"), F.count_distinct(key)).first()
    if rows == ids:
        return docs.withColumn("row", key)
    order = [F.col("_r_id").asc_nulls_last(), F.col("_r_digest"), F.col("_r_tie")]
    tied = docs.withColumns({"_r_id": key, "_r_digest": F.xxhash64(*content), "_r_tie": F.monotonically_increasing_id()})
    ranged = tied.repartitionByRange(max(2, shuffle_parts(docs.sparkSession)), *order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn("row", F.monotonically_increasing_id()).drop("_r_id", "_r_digest", "_r_tie"), "numbered")
