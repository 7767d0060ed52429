"""Encodings: dictionaries, digit split and merge, composite keys, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkin.model.domain import Domain
from loomkin.operators.relational import dense_ids, running_total

#: Attributes with more codes than this are split into two digits.
SPLIT_OVER = 20
#: Rows up to which a counted dictionary is broadcast.
BROADCAST_ROWS = 200_000


def dictionary(df: DataFrame, attr: str) -> DataFrame:
    """(value, code): distinct values in order, coded 0, 1, ...; numbered in ranges, so that no task sees all values."""
    values = df.select(F.col(attr).alias("value")).where(F.col(attr).isNotNull()).distinct()
    return dense_ids(values, "code", ["value"]).withColumn("code", F.col("code").cast("int"))


def _small(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def encode(df: DataFrame, attr: str, words: DataFrame, to: str | None = None) -> DataFrame:
    """df with attr's codes in `to` (in place of attr by default). Unknown values become null."""
    out = df.join(_small(words.select(F.col("value").alias("_value"), F.col("code").alias("_code"))), F.col(attr) == F.col("_value"), "left")
    return out.withColumn(to or attr, F.col("_code")).drop("_value", "_code")


def decode(df: DataFrame, attr: str, words: DataFrame, to: str | None = None) -> DataFrame:
    out = df.join(_small(words.select(F.col("value").alias("_value"), F.col("code").alias("_code"))), F.col(attr) == F.col("_code"), "left")
    return out.withColumn(to or attr, F.col("_value")).drop("_value", "_code")


def split_domain(domain: Domain, over: int = SPLIT_OVER) -> Domain:
    """The domain after split_digits; the high digit's size follows from the declared size, not from the data."""
    out: dict[str, int] = {}
    for a, x in domain.items():
        out |= {f"{a}_hi": -(-x.size // 10), f"{a}_lo": 10} if x.size > over else {a: x.size}
    return Domain(out)


def split_digits(df: DataFrame, domain: Domain, over: int = SPLIT_OVER) -> DataFrame:
    """Each attribute with more than `over` codes becomes its tens and units."""
    wide = [a for a, x in domain.items() if x.size > over]
    cols: list[Column] = []
    for c in df.columns:
        cols += [F.floor(F.col(c) / 10).cast("int").alias(f"{c}_hi"), F.pmod(F.col(c), F.lit(10)).cast("int").alias(f"{c}_lo")] if c in wide else [F.col(c)]
    return df.select(*cols)


def merge_digits(df: DataFrame, domain: Domain, over: int = SPLIT_OVER) -> DataFrame:
    """The inverse of split_digits; what exceeds the domain is clamped to its last code."""
    cols: list[Column] = []
    for c in df.columns:
        a = c[:-3]
        if c.endswith("_hi") and a in domain and domain[a].size > over:
            cols.append(F.least(F.col(c) * 10 + F.col(f"{a}_lo"), F.lit(domain[a].size - 1)).cast("int").alias(a))
        elif not (c.endswith("_lo") and a in domain and domain[a].size > over):
            cols.append(F.col(c))
    return df.select(*cols)


def packing_base(df: DataFrame, low: str) -> int:
    """max + 1 of the low key: one scalar on the driver."""
    return int(df.agg(F.max(low)).first()[0] or 0) + 1


def pack_key(high: Column, low: Column, base: int) -> Column:
    """high * base + low in whole numbers; null where that exceeds a long."""
    return F.try_add(F.try_multiply(high.cast("long"), F.lit(base).cast("long")), low.cast("long"))


def unpack_key(key: Column, base: int) -> tuple[Column, Column]:
    """The two parts of a packed key, by whole division."""
    low = F.pmod(key.cast("long"), F.lit(base).cast("long"))
    return F.call_function("div", key.cast("long") - low, F.lit(base).cast("long")), low


def equal_width(value: Column, least: float, most: float, bins: int = 16) -> Column:
    """The smallest id with value <= least + (id + 1) * width + 1 (the slack of one belongs to the rule)."""
    width = (most - least) / bins
    return F.greatest(F.ceil((value - 1 - least) / width) - 1, F.lit(0)).cast("int") if width else F.lit(0)


def equal_frequency(counts: DataFrame, bins: int) -> DataFrame:
    """(value, bin) from (value, n): values in order, a bin closed as soon as the running count reaches its share.

    Each value goes whole into one bin: the first whose share its predecessors leave unfinished.
    """
    total = counts.agg(F.sum("n")).first()[0] or 1
    run = running_total(counts.select("value", "n"), "n", "before", ["value"])
    return run.select("value", F.least(F.floor(F.col("before") * bins / F.lit(total)), F.lit(bins - 1)).cast("int").alias("bin"))


def clip_negative(value: Column) -> Column:
    return F.greatest(value, F.lit(0))


def mixed_radix(cell: Column, domain: Domain) -> list[Column]:
    """The attributes' codes of a flat cell number, first attribute slowest."""
    out, rest = [], domain.cells()
    for a, x in domain.items():
        rest //= x.size
        out.append(F.pmod(F.floor(cell / rest), F.lit(x.size)).cast("int").alias(a))
    return out


def flat_cell(domain: Domain, col=F.col) -> Column:
    """The flat cell number of the attributes' codes."""
    out: Column = F.lit(0).cast("long")
    for a, x in domain.items():
        out = out * x.size + col(a)
    return out
