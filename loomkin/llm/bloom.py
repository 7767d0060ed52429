"""Bloom filters as plain expressions: strings of 7-bit characters, of which one bit is tested for each hash."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkin.llm.common import checked_broadcast, let

#: Bits in a character.
WIDTH = 7
#: Most characters in a filter of ids, ids' share of its bits, and characters put together in one task.
MOST_CHARS, BITS_EACH, BLOCK = 4 << 20, 10, 1 << 12


def bit_at(key: Column, level: int, probe: Column, bits: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), probe), bits)


def bit_set(at: Column, body: Column) -> Column:
    char = F.ascii(F.substring(body, (F.floor(at / WIDTH) + 1).cast("int"), F.lit(1)).cast("string")).cast("long")
    return F.getbit(char, F.pmod(at, F.lit(WIDTH)).cast("int")) == 1


def accepted(key: Column, level: int, probes: int, bits: int, body: Column) -> Column:
    """Whether a filter accepts key, all its probes' bits being set; unrolled for a known number of probes."""
    out = F.lit(True)
    for j in range(probes):
        out = out & bit_set(bit_at(key, level, F.lit(j), F.lit(bits).cast("long")), body)
    return out


def packed(at: DataFrame, *by: str) -> DataFrame:
    """(by..., c, v): the bits of each character c, from positions (by..., at)."""
    return at.groupBy(*by, F.floor(F.col("at") / WIDTH).alias("c")).agg(F.expr(f"bit_or(shiftleft(1, cast(at % {WIDTH} as int)))").alias("v"))


def body_of(chars: Column) -> Column:
    """Characters from an array of structs (c, v)."""
    return F.array_join(F.transform(F.sort_array(chars), lambda x: F.char(x["v"])), "")


def passes(key: Column, keys: DataFrame, rows: int, most: int = MOST_CHARS) -> Column:
    """Whether key may be among the `rows` rows of keys (its only column). Of bounded size: with very many keys it lets more through."""
    if not rows:
        return F.lit(False)
    chars = min(most, -(-rows * BITS_EACH // WIDTH))
    bits = chars * WIDTH
    probes = min(6, max(1, round(bits / rows * math.log(2))))
    name = F.col(keys.columns[0])
    at = keys.select(F.explode(F.array(*(bit_at(name, 0, F.lit(j), F.lit(bits).cast("long")) for j in range(probes)))).alias("at"))
    grid = keys.sparkSession.range(chars).select(F.col("id").alias("c"), F.lit(0).alias("v"))
    full = packed(at).unionByName(grid).groupBy("c").agg(F.max("v").alias("v"))
    blocks = full.groupBy(F.floor(F.col("c") / BLOCK).alias("b")).agg(body_of(F.collect_list(F.struct("c", "v"))).alias("body"))
    body = "".join(r["body"] for r in blocks.orderBy("b").collect()).encode()
    return let(F.struct(key.alias("key"), F.lit(body).alias("body")), lambda x: accepted(x["key"], 0, probes, bits, x["body"]))


def without(docs: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """docs whose key is not among keys (its only column, distinct; a null key is one too).

    A small counted list is broadcast. Beside a longer one only the rows that pass its filter are shuffled.
    """
    same = docs[key].eqNullSafe(keys[keys.columns[0]])
    n = keys.count()
    if (small := checked_broadcast(keys, n)) is not keys or not n:
        return docs.join(small, same, "left_anti")
    may = passes(docs[key], keys, n)
    return docs.where(~may).unionByName(docs.where(may).join(keys, same, "left_anti"))
