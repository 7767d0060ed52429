"""Minimax contiguous sharding.

Groups of equal texts are atomic and stand in the order of their first doc_id. The smallest capacity
for which a greedy walk over the ordered group sizes needs no more shards than asked for is found by
binary search; the cuts of that walk are the shards' borders.

Group sizes and their running sums stay distributed, in sorted ranges. The driver knows some of the
sums, at first each range's last one. Between two known sums a walk can be bounded from both sides: cuts
at known sums come too early, cuts at the full capacity too late. The smallest capacities feasible by
the one and by the other bound the smallest feasible one; the stretches that walks between the two can
cut in are then read more closely, a bounded number of sums a pass, until both agree and the walk's
cuts are known themselves.

Defined results: a null text counts as empty (size 1, CRC 0) and belongs with the empty texts. Groups
without any doc_id stand last, in order of their text's digest. Rows without a doc_id, or with a
repeated one, get a slot each. With fewer groups than shards, the last shards are empty. An empty table
gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkin.llm.common import materialize, shuffle_parts, table

SHARDS = 8
#: Running sums read in one pass at most, and ranges that tables are sorted in at most.
SUMS_AT_ONCE, RANGES = 1 << 16, 4096


#: monotonically_increasing_id() has the partition above these bits and the row's place in it below.
PLACE_BITS = 33


def _in_ranges(df: DataFrame, *order) -> DataFrame:
    """df in sorted ranges of `order`, with each row's range and place in it as one number `at`; equal rows may lie in several ranges."""
    n = min(RANGES, max(2, shuffle_parts(df.sparkSession)))
    tied = df.withColumn("_s_tie", F.monotonically_increasing_id())
    keys = [*order, F.col("_s_tie")]
    return tied.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_s_tie").withColumn("at", F.monotonically_increasing_id())


def _part() -> Column:
    return F.shiftright("at", PLACE_BITS).cast("int")


def _place() -> Column:
    return F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def _running_weights(batches):
    """Adds `own`, the running sum of the weights (the second column) of a task."""
    total = 0
    for batch in batches:
        sums = total + np.cumsum(batch.column(1).to_numpy(zero_copy_only=False))
        total = int(sums[-1]) if len(sums) else total
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], names=[*batch.schema.names, "own"])


def _offsets(df: DataFrame, rows: list, schema: str) -> DataFrame:
    """A driver table of at most RANGES rows, for broadcast."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


class Sums:
    """What the driver knows of the ordered groups: ends (running sums) with their index in the whole order, both ascending from 0."""

    def __init__(self, parts: list[tuple[int, int, int]]) -> None:
        """parts: (part, groups, sum) of the ranges in their order."""
        self.parts = parts
        self.ends, self.at = [0], [0]
        self.before: dict[int, tuple[int, int]] = {}
        for part, n, total in parts:
            self.before[part] = self.at[-1], self.ends[-1]
            self.at.append(self.at[-1] + n)
            self.ends.append(self.ends[-1] + total)

    @property
    def total(self) -> int:
        return self.ends[-1]

    def add(self, found: list[tuple[int, int]]) -> None:
        merged = sorted({*zip(self.at, self.ends, strict=True), *found})
        self.at, self.ends = [x[0] for x in merged], [x[1] for x in merged]

    def open(self, k: int) -> bool:
        """Whether there are unknown sums after the k-th known one."""
        return k + 1 < len(self.at) and self.at[k + 1] - self.at[k] > 1

    def walk(self, capacity: int, shards: int, late: bool) -> list[int]:
        """Cuts of a greedy walk; those at unknown sums come too early, or (late) too late."""
        cuts, pos = [], 0
        for _ in range(shards):
            k = bisect_right(self.ends, pos + capacity) - 1
            pos = min(pos + capacity, self.ends[k + 1] - 1) if late and self.open(k) else self.ends[k]
            cuts.append(pos)
        return cuts

    def smallest(self, low: int, high: int, shards: int, late: bool) -> int:
        """The smallest capacity in low..high whose walk reaches the end; high's does."""
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.walk(mid, shards, late)[-1] == self.total else (mid + 1, high)
        return high

    def stretches(self, low: int, high: int, shards: int) -> list[int]:
        """Known sums with unknown ones after them in which a walk of a capacity in low..high may cut."""
        wanted: set[int] = set()
        early, late = [0, *self.walk(low, shards, False)], [0, *self.walk(high, shards, True)]
        for a, b in zip(early[:-1], late[:-1], strict=True):
            first, last = (bisect_right(self.ends, x) - 1 for x in (a + low, b + high))
            wanted.update(k for k in range(first, last + 1) if self.open(k))
        return sorted(wanted)


def minimax_cuts(prefix: DataFrame, sums: Sums, shards: int, heaviest: int) -> list[int]:
    """The greedy cuts for the smallest feasible capacity. prefix: (part, own, index), the running sums in each part."""
    low, high = max(heaviest, -(-sums.total // shards)), max(heaviest, sums.total)
    while True:
        low, high = sums.smallest(low, high, shards, True), sums.smallest(low, high, shards, False)
        cuts = sums.walk(high, shards, False)
        if low == high and cuts == sums.walk(high, shards, True):
            return cuts
        stretches = sums.stretches(low, high, shards)
        each = max(16, SUMS_AT_ONCE // len(stretches))
        wanted: dict[int, list[tuple[int, int, int]]] = {}
        firsts = [sums.before[p][0] for p, _, _ in sums.parts]
        for k in stretches:
            part = sums.parts[bisect_right(firsts, sums.at[k]) - 1][0]
            # the known sum number i is the sum up to the group of index i - 1
            after, before = (sums.at[j] - sums.before[part][0] - 1 for j in (k, k + 1))
            wanted.setdefault(part, []).append((after, before, max(1, (before - after) // each)))
        rows = prefix.where(F.col("part").isin(sorted(wanted))).mapInArrow(_sums_at(wanted), "part int, index long, own long").collect()
        sums.add([(r["index"] + 1 + sums.before[r["part"]][0], r["own"] + sums.before[r["part"]][1]) for r in rows])


def _sums_at(wanted: dict[int, list[tuple[int, int, int]]]):
    """Rows (part, index, own) at every step-th index between two of a part: wanted[part] has (after, before, step), in order."""

    def run(batches):
        for batch in batches:
            part, own, index = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("part", "own", "index"))
            for p in np.unique(part).tolist():
                after, before, step = (np.array(c) for c in zip(*wanted[p], strict=True))
                mine = part == p
                i, sums = index[mine], own[mine]
                k = np.searchsorted(after, i, side="left") - 1
                ok = (k >= 0) & (i < before[k]) & ((i - after[k]) % step[k] == 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(ok.sum()), p, np.int32)), pa.array(i[ok]), pa.array(sums[ok])], names=["part", "index", "own"])

    return run


def minimax_shards(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows (doc_id, key, size, ...) with `shard` and the gapless `slot` in it."""
    groups = rows.groupBy("key").agg(F.sum("size").alias("weight"), F.min("doc_id").alias("first"))
    ranged = _in_ranges(groups, F.col("first").asc_nulls_last(), F.col("key")).select("key", "weight", "at")
    prefix = materialize(ranged.mapInArrow(_running_weights, T.StructType([*ranged.schema.fields, T.StructField("own", T.LongType())])), "prefix")
    prefix = prefix.withColumn("part", _part())
    totals = prefix.groupBy("part").agg(F.count("*").alias("n"), F.sum("weight").alias("s"), F.max("weight").alias("w")).orderBy("part").collect()
    sums = Sums([(r["part"], r["n"], r["s"]) for r in totals])
    cuts = minimax_cuts(prefix.select("part", "own", _place().alias("index")), sums, shards, max((r["w"] for r in totals), default=0)) if totals else [0] * shards
    before = _offsets(prefix, [(p, sums.before[p][1]) for p, _, _ in sums.parts] or [(0, 0)], "part int, before long")
    ends = F.col("own") + F.col("before")
    shard = sum(((ends > c).cast("int") for c in cuts[:-1]), F.lit(0))
    placed = rows.join(prefix.join(before, "part").select("key", shard.alias("shard")), "key")

    # in order of shard and doc_id over all ranges, a row's slot is its number less that of its shard's first row
    slots = materialize(_in_ranges(placed, F.col("shard"), F.col("doc_id").asc_nulls_last(), F.col("key")).drop("key"), "placed").withColumn("part", _part())
    starts, first, at = {}, [0] * (shards + 1), 0
    for part, s, n in sorted((r["part"], r["shard"], r["n"]) for r in slots.groupBy("part", "shard").agg(F.count("*").alias("n")).collect()):
        starts.setdefault(part, at)
        first[s + 1] += n
        at += n
    firsts = F.array(*(F.lit(sum(first[: s + 1])).cast("long") for s in range(shards)))
    out = slots.join(_offsets(slots, list(starts.items()) or [(0, 0)], "part int, before long"), "part")
    return out.withColumn("slot", F.col("before") + _place() - F.get(firsts, F.col("shard"))).drop("part", "at", "before")


def document_rows(docs: DataFrame) -> DataFrame:
    """Narrow rows for sharding: size, CRC and a digest by which equal texts meet."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))


def op8_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(document_rows(table(spark, sf_dir, "documents")), "sizes")
    out = minimax_shards(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def crc_step() -> str:
    """CRC-32 (reflected polynomial EDB88320) of one more byte y in SQL: four bits, then the other four."""
    table = list(range(16))
    for _ in range(4):
        table = [v >> 1 ^ (0xEDB88320 if v & 1 else 0) for v in table]
    half = lambda v, y: f"xor({v} >> 4, {table}[(xor({v}, {y}) & 15) + 1])"
    return half(half("v", "y"), "(y >> 4)")


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT t, sum(length(h) // 2 + 1) AS w, min(doc_id) AS f FROM d GROUP BY t),
p AS (SELECT t, w, CAST(sum(w) OVER (ORDER BY f) AS BIGINT) AS e FROM g),
b(lo, hi, pos, k, step) AS (
  SELECT CAST(greatest(max(w), (max(e) + 7) // 8) AS BIGINT), max(e), CAST(0 AS BIGINT), 0, 0 FROM p
  UNION ALL
  SELECT CASE WHEN k = 8 AND pos < (SELECT max(e) FROM p) THEN (lo + hi) // 2 + 1 ELSE lo END,
         CASE WHEN k = 8 AND pos = (SELECT max(e) FROM p) THEN (lo + hi) // 2 ELSE hi END,
         CASE WHEN k = 8 THEN 0 ELSE greatest(pos, coalesce((SELECT max(e) FROM p WHERE e <= b.pos + (b.lo + b.hi) // 2), 0)) END,
         CASE WHEN k = 8 THEN 0 ELSE k + 1 END, step + 1
  FROM b WHERE lo < hi),
c(k, a, z) AS (
  SELECT 0, CAST(-1 AS BIGINT), (SELECT max(e) FROM p WHERE e <= (SELECT arg_max(hi, step) FROM b))
  UNION ALL
  SELECT k + 1, z, coalesce((SELECT max(e) FROM p WHERE e <= c.z + (SELECT arg_max(hi, step) FROM b)), c.z) FROM c WHERE k < 7),
s AS (
  SELECT doc_id, CAST(length(h) // 2 + 1 AS BIGINT) AS size, c.k AS shard,
         xor(4294967295, list_reduce(
           list_concat([CAST(4294967295 AS BIGINT)], list_transform(regexp_extract_all(h, '..'), lambda x: CAST(16 * instr('0123456789ABCDEF', x[1]) + instr('0123456789ABCDEF', x[2]) - 17 AS BIGINT))),
           lambda v, y: {step})) AS text_crc32
  FROM d JOIN p ON p.t = d.t JOIN c ON p.e > c.a AND p.e <= c.z)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
""".replace("{step}", crc_step())
