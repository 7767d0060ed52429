"""Best-fit packing under conflicts.

Items (document pieces) go into bins of a fixed capacity. No bin holds two pieces of one source or
of one duplicate cluster. Pieces are dealt by hash into independent blocks of about BLOCK_ITEMS, so
any source or cluster, however large, spreads evenly and a task holds one block. Within a block the
pieces come longest first; bins stand ordered by residual, each with one bitmap of the sources and
clusters it holds, and the search goes from the first bin that is large enough to its successors
until one is free of conflicts: the tightest compatible bin.

Neighbours in this order stand together in short shelves. A shelf knows the bits that all its bins
hold, so the search passes over a shelf of which every bin holds the piece's source (or cluster) at once.

Defined results: a null or empty text has length 1 (its separator). A text longer than the capacity
is cut into pieces of at most the capacity. A null source or cluster conflicts with nothing. Rows
without a doc_id, or with a repeated one, are packed once each, in order of a digest of source, cluster
and length. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkin.llm.common import numbered, table

#: Production parameters: bytes in a bin (about 2,000 tokens), and items in a block. A source with a share of
#: the pieces needs as many bins as it has pieces, so a much larger capacity would leave most of a bin empty.
CAPACITY, BLOCK_ITEMS = 8_192, 2_048
#: Bins of a block have ids below this.
BIN_SPAN = 1 << 20
#: Bins of a shelf at most; a longer one is cut in two.
SHELF = 64
SCHEMA = "doc_id long, piece long, start long, length long, bin_id long, bin_offset long"


class Bins:
    """Open bins ordered by (residual, number), on shelves; masks[number] has a bin's conflict bits."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.masks = capacity, []
        self.shelves: list[list[tuple[int, int]]] = []
        self.last: list[tuple[int, int]] = []  # each shelf's last bin
        self.common: list[int] = []  # the bits that all bins of a shelf hold

    def put(self, length: int, bits: int) -> tuple[int, int]:
        """The bin's number and the offset in it of a new item."""
        found = self._take(length, bits)
        if found is None:
            found = self.capacity, len(self.masks)
            self.masks.append(0)
        residual, number = found
        self.masks[number] |= bits
        if residual > length:
            self._add((residual - length, number))
        return number, self.capacity - residual

    def _take(self, length: int, bits: int) -> tuple[int, int] | None:
        """Takes the first bin of at least this residual that holds none of the bits off its shelf."""
        masks = self.masks
        for s in range(bisect_left(self.last, (length, -1)), len(self.shelves)):
            if self.common[s] & bits:
                continue
            shelf = self.shelves[s]
            for k in range(bisect_left(shelf, (length, -1)), len(shelf)):
                if not masks[shelf[k][1]] & bits:
                    found = shelf.pop(k)
                    self._count(s)
                    return found
        return None

    def _add(self, one: tuple[int, int]) -> None:
        s = min(bisect_left(self.last, one), len(self.shelves) - 1)
        if s < 0:
            self.shelves.append([])
            self.last.append(one)
            self.common.append(0)
            s = 0
        shelf = self.shelves[s]
        insort(shelf, one)
        if len(shelf) > SHELF:
            self.shelves[s : s + 1] = [shelf[: SHELF // 2], shelf[SHELF // 2 :]]
            self.last.insert(s, one)
            self.common.insert(s, 0)
            self._count(s + 1)
        self._count(s)

    def _count(self, s: int) -> None:
        shelf = self.shelves[s]
        if not shelf:
            del self.shelves[s], self.last[s], self.common[s]
            return
        bits = -1
        for _, number in shelf:
            bits &= self.masks[number]
        self.last[s], self.common[s] = shelf[-1], bits


def pack(items: Iterable[tuple[int, object, object]], capacity: int) -> Iterator[tuple[int, int]]:
    """Best fit for items of (length, source, cluster) in their order; yields (bin, offset)."""
    items = list(items)
    bit: dict[tuple[int, object], int] = {}
    seen = Counter((kind, x[kind]) for x in items for kind in (1, 2) if x[kind] is not None)
    bins = Bins(capacity)
    for x in items:
        bits = 0
        for key in ((1, x[1]), (2, x[2])):
            if seen[key] > 1:  # what occurs once meets no conflict
                bits |= 1 << bit.setdefault(key, len(bit))
        yield bins.put(x[0], bits)


def _block(capacity: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("row", "ascending"), ("piece", "ascending")])
        placed = list(pack(zip(*(rows[c].to_pylist() for c in ("length", "source", "cluster")), strict=True), capacity))
        first = rows["block"][0].as_py() * BIN_SPAN
        rows = rows.select(["doc_id", "piece", "start", "length"])
        rows = rows.append_column("bin_id", pa.array([first + n for n, _ in placed], pa.int64()))
        return rows.append_column("bin_offset", pa.array([o for _, o in placed], pa.int64()))

    return run


def best_fit(items: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Pack items (doc_id, length, source, cluster) into bins; SCHEMA's columns.

    The only figures taken to the driver are counts of pieces and ids; only narrow rows are shuffled.
    """
    own = items.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string"), F.col("cluster").cast("string"), F.col("length").cast("long").alias("whole"))
    own = numbered(own, "source", "cluster", "whole")
    last_piece = F.floor((F.greatest(F.col("whole"), F.lit(1).cast("long")) - 1) / capacity)
    blocks = max(1, -(-(own.agg(F.sum(last_piece + 1)).first()[0] or 0) // block_items))
    pieces = own.select("row", "doc_id", "source", "cluster", "whole", F.explode(F.sequence(F.lit(0).cast("long"), last_piece)).alias("piece"))
    pieces = pieces.withColumn("start", F.col("piece") * capacity).withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("whole") - F.col("start"))).drop("whole")
    keyed = pieces.withColumn("block", F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)))
    return keyed.groupBy("block").applyInArrow(_block(capacity), SCHEMA)


def document_items(docs: DataFrame) -> DataFrame:
    """Items from documents: bytes plus one separator; equal texts (but for empty ones) are one duplicate cluster."""
    return docs.select("doc_id", "source", F.when(F.length("text") > 0, F.xxhash64("text")).alias("cluster"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("length"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(document_items(table(spark, sf_dir, "documents")))
