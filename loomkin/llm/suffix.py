"""Removal of repeated byte strings by longest-previous-factor arrays over buckets of suffixes.

A byte goes if some 100-byte string over it starts earlier too (an earlier document, or the same one and
an earlier start): if the longest previous factor at that start is of 100 bytes or more. The corpus has
too many suffixes for one order, so they are dealt into buckets such that equal 100-byte strings always
meet; each bucket has its own suffix array and LPF array.

1. Each 100-byte window picks its anchor, the 32-byte substring in it with the smallest hash (the leftmost
   of equals): equal windows pick equal anchors. Consecutive windows of one anchor form a run.
2. Anchors that occur twice or more go on. A task knows those that repeat among its own documents and
   sends one row of each; the others are found by sorting.
3. Documents meet their repeated anchors; each run's bytes go to the anchor's bucket. Equal runs seen
   before in the same task are known to be copies and are not sent again. The runs of an anchor with very
   many of them are dealt over several buckets, equal runs into the same one.
4. In a bucket, equal runs are copies of the earliest. The suffixes of the runs that differ are sorted
   with the lengths that neighbours have in common (LCP); for each, the previous and the next one in this
   order that start at an earlier place give its longest previous factor. A factor of 100 bytes or more
   is removed.

The firsts of the parts of a split bucket meet once more, by a 128-bit digest of their 100 bytes, in an
ordinary aggregate. No step collects a bucket, and all steps count strings as they are in the input.

Defined results: a null or empty text has 0 bytes and keeps 0. Documents are ordered by doc_id, nulls
last; rows without a doc_id, or with a repeated one, are documents of their own, in order of a digest of
their text (so of equal rows one keeps its text). An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkin.llm.common import checked_broadcast, discard, materialize, numbered, shuffle_parts, table

MATCH, ANCHOR = 100, 32
#: Window starts handled at once (positions fit in 16 bits with it), suffixes sorted at once, runs of a bucket sorted together, and runs a task remembers.
SEGMENT, SORTED, BUCKET_RUNS, REMEMBERED = 48_000, 200_000, 8_000, 60_000
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.random.default_rng(7).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def gram_hashes(data: np.ndarray, size: int = ANCHOR) -> np.ndarray:
    """64-bit hash of each substring of `size` (a power of two) bytes."""
    h, k, step = _BYTE[data], 1, 0
    while k < size:
        h = h[:-k] * _STEP[step] + h[k:]
        h ^= h >> np.uint64(29)
        k, step = 2 * k, step + 1
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchor_runs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the anchor's hash, the first start and the number of windows."""
    n, width = len(text) - MATCH + 1, MATCH - ANCHOR + 1
    hashes, starts, counts = [], [], []
    data = np.frombuffer(text, np.uint8)
    for a in range(0, n, SEGMENT):
        m = min(SEGMENT, n - a)
        h = gram_hashes(data[a : a + m + MATCH - 1])
        low = (h & np.uint64(0xFFFFFFFFFFFF0000)) | np.arange(len(h), dtype=np.uint64)
        k = 1
        while 2 * k <= width:
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        if k < width:
            low = np.minimum(low[: -(width - k)], low[width - k :])
        at = (low & np.uint64(0xFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        hashes.append(h[at[first]])
        starts.append(first + a)
        counts.append(np.diff(np.r_[first, m]))
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(counts)


#: Anchors of a task looked at together before they are dealt out.
ANCHORS_AT_ONCE = 1 << 20
#: A row alone in its task; one known to repeat. Any larger state is a spokesman's: the rows it stands for, itself included.
ALONE, KNOWN = 1, 0
ANCHORS = "bucket long, anchor long, doc long, run long, state int"


def _emit_anchors(batches):
    """Rows for the search of repeated anchors.

    An anchor that repeats within the task is known to: one row of it speaks for it in the anchor's bucket
    and the others are dealt out evenly, so a very frequent anchor sends a row a task to its bucket.
    """
    held: list[list[np.ndarray]] = [[], [], []]
    n = 0

    def dealt():
        anchor, doc, run = (np.concatenate(c) for c in held)
        order = np.argsort(anchor, kind="stable")
        anchor, doc, run = anchor[order], doc[order], run[order]
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        state = np.zeros(len(anchor), np.int32)
        state[first] = np.diff(np.r_[first, len(anchor)])
        bucket = np.where(state == KNOWN, doc * 1_000_003 + run, anchor)
        for a in range(0, len(anchor), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)]) for c in (bucket, anchor, doc, run, state)], names=["bucket", "anchor", "doc", "run", "state"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text is not None and len(text) >= MATCH:
                h, s, c = anchor_runs(text)
                for k, x in enumerate((h.view(np.int64), np.full(len(h), doc, np.int64), s << 8 | c)):
                    held[k].append(x)
                n += len(h)
                if n >= ANCHORS_AT_ONCE:
                    yield from dealt()
                    held, n = [[], [], []], 0
    if n:
        yield from dealt()


class _Hot:
    """Anchors of more than BUCKET_RUNS rows, counted over sorted batches; the last group of a batch stays open."""

    def __init__(self) -> None:
        self.open: tuple[int, int] = (0, 0)  # anchor, rows

    def add(self, bucket: np.ndarray, anchor: np.ndarray, state: np.ndarray) -> list[tuple[int, int]]:
        told = np.flatnonzero(state != KNOWN)
        if not len(told):
            return []
        anchor, state = anchor[told], state[told]
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        sums = np.add.reduceat(state.astype(np.int64), first)
        done = self.close() if int(anchor[0]) != self.open[0] else []
        if int(anchor[0]) == self.open[0]:
            sums[0] += self.open[1]
        self.open = int(anchor[-1]), int(sums[-1])
        large = np.flatnonzero(sums[:-1] > BUCKET_RUNS)
        return done + [(int(anchor[first[k]]), int(sums[k])) for k in large]

    def close(self) -> list[tuple[int, int]]:
        anchor, rows = self.open
        self.open = 0, 0
        return [(anchor, rows)] if rows > BUCKET_RUNS else []


def _repeated(batches):
    """Rows known to repeat, and rows sorted by bucket whose anchor is in a neighbouring row; holds two rows at a time.

    An anchor of more than BUCKET_RUNS rows has one more row, without a document: its number of rows.
    """
    held: list[np.ndarray] | None = None  # the last rows: context, and one not yet judged
    skip, hot = 0, _Hot()

    def judged(cols, upto):
        bucket, anchor, _, _, state = cols
        same = (bucket[1:] == bucket[:-1]) & (anchor[1:] == anchor[:-1])
        more = np.r_[False, same] | np.r_[same, False] | (state != ALONE)
        k = np.flatnonzero(more[skip:upto]) + skip
        for a in range(0, len(k), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[k[a : a + (1 << 16)]]) for c in cols[1:4]], names=["anchor", "doc", "run"])

    def large(rows):
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.nulls(len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["anchor", "doc", "run"])

    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        if not len(cols[0]):
            continue
        yield from large(hot.add(cols[0], cols[1], cols[4]))
        if held:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        yield from judged(cols, len(cols[0]) - 1)
        held = [c[-2:] for c in cols]
        skip = len(held[0]) - 1
    yield from large(hot.close())
    if held:
        yield from judged(held, len(held[0]))


RUNS = "bucket long, doc long, start long, bytes binary, copied int"
#: Bits of a run's number of windows, and of these and its start; above them stands the number of buckets of its anchor.
COUNT_BITS, PLACE_BITS, MOST_PARTS = 8, 48, (1 << 15) - 1
#: In place of `copied`: the run's bucket is one of several of its anchor.
SPLIT = -1


def _emit_runs(batches):
    """Rows for the buckets: a run's bytes, or (copied > 0) the length of a run known to be a copy."""
    seen: dict[bytes, tuple[int, int]] = {}
    for batch in batches:
        bucket, docs, starts, data, copied = [], [], [], [], []
        for doc, text, runs in zip(batch.column(0).to_pylist(), _unpacked(batch.column(1)), batch.column(2), strict=True):
            anchors, places = (runs.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            for anchor, place in zip(anchors.tolist(), places.tolist(), strict=True):
                parts, place = place >> PLACE_BITS, place & (1 << PLACE_BITS) - 1
                start, n = place >> COUNT_BITS, place & (1 << COUNT_BITS) - 1
                own = text[start : start + n + MATCH - 1]
                docs.append(doc)
                starts.append(start)
                if (first := seen.get(own)) is not None and first < (doc, start):
                    bucket.append(doc * 31 + start & 0xFFFFFFFF)
                    data.append(None)
                    copied.append(len(own))
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[own] = (doc, start)
                bucket.append(_part_of(anchor, own, parts) if parts else anchor)
                data.append(own)
                copied.append(SPLIT if parts else 0)
                if len(docs) >= 1 << 15:
                    yield _run_batch(bucket, docs, starts, data, copied)
                    bucket, docs, starts, data, copied = [], [], [], [], []
        if docs:
            yield _run_batch(bucket, docs, starts, data, copied)


def _part_of(anchor: int, own: bytes, parts: int) -> int:
    mixed = xxhash.xxh3_64_intdigest(anchor.to_bytes(8, "little", signed=True), seed=xxhash.xxh3_64_intdigest(own) % parts)
    return mixed - (1 << 64) if mixed >> 63 else mixed


def _run_batch(bucket, docs, starts, data, copied):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((bucket, docs, starts, data, copied), kinds, strict=True)], names=["bucket", "doc", "start", "bytes", "copied"])


def suffix_array(text: np.ndarray, at: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of `left` bytes at `at`, and (LCP) how many bytes each one in it shares with the one before.

    A suffix is compared as if zeros followed it, which may only add to the LCP what lies beyond its end.
    """
    width = int(left.max())
    padded = np.concatenate([text, np.zeros(width, np.uint8)])
    suffixes = np.lib.stride_tricks.sliding_window_view(padded, width)[at]
    suffixes[np.arange(width) >= left[:, None]] = 0
    order = np.argsort(suffixes.view(f"S{width}").ravel(), kind="stable")
    lcp = np.zeros(len(at), np.int64)
    for a in range(1, len(at), 1 << 16):
        k = slice(a, min(len(at), a + (1 << 16)))
        differ = suffixes[order[k]] != suffixes[order[a - 1 : k.stop - 1]]
        lcp[k] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, lcp


def previous_factors(text: np.ndarray, at: np.ndarray, left: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each suffix the length of its longest previous factor: the most bytes it shares with one of an earlier place.

    Among the suffixes of earlier places the previous and the next one in suffix order share the most. One
    scan finds both: the stack holds suffixes of growing places, each with the LCP to the one below it
    (its previous smaller); what takes it off the stack is its next smaller. The length is cut at the ends of both.
    """
    order, lcp = suffix_array(text, at, left)
    place, rest = places[order].tolist(), left[order].tolist()
    place.append(-1)
    common = [*lcp.tolist(), 0]
    found = [0] * len(order)
    stack: list[tuple[int, int]] = []  # suffix, LCP with the one below
    for i, p in enumerate(place):
        shared = common[i]
        while stack and place[stack[-1][0]] > p:
            top, below = stack.pop()
            after = min(shared, rest[top], rest[i]) if p >= 0 else 0
            before = min(below, rest[top], rest[stack[-1][0]]) if stack else 0
            found[top] = max(after, before)
            shared = min(shared, below)
        stack.append((i, shared))
    out = np.empty(len(order), np.int64)
    out[order] = found
    return out


MATCHES = "doc long, start long, until long, digest binary"


class _Buckets:
    """Runs of buckets that differ, gathered for the sort; rows of MATCHES as they come out."""

    def __init__(self) -> None:
        self.out: list[tuple] = []
        self.pending: list[tuple[bytes, int, int, bool]] = []
        self.windows = 0

    def add(self, runs: list[tuple[bytes, int, int]], part: bool) -> None:
        self.pending += ((*r, part) for r in runs)
        self.windows += sum(len(r[0]) - MATCH + 1 for r in runs)

    def sort(self) -> None:
        if not self.pending:
            return
        text = np.frombuffer(b"".join(r[0] for r in self.pending), np.uint8)
        sizes = np.array([len(r[0]) for r in self.pending])
        counts = sizes - MATCH + 1
        run = np.repeat(np.arange(len(sizes)), counts)
        inner = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = (np.cumsum(sizes) - sizes)[run] + inner
        docs = np.array([r[1] for r in self.pending], np.int64)[run]
        starts = np.array([r[2] for r in self.pending], np.int64)[run] + inner
        places = np.empty(len(run), np.int64)
        places[np.lexsort((starts, docs))] = np.arange(len(run))
        factors = previous_factors(text, at, sizes[run] - inner, places)
        # factors of a run that meet or overlap make one stretch of bytes
        hit = np.flatnonzero(factors >= MATCH)
        until = starts[hit] + factors[hit]
        edge = np.r_[True, (run[hit][1:] != run[hit][:-1]) | (starts[hit][1:] > until[:-1])] if len(hit) else np.empty(0, bool)
        first = np.flatnonzero(edge)
        if len(hit):
            self.out += zip(docs[hit[first]].tolist(), starts[hit[first]].tolist(), np.maximum.reduceat(until, first).tolist(), [None] * len(first), strict=True)
        parts = np.array([r[3] for r in self.pending])[run]
        for k in np.flatnonzero(parts & (factors < MATCH)).tolist():
            own = text[at[k] : at[k] + MATCH]
            self.out.append((int(docs[k]), int(starts[k]), int(starts[k]) + MATCH, xxhash.xxh3_128_digest(own.tobytes())))
        self.pending, self.windows = [], 0

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.out, strict=True)) or [[], [], [], []]
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc", "start", "until", "digest"])


def _match_buckets(batches):
    """Rows sorted by bucket, bytes, doc and start to MATCHES; rows with a digest are firsts of a part of a large bucket."""
    work, bucket, last, runs, split = _Buckets(), None, None, [], False
    for batch in batches:
        for b, doc, start, own, copied in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if copied > 0:
                work.out.append((doc, start, start + copied, None))
                continue
            if b != bucket:
                if len(runs) > 1 or split:
                    work.add(runs, split)
                bucket, runs, split, last = b, [], copied == SPLIT, None
            if last is not None and last[0] == own:
                if last[1:] != (doc, start):
                    work.out.append((doc, start, start + len(own), None))
                continue
            last = (own, doc, start)
            runs.append(last)
            if len(runs) >= BUCKET_RUNS:
                split = True
                work.add(runs, True)
                runs = []
            if work.windows >= SORTED:
                work.sort()
        if len(work.out) > 1 << 14:
            yield work.batch()
    if len(runs) > 1 or split:
        work.add(runs, split)
    work.sort()
    if work.out:
        yield work.batch()


def _texts(docs: DataFrame) -> DataFrame:
    """(doc, text, doc_id) with doc the row's number in the order of documents."""
    return numbered(docs.select("doc_id", F.col("text").cast("binary").alias("text")), "text").select(F.col("row").alias("doc"), "text", F.col("doc_id").cast("long").alias("doc_id"))


def _pack(batches):
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [None if t is None else press.compress(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), batch.column(2)], names=["doc", "text", "doc_id"])


def _packed(texts: DataFrame) -> DataFrame:
    """texts (doc, text, doc_id) with text compressed, for a shuffle of whole texts: half the bytes of the shuffle's own codec."""
    return texts.mapInArrow(_pack, "doc long, text binary, doc_id long")


def _unpacked(column: pa.Array) -> list[bytes | None]:
    press = zstandard.ZstdDecompressor()
    return [None if t is None else press.decompress(t) for t in column.to_pylist()]


def _with_parts(repeated: DataFrame) -> DataFrame:
    """Repeated anchors' rows; those of an anchor with very many carry the number of its buckets above their place."""
    rows = repeated.where("doc is not null")
    hot = repeated.where("doc is null").groupBy("anchor").agg(F.sum("run").alias("n"))
    hot = materialize(hot.select("anchor", F.least(F.ceil(F.col("n") / BUCKET_RUNS), F.lit(MOST_PARTS)).cast("long").alias("parts")), "hot")
    met = rows.join(checked_broadcast(hot), "anchor", "left")
    return met.select("anchor", "doc", F.col("run").bitwiseOR(F.shiftleft(F.coalesce("parts", F.lit(0).cast("long")), PLACE_BITS)).alias("run"))


def earlier_copies(texts: DataFrame) -> DataFrame:
    """(doc, start, until): byte stretches of texts (doc, text, doc_id) that are covered by earlier copies."""
    parts = shuffle_parts(texts.sparkSession)
    anchors = texts.mapInArrow(_emit_anchors, ANCHORS).repartition(parts, "bucket").sortWithinPartitions("bucket", "anchor", "state")
    repeated = materialize(anchors.mapInArrow(_repeated, "anchor long, doc long, run long"), "anchors")
    of_doc = _with_parts(repeated).groupBy("doc").agg(F.collect_list(F.struct("anchor", "run")).alias("runs"))
    runs = _packed(texts).join(of_doc.hint("merge"), "doc").select("doc", "text", "runs").mapInArrow(_emit_runs, RUNS)
    buckets = runs.repartition(parts, "bucket").sortWithinPartitions("bucket", "bytes", "doc", "start")
    matches = materialize(buckets.mapInArrow(_match_buckets, MATCHES), "matches")
    discard(repeated)
    firsts = matches.where("digest is not null")
    least = materialize(firsts.groupBy("digest").agg(F.min(F.struct("doc", "start")).alias("least")), "least")
    later = firsts.join(least, "digest").where(F.struct("doc", "start") > F.col("least")).select("doc", "start", "until")
    return matches.where("digest is null").select("doc", "start", "until").unionByName(later)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _remove(batches):
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), _unpacked(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            text = text or b""
            kept, at, n_spans, removed = [], 0, 0, 0
            for s in sorted(spans or (), key=lambda s: (s["start"], s["until"])):
                if s["start"] > at or not n_spans:
                    kept.append(text[at : s["start"]])
                    n_spans += 1
                    at = s["start"]
                if s["until"] > at:
                    removed += s["until"] - at
                    at = s["until"]
            kept.append(text[at:])
            rows.append((doc_id, len(text), removed, n_spans, b"".join(kept)))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 4, pa.binary()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _digest(batches):
    for batch in _remove(batches):
        digests = [hashlib.sha256(k).hexdigest() for k in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(digests, pa.string())], names=[*batch.schema.names[:4], "kept_sha256"])


def _with_spans(docs: DataFrame) -> DataFrame:
    texts = _texts(docs)
    spans = earlier_copies(texts).groupBy("doc").agg(F.collect_set(F.struct("start", "until")).alias("spans"))
    return _packed(texts).join(spans.hint("merge"), "doc", "left").select("doc_id", "text", "spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of each document."""
    return _with_spans(docs).mapInArrow(_remove, KEPT)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _with_spans(docs).mapInArrow(_digest, KEPT.replace("kept binary", "kept_sha256 string"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, s, md5(substr(h, 2 * s + 1, 200)) AS m FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 99)) AS s FROM d)),
c AS (SELECT r, s FROM (SELECT r, s, r * 1000000000 + s AS p, min(r * 1000000000 + s) OVER (PARTITION BY m) AS p0 FROM w) WHERE p > p0),
i AS (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS g FROM (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM c)),
x AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS e FROM (SELECT r, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY r, g)),
k AS (
  SELECT d.r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM x JOIN d ON d.r = x.r GROUP BY d.r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k ON k.r = d.r
"""
