"""Line deduplication by a segment-partition edit join.

A line goes if an equal line, or one within EDITS single-byte edits of it, stands earlier in the corpus
(an earlier document, or the same one and an earlier line); the first one stays. Lines are compared
without the white space at their ends. Blank lines are left alone. Lines under MIN_BYTES go only if an
equal one stands earlier: there EDITS edits would be more than a tenth of the line, and different short
lines would pass for copies.

1. Occurrences (128-bit line digest, document, line number) give each distinct line's first place.
2. A distinct line of MIN_BYTES or more is split into EDITS + 1 even segments. A line within EDITS edits, of the same length
   or up to EDITS longer, holds one of them whole near its place; which starts can matter follows from
   the lengths and the segment's number (the multi-match-aware window). Segments and probes are hashes of
   (length, segment number, bytes), computed for all lines of a batch from prefix hashes.
3. Equal hashes meet by sorting. A pair is made only if the lines' signatures - parities of their byte
   pairs in 64 classes, of which an edit changes four at most - allow it.
   The members of a list of more than LARGE comparisons are dealt out again by segments of what the list
   does not hold, under the edits that are left for it.
4. The lines of the pairs are read once more - a filter of their ids, of bounded size, goes to the scan -
   and verified by banded bit-parallel edit distance.
5. A distinct line with an earlier relative goes wherever it occurs; any other stays at its first place.
   Places are judged on the input, so the order of work has no influence.

Defined results: a null text is kept as it is and has no lines. A document of which every line that
counts was removed has only its blank lines left, perhaps none. Documents are ordered by doc_id, nulls
last; rows without a doc_id, or with a repeated one, are documents of their own, in order of a digest of
their text. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkin.llm.common import checked_broadcast, discard, let, materialize, numbered, shuffle_parts, table

EDITS, MIN_BYTES = 2, 20
#: Signature bits that one edit changes at most.
FLIPS = 4
#: Bytes of text whose keys are made at once, and pairs of a list compared at once.
TEXT_AT_ONCE, PAIRS_AT_ONCE = 2 << 20, 1 << 20
CACHE_PAIRS, CACHE_LINES, LINES_AT_ONCE = 1 << 18, 1 << 19, 1 << 13
#: Comparisons in one list above which its members are split by finer keys.
LARGE = 1 << 22
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def lines_of(text: bytes | None, least: int = 1) -> list[tuple[int, bytes]]:
    """(number, stripped bytes) of the lines of at least so many bytes; by default of all that aren't blank."""
    return [(i, s) for i, x in enumerate((text or b"").split(b"\n")) if len(s := x.strip()) >= least]


#: 128-bit digest of a line.
line_id = xxhash.xxh3_128_digest


def ids_of(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The halves of line digests. The first is the line's id, of which the lowest bit is left free; the second tells lines of one id apart."""
    halves = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
    return (halves[:, 0] & np.uint64(0xFFFFFFFFFFFFFFFE)).view(np.int64), halves[:, 1].copy().view(np.int64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** n modulo 2 ** 64."""
    out = np.ones(n + 1, np.uint64)
    filled, step = 1, base
    while filled <= n:
        m = min(filled, n + 1 - filled)
        out[filled : filled + m] = out[:m] * np.uint64(step)
        filled, step = filled + m, step * step % (1 << 64)
    return out


class _Hasher:
    """Hashes of substrings of one concatenated text, from prefix sums."""

    def __init__(self, text: np.ndarray) -> None:
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(text))[:-1], out=self.sums[1:])
        self.back = _powers(_INVERSE, len(text))

    def __call__(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.back[start]


def segment_bounds(length: np.ndarray, number: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment `number` (from 1) of lines of `length`: even, the longer ones last."""
    k = edits + 1
    size, more = length // k, length % k
    before = (number - 1) * size + np.maximum(0, number - 1 - (k - more))
    return before, size + (number > k - more)


def signatures(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Parity of the number of byte pairs in each of 64 classes, one word for each line."""
    pairs = (text[:-1].astype(np.uint32) << np.uint32(8) | text[1:]) * np.uint32(0x9E3779B1) >> np.uint32(26)
    bits = np.left_shift(np.uint64(1), pairs.astype(np.uint64))
    edges = np.empty(2 * len(start), np.int64)
    edges[0::2], edges[1::2] = start, start + size - 1
    return np.bitwise_xor.reduceat(np.r_[bits, np.uint64(0)], edges)[0::2]


def _key_parts(hashed: _Hasher, start: np.ndarray, size: np.ndarray, edits: int):
    """For each segment and probe: (key, line, role, segment number, length of the segment's line, start in the line, bytes)."""

    def part(length, number, at, n, ok, role):
        k = np.flatnonzero(ok)
        h = hashed(start[k] + at[k], n[k])
        key = _mix(h + length[k].astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(number * 0x1D8E4E27C47D124F & (1 << 64) - 1))
        return key, k, role, number, length[k], at[k], n[k]

    for i in range(1, edits + 2):
        before, n = segment_bounds(size, i, edits)
        yield part(size, i, before, n, n > 0, 0)
        for longer in range(edits + 1):
            other = size - longer
            before, n = segment_bounds(other, i, edits)
            for at in _shifted(before, longer, i, edits):
                yield part(other, i, at, n, (other >= MIN_BYTES) & (n > 0) & (at >= 0) & (at + n <= size), 1)


def _shifted(before: np.ndarray, longer: int, number: int, edits: int):
    """Starts at which a line `longer` bytes longer than the segment's can hold segment `number`."""
    for shift in range(max(1 - number, longer - (edits + 1 - number)), min(number - 1, longer + (edits + 1 - number)) + 1):
        yield before + shift


def _joined(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines' bytes in one array, with each line's start and size."""
    size = np.array([len(x) for x in lines], np.int64)
    return np.frombuffer(b"".join(lines), np.uint8), np.cumsum(size) - size, size


def keys_of(lines: list[bytes], edits: int = EDITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct lines: key, line's index and role (0 a segment, 1 a probe), and the lines' signatures."""
    text, start, size = _joined(lines)
    parts = [(p[0], p[1] << 1 | p[2]) for p in _key_parts(_Hasher(text), start, size, edits)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), signatures(text, start, size)


def finer_keys(lines: list[bytes], wanted: np.ndarray, roles: np.ndarray, edits: int = EDITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys for the members of large lists: line k stands in the list of key wanted[k] with roles[k].

    What a pair of the list has in common is segment i of the one line. Some such i has at most i - 1 edits
    before it and at most edits + 1 - i after it, so one side is split again into as many segments as it
    may have edits, and one more. Returns key, line's index and role, and the signatures.
    """
    text, start, size = _joined(lines)
    hashed = _Hasher(text)
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def part(list_key, k, at, n, number, ok, role):
        j = np.flatnonzero(ok & (n > 0) & (at >= 0) & (at + n <= size[k]))
        h = hashed(start[k[j]] + at[j], n[j])
        key = _mix(h + list_key[j] * np.uint64(0x9FB21C651E98DF25) + np.uint64(number * 0x1D8E4E27C47D124F & (1 << 64) - 1))
        out.append((key, k[j] << 1 | role))

    for key, k, role, i, length, at, n in _key_parts(hashed, start, size, edits):
        mine = (key == wanted[k]) & (roles[k] == role)
        key, k, length, at, n = key[mine], k[mine], length[mine], at[mine], n[mine]
        if not len(k):
            continue
        before, _ = segment_bounds(length, i, edits)
        own_left, own_right = before, length - before - n
        right = np.full(len(k), i == 1) if i in (1, edits + 1) else own_right >= own_left
        for side in (False, True):
            most = edits + 1 - i if side else i - 1
            s = np.flatnonzero(right == side)
            if not len(s):
                continue
            own = (own_right if side else own_left)[s]
            first = (at + n)[s] if side else np.zeros(len(s), np.int64)
            longer = ((size[k] - at - n) if side else at)[s] - own
            for j in range(1, most + 2):
                b, m = segment_bounds(own, j, most)
                if role == 0:
                    part(key[s], k[s], first + b, m, j, np.ones(len(s), bool), 0)
                    continue
                for d in range(-most, most + 1):
                    for x in _shifted(b, d, j, most):
                        inside = (longer == d) & (x >= 0) & (x + m <= own + longer)
                        part(key[s], k[s], first + x, m, j, inside, 1)
    empty = np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, index = (np.concatenate([o[c] for o in out]) if out else empty[c] for c in (0, 1))
    return keys, index, signatures(text, start, size)


def _rows(batch):
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def _occurrences(batches):
    for batch in batches:
        ids, docs, numbers = [], [], []
        for doc, text in _rows(batch):
            for i, line in lines_of(text):
                ids.append(line_id(line))
                docs.append(doc)
                numbers.append(i)
        yield pa.RecordBatch.from_arrays([*map(pa.array, ids_of(ids)), pa.array(docs, pa.int64()), pa.array(numbers, pa.int64())], names=["line", "other", "doc", "number"])


def _emit_keys(batches):
    """Rows (key, line | role, signature) of the lines of a task, mostly once each."""
    seen: set[bytes] = set()
    lines: list[bytes] = []
    ids: list[bytes] = []
    held = 0

    def made():
        keys, index, sigs = keys_of(lines)
        own = ids_of(ids)[0]
        which = index >> 1
        out = [keys.view(np.int64), own[which] | (index & 1), sigs.view(np.int64)[which]]
        for a in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)]) for c in out], names=["key", "line", "sig"])

    for batch in batches:
        for _, text in _rows(batch):
            for _, line in lines_of(text, MIN_BYTES):
                if (h := line_id(line)) not in seen:
                    seen.add(h)
                    lines.append(line)
                    ids.append(h)
                    held += len(line)
            if len(seen) > CACHE_LINES:
                seen.clear()
            if held >= TEXT_AT_ONCE:
                yield from made()
                lines, ids, held = [], [], 0
    if lines:
        yield from made()


def _runs_of_keys(batches):
    """Sorted rows, cut between keys."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        key = cols[0]
        if not len(key):
            continue
        first = int(np.argmax(key == key[-1]))
        if held and first == 0 and key[0] == held[-1][0][-1]:
            held.append(cols)
            continue
        head = [*held, [c[:first] for c in cols]]
        if sum(len(h[0]) for h in head):
            yield [np.concatenate([h[k] for h in head]) for k in range(3)]
        held = [[c[first:] for c in cols]]
    if held:
        yield [np.concatenate([h[k] for h in held]) for k in range(3)]


#: Rows of _pairs: a pair of lines, or (large) a list's key and a member.
PAIRS = "a long, b long, large boolean"


def _pairs(most: float):
    """Pairs (a, b) of lines of which one holds the other's segment, if their signatures allow it.

    A list of more than `most` comparisons is not compared here; its members come out for finer keys.
    """

    def run(batches):
        sent: set[tuple[int, int]] = set()
        out: list[tuple[int, int]] = []
        for key, line, sig in _runs_of_keys(batches):
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            bare = line & ~np.int64(1)
            # most lists hold one line only, which meets its own segments there
            mixed = np.minimum.reduceat(bare, cuts[:-1]) != np.maximum.reduceat(bare, cuts[:-1])
            for r in np.flatnonzero(mixed).tolist():
                a, b = cuts[r], cuts[r + 1]
                role, ids, s = line[a:b] & 1, bare[a:b], sig[a:b]
                own, probe = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
                if not len(own) or not len(probe):
                    continue
                own = own[np.unique(ids[own], return_index=True)[1]]
                probe = probe[np.unique(ids[probe], return_index=True)[1]]
                if len(own) * len(probe) > most:
                    members = np.concatenate([ids[own], ids[probe] | 1])
                    for c in range(0, len(members), 1 << 16):
                        some = members[c : c + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), key[a])), pa.array(some), pa.array(np.ones(len(some), bool))], names=["a", "b", "large"])
                    continue
                step = max(1, PAIRS_AT_ONCE // len(own))
                for p in range(0, len(probe), step):
                    some = probe[p : p + step]
                    flips = np.bitwise_count((s[some][:, None] ^ s[own][None, :]).view(np.uint64))
                    x, y = np.nonzero((flips <= FLIPS * EDITS) & (ids[some][:, None] != ids[own][None, :]))
                    for u, v in zip(ids[some][x].tolist(), ids[own][y].tolist(), strict=True):
                        pair = (u, v) if u < v else (v, u)
                        if pair not in sent:
                            if len(sent) > CACHE_PAIRS:
                                sent.clear()
                            sent.add(pair)
                            out.append(pair)
            if len(out) > 1 << 15:
                yield _pair_batch(out, large=True)
                out = []
        if out:
            yield _pair_batch(out, large=True)

    return run


def _pair_batch(pairs, large: bool = False):
    """Pairs as a batch; large: with the column that says they are no members of large lists."""
    cols = [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([*cols, *([pa.array(np.zeros(len(pairs), bool))] if large else [])], names=["a", "b", "large"][: 2 + large])


def _emit_finer(batches):
    """Rows (key, line | role, signature) from members (list's key, line | role, text) of large lists."""
    for batch in batches:
        wanted = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        member = batch.column(1).to_numpy(zero_copy_only=False)
        texts = batch.column(2).to_pylist()
        for a in range(0, len(texts), 2048):
            c = slice(a, a + 2048)
            keys, index, sigs = finer_keys(texts[c], wanted[c], member[c] & 1)
            which = index >> 1
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array((member[c] & ~np.int64(1))[which] | index & 1), pa.array(sigs.view(np.int64)[which])], names=["key", "line", "sig"])


def within(a: bytes, b: bytes, edits: int = EDITS) -> bool:
    """Whether a and b are within `edits` insertions, deletions or substitutions of a byte.

    After equal ends are cut off, one register for each number of errors holds the diagonals of the band
    (2 * edits + 1 bits) that can be reached with so many; each byte of b moves all of them at once.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    differ = x[:n] != y[:n]
    head = int(differ.argmax()) if differ.any() else n
    differ = x[len(a) - (n - head) :][::-1] != y[len(b) - (n - head) :][::-1]
    tail = int(differ.argmax()) if differ.any() else n - head
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    band = (1 << (2 * edits + 1)) - 1
    reach = [(1 << edits + d + 1) - (1 << edits) for d in range(edits + 1)]  # d bytes of a skipped
    for i, c in enumerate(b):
        match = 0
        for j in range(max(0, i - edits), min(len(a), i + edits + 1)):
            if a[j] == c:
                match |= 1 << j - i + edits
        now = []
        for d in range(edits + 1):
            bits = reach[d] & match
            if d:
                bits |= reach[d - 1] | reach[d - 1] >> 1 | now[d - 1] << 1
            now.append(bits & band)
        reach = now
        if not reach[-1]:
            return False
    return bool(reach[-1] >> len(a) - len(b) + edits & 1)


#: Most bits of a filter of line ids (a power of two), bits an id, and what its probes leave out of an id.
MOST_BITS, BITS_EACH, SHIFTS = 1 << 26, 10, (1, 20, 37)
_BLOCK = 1 << 16


def _filter_blocks(bits: int):
    def run(batches):
        own = np.zeros(bits, bool)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for shift in SHIFTS:
                own[ids >> shift & bits - 1] = True
        packed = np.packbits(own)
        for k in range(0, len(packed), _BLOCK):
            if (part := packed[k : k + _BLOCK]).any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["at", "part"])

    return run


def _either(blocks: pa.Table) -> pa.Table:
    part = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in blocks["part"].to_pylist()])
    return pa.table({"at": blocks["at"][:1], "part": pa.array([part.tobytes()], pa.binary())})


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bits that are set for the ids (line): of bounded size, so that with very many ids it lets more lines through."""
    bits = min(MOST_BITS, max(1 << 12, 1 << (BITS_EACH * ids.count()).bit_length()))
    packed = np.zeros(bits // 8, np.uint8)
    blocks = ids.mapInArrow(_filter_blocks(bits), "at long, part binary").groupBy("at").applyInArrow(_either, "at long, part binary")
    for r in blocks.collect():
        packed[r["at"] : r["at"] + len(r["part"])] = np.frombuffer(r["part"], np.uint8)
    return packed


def _wanted(shared):
    """(line, other, text) of a task's lines whose id passes the shared filter, mostly once each."""

    def run(batches):
        packed = shared.value
        last = len(packed) * 8 - 1
        seen: set[bytes] = set()

        def passing(digests: list[bytes], lines: list[bytes]):
            ids, others = ids_of(digests)
            ok = np.ones(len(ids), bool)
            for shift in SHIFTS:
                at = ids >> shift & last
                ok &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            k = np.flatnonzero(ok)
            if len(seen) > CACHE_LINES:
                seen.clear()
            seen.update(digests[i] for i in k)
            return pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(others[k]), pa.array([lines[i] for i in k], pa.binary())], names=["line", "other", "text"])

        digests, lines = [], []
        for batch in batches:
            for _, text in _rows(batch):
                for _, line in lines_of(text, MIN_BYTES):
                    if (h := line_id(line)) not in seen:
                        digests.append(h)
                        lines.append(line)
                if len(digests) >= LINES_AT_ONCE:
                    yield passing(digests, lines)
                    digests, lines = [], []
        if digests:
            yield passing(digests, lines)

    return run


def _verify(batches):
    for batch in batches:
        *keys, x, y = (batch.column(k).to_pylist() for k in range(6))
        ok = [k for k in range(len(x)) if x[k] != y[k] and within(x[k], y[k])]
        yield pa.RecordBatch.from_arrays([pa.array([c[k] for k in ok], pa.int64()) for c in keys], names=["a", "a_other", "b", "b_other"])


def texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(line, other, text) of all lines whose id is in ids (line), and perhaps of some more, once each; one more scan of texts."""
    shared = texts.sparkSession.sparkContext.broadcast(id_filter(ids))
    found = texts.mapInArrow(_wanted(shared), "line long, other long, text binary")
    return materialize(found.dropDuplicates(["line", "other"]), "lines")


def near_lines(texts: DataFrame) -> DataFrame:
    """(a, a_other, b, b_other): different lines of texts (doc, text) within EDITS edits."""
    parts = shuffle_parts(texts.sparkSession)
    keys = texts.mapInArrow(_emit_keys, "key long, line long, sig long").repartition(parts, "key").sortWithinPartitions("key")
    found = materialize(keys.mapInArrow(_pairs(LARGE), PAIRS), "candidates")
    pairs = found.where("not large").select("a", "b")
    large = found.where("large").select("a", F.col("b"), (F.shiftleft(F.shiftright("b", 1), 1)).alias("line"))
    if large.limit(1).count():
        of = texts_of(texts, materialize(large.select("line").distinct(), "members"))
        finer = large.join(of, "line").select("a", "b", "text").mapInArrow(_emit_finer, "key long, line long, sig long")
        lists = finer.repartition(parts, "key").sortWithinPartitions("key")
        pairs = pairs.unionByName(lists.mapInArrow(_pairs(float("inf")), PAIRS).select("a", "b"))
    pairs = materialize(pairs.distinct(), "pairs")
    discard(found)
    ids = pairs.select(F.col("a").alias("line")).unionByName(pairs.select(F.col("b").alias("line"))).distinct()
    of = texts_of(texts, materialize(ids, "wanted"))
    left, right = (of.select(F.col("line").alias(c), F.col("other").alias(f"{c}_other"), F.col("text").alias(t)) for c, t in (("a", "x"), ("b", "y")))
    met = pairs.join(left, "a").join(right, "b").select("a", "a_other", "b", "b_other", "x", "y")
    return materialize(met.mapInArrow(_verify, "a long, a_other long, b long, b_other long"), "near")


def repeated_lines(texts: DataFrame) -> DataFrame:
    """(doc, number): the lines of texts (doc, text) that go."""
    found = materialize(texts.select("doc", "text").mapInArrow(_occurrences, "line long, other long, doc long, number long"), "occurrences")
    place, line = F.struct("doc", "number"), ["line", "other"]
    firsts = materialize(found.groupBy(*line).agg(F.min(place).alias("first"), F.count("*").alias("n")), "firsts")
    near = near_lines(texts.select("doc", "text"))
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("b_other").alias("a_other"), F.col("a").alias("b"), F.col("a_other").alias("b_other")))
    at = lambda c, name: firsts.select(F.col("line").alias(c), F.col("other").alias(f"{c}_other"), F.col("first").alias(name))
    lost = both.join(at("a", "own"), ["a", "a_other"]).join(at("b", "earlier"), ["b", "b_other"]).where(F.col("earlier") < F.col("own"))
    lost = materialize(lost.select(F.col("a").alias("line"), F.col("a_other").alias("other")).distinct().withColumn("lost", F.lit(True)), "lost")
    judged = firsts.join(checked_broadcast(lost), line, "left").where((F.col("n") > 1) | F.col("lost"))
    gone = found.join(judged.select(*line, "first", "lost"), line).where(F.col("lost") | (place > F.col("first")))
    return gone.select("doc", "number")


TEXTS = "doc_id long, text string, n_lines long, n_removed long"


def _without(batches):
    for batch in batches:
        texts, counts, removed = [], [], []
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = (text or b"").split(b"\n")
            gone = set(gone or ())
            counts.append(len(lines) if text is not None else 0)
            removed.append(len(gone))
            texts.append(text if text is None or not gone else b"\n".join(x for i, x in enumerate(lines) if i not in gone))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=["doc_id", "text", "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left, for each row of docs (doc_id, text)."""
    rows = numbered(docs.select("doc_id", "text"), "text")
    texts = rows.select(F.col("row").alias("doc"), F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    gone = repeated_lines(texts).groupBy("doc").agg(F.collect_set("number").alias("gone"))
    out = texts.join(gone.hint("merge"), "doc", "left").select("doc_id", "text", "gone").mapInArrow(_without, TEXTS)
    return out.select("doc_id", "n_lines", "n_removed", "text")


def clean_lines(docs: DataFrame) -> DataFrame:
    """docs with their repeated lines taken out of text; a document left without a word goes if lines of it were removed."""
    columns = docs.columns
    inner = docs.withColumnsRenamed({c: f"_l_{c}" for c in columns if c not in ("doc_id", "text")})
    rows = numbered(inner, "text").withColumnRenamed("row", "_l_row_")
    texts = rows.select(F.col("_l_row_").alias("doc"), F.col("text").cast("binary").alias("text"))
    gone = repeated_lines(texts).groupBy(F.col("doc").alias("_l_doc_")).agg(F.sort_array(F.collect_set("number")).alias("_l_gone_"))
    met = rows.join(gone.hint("merge"), F.col("_l_row_") == F.col("_l_doc_"), "left")

    def rest(x: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(x).cast("long") - 1), F.col("_l_gone_"))
        return F.array_join(F.transform(numbers, lambda i: F.get(x, i.cast("int"))), "\n")

    met = met.withColumn("text", F.when(F.col("_l_gone_").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), rest)))
    left = met.where(F.col("_l_gone_").isNull() | F.col("text").rlike(r"\S"))
    return left.select(*(F.col(c if c in ("doc_id", "text") else f"_l_{c}").alias(c) for c in columns))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
o AS (SELECT r, i, l[i] AS line, trim(l[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS own FROM (SELECT r, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
f AS (SELECT own, min(r * 1000000000 + i) AS p FROM o WHERE own <> '' GROUP BY own),
u AS (SELECT own, p, hex(encode(own)) AS h, length(hex(encode(own))) // 2 AS n FROM f WHERE length(hex(encode(own))) >= 40),
b AS (SELECT n, k, (k - 1) * (n // 3) + greatest(0, k - 4 + n % 3) AS a, n // 3 + CASE WHEN k > 3 - n % 3 THEN 1 ELSE 0 END AS z FROM (SELECT DISTINCT n FROM u), (SELECT unnest([1, 2, 3]) AS k)),
s AS (SELECT own, p, b.n, k, substr(h, 2 * a + 1, 2 * z) AS g FROM u JOIN b ON b.n = u.n),
q AS (
  SELECT DISTINCT own, p, b.n, k, substr(h, 2 * (a + t) + 1, 2 * z) AS g
  FROM u JOIN b ON b.n BETWEEN u.n - 2 AND u.n, (SELECT unnest([-2, -1, 0, 1, 2]) AS t) WHERE a + t >= 0 AND a + t + z <= u.n),
e AS (SELECT DISTINCT s.own AS x, s.p AS px, q.own AS y, q.p AS py FROM s JOIN q USING (n, k, g) WHERE s.own <> q.own),
m AS (SELECT CASE WHEN px > py THEN x ELSE y END AS own FROM e WHERE levenshtein(x, y) <= 2),
j AS (SELECT r, i, line, o.own <> '' AND (o.own IN (SELECT own FROM m) OR r * 1000000000 + i > p) AS gone FROM o LEFT JOIN f ON f.own = o.own),
t AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT coalesce(gone, FALSE)), '') AS text FROM j GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, t.text FROM d LEFT JOIN t ON t.r = d.r
"""
