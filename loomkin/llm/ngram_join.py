"""Exact set-similarity join of documents on 5-word shingles (Jaccard of 0.75 or more), as components.

1. One scan makes each document's shingle set, its size and digest, and adds the shingles to a table
   of counts of fixed width: every task's counts are summed, whatever the number of documents. Documents
   of equal sets are collapsed into one, by a 128-bit digest.
2. A second scan orders each set from rare to frequent (count, then hash: one order for all) and emits
   the prefix that any partner must share a token of. Tokens of one document only are dropped.
3. Documents of identical prefix and size - the same tokens left, at the same positions - are collapsed
   into a group; only its head stands in the tokens' lists, which are ordered by size.
4. A first linking verifies each member with its group's head, and each head with the hubs and
   neighbours it meets in most lists. The links make components. Pairs inside a component can't change
   it, so they are not made any more; nor are the groups of one component paired.
5. Each list gives the pairs of groups that pass the size, prefix and position bounds, of which both have
   as many repeated prefix tokens as a link needs in common, and which are not of one component. The
   group pairs, and the groups whose members are of several components, are expanded to their members of
   different components, and these are verified on the whole sets.

Prefix bounds: a set of n has 0.25 n + 1 probing tokens; as the smaller partner it needs only its first
n / 7 + 1.

Defined results: null, empty or blank texts have the empty set and are linked with nothing. Fewer than
five words make one shingle of the whole sequence. Rows without a doc_id, or with a repeated one, are
documents of their own; component_id is the smallest doc_id of the component, null if none of its
documents has one. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomkin.llm.bloom import passes, without
from loomkin.llm.common import checked_broadcast, discard, materialize, numbered, shuffle_parts, table
from loomkin.llm.components import components

SHINGLE = 5
#: Buckets of the count table (4 bytes each) and buckets in a row of it.
SKETCH_BITS, BLOCK_BITS = 20, 12
#: Neighbours that the first linking verifies for a document; all other pairs are left to the second.
NEIGHBOURS = 2
#: Words a worker's hash cache holds, sets a task remembers as counted, and pairs it remembers as emitted.
CACHE_WORDS, CACHE_SETS, CACHE_PAIRS = 1 << 20, 1 << 19, 1 << 18
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class _Words(dict):
    """Hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def shingle_set(text: bytes | None, words: _Words, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(words) > CACHE_WORDS:
        words.clear()
    ids = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(size, len(ids))
    h = np.full(len(ids) - k + 1, k, np.uint64)
    for j in range(k):
        h += ids[j : len(ids) - k + 1 + j] * _MIX[j % len(_MIX)]
    return np.unique(_mixed(h))


def probing(n: int) -> int:
    """Prefix of a set of n that holds a token of every partner's prefix: n - ceil(0.75 n) + 1."""
    return n - -(-3 * n // 4) + 1


def _batch_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes | None]]:
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


SETS = "node long, doc_id long, n long, digest binary, block int, counts binary"


def _scan_sets(batches):
    words, sketch, seen = _Words(), np.zeros(1 << SKETCH_BITS, np.uint32), set()
    schema = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())])
    for batch in batches:
        sizes, digests = [], []
        for _, text in _batch_rows(batch):
            s = shingle_set(text, words)
            sizes.append(len(s))
            digests.append(d := xxhash.xxh3_128_digest(s.tobytes()))
            if d not in seen:
                if len(seen) >= CACHE_SETS:
                    seen.clear()
                seen.add(d)
                at, c = np.unique((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), return_counts=True)
                sketch[at] += c.astype(np.uint32)
        none = pa.nulls(len(sizes))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
    if seen:
        blocks = sketch.reshape(-1, 1 << BLOCK_BITS)
        used = [i for i in range(len(blocks)) if blocks[i].any()]
        none = pa.nulls(len(used))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(used, pa.int32()), pa.array([blocks[i].tobytes() for i in used], pa.binary())], schema=schema)


def _sum_counts(pdf):
    total = np.zeros(1 << BLOCK_BITS, np.uint64)
    for c in pdf["counts"]:
        total += np.frombuffer(c, np.uint32)
    out = pdf.iloc[:1][["block"]].copy()
    out["counts"] = [np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()]
    return out


def count_table(scanned: DataFrame) -> np.ndarray:
    """The summed counts: 4 << SKETCH_BITS bytes, however many documents there are."""
    sketch = np.zeros((1 << (SKETCH_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint32)
    for r in scanned.where("block is not null").select("block", "counts").groupBy("block").applyInPandas(_sum_counts, "block int, counts binary").collect():
        sketch[r["block"]] = np.frombuffer(r["counts"], np.uint32)
    return sketch.reshape(-1)


def ordered(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The set from rare to frequent."""
    return s[np.argsort(sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")]


POSTINGS = "token long, node long, place long"


def _emit_prefixes(shared):
    """Rows (token, node, place) with place = size << 32 | position in the order."""

    def run(batches):
        words, sketch = _Words(), shared.value
        for batch in batches:
            tokens, nodes, places = [], [], []
            for node, text in _batch_rows(batch):
                if n := len(s := shingle_set(text, words)):
                    p = ordered(s, sketch)[: probing(n)]
                    tokens.append(p)
                    nodes.append(np.full(len(p), node, np.int64))
                    places.append((n << 32) + np.arange(len(p), dtype=np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(places))], names=["token", "node", "place"])

    return run


def may_link(n_x, i, n_y, j):
    """Whether sets of sizes n_x <= n_y can link if i and j are the positions of their first common token."""
    left = np.minimum(n_x - i, n_y - j)
    return (4 * n_x >= 3 * n_y) & (7 * left >= 3 * (n_x + n_y))


def common_needed(n_x, n_y):
    """Tokens that the prefixes of two linked sets have in common at least.

    Of the ceil(3 (n_x + n_y) / 7) common tokens, each prefix holds all but those that its set has after it;
    the first ones in the order are the same on both sides.
    """
    both = -(-3 * (n_x + n_y) // 7)
    return np.minimum(both - -(-3 * n_x // 4), both - -(-3 * n_y // 4)) + 1


def _arrays(batches, *names):
    for batch in batches:
        yield [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]


def _runs(batches, *names):
    """Rows of sorted batches, cut so that a run of equal first columns is never split; yields lists of arrays."""
    held: list[list[np.ndarray]] = []
    for cols in _arrays(batches, *names):
        key = cols[0]
        if not len(key):
            continue
        first = int(np.argmax(key == key[-1]))  # where the last run begins
        if held and first == 0 and key[0] == held[-1][0][-1]:
            held.append(cols)  # one run goes on
            continue
        head = [*held, [c[:first] for c in cols]]
        if sum(len(h[0]) for h in head):
            yield [np.concatenate([h[k] for h in head]) for k in range(len(cols))]
        held = [[c[first:] for c in cols]]
    if held:
        yield [np.concatenate([h[k] for h in held]) for k in range(len(held[0]))]


def _postings(batches):
    """Keeps the tokens of two or more nodes. Two rows are held at a time: one for context and one that is not yet judged."""
    held, skip = None, 0

    def judged(cols, upto):
        same = cols[0][1:] == cols[0][:-1]
        k = np.flatnonzero((np.r_[False, same] | np.r_[same, False])[skip:upto]) + skip
        for a in range(0, len(k), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[k[a : a + (1 << 16)]]) for x in cols], names=["token", "node", "place"])

    for cols in _arrays(batches, "token", "node", "place"):
        if not len(cols[0]):
            continue
        if held:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        yield from judged(cols, len(cols[0]) - 1)
        held = [c[-2:] for c in cols]
        skip = len(held[0]) - 1
    if held:
        yield from judged(held, len(held[0]))


def _hub_pairs(batches):
    """(node, hub, lists): each head with the one of its list that has the most repeated tokens, and with the neighbour before.

    An original has more of its tokens repeated than its edited copies have, so most copies meet it here.
    Rows of a run of lists are added up before they go out.
    """
    for token, node, place, repeats in _runs(batches, "token", "node", "place", "repeats"):
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[first, len(token)])
        rank = repeats << 32 | (len(token) - np.arange(len(token)))
        best = len(token) - (np.maximum.reduceat(rank, first) & 0xFFFFFFFF)
        n, i = place >> 32, place & 0xFFFFFFFF
        others = [np.repeat(best, size), np.maximum(np.arange(len(token)) - 1, np.repeat(first, size))]
        pairs = []
        for o in others:
            x, y = np.minimum(o, np.arange(len(token))), np.maximum(o, np.arange(len(token)))
            ok = (node[x] != node[y]) & may_link(n[x], i[x], n[y], i[y]) & (np.minimum(repeats[x], repeats[y]) >= common_needed(n[x], n[y]))
            pairs.append(np.stack([node[ok], node[o[ok]]], axis=1))
        pairs = np.concatenate(pairs)
        if len(pairs):
            pairs, count = np.unique(pairs, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(count.astype(np.int64))], names=["node", "hub", "lists"])


def _cross_pairs(batches):
    """Pairs of groups (heads a, b) in one list that pass the bounds and are not of one component; each at most once while remembered."""
    sent: set[tuple[int, int]] = set()
    for token, node, place, comp, mixed, repeats in _runs(batches, "token", "node", "place", "comp", "mixed", "repeats"):
        cuts = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True])
        out_a, out_b = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            c, m = comp[a:b], mixed[a:b]
            if (c == c[0]).all() and not m.any():
                continue
            d, n, i, r = node[a:b], place[a:b] >> 32, place[a:b] & 0xFFFFFFFF, repeats[a:b]
            low = np.searchsorted(4 * n, 3 * n)  # smaller partners must have 0.75 of the size
            for y in range(1, b - a):
                x = slice(low[y], y)
                for k in np.flatnonzero(((c[x] != c[y]) | m[x] | m[y]) & may_link(n[x], i[x], n[y], i[y]) & (np.minimum(r[x], r[y]) >= common_needed(n[x], n[y]))):
                    pair = (int(d[low[y] + k]), int(d[y]))
                    if pair not in sent:
                        if len(sent) > CACHE_PAIRS:
                            sent.clear()
                        sent.add(pair)
                        out_a.append(pair[0])
                        out_b.append(pair[1])
            if len(out_a) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
                out_a, out_b = [], []
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def _written_sets(batches):
    words = _Words()
    for batch in batches:
        sets = [shingle_set(text, words).tobytes() for _, text in _batch_rows(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])


def linked(x: bytes, y: bytes) -> bool:
    """100 * intersection >= 75 * union of two written sets."""
    both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
    common = int((both[1:] == both[:-1]).sum())
    return 7 * common >= 3 * len(both)


def _verify(batches):
    for batch in batches:
        a, b, x, y = (batch.column(k).to_pylist() for k in range(4))
        ok = [k for k in range(len(a)) if linked(x[k], y[k])]
        yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in ok], pa.int64()), pa.array([b[k] for k in ok], pa.int64())], names=["a", "b"])


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of texts (node, text) whose whole sets link.

    A filter of the pairs' nodes goes to the scan, so only their texts (and a few more) are read into sets.
    """
    ids = materialize(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    sets = texts.where(passes(F.col("node"), ids, ids.count())).select("node", "text")
    sets = materialize(sets.mapInArrow(_written_sets, "node long, set binary"), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("x")).hint("shuffle_merge")
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("y")).hint("shuffle_merge")
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return materialize(met.mapInArrow(_verify, "a long, b long"), "links")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def prefix_groups(postings: DataFrame) -> DataFrame:
    """(node, head, repeats): nodes with the same (token, place) rows form a group, named by its smallest node; repeats counts the rows.

    place holds the set's size, so the rows say prefix and size. They are compared by two 64-bit sums.
    """
    key = ["one", "other", "repeats"]
    sums = [F.bit_xor(F.xxhash64("token", "place")).alias("one"), F.expr("bit_xor(xxhash64(place, token, 1))").alias("other"), F.count("*").alias("repeats")]
    nodes = materialize(postings.groupBy("node").agg(*sums), "prefixes")
    large = nodes.groupBy(*key).agg(F.min("node").alias("head"), F.count("*").alias("members")).where("members > 1").drop("members")
    large = materialize(large, "groups")  # written, so that a large group can be split in the join
    return materialize(nodes.join(checked_broadcast(large), key, "left").select("node", F.coalesce("head", "node").alias("head"), "repeats"), "members")


def node_components(rows: DataFrame) -> DataFrame:
    """(node, doc_id, n, component) for rows (node, text binary, doc_id): n is the set's size, component the smallest node reachable."""
    spark = rows.sparkSession
    parts = shuffle_parts(spark)
    scanned = materialize(rows.mapInArrow(_scan_sets, SETS), "sets")
    shared = spark.sparkContext.broadcast(count_table(scanned))
    own = scanned.where("block is null").select("node", "doc_id", "n", "digest")
    classes = own.where("n > 0").groupBy("digest").agg(F.min("node").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes.where("copies > 1").drop("copies"), "classes")  # written, so that a large class can be split in the join
    reps = materialize(own.join(classes, "digest", "left").select("node", "doc_id", "n", F.coalesce("rep", "node").alias("rep")), "reps")
    discard(scanned)

    copies = materialize(reps.where("rep <> node").select(F.col("node").alias("copy")), "copies")
    prefixes = without(rows, "node", copies).select("node", "text").mapInArrow(_emit_prefixes(shared), POSTINGS)
    lists = prefixes.repartition(parts, "token").sortWithinPartitions("token", "place", "node")
    postings = materialize(lists.mapInArrow(_postings, POSTINGS), "postings")
    members = prefix_groups(postings)
    heads = members.where("node = head")
    counted = materialize(postings.join(heads.select("node", "repeats"), "node"), "counted")
    discard(postings)

    # a first linking: members with their heads, and heads with the hubs and neighbours they share the most lists with
    lists = counted.repartition(parts, "token").sortWithinPartitions("token", "place", "node")
    shares = lists.mapInArrow(_hub_pairs, "node long, hub long, lists long").groupBy("node", "hub").agg(F.sum("lists").alias("lists"))
    rank = F.row_number().over(W.partitionBy("node").orderBy(F.desc("lists"), "hub"))
    near = shares.withColumn("rank", rank).where(F.col("rank") <= NEIGHBOURS).select(*_ordered("hub", "node"))
    near = materialize(near.unionByName(members.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))).distinct(), "near")
    links = verified(rows, near)
    comps = materialize(components(links), "comps")

    # then all pairs of groups that the bounds leave, but for those of one component
    labels = checked_broadcast(comps.withColumnRenamed("component", "comp"))
    members = materialize(members.join(labels, "node", "left").select("node", "head", F.coalesce("comp", "node").alias("comp")), "labelled")
    mixed = members.where("node <> head").groupBy("head").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    own_comp = members.where("node = head").select("node", "comp")
    mixed = materialize(mixed.join(own_comp, F.col("head") == F.col("node")).where("low <> comp or high <> comp").select("head"), "mixed")
    several = F.coalesce("several", F.lit(False)).alias("mixed")
    labelled = counted.join(own_comp, "node").join(checked_broadcast(mixed.select(F.col("head").alias("node"), F.lit(True).alias("several"))), "node", "left").select("token", "node", "place", "comp", several, "repeats")
    lists = labelled.repartition(parts, "token").sortWithinPartitions("token", "place", "node")
    pairs = lists.mapInArrow(_cross_pairs, "a long, b long").select(*_ordered("a", "b")).distinct()
    pairs = materialize(pairs.unionByName(mixed.select(F.col("head").alias("a"), F.col("head").alias("b"))), "pairs")
    discard(counted)
    side = lambda c: members.select(F.col("head").alias(c), F.col("node").alias(f"{c}_node"), F.col("comp").alias(f"{c}_comp"))
    cross = pairs.join(side("a"), "a").join(side("b"), "b").where("a_comp <> b_comp").select(*_ordered("a_node", "b_node")).distinct()
    cross = materialize(cross.join(near, ["a", "b"], "left_anti"), "cross")
    comps = components(links.unionByName(verified(rows, cross)))
    return reps.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("node", "doc_id", "n", F.coalesce("component", "rep").alias("component"))


def _rows(docs: DataFrame) -> DataFrame:
    """(node, text, doc_id) from numbered documents."""
    return docs.select(F.col("row").alias("node"), F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))


def similarity_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    found = materialize(node_components(_rows(numbered(docs.select("doc_id", "text"), "text"))), "found")
    if found.where("not node <=> doc_id").limit(1).count():
        ids = found.select(F.col("node").alias("component"), F.col("doc_id").alias("component_id"))
        found = found.join(ids, "component")
    else:
        found = found.withColumn("component_id", F.col("component"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with only one document of each component: the one of the smallest doc_id."""
    columns = docs.columns
    inner = docs.withColumnsRenamed({c: f"_j_{c}" for c in columns if c not in ("doc_id", "text")})
    rows = numbered(inner, "text")
    gone = materialize(node_components(_rows(rows)).where("component <> node").select(F.col("node").alias("_j_gone_")), "gone")
    left = without(rows, "row", gone)
    return left.select(*(F.col(c if c in ("doc_id", "text") else f"_j_{c}").alias(c) for c in columns))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT x, y FROM e UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id
"""
