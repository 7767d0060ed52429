"""Benchmark decontamination by a prefix-filtered containment join.

An item's windows (ten consecutive words; a shorter item is one window) must be contained whole in a
document, so of each window's shingles, ordered by how rare they are in the corpus, one is a necessary
prefix: the rarest. Documents emit their shingles, the join keeps those that are some window's prefix,
length and position bounds drop windows that would not fit at that place, and the document's words there
are compared with the window's one by one.

Up to BROADCAST_ROWS prefixes go to the scan: nothing but counts of the items' own shingles and verified
hits is shuffled; the text and the words stay in the scan task. Beyond that a filter of bounded size of
the prefixes goes to the scan, and what passes it - a shingle's place and the few words around it - is
joined with the prefixes.

Defined results: null or empty texts have no words; such items have no windows. Repeated item texts
all count as found; repeated document rows, and rows without a doc_id, give one row each. With an empty
benchmark no document is hit; with no documents there are no rows. Only the columns doc_id, text and
item_id are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkin.llm import common
from loomkin.llm.bloom import passes, without
from loomkin.llm.common import ascii_lower, checked_broadcast, let, materialize, numbered, table

WINDOW, SHINGLE = 10, 3
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Documents emit this once more than their shingles, so that those without a hit stay.
EVERY = 0


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def shingles(words: Column, size: int) -> Column:
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(F.size(words) >= size, hashes).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: words, len, items (ids as strings)."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    each = w.select("item", "w", F.explode(starts).alias("i")).select("item", F.slice("w", F.col("i"), window).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("len", F.size("words"))


def window_shingles(windows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Each window's shingles: h, at (position in the window), size; windows shorter than a shingle are one."""
    parts = None
    for k in range(1, size + 1):
        of = windows.where(F.col("len") >= k) if k == size else windows.where(F.col("len") == k)
        part = of.select("words", F.posexplode(shingles(F.col("words"), k)).alias("at", "h")).withColumn("size", F.lit(k))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def emitted(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """row, doc_id, words, n and (pos, h, size) for all shingles of the given sizes, and one row with h EVERY and size 0."""
    last = F.array(F.lit(EVERY).cast("long"))

    def both(w: Column) -> Column:
        return F.struct(w.alias("words"), *(shingles(w, k).alias(f"h{k}") for k in sizes))

    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", let(words_of(F.col("text")), both).alias("x"))
    own = own.select("row", "doc_id", "x.*").withColumn("n", F.size("words"))
    if len(sizes) == 1:  # a plain array of hashes, the last one the extra
        k = sizes[0]
        out = own.select("row", "doc_id", "words", "n", F.posexplode(F.concat(f"h{k}", last)).alias("pos", "h"))
        return out.withColumn("size", F.when(F.col("pos") >= F.col("n") - (k - 1), F.lit(0)).otherwise(F.lit(k)))
    each = [_sized(F.col(f"h{k}"), k) for k in sizes]
    out = own.select("row", "doc_id", "words", "n", F.explode(F.concat(*each, _sized(last, 0))).alias("x"))
    return out.select("row", "doc_id", "words", "n", "x.pos", "x.h", "x.size")


def _sized(hashes: Column, size: int) -> Column:
    return F.transform(hashes, lambda h, i: F.struct(i.alias("pos"), h.alias("h"), F.lit(size).alias("size")))


def containments(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document row: row, doc_id, n_words, hits (start, len) in order, items (sorted ids)."""
    windows = materialize(item_windows(items), "windows")
    grams = materialize(window_shingles(windows), "grams")
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect()) or [SHINGLE]
    # rarity: how often the corpus has each shingle of the items
    known = materialize(grams.select("h", "size").distinct(), "known")
    n_known = known.count()
    every_shingle = emitted(docs, sizes).select("h", "size")
    if n_known > common.BROADCAST_ROWS:
        every_shingle = every_shingle.where(passes(F.col("h"), known.select("h").distinct(), n_known))
    seen = every_shingle.join(checked_broadcast(known, n_known), ["h", "size"]).groupBy("h", "size").agg(F.count("*").alias("freq"))
    ranked = grams.join(checked_broadcast(materialize(seen, "rarity")), ["h", "size"], "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    prefix = ranked.groupBy("words").agg(F.min(F.struct("freq", "h", "at", "size")).alias("p")).where("p.freq > 0")
    prefix = prefix.join(windows, "words").select(F.col("p.h").alias("h"), F.col("p.size").alias("size"), F.col("p.at").alias("at"), F.col("words").alias("want"), "len", "items")
    prefix = materialize(prefix, "prefix")
    n_prefix = prefix.count()
    start = F.col("pos") - F.col("at")
    if n_prefix <= common.BROADCAST_ROWS:
        every = docs.sparkSession.range(1).select(F.lit(EVERY).cast("long").alias("h"), F.lit(0).alias("size"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("want"), F.lit(0).alias("len"), F.array().cast("array<string>").alias("items"))
        met = emitted(docs, sizes).withColumn("shift", F.lit(0)).join(F.broadcast(prefix.unionByName(every)), ["h", "size"])
    else:
        own = emitted(docs, sizes)
        whole = F.col("size") == 0
        shift = F.when(whole, 0).otherwise(F.greatest(F.col("pos") - (WINDOW - 1), F.lit(0)))
        near = F.when(~whole, F.slice("words", shift + 1, 2 * WINDOW - 1))
        own = own.where(whole | passes(F.col("h"), prefix.select("h").distinct(), n_prefix))
        # rows that stand for documents meet nothing, and are spread by their number
        own = own.select("row", "doc_id", "n", "pos", F.when(whole, F.col("row")).otherwise(F.col("h")).alias("h"), "size", shift.alias("shift"), near.alias("words"))
        met = own.join(prefix, ["h", "size"], "left").withColumns({"len": F.when(F.col("size") == 0, 0).otherwise(F.col("len")), "items": F.coalesce("items", F.array().cast("array<string>"))}).where("len is not null")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n"))
    same = F.slice("words", F.when(fits, start - F.col("shift") + 1).otherwise(F.lit(1)), F.col("len")) == F.col("want")
    found = met.where((F.col("len") == 0) | fits & same)
    hit = F.when(F.col("len") > 0, F.struct(start.alias("start"), F.col("len")))
    rows = found.select("row", "doc_id", "n", hit.alias("hit"), "items").groupBy("row", "doc_id")
    return rows.agg(F.max("n").cast("long").alias("n_words"), F.sort_array(F.collect_list("hit")).alias("hits"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def covered(hits: Column) -> Column:
    """Words under the union of hits, which are in order."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, h: Column) -> Column:
        end = h["start"] + h["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], h["start"]))).alias("n"))

    return F.aggregate(hits, zero, step)["n"]


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the documents in which a window of some item occurs."""
    columns = docs.columns
    inner = docs.withColumnsRenamed({c: f"_d_{c}" for c in columns if c not in ("doc_id", "text")})
    rows = numbered(inner, "text")
    bad = containments(rows.select(F.col("row").alias("doc_id"), "text"), items).where(F.size("hits") > 0)
    left = without(rows, "row", materialize(bad.select(F.col("doc_id").alias("_d_gone_")), "contaminated"))
    return left.select(*(F.col(c if c in ("doc_id", "text") else f"_d_{c}").alias(c) for c in columns))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = containments(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", covered(F.col("hits")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated")
    )


OP3_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT item, list_slice(w, i, i + 9) AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS l FROM win),
dg AS (
  SELECT r, i, l, list_slice(w, i, i + l - 1) AS win FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, lens WHERE len(w) >= l)),
hit AS (SELECT r, i, l, item FROM dg JOIN win USING (win)),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos ON pos.r = dw.r LEFT JOIN its ON its.r = dw.r
"""
