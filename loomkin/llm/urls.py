"""URL filter: fixed host/path rules, then exact list membership by a cascade of Bloom filters.

The complete key universe is known: every distinct host + path of the table. Level 1 encodes the
listed keys; level 2 the universe's other keys that level 1 wrongly accepts; level 3 the listed keys
that level 2 wrongly accepts, and so on until no key is wrong. A key of the universe is then judged
exactly by the first level that rejects it, without a join. Levels are strings of 7-bit characters,
so that one character is read and one bit tested for each hash, inside a plain expression.

The list is a table of exact keys (`flagged`), or any flag of the universe's keys. Keys are dealt by hash
to as many cascades as the bound on one cascade's bytes asks for, built together level by level. One
cascade is a constant of the plan; several are rows, in SALTS copies or more, that keys meet by their
shard and a salt, so that a key with many rows does not meet them in one task.

Defined results: a null URL, or one without `://`, has an empty host and path and is an ordinary,
unlisted key. Repeated rows are judged once each. An empty table or list gives an empty cascade that
rejects everything. Only page_id and url are read; other columns do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkin.llm.bloom import WIDTH, accepted, bit_at, bit_set, body_of, packed
from loomkin.llm.common import ascii_lower, materialize, shuffle_parts, table

#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The query's list: every key whose host has one of these labels (a parameter).
LISTED_LABELS = ("ads-track", "casino-win", "spam-farm", "adult-x", "cheap-pills", "free-bets")
#: False positives of levels after the first, and the most bytes in one cascade held as a constant.
LATER_RATE, MOST_BYTES = 2.0**-5, 1 << 20
LEVELS, SALTS = 64, 8


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def under(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith("." + domain)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as written, and its verdict; null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [under(host, h) & path.startswith(p) for h, p, _ in ordered]
    name = F.coalesce(*(F.when(f, F.lit(h + p)) for f, (h, p, _) in zip(fits, ordered, strict=True)))
    verdict = F.coalesce(*(F.when(f, F.lit(v)) for f, (_, _, v) in zip(fits, ordered, strict=True)))
    return name, verdict


def accepted_by(key: Column, level: int, cascade: Column) -> Column:
    """The same for a level (probes, bits, body) that is a column."""
    probes = F.sequence(F.lit(0), cascade["probes"] - 1)
    return F.forall(probes, lambda j: bit_set(bit_at(key, level, j, cascade["bits"]), cascade["body"]))


def parameters(n_in: int, n_out: int, level: int) -> tuple[int, int]:
    """(probes, bits) of a level for n_in keys against n_out others; a level without keys rejects all."""
    rate = LATER_RATE if level else min(0.5, max(2.0**-16, math.sqrt(0.5) * n_in / max(n_out, 1)))
    probes = max(1, round(-math.log2(rate)))
    return probes, max(WIDTH, math.ceil(n_in * probes / math.log(2)))


def level_table(keys: DataFrame, level: int, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """(shard, probes, bits, body) of one level for all shards at once, from keys (key, shard); sizes: (probes, bits) by shard."""
    spark = keys.sparkSession
    values = ", ".join(f"({s}, {p}, {b}L)" for s, (p, b) in sorted(sizes.items()))
    plan = F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t(shard, probes, bits)"))
    probed = keys.join(plan, "shard").select("key", "shard", "bits", F.explode(F.sequence(F.lit(0), F.col("probes") - 1)).alias("j"))
    at = probed.select("shard", bit_at(F.col("key"), level, F.col("j"), F.col("bits")).alias("at"))
    grid = plan.select("shard", "probes", "bits", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("bits") / WIDTH) - 1)).alias("c"))
    full = grid.join(packed(at, "shard"), ["shard", "c"], "left").groupBy("shard", "probes", "bits")
    body = body_of(F.collect_list(F.struct("c", F.coalesce("v", F.lit(0)).alias("v")))).cast("binary")
    return materialize(full.agg(body.alias("body")), f"level{level}")


def build_cascades(keys: DataFrame, shards: int) -> list[DataFrame]:
    """Levels for keys (key, listed, shard), distinct and complete; every level is made for all shards in one pass.

    Only two counts a shard and level reach the driver.
    """
    counts = {(r["shard"], r["listed"]): r["n"] for r in keys.groupBy("shard", "listed").agg(F.count("*").alias("n")).collect()}
    n_in, n_out = ({s: counts.get((s, flag), 0) for s in range(shards)} for flag in (True, False))
    inside, outside = keys.where("listed").select("key", "shard"), keys.where("not listed").select("key", "shard")
    levels: list[DataFrame] = []
    while any(n_in.values()):
        k = len(levels)
        if k >= LEVELS:
            raise RuntimeError("the cascade does not end; are the keys distinct?")
        levels.append(level_table(inside, k, {s: parameters(n_in[s], n_out[s], k) for s in range(shards)}))
        own = levels[k].select("shard", F.struct("probes", "bits", "body").alias("l")).hint("broadcast" if shards == 1 else "shuffle_hash")
        wrong = outside.join(own, "shard").where(accepted_by(F.col("key"), k, F.col("l"))).select("key", "shard")
        wrong = materialize(wrong, f"wrong{k}")
        inside, outside, n_out = wrong, inside, n_in
        found = {r["shard"]: r["n"] for r in wrong.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        n_in = {s: found.get(s, 0) for s in range(shards)}
    return levels


def member(key: Column, accepts: list[Column]) -> Column:
    """Exact membership for keys of the universe: the parity of the first level that rejects."""
    out = F.lit(len(accepts) % 2 == 1)
    for k in reversed(range(len(accepts))):
        out = F.when(accepts[k], out).otherwise(F.lit(k % 2 == 1))
    return out


def flagged(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, listed) for every key of rows (key, ...), from a table of listed keys (key); the list need not be distinct or inside rows."""
    own = rows.select("key").distinct()
    return own.join(listed.select("key", F.lit(True).alias("listed")).distinct(), "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))


def listed_flags(rows: DataFrame, keys: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """rows (key, ...) with `listed`, for keys (key, listed) that hold every key of rows once.

    A list that fits one cascade of most_bytes is judged by constants, without a join. A larger one is
    dealt into shards by a hash of the key, and rows meet their shard's cascade by that number and a salt.
    """
    listed = keys.where("listed").count()
    shards = max(1, -(-listed * 3 // most_bytes))  # a listed key takes under 3 bytes over all levels
    shard = F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(shards)).cast("int")
    levels = build_cascades(keys.select("key", "listed", shard.alias("shard")), shards)
    key = F.col("key")
    if shards == 1:
        held = [x.first() for x in levels]
        return rows.withColumn("listed", member(key, [accepted(key, k, x["probes"], x["bits"], F.lit(bytes(x["body"]))) for k, x in enumerate(held)]))
    salts = max(SALTS, -(-shuffle_parts(rows.sparkSession) // shards))
    met = rows.withColumn("_u_shard", shard).withColumn("_u_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    cascades = levels[0].select(F.col("shard").alias("_u_shard"), F.struct("probes", "bits", "body").alias("_u_0"))
    for k, x in enumerate(levels[1:], 1):
        cascades = cascades.join(x.select(F.col("shard").alias("_u_shard"), F.struct("probes", "bits", "body").alias(f"_u_{k}")), "_u_shard")
    cascades = cascades.withColumn("_u_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = met.join(cascades.hint("shuffle_hash"), ["_u_shard", "_u_salt"])
    out = met.withColumn("listed", member(key, [accepted_by(key, k, F.col(f"_u_{k}")) for k in range(len(levels))]))
    return out.select(*rows.columns, "listed")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", F.concat("host", "path"))
    listed = F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, LISTED_LABELS)))
    keys = materialize(rows.select("key", listed.alias("listed")).groupBy("key").agg(F.bool_or("listed").alias("listed")), "keys")
    name, verdict = rule_of(F.col("host"), F.col("path"))
    judged = listed_flags(rows, keys)
    return judged.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    regexp_matches(host, '(^|\.)(ads-track|casino-win|spam-farm|adult-x|cheap-pills|free-bets)(\.|$)') AS listed
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
