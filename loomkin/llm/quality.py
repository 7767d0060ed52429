"""Quality rules with host-level verdicts.

Per document the rules are judged on the whole text. Per host (the source column) the failures of
each rule are summed, the failure rate is shrunk towards a beta prior fitted to all hosts by the
method of moments (the spread of the rates less what binomial sampling adds to it), and a host whose shrunk rate of some rule reaches HOST_LIMIT is rejected with
all its documents. Everything runs as DataFrame expressions; the text never leaves its scan task.

Defined results: a null or empty text has no words and fails `short`. A null host takes part in no
host verdict. Repeated rows are judged, counted and returned once each. An empty table gives an
empty result. Other columns of the input are kept out of the way (all internal names start with
`_q_`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkin.llm.common import BROADCAST_ROWS, let, materialize, table

#: Production parameters.
MIN_WORDS, REPEAT_PERCENT, SYMBOL_PERCENT, WINDOW = 20, 30, 25, 8
HOST_LIMIT = 0.5
#: Bounds of the prior's strength in pseudo-documents.
PRIOR_MIN, PRIOR_MAX = 1.0, 1000.0
SALTS = 64
RULES = ("short", "repeats", "symbols")
SPACE = r"[\x20\x09-\x0D]+"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of `window` words that occur twice or more in the array."""

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda x, i: F.when(i == 0, F.lit(window)).otherwise(F.least(F.lit(window), x - F.get(at, i - 1))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(pairs: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        hit = F.filter(pairs, lambda x, i: same(F.get(pairs, F.greatest(i - 1, F.when(i > 0, F.lit(0)))), x) & (i > 0) | same(F.get(pairs, i + 1), x))
        return let(F.sort_array(F.transform(hit, lambda x: x["p"])), covered)

    def hashed(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, repeated))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) < window + 1, F.lit(0).cast("long")).otherwise(let(windows, hashed))


def features(text: Column) -> Column:
    """Struct of FEATURES (long) over the whole text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.array_remove(F.split(text, SPACE), "")
    return let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )


def score(docs: DataFrame) -> DataFrame:
    """docs with `_q_*`: the features and one boolean for each rule."""
    f = docs.withColumn("_q_f", features(F.col("text")))
    f = f.select(*docs.columns, *(F.col(f"_q_f.{c}").alias(f"_q_{c}") for c in FEATURES))
    n = F.col("_q_n_words")
    return f.withColumns(
        {
            "_q_short": n < MIN_WORDS,
            "_q_repeats": 100 * F.col("_q_n_repeat_words") > REPEAT_PERCENT * n,
            "_q_symbols": 100 * F.col("_q_n_symbols") > SYMBOL_PERCENT * F.col("_q_word_chars"),
        }
    )


def rejected_hosts(scored: DataFrame, host: str = "source") -> DataFrame:
    """Hosts with a shrunk failure rate of HOST_LIMIT or more in some rule.

    Rates are whole parts per million, so the prior's moments are exact sums whatever their order.
    Only one row of sums reaches the driver.
    """
    counts = scored.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("_q_host")).agg(F.count("*").alias("n"), *(F.sum(F.col(f"_q_{r}").cast("long")).alias(r) for r in RULES))
    counts = materialize(counts, "hosts")
    ppm = lambda r: F.floor(1_000_000 * F.col(r) / F.col("n")).cast("long")
    share = F.floor(F.lit(1_000_000) / F.col("n")).cast("long")
    sums = counts.agg(F.count("*").alias("hosts"), F.sum(share).alias("shares"), *(x for r in RULES for x in (F.sum(ppm(r)).alias(f"{r}_1"), F.sum((ppm(r) * ppm(r)).cast("decimal(38,0)")).alias(f"{r}_2")))).first()
    bad = F.lit(False)
    for r in RULES:
        a, b = prior(sums["hosts"], int(sums[f"{r}_1"] or 0), int(sums[f"{r}_2"] or 0), int(sums["shares"] or 0))
        bad = bad | ((F.col(r) + F.lit(a)) / (F.col("n") + F.lit(a + b)) >= HOST_LIMIT)
    return counts.where(bad).select("_q_host")


def prior(hosts: int, total: int, squares: int, shares: int) -> tuple[float, float]:
    """Beta (a, b) by the method of moments, from sums over hosts of the rates, their squares and 1 / n, in parts per million.

    A host of n documents and rate p adds p (1 - p) / n to the spread of the observed rates by chance.
    """
    if not hosts:
        return 0.5, 0.5
    mean = total / hosts / 1e6
    chance = mean * (1 - mean) * (shares / hosts / 1e6)
    var = max(squares / hosts / 1e12 - mean * mean - chance, 1e-12)
    strength = min(max(mean * (1 - mean) / var - 1, PRIOR_MIN), PRIOR_MAX)
    return mean * strength, (1 - mean) * strength


def with_verdicts(scored: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """scored with `_q_base_failed` and `_q_kept`. A small, counted host list is broadcast; a longer one meets salted rows."""
    n = hosts.count()
    marked = hosts.withColumn("_q_bad", F.lit(True))
    if n <= BROADCAST_ROWS:
        joined = scored.join(F.broadcast(marked), F.col(host) == F.col("_q_host"), "left")
    else:
        salted = marked.withColumn("_q_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("_q_host", "_q_host_r").withColumnRenamed("_q_salt", "_q_salt_r")
        keyed = scored.withColumn("_q_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        joined = keyed.join(salted, (F.col(host) == F.col("_q_host_r")) & (F.col("_q_salt") == F.col("_q_salt_r")), "left")
    failed = F.col("_q_short") | F.col("_q_repeats")
    return joined.withColumn("_q_base_failed", failed).withColumn("_q_kept", ~failed & F.col("_q_bad").isNull())


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that pass their own rules and whose host is not rejected, with docs' columns."""
    inner = docs.withColumnsRenamed({c: f"_d_{c}" for c in docs.columns if c not in ("text", host)})
    # written once with the marks, so that no text is scored twice; texts that go anyhow are left out
    marks = [F.col(f"_q_{r}") for r in RULES]
    failed = F.col("_q_short") | F.col("_q_repeats")
    scored = materialize(score(inner).select(*(c for c in inner.columns if c != "text"), F.when(~failed, F.col("text")).alias("text"), *marks), "scored")
    left = with_verdicts(scored, rejected_hosts(scored, host), host).where("_q_kept")
    return left.select(*(F.col(c if c in ("text", host) else f"_d_{c}").alias(c) for c in docs.columns))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    scored = materialize(score(docs).drop("text"), "quality")
    out = with_verdicts(scored, rejected_hosts(scored))
    return out.select("doc_id", *(F.col(f"_q_{c}").alias(c) for c in FEATURES), F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, list_slice(w, i, i + 7) AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
rw AS (SELECT doc_id, CAST(sum(least(8, coalesce(i - p, 8))) AS BIGINT) AS n
       FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rw ON rw.doc_id = d.doc_id),
s AS (
  SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repeats, 100 * n_symbols > 25 * word_chars AS symbols FROM f),
h AS (
  SELECT source, count(*) AS n, sum(short::INT) AS a, sum(repeats::INT) AS b, sum(symbols::INT) AS c FROM s WHERE source IS NOT NULL GROUP BY source),
u AS (SELECT source, n, unnest([a, b, c]) AS k, unnest([1, 2, 3]) AS rule FROM h),
m AS (
  SELECT rule, avg(p) / 1e6 AS mean, avg(p * p) / 1e12 AS squares, avg(s) / 1e6 AS share
  FROM (SELECT rule, floor(1000000 * k / n) AS p, floor(1000000 / n) AS s FROM u) GROUP BY rule),
z AS (
  SELECT rule, mean, least(greatest(mean * (1 - mean) / greatest(squares - mean * mean - mean * (1 - mean) * share, 1e-12) - 1, 1), 1000) AS strength
  FROM m),
bad AS (
  SELECT DISTINCT source FROM u JOIN z USING (rule) WHERE (k + mean * strength) / (n + strength) >= 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
       NOT (short OR repeats) AND bad.source IS NULL AS kept
FROM s LEFT JOIN bad ON bad.source = s.source
"""
