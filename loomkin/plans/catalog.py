"""Registered queries and their SQL for DuckDB. Doubles are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomkin.functions import encode as E
from loomkin.model.domain import Domain
from loomkin.operators import evaluate as V
from loomkin.operators import longfactor as L
from loomkin.operators import marginals as M
from loomkin.operators import matching as J
from loomkin.operators import relational as R
from loomkin.plans.fixtures import CHILD, CHILD_DOMAIN, KEYED, PARENT, PARENT_DOMAIN, child, keyed_child, parent
from loomkin.sources.io import first_rows, read_parquet, train_test

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from loomkin.plans import models  # noqa: F401  registers the queries of the fitted models

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- counts ---


@query(f"WITH {CHILD} SELECT rf, count(*) AS n FROM c GROUP BY rf")
def marginal_1way(spark, sf):
    return M.marginal(child(spark, sf), ["rf"])


@query(f"""WITH {CHILD} SELECT a.v AS rf, b.v AS qty, count(c.rf) AS n FROM (SELECT unnest(range(3)) AS v) a CROSS JOIN (SELECT unnest(range(50)) AS v) b
LEFT JOIN c ON c.rf = a.v AND c.qty = b.v GROUP BY a.v, b.v""")
def marginal_2way_dense(spark, sf):
    own = CHILD_DOMAIN.project(["rf", "qty"])
    return M.dense(M.marginal(child(spark, sf), list(own)), own)


@query(f"WITH {CHILD} SELECT rf, qty, disc, count(*) AS n FROM c GROUP BY rf, qty, disc")
def marginal_3way_sparse(spark, sf):
    return M.marginal(child(spark, sf), ["rf", "qty", "disc"])


@query(f"""WITH {CHILD} SELECT CASE grouping(rf, ls, disc) WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 3 THEN 3 END AS set_id, rf, ls, disc, count(*) AS n
FROM c GROUP BY GROUPING SETS ((rf, ls), (rf, disc), (ls, disc), (rf))""")
def marginals_grouping_sets(spark, sf):
    return M.marginals(child(spark, sf), [("rf", "ls"), ("rf", "disc"), ("ls", "disc"), ("rf",)])


_ALL = CHILD_DOMAIN.pairs()
_MASK = [sum(1 << (len(CHILD_DOMAIN) - 1 - i) for i, a in enumerate(CHILD_DOMAIN) if a not in p) for p in _ALL]


@query(f"""WITH {CHILD} SELECT CASE grouping({", ".join(CHILD_DOMAIN)}) {" ".join(f"WHEN {m} THEN {i}" for i, m in enumerate(_MASK))} END AS set_id, {", ".join(CHILD_DOMAIN)}, count(*) AS n
FROM c GROUP BY GROUPING SETS ({", ".join(f"({a}, {b})" for a, b in _ALL)})""")
def marginals_all_pairs(spark, sf):
    """All pairs of six attributes in one scan."""
    return M.marginals(child(spark, sf), _ALL)


@query(f"WITH {CHILD} SELECT rf, disc, CAST(sum(qty + 1) AS BIGINT) AS n FROM c GROUP BY rf, disc")
def weighted_marginal(spark, sf):
    return M.marginal(child(spark, sf), ["rf", "disc"], weight=(F.col("qty") + 1).cast("long"))


@query("SELECT size, count(*) AS n FROM (SELECT o_orderkey, count(l_orderkey) AS size FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) GROUP BY size")
def group_size_hist(spark, sf):
    return M.group_sizes(child(spark, sf), "fk", parents=parent(spark, sf), pk="pk")


@query("SELECT least(size, 6) AS size, count(*) AS n FROM (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY least(size, 6)")
def group_size_hist_capped(spark, sf):
    return M.group_sizes(child(spark, sf), "fk", cap=6)


@query("""WITH s AS (SELECT least(size, 12) AS size, count(*) AS n FROM (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY 1),
f AS (SELECT b.size, coalesce(s.n, 0) AS n FROM (SELECT unnest(range(1, 13)) AS size) b LEFT JOIN s USING (size))
SELECT size, round(CASE WHEN size <= 2 THEN n ELSE avg(n) OVER (PARTITION BY CASE WHEN size <= 2 THEN -size WHEN size <= 8 THEN (size - 3) // 2 ELSE 100 + (size - 9) // 4 END) END, 6) AS smoothed FROM f""")
def block_smoothed_sizes(spark, sf):
    out = M.block_smoothed(M.group_sizes(child(spark, sf), "fk", cap=12), [(2, 2), (8, 4)], 12)
    return out.select("size", r6("smoothed").alias("smoothed"))


@query("SELECT CAST(sum(size * n) AS BIGINT) AS n_rows FROM (SELECT size, count(*) AS n FROM (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY size)")
def group_size_rows(spark, sf):
    return M.rows_in_groups(M.group_sizes(child(spark, sf), "fk"))


def _status_types(spark, sf) -> DataFrame:
    """A fixed soft assignment for checks: an order's status takes three quarters, the next type one quarter."""
    own = parent(spark, sf).select(F.col("pk").alias("fk"), "st")
    return own.select("fk", F.col("st").alias("y"), F.lit(0.75).alias("p")).unionByName(own.select("fk", ((F.col("st") + 1) % 3).cast("int").alias("y"), F.lit(0.25).alias("p")))


TYPES = f"{PARENT}, q AS (SELECT pk AS fk, st AS y, 0.75::DOUBLE AS p FROM p UNION ALL SELECT pk, (st + 1) % 3, 0.25::DOUBLE FROM p)"


@query(f"WITH {CHILD}, {TYPES}, s AS (SELECT fk, least(count(*), 6) AS size FROM c GROUP BY fk) SELECT y, size, round(sum(p), 6) AS n FROM q JOIN s USING (fk) GROUP BY y, size")
def type_size_table(spark, sf):
    return M.type_sizes(child(spark, sf), "fk", _status_types(spark, sf), ["y"], 6).select("y", "size", r6("n").alias("n"))


@query(f"WITH {CHILD}, {TYPES}, s AS (SELECT fk, count(*) AS size FROM c GROUP BY fk) SELECT y, round(sum(size * p), 6) AS n FROM q JOIN s USING (fk) GROUP BY y")
def y_dist(spark, sf):
    return M.type_rows(child(spark, sf), "fk", _status_types(spark, sf), ["y"]).select("y", r6("n").alias("n"))


@query(f"WITH {CHILD}, {TYPES} SELECT rf, y, round(sum(p), 6) AS n FROM c JOIN q USING (fk) GROUP BY rf, y")
def latent_weighted_marginal(spark, sf):
    return M.latent_marginal(child(spark, sf), "fk", _status_types(spark, sf), ["rf", "y"], ["y"]).select("rf", "y", r6("n").alias("n"))


@query("SELECT l_shipdate AS value, count(*) AS n FROM lineitem GROUP BY l_shipdate ORDER BY n DESC, value LIMIT 100")
def top_value_frequencies(spark, sf):
    return M.value_counts(read_parquet(spark, sf, "lineitem"), "l_shipdate").limit(100)


@query("""WITH v AS (SELECT l_shipdate AS value, count(*) AS n FROM lineitem GROUP BY l_shipdate)
SELECT round((SELECT sum(n) FROM (SELECT n FROM v ORDER BY n DESC, value LIMIT 100)) / (SELECT sum(n) FROM v), 6) AS coverage""")
def value_coverage(spark, sf):
    return M.coverage(read_parquet(spark, sf, "lineitem"), "l_shipdate").select(r6("coverage").alias("coverage"))


@query(f"WITH {CHILD} SELECT 'rf' AS attr, max(rf) + 1 AS size FROM c UNION ALL SELECT 'qty', max(qty) + 1 FROM c UNION ALL SELECT 'disc', max(disc) + 1 FROM c")
def adaptive_domain(spark, sf):
    found = Domain.inferred(child(spark, sf), ["rf", "qty", "disc"])
    return spark.createDataFrame([(a, x.size) for a, x in found.items()], "attr string, size int")


@query(f"WITH {CHILD} SELECT CAST(count(*) FILTER (WHERE qty NOT BETWEEN 0 AND 39) AS BIGINT) AS qty, CAST(count(*) FILTER (WHERE rf NOT BETWEEN 0 AND 2) AS BIGINT) AS rf FROM c")
def domain_violations(spark, sf):
    return Domain({"qty": 40, "rf": 3}).violations(child(spark, sf))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def distinct_row_counts(spark, sf):
    return M.marginal(read_parquet(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(f"""WITH {CHILD} SELECT members, count(*) AS n FROM (SELECT fk, string_agg(rf || 'x' || t, ',' ORDER BY rf) AS members FROM (SELECT fk, rf, count(*) AS t FROM c GROUP BY fk, rf) GROUP BY fk) GROUP BY members""")
def group_multiset_freq(spark, sf):
    out = M.group_multisets(child(spark, sf), "fk", ["rf"])
    text = F.array_join(F.transform("members", lambda m: F.concat(m["rf"].cast("string"), F.lit("x"), m["times"].cast("string"))), ",")
    return out.select(text.alias("members"), "n")


# --- information and distances ---


@query(f"WITH {CHILD}, g AS (SELECT rf, count(*) AS n FROM c GROUP BY rf) SELECT round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy FROM g")
def entropy_1way(spark, sf):
    return M.entropy(child(spark, sf), ["rf"]).select(r6("entropy").alias("entropy"))


@query(f"WITH {CHILD}, g AS (SELECT qty, disc, count(*) AS n FROM c GROUP BY qty, disc) SELECT round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy FROM g")
def entropy_2way(spark, sf):
    return M.entropy(child(spark, sf), ["qty", "disc"]).select(r6("entropy").alias("entropy"))


_H = "(SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM (SELECT count(*) AS n FROM c GROUP BY {0}))"


@query(f"WITH {CHILD} SELECT round({_H.format('rf')} + {_H.format('ls')} - {_H.format('rf, ls')}, 6) AS mutual_information")
def mutual_information(spark, sf):
    return M.total_correlation(child(spark, sf), ["rf", "ls"]).select(r6("mutual_information").alias("mutual_information"))


@query(f"WITH {CHILD} SELECT round({_H.format('rf')} + {_H.format('ls')} + {_H.format('disc')} - {_H.format('rf, ls, disc')}, 6) AS mutual_information")
def total_correlation_3way(spark, sf):
    return M.total_correlation(child(spark, sf), ["rf", "ls", "disc"]).select(r6("mutual_information").alias("mutual_information"))


def _r_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS a, '{b}' AS b, round(sum(abs(x.n * y.n / t.n - coalesce(z.n, 0))) / 2, 4) AS r_score, round(sum(abs(x.n * y.n / t.n - coalesce(z.n, 0))) / 2 / any_value(t.n), 6) AS tvd
FROM (SELECT {a} AS va, count(*)::DOUBLE AS n FROM c GROUP BY {a}) x CROSS JOIN (SELECT {b} AS vb, count(*)::DOUBLE AS n FROM c GROUP BY {b}) y CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM c) t
LEFT JOIN (SELECT {a} AS va, {b} AS vb, count(*)::DOUBLE AS n FROM c GROUP BY {a}, {b}) z ON z.va = x.va AND z.vb = y.vb"""


@query(f"WITH {CHILD} {_r_sql('rf', 'ls')}")
def r_score_pair(spark, sf):
    return M.r_scores(child(spark, sf), [("rf", "ls")]).select("a", "b", F.round("r_score", 4).alias("r_score"), r6("tvd").alias("tvd"))


@query(f"WITH {CHILD} " + " UNION ALL ".join(_r_sql(a, b) for a, b in Domain.project(CHILD_DOMAIN, ["rf", "ls", "disc", "tax", "ln"]).pairs()))
def r_score_all_pairs(spark, sf):
    out = M.r_scores(child(spark, sf), CHILD_DOMAIN.project(["rf", "ls", "disc", "tax", "ln"]).pairs())
    return out.select("a", "b", F.round("r_score", 4).alias("r_score"), r6("tvd").alias("tvd"))


@query(f"WITH {CHILD} SELECT a, b, tvd FROM ({_r_sql('qty', 'disc')})")
def pairwise_tvd(spark, sf):
    return M.r_scores(child(spark, sf), [("qty", "disc")]).select("a", "b", r6("tvd").alias("tvd"))


@query(f"WITH {CHILD}, " + ", ".join(f"r{i} AS ({_r_sql(a, b)})" for i, (a, b) in enumerate(CHILD_DOMAIN.project(["rf", "ls", "disc", "ln"]).pairs())) + " SELECT a, b, r_score FROM (" + " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(6)) + ") ORDER BY r_score DESC, a, b LIMIT 3")
def top_k_edges(spark, sf):
    out = M.r_scores(child(spark, sf), CHILD_DOMAIN.project(["rf", "ls", "disc", "ln"]).pairs()).select("a", "b", F.round("r_score", 4).alias("r_score"))
    return R.top_k(out, "r_score", 3, ["a", "b"])


_CUT = f"""{PARENT}, x AS (SELECT st, pri, count(*)::DOUBLE AS n FROM p WHERE yr < 3 GROUP BY st, pri), y AS (SELECT st, pri, count(*)::DOUBLE AS n FROM p WHERE yr >= 3 GROUP BY st, pri)"""


def _halves(spark, sf):
    p = parent(spark, sf)
    return M.marginal(p.where("yr < 3"), ["st", "pri"]), M.marginal(p.where("yr >= 3"), ["st", "pri"])


@query(f"WITH {_CUT} SELECT round(sum(abs(coalesce(x.n, 0) - coalesce(y.n, 0))) / 2, 6) AS tvd_count, round(sum(abs(coalesce(x.n, 0) - coalesce(y.n, 0))) / 2 / sum(x.n), 6) AS tvd FROM x FULL JOIN y USING (st, pri)")
def tvd_two_tables(spark, sf):
    return M.tvd_count(*_halves(spark, sf), ["st", "pri"]).select(r6("tvd_count").alias("tvd_count"), r6("tvd").alias("tvd"))


@query(f"""WITH {_CUT}, s AS (SELECT (SELECT sum(n) FROM x) / (SELECT sum(n) FROM y) AS k)
SELECT round(sum(abs(coalesce(x.n, 0) - coalesce(y.n, 0) * k)) / 2, 4) AS tvd_count, round(sum(abs(coalesce(x.n, 0) - coalesce(y.n, 0) * k)) / 2 / sum(x.n), 6) AS tvd FROM x FULL JOIN y USING (st, pri) CROSS JOIN s""")
def normalized_tvd(spark, sf):
    return M.tvd_count(*_halves(spark, sf), ["st", "pri"], rescale=True).select(F.round("tvd_count", 4).alias("tvd_count"), r6("tvd").alias("tvd"))


@query(f"""WITH {CHILD}, a AS (SELECT fk, rf, count(*)::DOUBLE AS n FROM c WHERE disc < 5 GROUP BY fk, rf), b AS (SELECT fk, rf, count(*)::DOUBLE AS n FROM c WHERE disc >= 5 GROUP BY fk, rf),
sa AS (SELECT fk, sum(n) AS s FROM a GROUP BY fk), sb AS (SELECT fk, sum(n) AS s FROM b GROUP BY fk)
SELECT fk, round(sum(abs(coalesce(a.n, 0) - coalesce(b.n, 0) * coalesce(sa.s / sb.s, 0))) / 2, 4) AS tvd_count FROM a FULL JOIN b USING (fk, rf) LEFT JOIN sa USING (fk) LEFT JOIN sb USING (fk) GROUP BY fk""")
def group_tvd(spark, sf):
    c = child(spark, sf)
    return M.group_tvd(c.where("disc < 5"), c.where("disc >= 5"), "fk", ["rf"]).select("fk", F.round("tvd_count", 4).alias("tvd_count"))


@query(f"""WITH {CHILD}, {TYPES}, g AS (SELECT fk, rf, count(*)::DOUBLE AS n FROM c GROUP BY fk, rf), s AS (SELECT fk, sum(n) AS s FROM g GROUP BY fk),
h AS (SELECT s.fk, v.rf, coalesce(g.n, 0) / s.s AS h FROM s CROSS JOIN (SELECT unnest(range(3)) AS rf) v LEFT JOIN g ON g.fk = s.fk AND g.rf = v.rf),
m AS (SELECT y, rf, sum(p * h) / sum(p) AS mean FROM h JOIN q USING (fk) GROUP BY y, rf),
d AS (SELECT fk, y, any_value(p) AS p, sum(abs(h - mean)) / 2 AS d FROM h JOIN q USING (fk) JOIN m USING (y, rf) GROUP BY fk, y)
SELECT y, round(sum(p * d), 3) AS dispersion FROM d GROUP BY y""")
def dispersion(spark, sf):
    return M.dispersion(child(spark, sf), "fk", ["rf"], _status_types(spark, sf), ["y"]).select("y", F.round("dispersion", 3).alias("dispersion"))


@query(f"WITH {TYPES} SELECT fk, arg_max(y, p) AS y FROM q GROUP BY fk")
def argmax_type(spark, sf):
    return M.argmax_types(_status_types(spark, sf), "fk", ["y"])


@query(f"""WITH {TYPES}, m AS (SELECT y, sum(p) AS m FROM q GROUP BY y), g AS (SELECT count(DISTINCT fk) AS n FROM q)
SELECT round((SELECT count(*) FROM q WHERE p < 0.9 AND p > 1.0 / 3) / (SELECT n FROM g), 6) AS ratio, (SELECT count(*) FROM m WHERE m < 0.1 * (SELECT n FROM g) / 3) AS collapsed""")
def undetermined_types(spark, sf):
    return M.undetermined(_status_types(spark, sf), "fk", ["y"]).select(r6("ratio").alias("ratio"), "collapsed")


@query(f"""WITH {CHILD} SELECT 0 AS set_id, round((SELECT sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0))) / 2 FROM (SELECT rf, ls, disc, count(*) / (SELECT count(*) FROM c WHERE tax < 4) AS s FROM c WHERE tax < 4 GROUP BY ALL) a FULL JOIN (SELECT rf, ls, disc, count(*) / (SELECT count(*) FROM c WHERE tax >= 4) AS s FROM c WHERE tax >= 4 GROUP BY ALL) b USING (rf, ls, disc)), 6) AS tvd
UNION ALL SELECT 1, round((SELECT sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0))) / 2 FROM (SELECT rf, ln, count(*) / (SELECT count(*) FROM c WHERE tax < 4) AS s FROM c WHERE tax < 4 GROUP BY ALL) a FULL JOIN (SELECT rf, ln, count(*) / (SELECT count(*) FROM c WHERE tax >= 4) AS s FROM c WHERE tax >= 4 GROUP BY ALL) b USING (rf, ln)), 6)""")
def kway_tvd_fixed(spark, sf):
    c = child(spark, sf)
    return V.k_way_tvd(c.where("tax < 4"), c.where("tax >= 4"), [("rf", "ls", "disc"), ("rf", "ln")]).select("set_id", r6("tvd").alias("tvd"))


# --- encodings ---


@query("SELECT c_custkey, code FROM customer JOIN (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT c_mktsegment AS value FROM customer)) ON value = c_mktsegment")
def dictionary_encode(spark, sf):
    c = read_parquet(spark, sf, "customer")
    return E.encode(c, "c_mktsegment", E.dictionary(c, "c_mktsegment"), "code").select("c_custkey", F.col("code").cast("long").alias("code"))


@query("WITH w AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)) SELECT c_custkey, w.c_mktsegment FROM customer LEFT JOIN w ON code = c_nationkey % 7")
def dictionary_decode(spark, sf):
    """Words for codes that don't come from encoding them; codes beyond the dictionary have none."""
    c = read_parquet(spark, sf, "customer")
    coded = c.select("c_custkey", (F.col("c_nationkey") % 7).cast("int").alias("c_mktsegment"))
    return E.decode(coded, "c_mktsegment", E.dictionary(c, "c_mktsegment"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(greatest(ceil((l_extendedprice - 1 - lo) / ((hi - lo) / 16)) - 1, 0) AS INT) AS bin FROM lineitem CROSS JOIN (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)")
def bin16(spark, sf):
    t = read_parquet(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    lo, hi = t.agg(F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    return t.withColumn("bin", E.equal_width(F.col("l_extendedprice"), lo, hi, 16))


@query(f"""WITH {CHILD}, v AS (SELECT qty AS value, count(*) AS n FROM c GROUP BY qty)
SELECT value, CAST(least(floor(coalesce(sum(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 10 / (SELECT sum(n) FROM v)), 9) AS INT) AS bin FROM v""")
def equal_freq_bins(spark, sf):
    return E.equal_frequency(child(spark, sf).groupBy(F.col("qty").alias("value")).agg(F.count("*").alias("n")), 10)


@query(f"WITH {CHILD} SELECT fk, rf, qty // 10 AS qty_hi, qty % 10 AS qty_lo, ln FROM c")
def digit_split(spark, sf):
    return E.split_digits(child(spark, sf).select("fk", "rf", "qty", "ln"), CHILD_DOMAIN)


@query(f"WITH {CHILD} SELECT fk, rf, CAST(least(qty + 7, 49) AS INT) AS qty, ln FROM c")
def digit_merge(spark, sf):
    """Digits of values up to seven beyond the domain, merged and clamped to its last code."""
    c = child(spark, sf).withColumn("q", F.col("qty") + 7)
    return E.merge_digits(c.select("fk", "rf", F.floor(F.col("q") / 10).cast("int").alias("qty_hi"), (F.col("q") % 10).alias("qty_lo"), "ln"), CHILD_DOMAIN)


@query("SELECT l_orderkey, l_partkey * (SELECT max(l_suppkey) + 1 FROM lineitem) + l_suppkey AS packed FROM lineitem")
def composite_key_pack(spark, sf):
    t = read_parquet(spark, sf, "lineitem")
    return t.select("l_orderkey", E.pack_key(F.col("l_partkey"), F.col("l_suppkey"), E.packing_base(t, "l_suppkey")).alias("packed"))


@query("SELECT l_orderkey, (l_orderkey * 1000000000000 + l_partkey) // 3 AS part, (l_orderkey * 1000000000000 + l_partkey) % 3 AS supp FROM lineitem")
def composite_key_unpack(spark, sf):
    """Keys beyond 2 ** 53, in which doubles would lose units."""
    t = read_parquet(spark, sf, "lineitem")
    high, low = E.unpack_key(F.col("l_orderkey").cast("long") * F.lit(1_000_000_000_000) + F.col("l_partkey"), 3)
    return t.select("l_orderkey", high.alias("part"), low.alias("supp"))


# --- keys, joins, groups ---


@query("SELECT l_orderkey, l_linenumber, l_quantity, o_custkey, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def parent_child_join(spark, sf):
    c = read_parquet(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    p = read_parquet(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return R.join_parent(c, p, "l_orderkey", "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def childless_parents(spark, sf):
    return R.childless(read_parquet(spark, sf, "orders").select("o_orderkey"), read_parquet(spark, sf, "lineitem"), "o_orderkey", "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join_groups(spark, sf):
    keys = read_parquet(spark, sf, "orders").where("o_orderstatus = 'P'")
    return R.keep_groups(read_parquet(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), keys, "l_orderkey", "o_orderkey")


@query("""SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphans, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS childless,
(SELECT count(*) FROM lineitem) AS child_rows, (SELECT count(*) FROM orders) AS parents""")
def fk_integrity(spark, sf):
    return R.integrity(child(spark, sf), parent(spark, sf), "fk", "pk")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    from loomkin.sources.io import duplicate_keys as found

    return found(read_parquet(spark, sf, "lineitem"), "l_orderkey")


@query(f"WITH {CHILD}, s AS (SELECT fk, count(*) AS n FROM c GROUP BY fk) SELECT n = 1 AS single, rf, count(*) AS rows_ FROM c JOIN s USING (fk) GROUP BY n = 1, rf")
def size1_split(spark, sf):
    one, more = R.split_singles(child(spark, sf), "fk")
    return R.union_tables(one.withColumn("single", F.lit(True)), more.withColumn("single", F.lit(False))).groupBy("single", "rf").agg(F.count("*").alias("rows_"))


@query(f"WITH {KEYED} SELECT fk, rn, rf, qty FROM k WHERE rn <= 5")
def group_cap(spark, sf):
    return R.cap_groups(keyed_child(spark, sf).select("fk", "rn", "rf", "qty"), "fk", 5, order=["rn"])


@query(f"WITH {KEYED} SELECT fk, rn, rf, qty FROM k WHERE rn = 1")
def first_of_group(spark, sf):
    return R.first_of_group(keyed_child(spark, sf).select("fk", "rn", "rf", "qty"), "fk", ["rn"]).select("fk", "rn", "rf", "qty")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 + 1000 AS id FROM orders")
def surrogate_ids(spark, sf):
    return R.dense_ids(read_parquet(spark, sf, "orders").select("o_orderkey"), "id", ["o_orderkey"], 1000)


@query("SELECT l_orderkey, l_linenumber, l_partkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_partkey, l_orderkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn <= 3")
def first_rows_per_group(spark, sf):
    t = read_parquet(spark, sf, "lineitem")
    w = W.partitionBy("l_linenumber").orderBy("l_partkey", "l_orderkey", "l_suppkey", "l_extendedprice")
    kept = first_rows(t, "l_linenumber", ["l_partkey", "l_orderkey", "l_suppkey", "l_extendedprice"], 3)
    return kept.withColumn("rn", F.row_number().over(w)).select("l_orderkey", "l_linenumber", "l_partkey", "rn")


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS i FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS other, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS i FROM orders WHERE o_orderkey % 2 = 1)
SELECT o_orderkey, other, o_orderstatus FROM a JOIN b USING (o_orderstatus, i)""")
def zip_join_by_type(spark, sf):
    """Two halves of orders by the key's parity, matched within a status (the halves are the query's two tables)."""
    o = read_parquet(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return R.zip_by_type(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1").withColumnRenamed("o_orderkey", "other"), ["o_orderstatus"], "o_orderkey", "other")


@query("""WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_mktsegment, c_custkey) AS i FROM customer), b AS (SELECT c_custkey AS other, row_number() OVER (ORDER BY c_mktsegment, c_nationkey, c_custkey) AS i FROM customer)
SELECT c_custkey, other FROM a JOIN b USING (i)""")
def naive_zip_match(spark, sf):
    c = read_parquet(spark, sf, "customer")
    left = c.select("c_custkey", F.col("c_nationkey").cast("string").alias("x"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("m"))
    a = R.dense_ids(left.select("c_custkey", "n", "m"), "i", ["n", "m", "c_custkey"])
    b = R.dense_ids(left.select(F.col("c_custkey").alias("other"), "n", "m"), "i", ["m", "n", "other"])
    return a.join(b.select("other", "i"), "i").select("c_custkey", "other")


def _match_sides(spark, sf):
    """Rows of even and of odd orders, as many of each as the smaller side has, by place in key order."""
    k = keyed_child(spark, sf).select("pk", "rf", "ls", "disc", "fk")
    a, b = k.where("fk % 2 = 0"), k.where("fk % 2 = 1")
    n = min(a.count(), b.count())
    cut = lambda side, name: R.dense_ids(side, "_i", ["pk"]).where(F.col("_i") < n).select(F.col("pk").alias(name), "rf", "ls", "disc")
    return cut(a, "left_id"), cut(b, "right_id")


@query(f"""WITH {KEYED}, a AS (SELECT rf, row_number() OVER (ORDER BY fk * 100 + rn) AS i FROM k WHERE fk % 2 = 0), b AS (SELECT rf, row_number() OVER (ORDER BY fk * 100 + rn) AS i FROM k WHERE fk % 2 = 1),
n AS (SELECT least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS n), ca AS (SELECT rf, count(*) AS x FROM a, n WHERE i <= n GROUP BY rf), cb AS (SELECT rf, count(*) AS x FROM b, n WHERE i <= n GROUP BY rf)
SELECT (SELECT n FROM n) AS pairs, CAST(sum(least(ca.x, cb.x)) AS BIGINT) AS rf FROM ca JOIN cb USING (rf)""")
def greedy_match_one_column(spark, sf):
    a, b = _match_sides(spark, sf)
    return J.agreement(J.greedy_match(a, b, ["rf"], "left_id", "right_id", keep=True), ["rf"])


def _greedy_sql(columns) -> str:
    """The match column by column in SQL: equal values in key order, then what is left of a node in key order."""
    parts = [
        f"{KEYED}, a_ AS (SELECT fk * 100 + rn AS id, rf, ls, disc, row_number() OVER (ORDER BY fk * 100 + rn) AS i FROM k WHERE fk % 2 = 0)",
        "b_ AS (SELECT fk * 100 + rn AS id, rf, ls, disc, row_number() OVER (ORDER BY fk * 100 + rn) AS i FROM k WHERE fk % 2 = 1)",
        "n_ AS (SELECT least((SELECT count(*) FROM a_), (SELECT count(*) FROM b_)) AS n)",
        "a0 AS (SELECT id, rf, ls, disc, '' AS node FROM a_, n_ WHERE i <= n)",
        "b0 AS (SELECT id, rf, ls, disc, '' AS node FROM b_, n_ WHERE i <= n)",
    ]
    for k, c in enumerate(columns):
        parts += [
            f"p{k} AS (SELECT coalesce(x.node, y.node) AS node, coalesce(x.{c}, y.{c}) AS v, x.id AS l, y.id AS r FROM (SELECT *, row_number() OVER (PARTITION BY node, {c} ORDER BY id) AS j FROM a{k}) x "
            f"FULL JOIN (SELECT *, row_number() OVER (PARTITION BY node, {c} ORDER BY id) AS j FROM b{k}) y ON x.node = y.node AND x.{c} = y.{c} AND x.j = y.j)",
            f"m{k} AS (SELECT l, r, node, v FROM p{k} WHERE l IS NOT NULL AND r IS NOT NULL UNION ALL SELECT x.l, y.r, x.node, x.v FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY l) AS j FROM p{k} WHERE r IS NULL) x "
            f"JOIN (SELECT *, row_number() OVER (PARTITION BY node ORDER BY r) AS j FROM p{k} WHERE l IS NULL) y ON x.node = y.node AND x.j = y.j)",
            f"a{k + 1} AS (SELECT id, rf, ls, disc, m{k}.node || '/' || v AS node FROM a{k} JOIN m{k} ON l = id)",
            f"b{k + 1} AS (SELECT id, rf, ls, disc, m{k}.node || '/' || v AS node FROM b{k} JOIN m{k} ON r = id)",
        ]
    return "WITH " + ", ".join(parts) + f" SELECT l AS left_id, r AS right_id FROM m{len(columns) - 1}"


@query(_greedy_sql(["rf", "ls", "disc"]))
def greedy_match_three_columns(spark, sf):
    a, b = _match_sides(spark, sf)
    return J.greedy_match(a, b, ["rf", "ls", "disc"], "left_id", "right_id")


@query("SELECT o_orderkey, c_mktsegment, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey")
def public_attr_join(spark, sf):
    o = read_parquet(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = read_parquet(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return R.join_parent(o, c, "o_custkey", "c_custkey").select("o_orderkey", "c_mktsegment", "c_nationkey")


@query("SELECT n_name, r_name, count(*) AS orders_, CAST(sum(lines) AS BIGINT) AS lines FROM (SELECT o_orderkey, o_custkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY n_name, r_name")
def chain_join(spark, sf):
    """The chain of two foreign keys, and the public attributes above it."""
    lines = read_parquet(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    o = read_parquet(spark, sf, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    up = R.join_parent(o, read_parquet(spark, sf, "customer").select("c_custkey", "c_nationkey"), "o_custkey", "c_custkey")
    up = R.join_parent(up, read_parquet(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), "c_nationkey", "n_nationkey")
    up = R.join_parent(up, read_parquet(spark, sf, "region").select("r_regionkey", "r_name"), "n_regionkey", "r_regionkey")
    return up.groupBy("n_name", "r_name").agg(F.count("*").alias("orders_"), F.sum(F.coalesce("lines", F.lit(0))).cast("long").alias("lines"))


@query(f"WITH {CHILD}, {PARENT}, t AS (SELECT fk, arg_max(rf, n * 10 - rf) AS y FROM (SELECT fk, rf, count(*) AS n FROM c GROUP BY fk, rf) GROUP BY fk) SELECT pk, st, y FROM p LEFT JOIN t ON fk = pk")
def attach_types(spark, sf):
    """Types of groups (their most frequent flag) joined to parents; parents without a group come back with a null."""
    q = child(spark, sf).groupBy("fk", F.col("rf").alias("y")).agg(F.count("*").cast("double").alias("p"))
    met, rest = R.attach_types(parent(spark, sf).select("pk", "st"), M.argmax_types(q, "fk", ["y"]), "pk", "fk", ["y"])
    return met.unionByName(rest.withColumn("y", F.lit(None).cast("int")))


@query("SELECT 0 AS part, o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 1, o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'")
def union_synthetic(spark, sf):
    o = read_parquet(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    tag = lambda df, k: df.select(F.lit(k).alias("part"), "o_orderkey", "o_custkey")
    return R.union_tables(tag(o.where("o_orderstatus = 'F'"), 0), tag(o.where("o_orderstatus <> 'F'"), 1))


@query("SELECT o_orderkey, o_custkey FROM orders")
def drop_columns(spark, sf):
    return R.drop_attrs(read_parquet(spark, sf, "orders"), ["o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])


@query(f"WITH {CHILD} SELECT count(*) AS n FROM c WHERE rf IN (0, 2) AND disc IN (1, 2, 3)")
def set_membership(spark, sf):
    return child(spark, sf).where(R.requires({"rf": [0, 2], "disc": [1, 2, 3]})).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(CAST('0x' || substr(md5('0:' || o_orderkey), 1, 8) AS BIGINT) % 5 AS INT) AS fold FROM orders")
def train_test_folds(spark, sf):
    return train_test(read_parquet(spark, sf, "orders"), "o_orderkey").select("o_orderkey", "fold")


# --- group queries ---

_GQ = """FROM p JOIN (SELECT fk, count(*) AS sz, count(*) FILTER (WHERE {a}) AS n1, count(*) FILTER (WHERE {b}) AS n2, count(*) FILTER (WHERE ({a}) OR ({b})) AS n_or FROM c GROUP BY fk) g ON g.fk = p.pk
WHERE {p} AND sz >= {lo} AND sz < {hi} AND n1 > 0 AND n2 > 0 AND n_or >= 2"""


@query(f"WITH {CHILD}, {PARENT} SELECT CAST(0 AS BIGINT) AS query, count(*) AS n " + _GQ.format(a="rf IN (0, 2)", b="rf IN (1)", p="st IN (0, 1)", lo=2, hi=6))
def intra_group_query(spark, sf):
    q = V.GroupQuery(2, 6, (("st", (0, 1)),), (("rf", (0, 2)),), (("rf", (1,)),))
    return V.count_groups(child(spark, sf), parent(spark, sf), "fk", "pk", [q])


QUERY_CHILD, QUERY_PARENT = CHILD_DOMAIN.project(["rf", "ls", "qty", "disc", "tax"]), PARENT_DOMAIN.project(["st", "pri", "yr", "mon"])
BATCH = V.random_queries(80, QUERY_CHILD, QUERY_PARENT, 1, 1, seed=5) + V.random_queries(20, QUERY_CHILD, QUERY_PARENT, 2, 1, seed=6)


def _sql_needs(needs) -> str:
    return " AND ".join(f"{a} IN ({', '.join(map(str, v))})" for a, v in needs) or "TRUE"


@query(f"WITH {CHILD}, {PARENT} " + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS query, count(*) AS n " + _GQ.format(a=_sql_needs(q.first), b=_sql_needs(q.second), p=_sql_needs(q.parent), lo=q.low, hi=q.high) for i, q in enumerate(BATCH)))
def intra_group_query_batch(spark, sf):
    return V.count_groups(child(spark, sf), parent(spark, sf), "fk", "pk", BATCH)


THOUSAND = V.random_queries(700, QUERY_CHILD, QUERY_PARENT, 1, 1, seed=7) + V.random_queries(300, QUERY_CHILD, QUERY_PARENT, 2, 1, seed=8)


def _values(part: str) -> str:
    """(query, attribute, code) of all queries' requirements of a part, and how many attributes each query names."""
    rows = [f"({i}, '{a}', {v})" for i, q in enumerate(THOUSAND) for a, vs in getattr(q, part) for v in vs]
    return f"(VALUES {', '.join(rows)}) AS t(query, attr, code)"


_LONG = "SELECT {key}, attr, code FROM (UNPIVOT (SELECT {key}, {casts} FROM {table}) ON {attrs} INTO NAME attr VALUE code)"
_C_LONG = _LONG.format(key="id, fk", casts=", ".join(f"CAST({a} AS INT) AS {a}" for a in QUERY_CHILD), table="ci", attrs=", ".join(QUERY_CHILD))
_P_LONG = _LONG.format(key="pk", casts=", ".join(f"CAST({a} AS INT) AS {a}" for a in QUERY_PARENT), table="p", attrs=", ".join(QUERY_PARENT))


def _met(part: str, key: str, table: str) -> str:
    """({key}, query): rows that have a required code in each attribute that the query names."""
    return f"SELECT {key}, t.query FROM {table} l JOIN {_values(part)} ON t.attr = l.attr AND t.code = l.code JOIN (VALUES {', '.join(f'({i}, {len(getattr(q, part))})' for i, q in enumerate(THOUSAND))}) AS w(query, need) ON w.query = t.query GROUP BY {key}, t.query, need HAVING count(*) = need"


@query(
    f"WITH {CHILD}, {PARENT}, ci AS (SELECT *, row_number() OVER () AS id FROM c), cl AS ({_C_LONG}), pl AS ({_P_LONG}), "
    f"z AS (SELECT g.fk, s.query FROM (SELECT fk, count(*) AS sz FROM c GROUP BY fk) g JOIN (VALUES {', '.join(f'({i}, {q.low}, {q.high})' for i, q in enumerate(THOUSAND))}) AS s(query, lo, hi) ON sz >= lo AND sz < hi), "
    f"x AS ({_met('first', 'id, fk', 'cl')}), y AS ({_met('second', 'id, fk', 'cl')}), w AS ({_met('parent', 'pk', 'pl')}), "
    "e AS (SELECT id, fk, query, max(a) AS a, max(b) AS b FROM (SELECT id, fk, query, 1 AS a, 0 AS b FROM x UNION ALL SELECT id, fk, query, 0, 1 FROM y) GROUP BY id, fk, query), "
    "h AS (SELECT fk, query FROM e GROUP BY fk, query HAVING max(a) = 1 AND max(b) = 1 AND count(*) >= 2), "
    "n AS (SELECT h.query, count(*) AS n FROM h JOIN z ON z.fk = h.fk AND z.query = h.query JOIN w ON w.pk = h.fk AND w.query = h.query GROUP BY h.query) "
    f"SELECT q.query, coalesce(n.n, 0) AS n FROM (SELECT unnest(range({len(THOUSAND)})) AS query) q LEFT JOIN n ON n.query = q.query"
)
def intra_group_query_thousand(spark, sf):
    return V.count_groups(child(spark, sf), parent(spark, sf), "fk", "pk", THOUSAND)


_FEW = BATCH[:20]


@query(f"WITH {CHILD}, {PARENT}, " + "a AS (" + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS query, count(*) AS n " + _GQ.format(a=_sql_needs(q.first), b=_sql_needs(q.second), p=_sql_needs(q.parent) + " AND cust % 2 = 0", lo=q.low, hi=q.high) for i, q in enumerate(_FEW)) + "), b AS (" + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS query, count(*) AS n " + _GQ.format(a=_sql_needs(q.first), b=_sql_needs(q.second), p=_sql_needs(q.parent) + " AND cust % 2 = 1", lo=q.low, hi=q.high) for i, q in enumerate(_FEW)) + """), s AS (SELECT (SELECT count(*) FROM p WHERE cust % 2 = 0)::DOUBLE AS n1, (SELECT count(*) FROM p WHERE cust % 2 = 1)::DOUBLE AS n2)
SELECT query, a.n AS truth, b.n AS synthetic, round(abs(a.n - b.n * n1 / n2) / greatest(0.001 * n1, a.n), 6) AS error FROM a JOIN b USING (query) CROSS JOIN s""")
def relative_error(spark, sf):
    """Orders of even customers as the truth, of odd ones in the place of synthetic data."""
    c, p = child(spark, sf), parent(spark, sf)
    even, odd = p.where("cust % 2 = 0"), p.where("cust % 2 = 1")
    out = V.relative_error(V.count_groups(c, even, "fk", "pk", _FEW), V.count_groups(c, odd, "fk", "pk", _FEW), even.count(), odd.count())
    return out.withColumn("error", r6("error"))


# --- long factors ---

_F = "f AS (SELECT rf, ls, count(*)::DOUBLE AS value FROM c GROUP BY rf, ls), g AS (SELECT ls, disc, count(*)::DOUBLE AS value FROM c GROUP BY ls, disc)"
_LF = "f AS (SELECT rf, ls, ln(count(*)) AS value FROM c GROUP BY rf, ls), g AS (SELECT ls, disc, ln(count(*)) - ls AS value FROM c GROUP BY ls, disc)"


def _factors(spark, sf):
    c = child(spark, sf)
    table = lambda attrs: M.marginal(c, attrs).select(*attrs, F.col("n").cast("double").alias("value"))
    return table(["rf", "ls"]), table(["ls", "disc"])


def _log_factors(spark, sf):
    f, g = _factors(spark, sf)
    return L.mapped(f, F.ln), g.withColumn("value", F.ln("value") - F.col("ls"))


@query(f"WITH {CHILD}, {_F} SELECT rf, ls, disc, round(f.value * g.value, 6) AS value FROM f JOIN g USING (ls)")
def factor_product(spark, sf):
    return L.combine(*_factors(spark, sf), "*").select("rf", "ls", "disc", r6("value").alias("value"))


@query(f"WITH {CHILD}, {_F} SELECT rf, ls, disc, round(g.value / f.value, 6) AS value FROM f JOIN g USING (ls)")
def factor_divide(spark, sf):
    f, g = _factors(spark, sf)
    return L.combine(g, f, "/").select("rf", "ls", "disc", r6("value").alias("value"))


@query(f"WITH {CHILD}, {_F} SELECT disc, round(sum(value), 6) AS value FROM g GROUP BY disc")
def factor_project(spark, sf):
    return L.project(_factors(spark, sf)[1], ["disc"]).select("disc", r6("value").alias("value"))


@query(f"WITH {CHILD}, {_F} SELECT disc, round(value, 6) AS value FROM g WHERE ls = 1")
def conditional_slice(spark, sf):
    return L.at(_factors(spark, sf)[1], {"ls": 1}).select("disc", r6("value").alias("value"))


@query(f"WITH {CHILD}, {_LF} SELECT ls, round(m + ln(sum(exp(value - m))), 6) AS value FROM g JOIN (SELECT ls, max(value) AS m FROM g GROUP BY ls) USING (ls) GROUP BY ls, m")
def factor_logsumexp(spark, sf):
    return L.logsumexp(_log_factors(spark, sf)[1], ["ls"]).select("ls", r6("value").alias("value"))


@query(f"WITH {CHILD}, {_F}, t AS (SELECT ls, 100.0 * (ls + 1) AS t FROM (SELECT DISTINCT ls FROM g)) SELECT ls, disc, round(value * t / sum(value) OVER (PARTITION BY ls), 6) AS value FROM g JOIN t USING (ls)")
def factor_scale_to_totals(spark, sf):
    g = _factors(spark, sf)[1]
    totals = g.select("ls").distinct().select("ls", (F.lit(100.0) * (F.col("ls") + 1)).alias("value"))
    return L.scaled(g, totals).select("ls", "disc", r6("value").alias("value"))


@query(f"WITH {CHILD}, {_F} SELECT round(sum(f.value * g.value), 6) AS value FROM f JOIN (SELECT ls, disc % 3 AS rf, sum(value) AS value FROM g GROUP BY 1, 2) g USING (rf, ls)")
def factor_dot(spark, sf):
    f, g = _factors(spark, sf)
    other = g.groupBy("ls", (F.col("disc") % 3).alias("rf")).agg(F.sum("value").alias("value"))
    return L.dot(f, other).select(r6("value").alias("value"))


@query(f"""WITH {CHILD}, {_LF}, j AS (SELECT rf, ls, disc, exp(f.value + g.value) AS w FROM f JOIN g USING (ls)), z AS (SELECT sum(w) AS z FROM j)
SELECT 'f' AS clique, rf AS a, ls AS b, round(1000 * sum(w) / any_value(z), 6) AS value FROM j CROSS JOIN z GROUP BY rf, ls UNION ALL SELECT 'g', ls, disc, round(1000 * sum(w) / any_value(z), 6) FROM j CROSS JOIN z GROUP BY ls, disc""")
def belief_propagation_2clique(spark, sf):
    f, g = L.propagate_pair(*_log_factors(spark, sf), total=1000.0)
    tag = lambda df, k, a, b: df.select(F.lit(k).alias("clique"), F.col(a).alias("a"), F.col(b).alias("b"), r6("value").alias("value"))
    return tag(f, "f", "rf", "ls").unionByName(tag(g, "g", "ls", "disc"))
