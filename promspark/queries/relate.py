"""Driver queries for joins, set operations, ordering and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog as cat
from ..fixture import stored_prom
from ..operators import relate as R
from ..operators.stats import rank_table, spearman
from ._sql import ctes, r6, scored_cte
from .prep import cleaned, scored
from .stats import FEATURES, OUTCOME, _spearman_sql


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def j01_union(spark, sf):
    p = cleaned(spark, sf).select("record_id", "year", "t0_eq_vas", "oks_t0_score")
    frames = [p.where(F.col("year") == y) for y in cat.YEARS]
    frames[0] = frames[0].drop("t0_eq_vas")          # one yearly file lacks a column
    u = R.union_aligned(frames, tags=[f"file_{y}" for y in cat.YEARS], tag_col="source")
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("t0_eq_vas").alias("n_vas"))


SQL_J01 = ctes() + """SELECT source, COUNT(*) AS n, COUNT(t0_eq_vas) AS n_vas FROM (
  SELECT 'file_' || year AS source, CAST(NULL AS INTEGER) AS t0_eq_vas FROM clean WHERE year = '2016/17'
  UNION ALL SELECT 'file_' || year, t0_eq_vas FROM clean WHERE year IN ('2017/18', '2018/19')) GROUP BY source"""


def j02_outer_align(spark, sf):
    c = _t(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n_customers"))
    s = _t(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return R.outer_align(c, s, "nationkey")


SQL_J02 = """SELECT COALESCE(c.nationkey, s.nationkey) AS nationkey, n_customers, n_suppliers FROM
  (SELECT c_nationkey AS nationkey, COUNT(*) AS n_customers FROM customer GROUP BY 1) c FULL JOIN
  (SELECT s_nationkey AS nationkey, COUNT(*) AS n_suppliers FROM supplier GROUP BY 1) s ON c.nationkey = s.nationkey"""


def j03_rank_join(spark, sf):
    from .stats import cohort_rankings
    r = cohort_rankings(spark, sf)
    k = r.where(F.col("procedure") == "Knee Replacement")
    h = r.where(F.col("procedure") == "Hip Replacement")
    return k.select("feature", F.col("r").alias("r_knee")).join(h.select("feature", F.col("r").alias("r_hip")), "feature")


SQL_J03 = ctes(scored_cte(),
               f"k AS ({_spearman_sql('scored', FEATURES, OUTCOME, where=' WHERE procedure = ' + chr(39) + 'Knee Replacement' + chr(39))})",
               f"h AS ({_spearman_sql('scored', FEATURES, OUTCOME, where=' WHERE procedure = ' + chr(39) + 'Hip Replacement' + chr(39))})") + \
    "SELECT k.feature, k.r AS r_knee, h.r AS r_hip FROM k JOIN h ON k.feature = h.feature"


def j04_counts_shares(spark, sf):
    o = _t(spark, sf, "orders")
    counts = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    shares = counts.select("o_orderpriority", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))
    return counts.join(shares, "o_orderpriority", "left")


SQL_J04 = f"""SELECT o_orderpriority, COUNT(*) AS n, {r6('COUNT(*) * 1.0 / (SELECT COUNT(*) FROM orders)')} AS share
FROM orders GROUP BY o_orderpriority"""


def j05_semi_join_top(spark, sf):
    o = _t(spark, sf, "orders")
    top = R.top_k(o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders")),
                  [F.desc("n_orders"), F.asc("o_custkey")], 10)
    li = _t(spark, sf, "lineitem")
    kept = R.semi_join_top(o, top, "o_custkey").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return kept.groupBy("o_custkey").agg(F.round(F.sum("l_extendedprice"), 6).alias("revenue"),
                                         F.count(F.lit(1)).alias("n_lines"))


SQL_J05 = f"""WITH top AS (SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 10)
SELECT o_custkey, {r6('SUM(l_extendedprice)')} AS revenue, COUNT(*) AS n_lines
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey IN (SELECT o_custkey FROM top) GROUP BY o_custkey"""


def j06_align_target(spark, sf):
    p = cleaned(spark, sf)
    feats = p.select("record_id", "oks_t0_score", "t0_eq_vas")
    target = scored(spark, sf).select("record_id", "oks_t1_score")
    return R.align_target(feats, target, "record_id")


SQL_J06 = ctes(scored_cte()) + """SELECT c.record_id, c.oks_t0_score, c.t0_eq_vas, s.oks_t1_score
FROM clean c LEFT JOIN scored s ON c.record_id = s.record_id"""


def j07_rank_position(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", "c_acctbal")
    s = _t(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return R.rank_position_join(c, s, [F.desc("c_acctbal"), "c_custkey"], [F.desc("s_acctbal"), "s_suppkey"], 15)


SQL_J07 = """WITH a AS (SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS position, c_custkey AS a_c_custkey, c_acctbal AS a_c_acctbal FROM customer),
b AS (SELECT row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS position, s_suppkey AS b_s_suppkey, s_acctbal AS b_s_acctbal FROM supplier)
SELECT CAST(COALESCE(a.position, b.position) AS INTEGER) AS position, a_c_custkey, a_c_acctbal, b_s_suppkey, b_s_acctbal
FROM (SELECT * FROM a WHERE position <= 15) a FULL JOIN (SELECT * FROM b WHERE position <= 15) b ON a.position = b.position"""


def j08_set_ops(spark, sf):
    from ..operators.clean import columns_containing
    from ..operators.profile import missing_report
    a = missing_report(cleaned(spark, sf)).where(F.col("n_missing") > 0).select(F.col("column_name").alias("name"))
    b = columns_containing(stored_prom(spark, sf), 9).select(F.col("column_name").alias("name"))
    return R.set_ops(a, b, "name")


def _j08_sql():
    from ..fixture import column_order
    allc = column_order()
    num = [c for c in allc if c not in ("provider_code", "year", "procedure", "age_band", "gender")]
    a = " UNION ALL ".join(f"SELECT '{c}' AS name FROM clean HAVING COUNT(*) FILTER (WHERE {c} IS NULL) > 0" for c in allc)
    b = " UNION ALL ".join(f"SELECT '{c}' AS name FROM prom HAVING MAX(CASE WHEN {c} = 9 THEN 1 ELSE 0 END) = 1" for c in num)
    return ctes(f"a AS ({a})", f"b AS ({b})") + """SELECT COALESCE(a.name, b.name) AS name, a.name IS NOT NULL AS in_a, b.name IS NOT NULL AS in_b,
  CASE WHEN a.name IS NOT NULL AND b.name IS NOT NULL THEN 'both' WHEN a.name IS NOT NULL THEN 'only_a' ELSE 'only_b' END AS "set"
FROM a FULL JOIN b ON a.name = b.name"""


def w01_sort(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return o.orderBy(F.asc("o_orderpriority"), F.abs(F.col("o_totalprice") - 100000.0).desc(), "o_orderkey")


SQL_W01 = "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, abs(o_totalprice - 100000.0) DESC, o_orderkey"


def w02_topk(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    per = R.top_k_per_group(c, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)
    glob_top = R.top_k(c, [F.desc("c_acctbal"), F.asc("c_custkey")], 5).withColumn("rank", F.lit(0))
    glob_bot = R.top_k(c, [F.asc("c_acctbal"), F.asc("c_custkey")], 5).withColumn("rank", F.lit(-1))
    return per.unionByName(glob_top).unionByName(glob_bot)


SQL_W02 = """SELECT c_custkey, c_nationkey, c_acctbal, rank FROM (
  SELECT c_custkey, c_nationkey, c_acctbal, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer)
WHERE rank <= 3
UNION ALL SELECT * FROM (SELECT c_custkey, c_nationkey, c_acctbal, 0 AS rank FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5)
UNION ALL SELECT * FROM (SELECT c_custkey, c_nationkey, c_acctbal, -1 AS rank FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5)"""


def w03_average_rank(spark, sf):
    return rank_table(_t(spark, sf, "lineitem").select("l_quantity", "l_returnflag"), "l_quantity", ["l_returnflag"])


SQL_W03 = """SELECT DISTINCT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
  + (COUNT(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rank FROM lineitem"""


def w06_explicit_order(spark, sf):
    d = cleaned(spark, sf).groupBy("age_band").agg(F.count(F.lit(1)).alias("n"))
    return R.explicit_order(d, "age_band", cat.AGE_BANDS, "order")


SQL_W06 = ctes() + "SELECT age_band, COUNT(*) AS n, CASE age_band " + " ".join(
    f"WHEN '{b}' THEN {i + 1}" for i, b in enumerate(cat.AGE_BANDS)) + f" ELSE {len(cat.AGE_BANDS) + 1} END AS \"order\" FROM clean GROUP BY age_band"


def w07_head(spark, sf):
    return scored(spark, sf).select("record_id", "provider_code", "oks_t0_score").orderBy("record_id").limit(10)


SQL_W07 = ctes(scored_cte()) + "SELECT record_id, provider_code, oks_t0_score FROM scored ORDER BY record_id LIMIT 10"


QUERIES = {
    "J01_S07_union_aligned": (j01_union, SQL_J01),
    "J02_outer_align": (j02_outer_align, SQL_J02),
    "J03_T19_ranking_join": (j03_rank_join, SQL_J03),
    "J04_counts_with_shares": (j04_counts_shares, SQL_J04),
    "J05_semi_join_top10": (j05_semi_join_top, SQL_J05),
    "J06_align_target": (j06_align_target, SQL_J06),
    "J07_rank_position_join": (j07_rank_position, SQL_J07),
    "J08_set_operations": (j08_set_ops, _j08_sql()),
    "W01_multi_key_sort": (w01_sort, SQL_W01),
    "W02_top_bottom_k": (w02_topk, SQL_W02),
    "W03_average_rank_ties": (w03_average_rank, SQL_W03),
    "W06_explicit_order": (w06_explicit_order, SQL_W06),
    "W07_sample_head": (w07_head, SQL_W07),
}
