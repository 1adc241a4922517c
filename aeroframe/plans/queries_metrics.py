"""Metric, gate and split queries on the driver tables.

Each table row plays one case: a line item priced by its part gives a true and a predicted coefficient.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.functions import bands, physics
from aeroframe.operators import compare, metrics, ordering, predict, quality, regression, splits
from aeroframe.plans import training
from aeroframe.plans.registry import query, r, rounded, table

CASES_SQL = """
SELECT l_returnflag AS task, l_linestatus AS family, l_orderkey, l_partkey, l_suppkey, l_linenumber,
       l_extendedprice / 10000.0 AS Cl_true, l_quantity * p_retailprice / 10000.0 AS Cl_pred,
       20.0 * l_discount + 0.5 AS Cl_std,
       (1.0 + l_tax) * (1.0 + l_quantity) / 100.0 AS Cd_true, (1.0 + l_discount) * (1.0 + l_quantity) / 100.0 AS Cd_pred,
       l_tax / 2.0 + 0.02 AS logCd_std
FROM lineitem JOIN part ON l_partkey = p_partkey
"""


def cases(spark, sf) -> DataFrame:
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    q = F.col("l_quantity")
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_returnflag").alias("task"), F.col("l_linestatus").alias("family"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        (F.col("l_extendedprice") / 10000.0).alias("Cl_true"), (q * F.col("p_retailprice") / 10000.0).alias("Cl_pred"),
        (20.0 * F.col("l_discount") + 0.5).alias("Cl_std"), ((1.0 + F.col("l_tax")) * (1.0 + q) / 100.0).alias("Cd_true"),
        ((1.0 + F.col("l_discount")) * (1.0 + q) / 100.0).alias("Cd_pred"), (F.col("l_tax") / 2.0 + 0.02).alias("logCd_std"))


@query(f"""
WITH c AS ({CASES_SQL}),
l AS (SELECT task, family, 'Cl' AS target, Cl_true AS t, Cl_pred AS p, Cl_true AS mt, Cl_pred AS mp, Cl_std AS s FROM c
      UNION ALL SELECT task, family, 'Cd', Cd_true, Cd_pred, ln(Cd_true), ln(Cd_pred), logCd_std FROM c),
k AS (SELECT *, abs((t - p) / t) AS rel,
      rank() OVER (PARTITION BY task, family, target ORDER BY t) + (count(*) OVER (PARTITION BY task, family, target, t) - 1) / 2.0 AS rt,
      rank() OVER (PARTITION BY task, family, target ORDER BY p) + (count(*) OVER (PARTITION BY task, family, target, p) - 1) / 2.0 AS rp FROM l)
SELECT task, family, target, count(*) AS n_test, round(1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)), 6) AS R2,
       round(sqrt(avg((t - p) * (t - p))), 6) AS RMSE, round(avg(abs(t - p)), 6) AS MAE, round(avg(rel), 6) AS rel_err_mean,
       round(quantile_cont(rel, 0.5), 6) AS rel_err_median, round(avg(CASE WHEN abs(mt - mp) <= 2 * s THEN 1.0 ELSE 0.0 END), 6) AS coverage_2sigma,
       round(corr(rt, rp), 6) AS spearman
FROM k GROUP BY task, family, target
""")
def regression_metrics(spark, sf):
    return rounded(training.coefficient_metrics(cases(spark, sf)))


@query(f"""
WITH c AS ({CASES_SQL}), g AS (
SELECT family, task, grouping(task) AS a, count(*) AS n, 1 - sum((Cl_true - Cl_pred) * (Cl_true - Cl_pred)) / (var_pop(Cl_true) * count(*)) AS R2,
       sqrt(avg((Cl_true - Cl_pred) * (Cl_true - Cl_pred))) AS RMSE, avg(abs(Cl_true - Cl_pred)) AS MAE, avg(abs((Cl_true - Cl_pred) / Cl_true)) AS e
FROM c GROUP BY GROUPING SETS ((family), (family, task)))
SELECT family, CASE WHEN a = 1 THEN 'global' ELSE task END AS slice, n, round(R2, 6) AS R2, round(RMSE, 6) AS RMSE, round(MAE, 6) AS MAE,
       round(e, 6) AS rel_err_mean, R2 >= -0.5 AS passed FROM g
""")
def metrics_grouping_sets(spark, sf):
    return rounded(metrics.sliced_metrics(cases(spark, sf), ["family"], "task", "Cl_true", "Cl_pred", -0.5))


@query(f"""
WITH c AS ({CASES_SQL}), e AS (SELECT *, abs(Cl_pred - Cl_true) AS dcl, abs(100 * (Cd_pred - Cd_true) / Cd_true) AS dcd,
  CASE WHEN Cl_pred - 1.96 * Cl_std <= Cl_true AND Cl_true <= Cl_pred + 1.96 * Cl_std THEN 1.0 ELSE 0.0 END AS c1,
  CASE WHEN Cd_pred * exp(-1.96 * logCd_std) <= Cd_true AND Cd_true <= Cd_pred * exp(1.96 * logCd_std) THEN 1.0 ELSE 0.0 END AS c2 FROM c)
SELECT family, round(1 - sum((Cl_true - Cl_pred) * (Cl_true - Cl_pred)) / (var_pop(Cl_true) * count(*)), 6) AS R2_Cl,
       round(1 - sum((Cd_true - Cd_pred) * (Cd_true - Cd_pred)) / (var_pop(Cd_true) * count(*)), 6) AS R2_Cd, round((avg(c1) + avg(c2)) / 2, 6) AS coverage_95,
       round(quantile_cont(dcl, 0.5), 6) AS median_abs_dCl, round(quantile_cont(dcd, 0.5), 6) AS median_dCd_pct, round(quantile_cont(dcd, 0.9), 6) AS p90_dCd_pct,
       CASE family WHEN 'F' THEN 'GP' ELSE 'KRG' END AS label
FROM e GROUP BY family
""")
def family_summary(spark, sf):
    out = metrics.family_summary(cases(spark, sf), ["family"])
    return rounded(out.withColumn("label", predict.family_label(F.when(F.col("family") == "F", "gp").otherwise("krg"))))


@query(f"""
WITH c AS ({CASES_SQL}), e AS (SELECT task, abs(Cd_pred - Cd_true) AS gap, abs((Cd_true - Cd_pred) / Cd_true) AS rel FROM c)
SELECT task, count(*) AS n, round(avg(rel), 6) AS mean_rel, round(avg(CASE WHEN rel > 3.0 * 0.05 THEN 1.0 ELSE 0.0 END), 6) AS tail_fraction,
       round(quantile_cont(rel, 0.5), 6) AS median_rel, round(quantile_cont(rel, 0.95), 6) AS p95_rel, round(quantile_cont(gap, 0.5), 6) AS median_abs,
       quantile_cont(rel, 0.5) <= 0.05 AND avg(CASE WHEN rel > 3.0 * 0.05 THEN 1.0 ELSE 0.0 END) <= 0.05 AS passed
FROM e GROUP BY task
""")
def error_criterion(spark, sf):
    return rounded(metrics.error_criterion(cases(spark, sf), ["task"], "Cd_true", "Cd_pred", 0.05))


WALL_SQL = """SELECT l_extendedprice / 10000.0 AS Cl, (1.0 + l_quantity) / 100.0 AS Cd, l_extendedprice / 10000.0 * (1.0 + (l_discount - 0.05) / 10.0) AS Cl_int_p,
  l_extendedprice / 10000.0 * l_tax / 100.0 AS Cl_int_tau, (1.0 + l_quantity) / 100.0 * 0.3 AS Cd_int_p,
  (1.0 + l_quantity) / 100.0 * (0.7 + l_tax / 4.0) AS Cd_int_tau FROM lineitem"""


def wall_dataset(spark, sf):
    l = table(spark, sf, "lineitem")
    cl, cd = F.col("l_extendedprice") / 10000.0, (1.0 + F.col("l_quantity")) / 100.0
    return l.select(cl.alias("Cl"), cd.alias("Cd"), (cl * (1.0 + (F.col("l_discount") - 0.05) / 10.0)).alias("Cl_int_p"), (cl * F.col("l_tax") / 100.0).alias("Cl_int_tau"),
                    (cd * 0.3).alias("Cd_int_p"), (cd * (0.7 + F.col("l_tax") / 4.0)).alias("Cd_int_tau"))


@query(f"""
WITH w AS ({WALL_SQL}), e AS (SELECT abs((Cl - Cl_int_p) / Cl) AS a, abs((Cl - (Cl_int_p + Cl_int_tau)) / Cl) AS b, abs((Cd - (Cd_int_p + Cd_int_tau)) / Cd) AS d,
  Cd_int_tau / (Cd_int_p + Cd_int_tau) AS s FROM w),
g AS (SELECT quantile_cont(a, 0.5) <= 0.02 AND avg(CASE WHEN a > 3.0 * 0.02 THEN 1.0 ELSE 0.0 END) <= 0.05 AS Cl_pressure_only_ok,
  quantile_cont(b, 0.5) <= 0.02 AND avg(CASE WHEN b > 3.0 * 0.02 THEN 1.0 ELSE 0.0 END) <= 0.05 AS Cl_ok,
  quantile_cont(d, 0.5) <= 0.05 AND avg(CASE WHEN d > 3.0 * 0.05 THEN 1.0 ELSE 0.0 END) <= 0.05 AS Cd_ok, round(quantile_cont(s, 0.5), 6) AS median_shear_share FROM e)
SELECT *, Cl_pressure_only_ok AS cp_pass, Cl_pressure_only_ok AND Cl_ok AND Cd_ok AS cf_pass FROM g
""")
def wall_gate(spark, sf):
    return rounded(metrics.wall_gate(wall_dataset(spark, sf)))


@query(f"""
WITH c AS ({CASES_SQL})
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(Cl_true, 6) AS Cl_true, round(Cl_pred, 6) AS Cl_pred, round(abs((Cl_true - Cl_pred) / Cl_true), 6) AS rel_err
FROM c ORDER BY abs((Cl_true - Cl_pred) / Cl_true) DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 10
""")
def worst_n(spark, sf):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return rounded(metrics.worst_rows(cases(spark, sf).select(*keys, "Cl_true", "Cl_pred"), "Cl_true", "Cl_pred", 10, keys))


ORDERS_SQL = """SELECT o_orderkey AS sample_id, o_custkey, o_totalprice, o_orderpriority, o_orderstatus,
  (o_custkey % 97) / 10.0 AS alpha_deg, o_totalprice * 10.0 AS Re, length(o_orderpriority) / 100.0 AS t_max, 0.3 AS x_tmax, 0.0 AS m_max, 0.0 AS x_m,
  CASE WHEN o_totalprice < 2000.0 THEN CAST('NaN' AS DOUBLE) ELSE (o_totalprice - 250000.0) / 90000.0 END AS Cl, o_totalprice / 1600000.0 AS Cd FROM orders"""


def order_cases(spark, sf):
    o = table(spark, sf, "orders")
    price = F.col("o_totalprice")
    return o.select(F.col("o_orderkey").alias("sample_id"), "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus", ((F.col("o_custkey") % 97) / 10.0).alias("alpha_deg"),
                    (price * 10.0).alias("Re"), (F.length("o_orderpriority") / 100.0).alias("t_max"), F.lit(0.3).alias("x_tmax"), F.lit(0.0).alias("m_max"), F.lit(0.0).alias("x_m"),
                    F.when(price < 2000.0, F.lit(float("nan"))).otherwise((price - 250000.0) / 90000.0).alias("Cl"), (price / 1600000.0).alias("Cd"))


@query(f"""
WITH c AS ({ORDERS_SQL}), g AS (SELECT count(*) = (SELECT count(*) FROM orders) AS a, bool_and(NOT isnan(Cl) AND NOT isnan(Cd)) AS b, bool_and(t_max BETWEEN 0.04 AND 0.22) AS c,
  bool_and(m_max BETWEEN -0.08 AND 0.08) AS d, bool_and(alpha_deg BETWEEN -5.0 AND 15.0) AS e, bool_and(Re BETWEEN 1.9e6 AND 6.1e6) AS f FROM c)
SELECT 'row count' AS label, a AS ok FROM g UNION ALL SELECT 'no missing numbers', b FROM g UNION ALL SELECT 't_max in [0.04, 0.22]', c FROM g
UNION ALL SELECT 'abs m_max <= 0.08', d FROM g UNION ALL SELECT 'alpha_deg in [-5, 15]', e FROM g UNION ALL SELECT 'Re in [1.9e6, 6.1e6]', f FROM g
""")
def range_gate(spark, sf):
    n = table(spark, sf, "orders").count()
    return quality.gate(order_cases(spark, sf), quality.ingest_checks(n, ["alpha_deg", "Re", "t_max", "Cl", "Cd"]))


FLAGS_SQL = f"""
WITH c AS ({ORDERS_SQL}), k AS (SELECT *, round_even(alpha_deg, 3) AS k1, round_even(Re / 1000.0, 0) AS k2, round_even(t_max, 5) AS k3 FROM c),
f AS (SELECT *, min(sample_id) OVER (PARTITION BY k1, k2, k3) AS first_id FROM k),
q AS (SELECT sample_id, isnan(Cl) AS r1, NOT (Cd > 0 AND Cd < 0.3) AS r2, isnan(Cl) OR NOT (abs(Cl) < 2.5) AS r3, first_id <> sample_id AS r4, first_id FROM f),
flags AS (SELECT sample_id, NOT (r1 OR r2 OR r3 OR r4) AS qa_pass,
  concat_ws(',', CASE WHEN r1 THEN 'non_finite' END, CASE WHEN r2 THEN 'cd_range' END, CASE WHEN r3 THEN 'cl_range' END, CASE WHEN r4 THEN 'duplicate' END) AS rules FROM q)
"""


@query(FLAGS_SQL + "SELECT * FROM flags")
def row_hard_checks(spark, sf):
    return quality.hard_checks(order_cases(spark, sf)).select("sample_id", "qa_pass", F.concat_ws(",", "rules").alias("rules"))


@query(FLAGS_SQL + """SELECT count(*) AS n, count(*) FILTER (WHERE NOT qa_pass) AS n_fail, round(avg(CASE WHEN qa_pass THEN 0.0 ELSE 1.0 END), 6) AS fail_fraction,
  avg(CASE WHEN qa_pass THEN 0.0 ELSE 1.0 END) <= 0.02 AS ok FROM flags""")
def failure_gate(spark, sf):
    return rounded(quality.failure_gate(quality.hard_checks(order_cases(spark, sf))))


@query("""
WITH k AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_orderkey * 10 + l_linenumber AS row_id,
  round_even(l_extendedprice / 1000.0, 0) AS k1, round_even(l_discount, 2) AS k2, l_quantity AS k3 FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice, 2) AS l_extendedprice,
       nullif(min(row_id) OVER (PARTITION BY k1, k2, k3), row_id) AS first_id FROM k
""")
def duplicate_keep_first(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    keys = [F.bround(F.col("l_extendedprice") / 1000.0, 0), F.bround("l_discount", 2), F.col("l_quantity")]
    out = ordering.first_of_duplicates(l, keys, "row_id")
    return rounded(out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "first_id"), 2)


@query(f"""
WITH c AS ({ORDERS_SQL}), l AS (SELECT 'alpha_deg' AS quantity, alpha_deg AS v FROM c UNION ALL SELECT 'Re', Re FROM c UNION ALL SELECT 'Cl', Cl FROM c UNION ALL SELECT 'Cd', Cd FROM c)
SELECT quantity, count(*) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.5), 6) AS median FROM l WHERE NOT isnan(v) GROUP BY quantity
""")
def numeric_summary(spark, sf):
    return rounded(metrics.numeric_summary(order_cases(spark, sf), ["alpha_deg", "Re", "Cl", "Cd"]))


@query("""
WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT least(CAST(floor((o_totalprice - lo) / ((hi - lo) / 40)) AS BIGINT), 39) AS bin FROM orders, s),
n AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT 'o_totalprice' AS quantity, CAST(i AS BIGINT) AS bin, coalesce(n.n, 0) AS n, round(lo + i * ((hi - lo) / 40), 4) AS lo, round(lo + (i + 1) * ((hi - lo) / 40), 4) AS hi
FROM range(40) t(i) CROSS JOIN s LEFT JOIN n ON n.bin = i
""")
def histogram(spark, sf):
    return rounded(metrics.histogram(table(spark, sf, "orders").select("o_totalprice"), ["o_totalprice"]), 4)


@query("""
WITH c AS (SELECT l_quantity AS x, l_extendedprice / 10000.0 AS y FROM lineitem), q AS (SELECT y / x AS r FROM c WHERE abs(x) > 1.0)
SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, (SELECT round(quantile_cont(r, 0.05), 6) FROM q) AS p5,
  (SELECT round(quantile_cont(r, 0.5), 6) FROM q) AS median, (SELECT round(quantile_cont(r, 0.95), 6) FROM q) AS p95 FROM c
""")
def slope_fit(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 10000.0).alias("y"))
    return rounded(metrics.slope_fit(l, "x", "y"))


@query("""
WITH c AS (SELECT l_quantity - 30.0 - l_extendedprice / 10000.0 / 0.5 AS a0 FROM lineitem)
SELECT count(*) AS n, round(avg(CASE WHEN a0 < 0 THEN 1.0 ELSE 0.0 END), 6) AS frac_negative, round(max(a0), 6) AS max, count(*) FILTER (WHERE a0 >= 0) AS n_nonnegative,
  round(quantile_cont(a0, 0.5), 6) AS median FROM c
""")
def zero_lift(spark, sf):
    l = table(spark, sf, "lineitem").select((F.col("l_quantity") - 30.0).alias("a"), (F.col("l_extendedprice") / 10000.0).alias("cl"))
    return rounded(metrics.zero_lift(l, "a", "cl", 0.5))


@query("""
WITH m AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice / 10000.0) AS my, covar_pop(l_quantity, l_extendedprice / 10000.0) AS c, var_pop(l_quantity) AS vx,
  var_pop(l_extendedprice / 10000.0) AS vy FROM lineitem),
z AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 1.0 / n + (l_quantity - mx) * (l_quantity - mx) / (n * vx) AS h,
  l_extendedprice / 10000.0 - my - c / vx * (l_quantity - mx) AS e, n * (vy - c / vx * c) / (n - 2) AS s2 FROM lineitem, m)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(h, 8) AS leverage, round(e / sqrt(s2 * (1 - h)), 6) AS z FROM z
""")
def loo_outliers_1d(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") / 10000.0).alias("y"))
    out = regression.simple_loo(l, "l_quantity", "y")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), r("leverage", 8).alias("leverage"), r("z").alias("z"))


@query("""
SELECT l_orderkey AS sample_id, l_partkey AS node_id, count(*) AS n_copies, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_pop(l_quantity), 6) AS l_quantity_std,
  round(avg(l_discount), 6) AS l_discount_mean, round(stddev_pop(l_discount), 6) AS l_discount_std FROM lineitem GROUP BY l_orderkey, l_partkey
""")
def ensemble_stats(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("node_id"), "l_quantity", "l_discount")
    return rounded(metrics.ensemble_stats(l, ["sample_id", "node_id"], ["l_quantity", "l_discount"]))


@query("""
WITH e AS (SELECT l_linestatus AS variable, l_linenumber AS copy, l_suppkey AS sample, (l_discount - l_tax) * (l_discount - l_tax) * 1000 AS e, l_returnflag = 'A' AS s FROM lineitem),
a AS (SELECT variable, copy, sample, avg(CASE WHEN s THEN e END) AS surface, avg(CASE WHEN NOT s THEN e END) AS volume, avg(e) AS all_nodes FROM e GROUP BY ALL),
b AS (SELECT variable, copy, avg(surface) AS surface, avg(volume) AS volume, avg(all_nodes) AS all_nodes, avg(surface) + avg(volume) AS total FROM a GROUP BY ALL)
SELECT variable, count(*) AS n_copies, round(avg(surface), 6) AS surface_mean, round(stddev_pop(surface), 6) AS surface_std, round(avg(volume), 6) AS volume_mean,
  round(stddev_pop(volume), 6) AS volume_std, round(avg(all_nodes), 6) AS all_nodes_mean, round(stddev_pop(all_nodes), 6) AS all_nodes_std, round(avg(total), 6) AS total_mean,
  round(stddev_pop(total), 6) AS total_std FROM b GROUP BY variable
""")
def field_scores(spark, sf):
    gap = F.col("l_discount") - F.col("l_tax")
    return rounded(metrics.field_scores(table(spark, sf, "lineitem"), "l_linenumber", "l_suppkey", "l_linestatus", gap * gap * 1000, F.col("l_returnflag") == "A")
                   .withColumnRenamed("l_linestatus", "variable"))


@query("""
WITH k AS (SELECT l_linenumber AS c, rank() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_linenumber, l_extendedprice) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY l_linenumber ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_linenumber, l_quantity) - 1) / 2.0 AS b FROM lineitem),
s AS (SELECT c, corr(a, b) AS v FROM k GROUP BY c)
SELECT count(v) AS n_copies, round(avg(v), 6) AS spearman_mean, round(stddev_pop(v), 6) AS spearman_std FROM s
""")
def copy_spearman(spark, sf):
    return rounded(metrics.copy_spearman(table(spark, sf, "lineitem"), "l_linenumber", "l_extendedprice", "l_quantity"))


@query(f"""
WITH c AS ({CASES_SQL}), m AS (SELECT task, family, sqrt(avg((Cl_true - Cl_pred) * (Cl_true - Cl_pred))) AS RMSE FROM c GROUP BY ALL)
SELECT task, min_by(family, RMSE) AS best, round(min(RMSE), 6) AS best_RMSE FROM m GROUP BY task
""")
def best_family(spark, sf):
    e = F.col("Cl_true") - F.col("Cl_pred")
    m = cases(spark, sf).groupBy("task", "family").agg(F.sqrt(F.avg(e * e)).alias("RMSE"))
    return rounded(metrics.best_by(m, ["task"], "family", "RMSE"))


@query(f"""
WITH c AS ({CASES_SQL}), m AS (SELECT task, family, 1 - sum((Cl_true - Cl_pred) * (Cl_true - Cl_pred)) / (var_pop(Cl_true) * count(*)) AS a,
  1 - sum((Cd_true - Cd_pred) * (Cd_true - Cd_pred)) / (var_pop(Cd_true) * count(*)) AS b FROM c GROUP BY ALL)
SELECT task, family, round(a, 6) AS Cl_R2, round(b, 6) AS Cd_R2, CAST(a >= -0.4 AS BIGINT) + CAST(b >= 0.95 AS BIGINT) AS n_met, a >= -0.4 AND b >= 0.95 AS all_met FROM m
""")
def targets_met(spark, sf):
    long = training.long_targets(cases(spark, sf))
    m = long.groupBy("task", "family", "target").agg(metrics.r_squared("true", "pred").alias("R2"))
    return rounded(metrics.targets_met(m, ["task", "family"], {("Cl", "R2"): -0.4, ("Cd", "R2"): 0.95}))


@query("""
WITH k AS (SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS i,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
p AS (SELECT o_orderpriority, o_orderkey, o_totalprice, unnest([CASE WHEN i = 0 THEN 'lowest' END, CASE WHEN i = n // 2 THEN 'middle' END, CASE WHEN i = n - 1 THEN 'highest' END]) AS pick FROM k)
SELECT o_orderpriority, pick, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM p WHERE pick IS NOT NULL
""")
def ranked_picks(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return rounded(metrics.ranked_picks(o, ["o_orderpriority"], "o_totalprice", "o_orderkey").select("o_orderpriority", "pick", "o_orderkey", "o_totalprice"), 2)


@query("""
SELECT c_mktsegment AS regime, round(min(c_acctbal), 2) AS c_acctbal_lo, round(max(c_acctbal), 2) AS c_acctbal_hi, CAST(min(c_nationkey) AS BIGINT) AS c_nationkey_lo,
  CAST(max(c_nationkey) AS BIGINT) AS c_nationkey_hi, count(*) AS n_train, bool_and(c_acctbal > -999.0) AS validated FROM customer GROUP BY c_mktsegment
""")
def regime_bounds(spark, sf):
    c = table(spark, sf, "customer").withColumn("validated", F.col("c_acctbal") > -999.0).withColumnRenamed("c_mktsegment", "regime")
    return rounded(metrics.regime_bounds(c, "regime", ["c_acctbal", "c_nationkey"]), 2)


@query("""
WITH d AS (SELECT l_returnflag AS reference, l_tax * 100.0 - l_discount * 100.0 AS a, 100.0 * (l_discount - l_tax) / (1.0 + l_tax) AS b FROM lineitem)
SELECT reference, count(*) AS n, round(avg(abs(a)), 6) AS mean_abs_dCl, round(avg(abs(b)), 6) AS mean_abs_dCd, round(quantile_cont(abs(a), 0.5), 6) AS median_abs_dCl,
  round(quantile_cont(b, 0.5), 6) AS median_dCd FROM d GROUP BY reference
""")
def agreement_summary(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("reference"), (F.col("l_tax") * 100.0 - F.col("l_discount") * 100.0).alias("dCl"),
                                            (100.0 * (F.col("l_discount") - F.col("l_tax")) / (1.0 + F.col("l_tax"))).alias("dCd_pct"))
    return rounded(metrics.agreement_summary(d, ["reference"]))


# --- curves ----------------------------------------------------------------------------------------

CURVES_SQL = """
WITH v AS (SELECT vec_id AS sample_id, label, unnest(embedding) AS t, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
m AS (SELECT label, i, avg(CAST(t AS DOUBLE)) AS p FROM v GROUP BY label, i),
c AS (SELECT sample_id, v.label, CASE WHEN v.i < 32 THEN 'upper' ELSE 'lower' END AS surface, v.i % 32 AS station, 0.5 * (1.0 - cos((v.i % 32) * pi() / 31.0)) AS x_c,
  CAST(t AS DOUBLE) AS t, p FROM v JOIN m ON v.label = m.label AND v.i = m.i)
"""


def label_curves(spark, sf):
    """Each vector is a curve of 2 x 32 stations; the prediction is its label's mean."""
    from aeroframe.functions.grids import cosine_station
    e = table(spark, sf, "embeddings")
    long = e.select(F.col("vec_id").alias("sample_id"), "label", F.posexplode("embedding").alias("i", "t")).withColumn("t", F.col("t").cast("double"))
    mean = long.groupBy("label", "i").agg(F.avg("t").alias("pred"), F.count(F.lit(1)).alias("n"))
    joined = ordering.lookup_join(long, mean, ["label", "i"], "n")
    station = F.col("i") % 32
    return joined.select("sample_id", "label", F.when(F.col("i") < 32, "upper").otherwise("lower").alias("surface"), station.alias("station"), cosine_station(station, 32).alias("x_c"),
                         F.col("t").alias("true"), "pred")


@query(CURVES_SQL + """,
s AS (SELECT surface, station, count(*) AS n, sum((t - p) * (t - p)) AS sse, sum(abs(t - p)) AS sae, var_pop(t) * count(*) AS sst,
  count(*) FILTER (WHERE abs(t - p) <= 2 * 0.5) AS cov FROM c GROUP BY surface, station),
f AS (SELECT var_pop(t) * count(*) AS sst FROM c)
SELECT CAST(sum(n) AS BIGINT) AS n_values, round(sqrt(sum(sse) / sum(n)), 6) AS RMSE, round(sum(sae) / sum(n), 6) AS MAE, round(avg(1 - sse / s.sst), 6) AS R2_station_mean,
  round(1 - sum(sse) / (SELECT sst FROM f), 6) AS R2_flat, round(sum(cov) / sum(n), 6) AS coverage_2sigma FROM s
""")
def curve_metrics(spark, sf):
    c = label_curves(spark, sf).withColumn("std", F.lit(0.5))
    return rounded(metrics.curve_metrics(c, [], std="std"))


@query(CURVES_SQL + """,
e AS (SELECT label, sample_id, min(t) AS pt, min(p) AS pp, min(CASE WHEN surface = 'upper' AND t < 0 AND x_c BETWEEN 0.02 AND 0.98 THEN x_c END) AS st,
  min(CASE WHEN surface = 'upper' AND p < 0 AND x_c BETWEEN 0.02 AND 0.98 THEN x_c END) AS sp FROM c GROUP BY label, sample_id)
SELECT CAST(label AS BIGINT) AS label, round(avg(abs(pp - pt)), 6) AS suction_peak_MAE, count(st) AS n_separated_true,
  round(avg(CASE WHEN (st IS NULL) = (sp IS NULL) THEN 1.0 ELSE 0.0 END), 6) AS separation_detect_accuracy, round(avg(abs(sp - st)), 6) AS separation_xc_MAE FROM e GROUP BY label
""")
def curve_event_metrics(spark, sf):
    c = label_curves(spark, sf)
    both = c.withColumn("quantity", F.explode(F.array(F.lit("Cp"), F.lit("Cf"))))
    return rounded(metrics.curve_event_metrics(both, ["label"]))


@query(CURVES_SQL + """,
k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY t, CASE surface WHEN 'upper' THEN 0 ELSE 1 END, x_c) AS n FROM c),
s AS (SELECT sample_id, min(CASE WHEN surface = 'upper' AND t < 0 AND x_c BETWEEN 0.02 AND 0.98 THEN x_c END) AS x_separation FROM c GROUP BY sample_id)
SELECT k.sample_id, round(t, 6) AS Cp_min, round(x_c, 6) AS x_c_Cp_min, surface AS surface_Cp_min, round(x_separation, 6) AS x_separation FROM k JOIN s ON k.sample_id = s.sample_id WHERE n = 1
""")
def surface_summary(spark, sf):
    c = label_curves(spark, sf).select("sample_id", "surface", "x_c", F.col("true").alias("Cp"), F.col("true").alias("Cf"))
    return rounded(predict.surface_summary(c, ["sample_id"]))


# --- envelopes and warnings ------------------------------------------------------------------------

ENVELOPE_SQL = """
WITH q AS (SELECT o_orderkey, c_mktsegment AS task, o_totalprice / 1000.0 AS Re, c_nationkey - 5.0 AS alpha_deg, c_acctbal / 100.0 AS t_max FROM orders JOIN customer ON o_custkey = c_custkey),
n AS (SELECT task, min(Re) AS rl, max(Re) AS rh, min(alpha_deg) AS al, max(alpha_deg) AS ah, min(t_max) AS tl, max(t_max) AS th FROM q
      WHERE Re BETWEEN 50.0 AND 400.0 AND alpha_deg BETWEEN -2.5 AND 12.5 AND t_max > 0 GROUP BY task)
"""


def order_queries(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    q = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_mktsegment").alias("task"), (F.col("o_totalprice") / 1000.0).alias("Re"),
                                                                   (F.col("c_nationkey") - 5.0).alias("alpha_deg"), (F.col("c_acctbal") / 100.0).alias("t_max"))
    train = q.filter(F.col("Re").between(50.0, 400.0) & F.col("alpha_deg").between(-2.5, 12.5) & (F.col("t_max") > 0))
    return q, train


@query(ENVELOPE_SQL + """SELECT task, 'Re' AS feature, round(rl, 6) AS lo, round(rh, 6) AS hi FROM n UNION ALL SELECT task, 'alpha_deg', round(al, 6), round(ah, 6) FROM n
UNION ALL SELECT task, 't_max', round(tl, 6), round(th, 6) FROM n""")
def envelope(spark, sf):
    return rounded(metrics.envelope(order_queries(spark, sf)[1], ["task"], ["Re", "alpha_deg", "t_max"]))


@query(ENVELOPE_SQL + """, w AS (SELECT o_orderkey, q.task, NOT (Re BETWEEN rl * (1 - 0.02) AND rh * (1 + 0.02)) AS a, alpha_deg < al - 0.1 OR alpha_deg > ah + 0.1 AS b,
  NOT (t_max BETWEEN tl AND th) AS c, alpha_deg > 12.0 AS d FROM q JOIN n ON q.task = n.task)
SELECT o_orderkey, task, concat_ws(',', CASE WHEN a THEN 'Re' END, CASE WHEN b THEN 'alpha_deg' END, CASE WHEN c THEN 't_max' END, CASE WHEN d THEN 'near_stall' END) AS warning_ids,
  NOT (a OR b OR c) AS in_envelope FROM w""")
def envelope_warnings(spark, sf):
    q, train = order_queries(spark, sf)
    env = metrics.envelope(train, ["task"], ["Re", "alpha_deg", "t_max"])
    out = predict.envelope_warnings(q, env, features=["t_max"])
    return out.select("o_orderkey", "task", F.concat_ws(",", "warning_ids").alias("warning_ids"), "in_envelope")


@query("""
WITH c AS (SELECT o_orderkey, (o_custkey % 20) - 2.0 AS a, o_totalprice * 10.0 AS re, length(o_orderpriority) / 100.0 + 0.05 AS t FROM orders)
SELECT CASE WHEN a >= 10.0 THEN 'B' WHEN re < 1.0e6 THEN 'C' WHEN re >= 2.0e6 AND a <= 6.0 AND t BETWEEN 0.10 AND 0.18 THEN 'D' ELSE 'A' END AS regime, o_orderkey,
  round(re * 1.5e-5, 8) AS u_inf, round(re * 1.5e-5 * cos(radians(a)), 8) AS ux, round(re * 1.5e-5 * sin(radians(a)), 8) AS uy, round(-sin(radians(a)), 6) + 0.0 AS lift_x,
  round(cos(radians(a)), 6) AS lift_y, round(30.0 * 1.5e-5 / sqrt(0.5 * 1.225 * pow(re * 1.5e-5, 2) * (0.026 / pow(re, 1.0 / 7.0)) / 1.225), 8) AS first_height,
  round(0.37 / pow(re, 0.2), 6) AS delta99, round(log10(re), 6) AS log10_re FROM c
""")
def flow_columns(spark, sf):
    c = table(spark, sf, "orders").select("o_orderkey", ((F.col("o_custkey") % 20) - 2.0).alias("a"), (F.col("o_totalprice") * 10.0).alias("re"),
                                          (F.length("o_orderpriority") / 100.0 + 0.05).alias("t"))
    u = physics.speed_from_reynolds(F.col("re"))
    d = physics.flow_directions(F.col("a"), u)
    return c.select(physics.classify_regime(F.col("a"), F.col("re"), F.col("t")).alias("regime"), "o_orderkey", r(u, 8).alias("u_inf"), r(d["ux"], 8).alias("ux"), r(d["uy"], 8).alias("uy"),
                    r(d["lift_x"]).alias("lift_x"), r(d["lift_y"]).alias("lift_y"), r(physics.first_cell_height(F.col("re"), F.lit(30.0)), 8).alias("first_height"),
                    r(physics.boundary_layer_thickness(F.col("re"))).alias("delta99"), r(F.log10("re")).alias("log10_re"))


@query("""
WITH s AS (SELECT s_suppkey, n_name AS family, s_acctbal / 10000.0 AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey),
w AS (SELECT s_suppkey, family, CAST(a AS DOUBLE) AS alpha_deg, 0.11 * a + b / 2 AS Cl, 0.02 + abs(b) / 20 AS Cl_std, ln(0.008 + 0.0001 * a * a) AS logcd, 0.01 + abs(b) / 50 AS s
      FROM s CROSS JOIN (SELECT -5.0 + 20.0 * i / 20 AS a FROM range(21) t(i))),
p AS (SELECT *, exp(logcd) AS Cd, exp(logcd) * s AS Cd_std, Cl / exp(logcd) AS L_over_D FROM w)
SELECT s_suppkey, family, round(alpha_deg, 6) AS alpha_deg, round(Cl, 9) AS Cl, round(Cl - 2 * Cl_std, 9) AS Cl_lo, round(Cl + 2 * Cl_std, 9) AS Cl_hi, round(Cd, 8) AS Cd,
  round(exp(logcd - 2 * s), 8) AS Cd_lo, round(exp(logcd + 2 * s), 8) AS Cd_hi, round(L_over_D, 10) AS L_over_D, round(Cl - 1.96 * Cl_std, 9) AS Cl_lo95,
  round(Cd * exp(1.96 * (Cd_std / Cd)), 8) AS Cd_hi95,
  round(coalesce(abs(L_over_D) * sqrt(pow(Cl_std / nullif(Cl, 0), 2) + (Cd_std / Cd) * (Cd_std / Cd)), 0), 10) AS L_over_D_std FROM p
""")
def sweep_bands(spark, sf):
    out = bands.add_95_band(supplier_sweep(spark, sf))
    return out.select("s_suppkey", "family", r("alpha_deg").alias("alpha_deg"), r("Cl", 9).alias("Cl"), r("Cl_lo", 9).alias("Cl_lo"), r("Cl_hi", 9).alias("Cl_hi"), r("Cd", 8).alias("Cd"),
                      r("Cd_lo", 8).alias("Cd_lo"), r("Cd_hi", 8).alias("Cd_hi"), r("L_over_D", 10).alias("L_over_D"), r("Cl_lo95", 9).alias("Cl_lo95"), r("Cd_hi95", 8).alias("Cd_hi95"),
                      r("L_over_D_std", 10).alias("L_over_D_std"))


def supplier_sweep(spark, sf):
    """An angle sweep per supplier with a closed-form mean and sigma."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select("s_suppkey", F.col("n_name").alias("family"), (F.col("s_acctbal") / 10000.0).alias("b"), F.lit(-5.0).alias("alpha_min"), F.lit(15.0).alias("alpha_max"), F.lit(21).alias("n_points"))
    w = predict.alpha_sweep(s)
    a, b = F.col("alpha_deg"), F.col("b")
    cols = bands.posterior_columns(0.11 * a + b / 2, 0.02 + F.abs(b) / 20, F.log(0.008 + 0.0001 * a * a), 0.01 + F.abs(b) / 50)
    return w.select("s_suppkey", "family", "alpha_deg", *[v.alias(k) for k, v in cols.items()])


@query("""
WITH s AS (SELECT s_suppkey, s_acctbal / 10000.0 AS b FROM supplier),
w AS (SELECT s_suppkey, CAST(a AS DOUBLE) AS a, 0.11 * a + b / 2 AS Cl, exp(ln(0.008 + 0.0001 * a * a)) AS Cd FROM s CROSS JOIN (SELECT -5.0 + 20.0 * i / 20 AS a FROM range(21) t(i))),
g AS (SELECT s_suppkey, max(Cl / Cd) AS best, max_by(a, Cl / Cd) AS ab, max(Cl) AS ch, min(Cl) AS cl, min(Cd) AS dm, max(CASE WHEN Cl <= 0 THEN Cl END) AS y0,
  max(CASE WHEN Cl <= 0 THEN a END) AS x0, min(CASE WHEN Cl > 0 THEN Cl END) AS y1, min(CASE WHEN Cl > 0 THEN a END) AS x1 FROM w GROUP BY s_suppkey)
SELECT s_suppkey, round(best, 7) AS L_over_D_max, round(ab, 6) AS alpha_at_best, round(ch, 9) AS Cl_max, round(dm, 8) AS Cd_min,
  CASE WHEN cl < 0 AND ch > 0 THEN round(x0 + (x1 - x0) * (-y0) / (y1 - y0), 6) END AS alpha_zero_lift FROM g
""")
def sweep_kpis(spark, sf):
    k = metrics.sweep_kpis(supplier_sweep(spark, sf), ["s_suppkey"])
    return k.select("s_suppkey", r("L_over_D_max", 7).alias("L_over_D_max"), r("alpha_at_best").alias("alpha_at_best"), r("Cl_max", 9).alias("Cl_max"), r("Cd_min", 8).alias("Cd_min"),
                    r("alpha_zero_lift").alias("alpha_zero_lift"))


@query("""
WITH q AS (SELECT o_orderkey, o_orderpriority AS task, o_orderstatus AS family FROM orders),
k AS (SELECT DISTINCT o_orderpriority AS task, 'F' AS family FROM orders UNION ALL SELECT DISTINCT o_orderpriority, 'O' FROM orders WHERE o_orderpriority < '3')
SELECT o_orderkey, q.task, q.family, CASE WHEN k.task IS NULL THEN 'no trained model for this task and family' END AS error FROM q LEFT JOIN k ON q.task = k.task AND q.family = k.family
""")
def check_models(spark, sf):
    o = table(spark, sf, "orders")
    q = o.select("o_orderkey", F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("family"))
    trained = o.select(F.col("o_orderpriority").alias("task")).distinct().withColumn("family", F.explode(F.when(F.col("task") < "3", F.array(F.lit("F"), F.lit("O"))).otherwise(F.array(F.lit("F")))))
    return predict.check_models(q, trained).select("o_orderkey", "task", "family", "error")


# --- splits ----------------------------------------------------------------------------------------

SPLIT_SQL = """
WITH k AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
s AS (SELECT o_orderkey, o_orderpriority, CASE WHEN rn <= round(n * 0.2) THEN 'test' ELSE 'train' END AS role FROM k)
"""


def order_split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return splits.stratified_split(o, "o_orderpriority", "o_orderkey", digest=F.md5(F.col("o_orderkey").cast("string").cast("binary")))


@query(SPLIT_SQL + "SELECT * FROM s")
def stratified_split(spark, sf):
    return order_split(spark, sf)


@query(SPLIT_SQL + "SELECT o_orderpriority, count(*) FILTER (WHERE role = 'train') AS train, count(*) FILTER (WHERE role = 'test') AS test FROM s GROUP BY o_orderpriority")
def split_counts(spark, sf):
    return metrics.pivot_counts(order_split(spark, sf), "o_orderpriority", "role", ["train", "test"])


@query("""SELECT c_custkey, (row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) - 1) % 5 AS fold FROM customer""")
def fold_assignment(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    return rounded(splits.fold_column(c, "c_custkey", digest=F.md5(F.col("c_custkey").cast("string").cast("binary"))))


MEMBER_SQL = """
WITH a AS (SELECT o_orderpriority || '/' || o_orderstatus AS name, o_custkey AS sample_id FROM orders),
b AS (SELECT o_orderpriority || '/' || o_orderstatus AS name, o_custkey AS sample_id FROM orders WHERE o_orderpriority <> '2-HIGH' OR o_totalprice > 100000.0)
"""


@query(MEMBER_SQL + """, x AS (SELECT name, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY name), y AS (SELECT name, count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY name),
  n AS (SELECT DISTINCT name FROM a)
SELECT n.name, coalesce(x.n, 0) AS only_a, coalesce(y.n, 0) AS only_b, coalesce(x.n, 0) = 0 AND coalesce(y.n, 0) = 0 AS same FROM n LEFT JOIN x ON n.name = x.name LEFT JOIN y ON n.name = y.name""")
def membership_equality(spark, sf):
    o = table(spark, sf, "orders")
    named = lambda d: d.select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("name"), F.col("o_custkey").alias("sample_id"))
    return splits.same_membership(named(o), named(o.filter((F.col("o_orderpriority") != "2-HIGH") | (F.col("o_totalprice") > 100000.0))))


@query("""SELECT o_custkey AS sample_id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def split_overlap(spark, sf):
    m = table(spark, sf, "orders").select(F.col("o_custkey").alias("sample_id"), "o_orderstatus")
    return splits.overlap(m, F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P")


SUMMARY_SQL = """
WITH m AS (SELECT o_orderpriority AS task, CASE WHEN o_orderstatus = 'F' THEN 'test' ELSE 'train' END AS role, o_totalprice > 20000.0 AS ok, (o_custkey % 97) / 10.0 AS a, o_totalprice * 10.0 AS re FROM orders)
"""


@query(SUMMARY_SQL + """SELECT task, role, count(*) FILTER (WHERE ok) AS n, count(*) FILTER (WHERE NOT ok) AS dropped, round(min(a) FILTER (WHERE ok), 6) AS alpha_lo,
  round(max(a) FILTER (WHERE ok), 6) AS alpha_hi, round(min(re) FILTER (WHERE ok), 3) AS Re_lo, round(max(re) FILTER (WHERE ok), 3) AS Re_hi FROM m GROUP BY task, role""")
def split_summary(spark, sf):
    c = order_cases(spark, sf)
    member = c.select(F.col("o_orderpriority").alias("task"), F.when(F.col("o_orderstatus") == "F", "test").otherwise("train").alias("role"), "sample_id")
    s = splits.split_summary(c, member, c.select("sample_id", (F.col("o_totalprice") > 20000.0).alias("qa_pass")))
    return s.select("task", "role", "n", "dropped", r("alpha_lo").alias("alpha_lo"), r("alpha_hi").alias("alpha_hi"), r("Re_lo", 3).alias("Re_lo"), r("Re_hi", 3).alias("Re_hi"))


@query("""
WITH m AS (SELECT CASE WHEN o_totalprice BETWEEN 150000.0 AND 250000.0 THEN 'train' ELSE 'test' END AS role, o_totalprice AS v FROM orders),
t AS (SELECT min(v) AS lo, max(v) AS hi FROM m WHERE role = 'train'), i AS (SELECT count(*) AS n FROM m, t WHERE role = 'test' AND v BETWEEN lo AND hi)
SELECT round(lo, 2) AS lo, round(hi, 2) AS hi, n AS test_inside, n = 0 AS sharp_cut, abs((lo / 150000.0) / (hi / 250000.0) - 1) < 0.01 AS edges_agree,
  (SELECT bool_and(v BETWEEN 149999.999 AND 250000.001) FROM m WHERE role = 'train') AS train_inside, (SELECT bool_and(v < 150000.001 OR v > 249999.999) FROM m WHERE role = 'test') AS test_outside FROM t, i
""")
def split_rules(spark, sf):
    v = F.col("o_totalprice")
    m = table(spark, sf, "orders").select(F.when(v.between(150000.0, 250000.0), "train").otherwise("test").alias("role"), v.alias("v"))
    band = splits.band_rules(m, "v", (150000.0, 250000.0))
    return rounded(ordering.join_null_safe(band, splits.angle_rules(m, "v", 150000.0, 250000.0), []), 2)


@query("""SELECT CASE WHEN c_mktsegment < 'F' THEN 'A' ELSE 'B' END AS regime, c_custkey AS position, row_number() OVER (ORDER BY CASE WHEN c_mktsegment < 'F' THEN 'A' ELSE 'B' END, c_custkey) - 1 AS case_id FROM customer""")
def sequential_ids(spark, sf):
    c = table(spark, sf, "customer").select(F.when(F.col("c_mktsegment") < "F", "A").otherwise("B").alias("regime"), F.col("c_custkey").alias("position"))
    return splits.sequential_ids(c, "regime", "position")


@query("""
WITH c AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey)
SELECT CAST(s_nationkey AS BIGINT) AS s_nationkey, n, CAST(sum(n) OVER (ORDER BY s_nationkey) AS BIGINT) AS stop, CAST(sum(n) OVER (ORDER BY s_nationkey) - n AS BIGINT) AS start FROM c
""")
def ragged_offsets(spark, sf):
    from aeroframe.sources.samples import ragged_offsets as offsets
    c = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return rounded(offsets(c, "s_nationkey", "n"))


@query(f"""
WITH c AS ({CASES_SQL}), s AS (SELECT task, family, round(avg(Cl_true), 6) AS a, round(avg(Cl_pred), 6) AS b, round(avg(Cd_true), 6) AS d FROM c GROUP BY task, family)
SELECT task, family AS model, 'force' AS score, CAST(0 AS BIGINT) AS component, a AS value, 'published' AS source FROM s UNION ALL SELECT task, family, 'force', 1, b, 'published' FROM s
UNION ALL SELECT task, family, 'pressure', 0, d, 'published' FROM s UNION ALL SELECT task, 'own', 'pressure', 0, min(d), 'own' FROM s GROUP BY task
""")
def benchmark_table(spark, sf):
    s = cases(spark, sf).groupBy("task", "family").agg(F.round(F.avg("Cl_true"), 6).alias("a"), F.round(F.avg("Cl_pred"), 6).alias("b"), F.round(F.avg("Cd_true"), 6).alias("d"))
    arrays = s.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("family", "a", "b", "d"))).alias("_m")).select(
        "task", F.transform("_m", lambda m: F.array(m["a"], m["b"])).alias("force"), F.transform("_m", lambda m: m["d"]).alias("pressure"))
    published = compare.published_scores(arrays, ["F", "O"], ["force", "pressure"])
    own = s.groupBy("task").agg(F.min("d").alias("value")).select("task", F.lit("own").alias("model"), F.lit("pressure").alias("score"), F.lit(0).alias("component"), "value")
    return rounded(compare.benchmark_table(published, own))
