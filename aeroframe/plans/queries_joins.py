"""Join and comparison queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroframe.functions.physics import percent_error
from aeroframe.operators import compare, joins, predict
from aeroframe.operators.quality import tolerance_verdict
from aeroframe.plans.registry import query, r, rounded, table
from aeroframe.session import written


def micros(ts: Column) -> Column:
    """Microseconds since 2024-01-01 of a zone-less timestamp, independent of the session time zone."""
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60
    seconds = F.date_part(F.lit("SECOND"), ts)
    return (F.datediff(ts.cast("date"), F.lit("2024-01-01").cast("date")).cast("long") * 86400 + clock) * 1_000_000 + (seconds * 1_000_000).cast("long")


MICROS_SQL = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00'))"


def event_knots(spark, sf, by: str) -> DataFrame:
    e = table(spark, sf, "events").select(by, (micros(F.col("ts")) / 1e6).alias("x"), F.col("value").alias("y"))
    return e.groupBy(by, "x").agg(F.min("y").alias("y"))


def knots_sql(by: str) -> str:
    return f"k AS (SELECT {by}, {MICROS_SQL} / 1e6 AS x, min(value) AS y FROM events GROUP BY ALL)"


BETWEEN_SQL = "CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) / (x1 - x0) * (q - x0) END"


#: Users whose points one task makes: each has 120.
DEALT = 5000


def user_points(spark, sf):
    """120 points in time per user. Users, few bytes, are dealt out before they are listed: one task would make and fold all points.

    They are written first, else Spark may merge the two shuffles by user into one of few partitions."""
    users = written(table(spark, sf, "events").select("user_id").distinct(), "point-users")
    dealt = users.repartition(max(spark.sparkContext.defaultParallelism, -(-users.count() // DEALT)), "user_id")
    return dealt.withColumn("q", F.explode(F.transform(F.sequence(F.lit(0), F.lit(119)), lambda i: i * 21600.0)))


@query(f"""
WITH {knots_sql('user_id')}, q AS (SELECT user_id, unnest(range(0, 120)) * 21600.0::DOUBLE AS q FROM (SELECT DISTINCT user_id FROM events)),
l AS (SELECT q.user_id, q.q, k.x AS x0, k.y AS y0 FROM q ASOF LEFT JOIN k ON q.user_id = k.user_id AND q.q >= k.x),
b AS (SELECT l.*, k.x AS x1, k.y AS y1 FROM l ASOF LEFT JOIN k ON l.user_id = k.user_id AND l.q < k.x)
SELECT user_id, q, round({BETWEEN_SQL}, 6) AS y_at FROM b
""")
def interpolation_join(spark, sf):
    knots = event_knots(spark, sf, "user_id")
    return rounded(joins.interpolate(user_points(spark, sf), knots, ["user_id"], "q", "x", ["y"]))


@query(f"""
WITH {knots_sql('event_type')}, q AS (SELECT event_type, unnest(range(0, 31)) * 86400.0::DOUBLE AS q FROM (SELECT DISTINCT event_type FROM events)),
l AS (SELECT q.event_type, q.q, k.x AS x0, k.y AS y0 FROM q ASOF LEFT JOIN k ON q.event_type = k.event_type AND q.q >= k.x),
b AS (SELECT l.*, k.x AS x1, k.y AS y1 FROM l ASOF LEFT JOIN k ON l.event_type = k.event_type AND l.q < k.x)
SELECT q, round(avg({BETWEEN_SQL}), 6) AS y FROM b GROUP BY q
""")
def zone_mean(spark, sf):
    grid = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: i * 86400.0)
    return rounded(compare.zone_mean(event_knots(spark, sf, "event_type"), "event_type", grid, [], "q", "x", ["y"]))


@query("""
WITH c AS (SELECT o_orderkey, o_totalprice / 50.0 AS q, s_acctbal, s_suppkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(o_totalprice / 50.0 - s_acctbal), s_suppkey) AS n
  FROM orders JOIN supplier ON abs(o_totalprice / 50.0 - s_acctbal) <= 20.0)
SELECT o_orderkey, round(s_acctbal, 2) AS near_s_acctbal, c.s_suppkey AS near_s_suppkey FROM orders LEFT JOIN c USING (o_orderkey) WHERE n = 1 OR n IS NULL
""")
def nearest_reference(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 50.0).alias("q"))
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal").withColumn("rank", F.col("s_suppkey"))
    out = joins.nearest(o, s, [], "q", "s_acctbal", "rank", ["s_suppkey"], 20.0)
    return rounded(out.select("o_orderkey", "near_s_acctbal", "near_s_suppkey"), 2)


@query("""
WITH c AS (SELECT c_custkey, min(s_suppkey) AS m FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 5.0 + 1e-5 * abs(s_acctbal) GROUP BY c_custkey)
SELECT c_custkey, m AS match_s_suppkey FROM customer LEFT JOIN c USING (c_custkey)
""")
def tolerance_match(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal").withColumn("rank", F.col("s_suppkey"))
    return joins.first_match(c, s, ["nation"], "c_acctbal", "s_acctbal", "rank", ["s_suppkey"], 5.0).select("c_custkey", "match_s_suppkey")


@query("""
WITH q AS (SELECT s_nationkey AS nation, avg(s_acctbal) AS b FROM supplier GROUP BY s_nationkey)
SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal, round(b, 4) AS q_bal FROM customer JOIN q ON c_nationkey = nation AND abs(c_acctbal - b) <= greatest(0.08 * abs(b), 300.0)
""")
def range_neighbours(spark, sf):
    q = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.avg("s_acctbal").alias("q_bal"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    out = joins.range_join(c, q, ["nation"], {"c_acctbal": ("q_bal", F.greatest(0.08 * F.abs("q_bal"), F.lit(300.0)), 800.0)})
    return out.select("c_custkey", r("c_acctbal", 2).alias("c_acctbal"), r("q_bal", 4).alias("q_bal"))


NEAR_SQL = """
WITH rows AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_extendedprice * 60.0 AS Re, 0.06 + l_discount AS t_max, l_tax * 0.5 AS m_max, l_quantity FROM lineitem),
q AS (SELECT s_suppkey, 1000000.0 + abs(s_acctbal) * 300.0 AS q_Re, 0.1003 + (s_nationkey % 5) * 0.0125 AS q_t_max, 0.0002 + (s_suppkey % 9) * 0.0045 AS q_m_max FROM supplier),
near AS (SELECT s_suppkey, id, l_quantity FROM rows, q WHERE abs(Re - q_Re) <= greatest(0.08 * q_Re, 75000.0) AND abs(t_max - q_t_max) <= 0.01 AND abs(m_max - q_m_max) <= 0.01)
"""


def near_tables(spark, sf):
    """Line items as training rows and suppliers as queries in Re, thickness and camber."""
    l = table(spark, sf, "lineitem")
    rows = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_extendedprice") * 60.0).alias("Re"), (0.06 + F.col("l_discount")).alias("t_max"),
                    (F.col("l_tax") * 0.5).alias("m_max"), "l_quantity")
    s = table(spark, sf, "supplier")
    asked = s.select("s_suppkey", (1.0e6 + F.abs("s_acctbal") * 300.0).alias("q_Re"), (0.1003 + (F.col("s_nationkey") % 5) * 0.0125).alias("q_t_max"), (0.0002 + (F.col("s_suppkey") % 9) * 0.0045).alias("q_m_max"))
    return rows, asked, 0.08 * 4.0e6


@query(NEAR_SQL + "SELECT s_suppkey, id FROM near")
def nearby_rows(spark, sf):
    """Line items close to each supplier's query in three dimensions."""
    rows, asked, widest = near_tables(spark, sf)
    return predict.nearby_rows(rows.drop("l_quantity"), asked, widest).select("s_suppkey", "id")


@query(NEAR_SQL + "SELECT s_suppkey, count(id) AS n, round(sum(l_quantity), 4) AS total, min(l_quantity) AS lo, max(l_quantity) AS hi FROM q LEFT JOIN near USING (s_suppkey) GROUP BY s_suppkey")
def nearby_summary(spark, sf):
    """The same as counts and quantities per query, whole cells at a time."""
    rows, asked, widest = near_tables(spark, sf)
    return rounded(predict.nearby_summary(rows, asked, widest, "l_quantity", "s_suppkey"), 4)


SNAP_SQL = """old AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * (1 + 1e-6) ELSE o_totalprice END AS p, o_custkey AS c FROM orders WHERE o_totalprice >= 5000.0),
new AS (SELECT o_orderkey AS k, o_totalprice AS p, o_custkey AS c FROM orders WHERE o_totalprice <= 490000.0)"""


@query(f"""
WITH {SNAP_SQL}, j AS (SELECT new.k AS a, old.k AS b, abs(new.p - old.p) AS dp, abs(new.c - old.c) AS dc, old.p AS op, old.c AS oc FROM new FULL JOIN old ON new.k = old.k),
t AS (SELECT count(*) FILTER (WHERE a IS NULL) AS only_old, count(*) FILTER (WHERE b IS NULL) AS only_new FROM j)
SELECT 'p' AS "column", count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND NOT dp <= 1e-9 * abs(op) + 1e-12) AS n_different, round(max(dp), 6) AS max_difference, round(avg(dp), 6) AS mean_difference, round(median(dp), 6) AS median_difference,
  any_value(only_new) AS only_new, any_value(only_old) AS only_old FROM j, t
UNION ALL SELECT 'c', count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND NOT dc <= 1e-9 * abs(oc) + 1e-12), round(max(dc), 6), round(avg(dc), 6), round(median(dc), 6), any_value(only_new), any_value(only_old) FROM j, t
""")
def snapshot_compare(spark, sf):
    o = table(spark, sf, "orders")
    price = F.col("o_totalprice")
    old = o.filter(price >= 5000.0).select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderpriority") == "1-URGENT", price * (1 + 1e-6)).otherwise(price).alias("p"), F.col("o_custkey").alias("c"))
    new = o.filter(price <= 490000.0).select(F.col("o_orderkey").alias("k"), price.alias("p"), F.col("o_custkey").alias("c"))
    return rounded(joins.snapshot_compare(new, old, "k", ["p", "c"]))


@query("""
SELECT o.o_orderkey, coalesce(c_mktsegment, 'none') AS segment, c_acctbal > 0 AS qa_pass FROM orders o LEFT JOIN customer ON o_custkey = c_custkey
""")
def flags_join(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") > 0).alias("qa_pass"))
    return o.join(c, "o_custkey", "left").select("o_orderkey", F.coalesce("segment", F.lit("none")).alias("segment"), "qa_pass")


@query("""SELECT c_custkey, coalesce(n.n, 0) AS n_orders, true AS qa_pass FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) n ON o_custkey = c_custkey""")
def one_to_one_join(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    c = table(spark, sf, "customer").select("c_custkey")
    both = joins.one_to_one(c, n, "c_custkey", {}).withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))
    return joins.one_to_one(both, None, "c_custkey", {"qa_pass": F.lit(True)})


@query("""
WITH u AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_orderkey) AS n
  FROM orders WHERE o_totalprice > 10000.0)
SELECT o_custkey, o_orderkey, o_orderpriority, round(100.0 * (o_totalprice - 250000.0) / 250000.0, 6) AS Cl_err_pct, abs(100.0 * (o_totalprice - 250000.0) / 250000.0) <= 40.0 AS passed FROM u WHERE n = 1
""")
def priority_reference(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")
    best = joins.best_by_priority(o, ["o_custkey"], F.col("o_orderpriority"), ["3-MEDIUM", "1-URGENT"], F.col("o_totalprice") > 10000.0, ["o_orderkey"])
    judged = best.withColumns({"Cl_err_pct": percent_error(F.col("o_totalprice"), F.lit(250000.0)), "Cd_err_pct": F.lit(None).cast("double"), "Cl_tol": F.lit(40.0), "Cd_tol": F.lit(None).cast("double")})
    return rounded(tolerance_verdict(judged).select("o_custkey", "o_orderkey", "o_orderpriority", "Cl_err_pct", "passed"))


COMPARE_SQL = """
WITH s AS (SELECT c_custkey AS case_id, c_acctbal / 1000.0 + 2.0 AS m FROM customer),
r AS (SELECT o_custkey AS case_id, o_orderkey AS seq, CASE WHEN o_orderpriority = '1-URGENT' THEN 'experimental_primary' ELSE o_orderpriority END AS role, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 50000.0 END AS cl FROM orders),
c AS (SELECT s.case_id, seq, role, cl, m, 100.0 * (m - cl) / cl AS e FROM s JOIN r ON s.case_id = r.case_id WHERE cl IS NOT NULL)
"""


def comparisons(spark, sf) -> tuple[DataFrame, DataFrame]:
    stats = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), (F.col("c_acctbal") / 1000.0 + 2.0).alias("Cl_mean"), F.lit(None).cast("double").alias("Cd_mean"))
    refs = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("seq"),
                                             F.when(F.col("o_orderpriority") == "1-URGENT", compare.PRIMARY_ROLE).otherwise(F.col("o_orderpriority")).alias("role"), F.lit(None).cast("string").alias("label"),
                                             F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 50000.0).alias("Cl"), F.lit(None).cast("double").alias("Cd"))
    return stats, compare.compare_coefficients(stats, refs)


@query(COMPARE_SQL + """SELECT s.case_id, c.role AS ref_role, round(s.m, 6) AS Cl_mean, round(c.cl, 6) AS Cl_ref, round(e, 5) AS Cl_err_pct FROM s LEFT JOIN c ON s.case_id = c.case_id""")
def coefficient_comparison(spark, sf):
    stats, c = comparisons(spark, sf)
    out = compare.comparison_summary(stats, c)
    return out.select("case_id", "ref_role", r("Cl_mean").alias("Cl_mean"), r("Cl_ref").alias("Cl_ref"), r("Cl_err_pct", 5).alias("Cl_err_pct"))


@query(COMPARE_SQL + """, k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN role = 'experimental_primary' THEN 0 ELSE 1 END, seq) AS n FROM c)
SELECT case_id, role, seq, round(e, 5) AS Cl_err_pct, abs(e) <= 5.0 AS passed FROM k WHERE n = 1""")
def case_verdicts(spark, sf):
    v = compare.case_verdicts(comparisons(spark, sf)[1])
    return rounded(v.select("case_id", "role", "seq", "Cl_err_pct", "passed"), 5)


@query(f"""
WITH p AS (SELECT user_id, event_type, {MICROS_SQL} / 2592000000000.0 AS x, value AS y FROM events),
k AS (SELECT * FROM p WHERE x BETWEEN 0 AND 1), ok AS (SELECT user_id, event_type FROM k GROUP BY ALL HAVING count(*) >= 5),
g AS (SELECT user_id, event_type, CAST(0.02 AS DOUBLE) + i * (CAST(0.98 AS DOUBLE) - CAST(0.02 AS DOUBLE)) / 49 AS q, i FROM ok, range(50) r(i)),
l AS (SELECT g.*, k.x AS x0, k.y AS y0 FROM g ASOF LEFT JOIN k ON g.user_id = k.user_id AND g.event_type = k.event_type AND g.q >= k.x),
b AS (SELECT l.*, k.x AS x1, k.y AS y1 FROM l ASOF LEFT JOIN k ON l.user_id = k.user_id AND l.event_type = k.event_type AND l.q < k.x),
v AS (SELECT user_id, event_type, i, {BETWEEN_SQL} AS y FROM b),
d AS (SELECT o.user_id, o.event_type, o.y - v.y AS d FROM v o JOIN v ON o.user_id = v.user_id AND o.i = v.i AND v.event_type = 'view' AND o.event_type <> 'view')
SELECT user_id || '/' || event_type AS case_id, round(sqrt(avg(d * d)), 5) AS rms_delta, round(max(abs(d)), 5) AS max_abs_delta FROM d GROUP BY ALL
""")
def compare_curves(spark, sf):
    """The curve of each of a user's event types against the one of their views."""
    e = table(spark, sf, "events").select("user_id", "event_type", (micros(F.col("ts")) / 2592000000000.0).alias("x_c"), F.col("value").alias("Cp"))
    named = lambda df, kind: df.withColumn("case_id", F.concat_ws("/", F.col("user_id").cast("string"), kind)).select("case_id", "x_c", "Cp")
    views = e.filter(F.col("event_type") == "view")
    kinds = e.filter(F.col("event_type") != "view").select("user_id", F.col("event_type").alias("kind")).distinct()
    _, summary = compare.compare_curves(named(e.filter(F.col("event_type") != "view"), F.col("event_type")), named(views.join(kinds, "user_id"), F.col("kind")))
    return rounded(summary, 5)


@query("""
WITH k AS (SELECT s_nationkey AS nation, s_acctbal / 1000.0 AS x, min(s_suppkey * 0.01 + 1.0) AS y FROM supplier GROUP BY ALL),
q AS (SELECT c_custkey, c_nationkey AS nation, c_acctbal / 1000.0 AS q FROM customer WHERE c_acctbal / 1000.0 BETWEEN -5 AND 15),
l AS (SELECT q.*, k.x AS x0, k.y AS y0 FROM q ASOF LEFT JOIN k ON q.nation = k.nation AND q.q >= k.x), b AS (SELECT l.*, k.x AS x1, k.y AS y1 FROM l ASOF LEFT JOIN k ON l.nation = k.nation AND l.q < k.x),
v AS (SELECT c_custkey, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) / (x1 - x0) * (q - x0) END AS y FROM b)
SELECT c_custkey, round(y - 1.5, 6) AS dCl, round(100 * (2 * y - 3.0) / 3.0, 5) AS dCd_pct FROM v
""")
def reference_agreement(spark, sf):
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") / 1000.0).alias("alpha_deg")).agg(F.min(F.col("s_suppkey") * 0.01 + 1.0).alias("Cl"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") / 1000.0).alias("alpha_deg"), F.lit(1.5).alias("Cl_ref"), F.lit(3.0).alias("Cd_ref"))
    out = compare.reference_agreement(c, s.withColumn("Cd", 2 * F.col("Cl")), ["nation"])
    return out.select("c_custkey", r("dCl").alias("dCl"), r("dCd_pct", 5).alias("dCd_pct"))
