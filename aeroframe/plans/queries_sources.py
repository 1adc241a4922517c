"""Reader queries: text and logs that Spark writes out from the driver tables and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from aeroframe.functions import text
from aeroframe.operators import ordering, quality
from aeroframe.plans.queries_joins import MICROS_SQL, micros
from aeroframe.plans.registry import query, r, rounded, table
from aeroframe.sources import cases, lines, samples


def zone_lines(spark, sf):
    """One zone table per order: a comment, names, and a zone per return flag, spread over several blocks."""
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), "l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice")
    place = F.ascii("l_returnflag").cast("long") * 2
    heads = l.select("file", "l_returnflag").distinct().select("file", place.alias("block"), F.lit(1).cast("long").alias("seq"),
                                                                F.concat(F.lit('zone, t="flag '), F.col("l_returnflag"), F.lit(", alpha="), F.ascii("l_returnflag").cast("string"), F.lit('.5"')).alias("line"))
    top = l.select("file").distinct().select("file", F.lit(0).cast("long").alias("block"), F.posexplode(F.array(F.lit("# forces"), F.lit('variables="Quantity, deg","x/c"'))).alias("seq", "line"))
    rows = l.select("file", (place + F.when(F.col("l_linenumber") > 3, 1).otherwise(0)).alias("block"), (F.col("l_linenumber") + 1).cast("long").alias("seq"),
                    F.concat(F.lit("  "), F.col("l_quantity").cast("string"), F.lit("   "), F.col("l_extendedprice").cast("string")).alias("line"))
    return heads.unionByName(top.withColumn("seq", F.col("seq").cast("long"))).unionByName(rows)


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS file, 'flag ' || l_returnflag || ', alpha=' || ascii(l_returnflag) || '.5' AS zone, ascii(l_returnflag) + 0.5::DOUBLE AS alpha_deg, l_quantity AS quantity,
  l_extendedprice AS price, 'src' AS source FROM lineitem""")
def zone_forward_fill(spark, sf):
    z = lines.refuse_bad(lines.read_zones(zone_lines(spark, sf)))
    t = lines.zone_table(z, ["quantity", "price"], {"source": "src"})
    return t.select("file", F.regexp_replace("zone", '"', "").alias("zone"), text.alpha_in_title(F.col("zone")).alias("alpha_deg"), "quantity", "price", "source")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS file, count(*) AS n_rows, count(DISTINCT l_returnflag) AS n_zones, round(sum(l_quantity), 2) AS total, 'quantity_deg,x_c' AS names FROM lineitem GROUP BY l_orderkey""")
def zone_tolerant(spark, sf):
    ls = zone_lines(spark, sf)
    z = lines.read_zones(ls, strict=False)
    out = z.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("zone").alias("n_zones"), F.sum(F.get("values", F.lit(0))).alias("total"))
    return rounded(out.join(lines.zone_columns(ls).select("file", F.array_join("columns", ",").alias("names")), "file"), 2)


def solver_lines(spark, sf):
    """One solver log per user: sign-ups are time markers, other events are residual lines; blocks are days."""
    e = table(spark, sf, "events")
    us = micros(F.col("ts"))
    residual = F.concat(F.lit("smoothSolver:  Solving for "), F.col("event_type"), F.lit(", Initial residual = "), F.col("value").cast("string"), F.lit(", Final residual = 0.001, No Iterations 2"))
    line = F.when(F.col("event_type") == "signup", F.concat(F.lit("Time = "), F.col("event_id").cast("string"))).otherwise(residual)
    return e.select(F.col("user_id").cast("string").alias("file"), F.floor(us / 86400000000).alias("block"), us.alias("seq"), line.alias("line"))


STEPS_SQL = f"""
WITH k AS (SELECT user_id, {MICROS_SQL} AS us, event_type, value, event_type = 'signup' AS m FROM events),
p AS (SELECT *, lag(m) OVER (PARTITION BY user_id ORDER BY us) AS pm FROM k),
t AS (SELECT *, sum(CASE WHEN NOT m AND coalesce(pm, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS step FROM p),
h AS (SELECT CAST(user_id AS VARCHAR) AS file, CAST(step AS BIGINT) AS step, event_type AS field, min_by(value, us) AS value FROM t WHERE NOT m GROUP BY ALL)
"""


@query(STEPS_SQL + """SELECT file, step, max(CASE WHEN field = 'click' THEN value END) AS click, max(CASE WHEN field = 'error' THEN value END) AS error, max(CASE WHEN field = 'purchase' THEN value END) AS purchase,
  max(CASE WHEN field = 'view' THEN value END) AS view FROM h GROUP BY file, step""")
def sessionise_marker(spark, sf):
    return lines.widen_steps(lines.residual_history(solver_lines(spark, sf)), ["click", "error", "purchase", "view"])


@query(STEPS_SQL + """, m AS (SELECT file, max(step) AS s FROM h GROUP BY file) SELECT h.file, count(*) AS n_fields, round(sum(value), 4) AS total FROM h JOIN m ON h.file = m.file AND h.step = m.s GROUP BY h.file""")
def final_residuals(spark, sf):
    f = lines.final_residuals(lines.residual_history(solver_lines(spark, sf)))
    return f.select("file", F.size("residuals_final").cast("bigint").alias("n_fields"), r(F.aggregate(F.map_values("residuals_final"), F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query(f"""
WITH k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY {MICROS_SQL} DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events)
SELECT event_type, max(c) AS n_iters, count(*) AS n_window, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std,
  CASE WHEN max(c) < 50 THEN 'too few force rows for a tail' END AS error FROM k WHERE n <= 200 GROUP BY event_type
""")
def tail_window_stats(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", "value", micros(F.col("ts")).alias("us"))
    return rounded(lines.tail_stats(e, ["event_type"], order=[F.desc("us"), F.desc("event_id")], values=["value"]))


@query("""
WITH u AS (SELECT user_id, substr('ABCD', CAST(user_id % 4 AS INT) + 1, 1) AS regime, count(*) * 15 AS n, stddev_samp(value) / 8000.0 AS cs, stddev_samp(value) / 9000.0 AS ds,
  CASE WHEN count(*) < 70 THEN avg(value) / 1.5 END AS y, bool_or(value > 450.0) AS fatal FROM events GROUP BY user_id),
l AS (SELECT *, CASE WHEN regime IN ('A', 'D') THEN 800 ELSE 1500 END AS mr, CASE WHEN regime = 'B' THEN 0.010 ELSE 0.005 END AS ct, CASE regime WHEN 'A' THEN 30.0 WHEN 'D' THEN 50.0 ELSE 0.5 END AS yt FROM u),
r AS (SELECT user_id, regime, CASE WHEN fatal THEN 'fatal error in solver log' WHEN n < mr THEN 'too few force rows' WHEN cs >= ct THEN 'lift not settled' WHEN ds >= ct THEN 'drag not settled'
  WHEN y IS NULL THEN 'y+ missing' WHEN abs(y - yt) > 0.5 * yt THEN 'y+ outside half of its target' ELSE 'converged' END AS reason FROM l)
SELECT user_id, regime, reason, reason = 'converged' AS converged, reason = 'converged' OR regime = 'C' AS include FROM r
""")
def convergence_gate(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg((F.count(F.lit(1)) * 15).alias("n_iters"), (F.stddev_samp("value") / 8000.0).alias("Cl_std"), (F.stddev_samp("value") / 9000.0).alias("Cd_std"),
                                                          F.when(F.count(F.lit(1)) < 70, F.avg("value") / 1.5).alias("y_plus_mean"), F.bool_or(F.col("value") > 450.0).alias("fatal"))
    e = e.withColumn("regime", F.substring(F.lit("ABCD"), (F.col("user_id") % 4 + 1).cast("int"), F.lit(1))).withColumn("y_plus_target", F.lit(None).cast("double"))
    return quality.convergence(e, ["C"]).select("user_id", "regime", "reason", "converged", "include")


#: Parts whose logs one task writes: each has eight lines.
DEALT = 10_000


def check_lines(spark, sf):
    """One mesh-check log per part. Parts are dealt out before they have lines: the table may be one file split, and its lines are sorted by file in the task that makes them."""
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    p = p.repartition(max(spark.sparkContext.defaultParallelism, -(-p.count() // DEALT)), "p_partkey")
    s = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    body = F.concat_ws("\n", F.lit("Mesh stats"), F.concat(F.lit("    points:           "), s(F.col("p_size") * 7)), F.concat(F.lit("    cells:            "), s(F.col("p_size") * 10)),
                       F.lit("Overall number of cells of each type:"), F.concat(F.lit("    hexahedra:     "), s(F.col("p_size") * 10 - F.when(F.col("p_size") > 40, 1).otherwise(0))),
                       F.concat(F.lit("    Max aspect ratio= "), s(F.col("p_retailprice") / 2), F.lit(" OK.")), F.concat(F.lit("    Mesh non-orthogonality Max: "), s(F.col("p_size") * 1.5), F.lit(" average: 5")),
                       F.concat(F.lit("    Max skewness = "), s(F.col("p_size") / 10.0), F.lit(" OK.")))
    return lines.lines_of(p.select(s("p_partkey").alias("file"), body.alias("body")), "file", "body")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS file, round(p_size * 1.5, 6)::DOUBLE AS max_non_orthogonality, round(p_size / 10.0, 6) AS max_skewness, round(p_retailprice / 2, 6) AS max_aspect_ratio,
  p_size * 10.0::DOUBLE AS cells_total, p_size * 7.0::DOUBLE AS points_total, round((p_size * 10 - CASE WHEN p_size > 40 THEN 1 ELSE 0 END) / (p_size * 10.0), 6) AS hex_fraction,
  concat_ws(',', CASE WHEN p_size * 1.5 >= 70 THEN 'non-orthogonality' END, CASE WHEN p_size / 10.0 >= 4.5 THEN 'skewness' END, CASE WHEN p_retailprice / 2 >= 500.0 THEN 'aspect ratio' END,
    CASE WHEN p_size > 40 AND 1 - 1 / (p_size * 10.0) < 0.999 THEN 'hex fraction' END) AS errors,
  concat_ws(',', CASE WHEN p_size * 10 < 50 THEN 'cells below target' END, CASE WHEN p_size * 10 > 450 THEN 'cells above target' END) AS advisories FROM part""")
def mesh_check_logs(spark, sf):
    m = quality.mesh_quality(lines.mesh_metrics(check_lines(spark, sf)), {"non_orthogonality_max": 70.0, "skewness_max": 4.5, "aspect_ratio_max": 500.0, "target_cells_min": 50, "target_cells_max": 450})
    return rounded(m.select("file", "max_non_orthogonality", "max_skewness", "max_aspect_ratio", "cells_total", "points_total", "hex_fraction", F.array_join("errors", ",").alias("errors"),
                            F.array_join("advisories", ",").alias("advisories")))


@query(r"""SELECT page_id, CAST(nullif(regexp_extract(html, 'track\((\d+)\)', 1), '') AS DOUBLE) AS first_number, len(regexp_extract_all(html, '<a ')) AS n_links, contains(html, 'FOAM FATAL ERROR') AS fatal FROM pages""")
def log_metric_extract(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", text.metric(F.col("html"), r"track\((\d+)\)").alias("first_number"), F.regexp_count("html", F.lit("<a ")).cast("bigint").alias("n_links"), F.contains("html", F.lit(lines.FATAL)).alias("fatal"))


@query("""SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events""")
def json_flatten(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "k BIGINT").alias("mesh"))
    return cases.mesh_records(e, "event_id")


@query("""WITH e AS (SELECT doc_id FROM documents UNION ALL SELECT item_id + 1000000000 FROM benchmark)
SELECT e.doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size, CASE WHEN text IS NULL THEN 'missing' ELSE 'present' END AS status FROM e LEFT JOIN documents d ON d.doc_id = e.doc_id""")
def content_manifest(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    expected = d.select("doc_id").unionByName(table(spark, sf, "benchmark").select((F.col("item_id") + 1000000000).alias("doc_id")))
    return cases.content_manifest(expected, d, "doc_id", "text").select("doc_id", "sha256", "size", "status")


@query("""WITH i AS (SELECT s_suppkey, s_suppkey AS a, s_suppkey + (s_nationkey % 5) - 1 AS b FROM supplier) SELECT DISTINCT unnest(range(a, b + 1)) AS case_number FROM i WHERE a <= b""")
def id_ranges(spark, sf):
    s = table(spark, sf, "supplier")
    items = s.select(F.concat(F.col("s_suppkey").cast("string"), F.lit("-"), (F.col("s_suppkey") + F.col("s_nationkey") % 5 - 1).cast("string")).alias("item"))
    return rounded(cases.expand_ids(items)[0])


@query("""WITH i AS (SELECT s_suppkey AS a, s_suppkey + (s_nationkey % 5) - 1 AS b FROM supplier) SELECT a || '-' || b AS item, CASE WHEN b < 0 THEN 'not an id or a range' ELSE 'start must be <= end' END AS error FROM i WHERE a > b""")
def id_range_errors(spark, sf):
    s = table(spark, sf, "supplier")
    items = s.select(F.concat(F.col("s_suppkey").cast("string"), F.lit("-"), (F.col("s_suppkey") + F.col("s_nationkey") % 5 - 1).cast("string")).alias("item"))
    return cases.expand_ids(items)[1]


@query("""SELECT o_orderkey, row_number() OVER () - 1 AS sample_id FROM orders""")
def global_row_index(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return samples.global_row_index(o)


@query(f"""SELECT user_id, event_id, CAST(sum(value) OVER w * 100 AS BIGINT) AS running, row_number() OVER w AS n, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS last_signup
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY {MICROS_SQL}, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_windows(spark, sf):
    """Prefix sums, row numbers and forward fill per user, carried across day blocks."""
    us = micros(F.col("ts"))
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", us.alias("us"), F.floor(us / 86400000000).alias("day"))
    order = ["us", "event_id"]
    out = ordering.running_sum(e, ["user_id"], "day", order, F.round(F.col("value") * 100).cast("long"), "running")
    out = ordering.row_numbers(out, ["user_id"], "day", order, "n")
    out = ordering.forward_fill(out, ["user_id"], "day", order, F.when(F.col("event_type") == "signup", F.col("event_id")), "last_signup")
    return rounded(out.select("user_id", "event_id", "running", "n", "last_signup"))
