"""Mesh, wall and section queries.

Every supplier gets a mesh that Spark derives from its row: rings of triangles between an elliptic body and
the clip box, with polynomial fields.  The number of meshes grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.functions.physics import reynolds
from aeroframe.operators import catalogue, quality, section, topology, wallflow
from aeroframe.plans import ingest as ingest_plan
from aeroframe.plans.registry import query, r, rounded, table

AROUND, RINGS = 24, 5
#: Samples whose meshes one task makes: a row of a few bytes becomes hundreds of nodes and triangles.
DEALT = 500

MESH_SQL = f"""
WITH sup AS (SELECT s_suppkey AS sample_id, 0.06 + s_nationkey * 0.002 AS h, s_acctbal / 10000.0 AS b FROM supplier),
ring AS (SELECT i, j, cos(2 * pi() * i / {AROUND}) AS c, sin(2 * pi() * i / {AROUND}) AS s, (j / {RINGS - 1}.0) * (j / {RINGS - 1}.0) AS w FROM range({AROUND}) a(i), range({RINGS}) d(j)),
place AS (SELECT sample_id, j * {AROUND} + i AS node_id, b, CAST(w AS DOUBLE) AS w, (1 - w) * (0.5 + 0.5 * c) + w * (1.0 + 3.0 * (c / greatest(abs(c), abs(s)))) AS x,
  (1 - w) * h * s + w * 1.5 * (s / greatest(abs(c), abs(s))) AS y FROM sup, ring),
nodes AS (SELECT *, x * x - y + b AS p, y * (1.0 + b) + 0.2 * x * x AS ux, 0.3 * x * y AS uy FROM place),
cell AS (SELECT sample_id, i, j, j * {AROUND} + i AS a, j * {AROUND} + (i + 1) % {AROUND} AS e, (j + 1) * {AROUND} + i AS c, (j + 1) * {AROUND} + (i + 1) % {AROUND} AS d
  FROM sup, range({AROUND}) q(i), range({RINGS - 1}) t(j)),
tri AS (SELECT sample_id, a * 2 AS tri_id, a AS n0, e AS n1, d AS n2 FROM cell UNION ALL SELECT sample_id, a * 2 + 1, a, d, c FROM cell)
"""


def samples(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("sample_id"), (0.06 + F.col("s_nationkey") * 0.002).alias("h"), (F.col("s_acctbal") / 10000.0).alias("b"),
                    (F.col("s_acctbal") / 100000.0 + 0.05).alias("alpha_rad"), (40.0 + F.col("s_nationkey")).alias("u_inf")) \
        .withColumn("cl", F.col("b") * 2.0).withColumn("cd", F.col("b") * F.col("b") + 0.01)


def meshes(spark, sf, around: int = AROUND, rings: int = RINGS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, nodes, triangles) of every supplier; samples are dealt out before their meshes are made, as the table may be one file split."""
    sup = samples(spark, sf)
    sup = sup.repartition(max(spark.sparkContext.defaultParallelism, -(-sup.count() // DEALT)), "sample_id")
    at = sup.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(rings - 1)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(around - 1))))
    c, s = F.cos(2 * F.pi() * F.col("i") / around), F.sin(2 * F.pi() * F.col("i") / around)
    edge = F.greatest(F.abs(c), F.abs(s))
    w = (F.col("j") / float(rings - 1)) * (F.col("j") / float(rings - 1))
    placed = at.withColumn("w", w).select("sample_id", (F.col("j") * around + F.col("i")).cast("long").alias("node_id"), "b", F.col("w").alias("implicit_distance"),
                                          ((1 - F.col("w")) * (0.5 + 0.5 * c) + F.col("w") * (1.0 + 3.0 * (c / edge))).alias("x"),
                                          ((1 - F.col("w")) * F.col("h") * s + F.col("w") * 1.5 * (s / edge)).alias("y"))
    x, y = F.col("x"), F.col("y")
    nodes = placed.select("sample_id", "node_id", "x", "y", "implicit_distance", (x * x - y + F.col("b")).alias("p"), (y * (1.0 + F.col("b")) + 0.2 * x * x).alias("ux"),
                          (0.3 * x * y).alias("uy"), F.lit(0.0).alias("nut"))
    cell = sup.select("sample_id").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(rings - 2)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(around - 1))))
    right = (F.col("i") + 1) % around
    a, e = F.col("j") * around + F.col("i"), F.col("j") * around + right
    low, d = (F.col("j") + 1) * around + F.col("i"), (F.col("j") + 1) * around + right
    two = F.array(F.struct((a * 2).alias("tri_id"), a.alias("n0"), e.alias("n1"), d.alias("n2")), F.struct((a * 2 + 1).alias("tri_id"), a.alias("n0"), d.alias("n1"), low.alias("n2")))
    tri = cell.select("sample_id", F.explode(two).alias("t")).select("sample_id", *[F.col(f"t.{k}").cast("long").alias(k) for k in ("tri_id", "n0", "n1", "n2")])
    return sup, nodes, tri


def parts(spark, sf) -> DataFrame:
    """Parts, dealt out before their sections are made: the table may be one file split."""
    p = table(spark, sf, "part").select("p_partkey")
    return p.repartition(max(spark.sparkContext.defaultParallelism, -(-p.count() // (100 * DEALT))), "p_partkey")


def wall_ids(spark, sf) -> DataFrame:
    """Wall nodes of the derived meshes by their rule (the inner ring), for queries that start from a wall."""
    _, nodes, _ = meshes(spark, sf)
    return nodes.filter(F.col("node_id") < AROUND).withColumn("pos", F.col("node_id").cast("int"))


EDGES_SQL = MESH_SQL + """, e AS (SELECT sample_id, least(n0, n1) AS a, greatest(n0, n1) AS b FROM tri UNION ALL SELECT sample_id, least(n1, n2), greatest(n1, n2) FROM tri
  UNION ALL SELECT sample_id, least(n2, n0), greatest(n2, n0) FROM tri),
edge AS (SELECT sample_id, a, b FROM e GROUP BY ALL HAVING count(*) = 1)"""
WALL_SQL = EDGES_SQL + """, box AS (SELECT sample_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM nodes GROUP BY sample_id),
onb AS (SELECT n.sample_id, node_id FROM nodes n JOIN box USING (sample_id) WHERE abs(x - x0) <= 1e-9 + 1e-5 * abs(x0) OR abs(x - x1) <= 1e-9 + 1e-5 * abs(x1)
  OR abs(y - y0) <= 1e-9 + 1e-5 * abs(y0) OR abs(y - y1) <= 1e-9 + 1e-5 * abs(y1)),
wedge AS (SELECT * FROM edge g WHERE NOT EXISTS (SELECT 1 FROM onb o WHERE o.sample_id = g.sample_id AND o.node_id IN (g.a, g.b))),
wnode AS (SELECT sample_id, a AS node_id FROM wedge UNION SELECT sample_id, b FROM wedge)"""


@query(EDGES_SQL + "SELECT * FROM edge")
def boundary_edges(spark, sf):
    return topology.boundary_edges(meshes(spark, sf)[2])


@query(WALL_SQL + "SELECT * FROM wedge")
def wall_edges(spark, sf):
    _, nodes, tri = meshes(spark, sf)
    return topology.wall_edges(nodes, tri)


@query(WALL_SQL + "SELECT n.sample_id, n.node_id, w.node_id IS NOT NULL AS on_wall FROM nodes n LEFT JOIN wnode w ON n.sample_id = w.sample_id AND n.node_id = w.node_id")
def wall_mask(spark, sf):
    _, nodes, tri = meshes(spark, sf)
    return topology.wall_node_mask(nodes.select("sample_id", "node_id", "x", "y"), topology.wall_edges(nodes, tri)).select("sample_id", "node_id", "on_wall")


@query(f"SELECT s_suppkey AS sample_id, i AS pos, i AS node_id, CAST({AROUND} AS BIGINT) AS n_nodes, CAST({AROUND} AS BIGINT) AS n_visited FROM supplier, range({AROUND}) t(i)")
def loop_chain(spark, sf):
    _, nodes, tri = meshes(spark, sf)
    return rounded(topology.chain_loops(topology.wall_edges(nodes, tri)))


GRAD_SQL = MESH_SQL + f""", corner AS (SELECT t.sample_id, t.tri_id, t.n0, t.n1, t.n2, (b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y) AS ta,
  a.ux * (b.y - c.y) + b.ux * (c.y - a.y) + c.ux * (a.y - b.y) AS uxx, a.ux * (c.x - b.x) + b.ux * (a.x - c.x) + c.ux * (b.x - a.x) AS uxy,
  a.uy * (b.y - c.y) + b.uy * (c.y - a.y) + c.uy * (a.y - b.y) AS uyx, a.uy * (c.x - b.x) + b.uy * (a.x - c.x) + c.uy * (b.x - a.x) AS uyy
  FROM tri t JOIN nodes a ON a.sample_id = t.sample_id AND a.node_id = t.n0 JOIN nodes b ON b.sample_id = t.sample_id AND b.node_id = t.n1
  JOIN nodes c ON c.sample_id = t.sample_id AND c.node_id = t.n2),
inc AS (SELECT *, unnest([n0, n1, n2]) AS node_id FROM corner),
grad AS (SELECT sample_id, node_id, sum(uxx / ta * abs(ta)) / sum(abs(ta)) AS dux_dx, sum(uxy / ta * abs(ta)) / sum(abs(ta)) AS dux_dy, sum(uyx / ta * abs(ta)) / sum(abs(ta)) AS duy_dx,
  sum(uyy / ta * abs(ta)) / sum(abs(ta)) AS duy_dy FROM inc WHERE node_id < {AROUND} GROUP BY sample_id, node_id)"""


@query(GRAD_SQL + "SELECT sample_id, node_id, round(dux_dx, 5) + 0.0 AS dux_dx, round(dux_dy, 5) + 0.0 AS dux_dy, round(duy_dx, 5) + 0.0 AS duy_dx, round(duy_dy, 5) + 0.0 AS duy_dy FROM grad")
def wall_gradients(spark, sf):
    _, nodes, tri = meshes(spark, sf)
    return rounded(wallflow.wall_gradients(nodes, tri, wall_ids(spark, sf)), 5)


LOOP_SQL = GRAD_SQL + f""", nx AS (SELECT n.*, coalesce(lead(x) OVER w, first_value(x) OVER w) AS xn, coalesce(lead(y) OVER w, first_value(y) OVER w) AS yn,
  coalesce(lead(p) OVER w, first_value(p) OVER w) AS pn FROM nodes n WHERE node_id < {AROUND} WINDOW w AS (PARTITION BY sample_id ORDER BY node_id)),
seg AS (SELECT *, CASE WHEN sum(x * yn - xn * y) OVER (PARTITION BY sample_id) < 0 THEN -1.0 ELSE 1.0 END AS sg, sqrt((xn - x) * (xn - x) + (yn - y) * (yn - y)) AS len FROM nx),
nor AS (SELECT *, sg * (yn - y) + coalesce(lag(sg * (yn - y)) OVER v, last_value(sg * (yn - y)) OVER v) AS mx, -sg * (xn - x) + coalesce(lag(-sg * (xn - x)) OVER v, last_value(-sg * (xn - x)) OVER v) AS my
  FROM seg WINDOW v AS (PARTITION BY sample_id ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
unit AS (SELECT *, mx / sqrt(mx * mx + my * my) AS normal_x, my / sqrt(mx * mx + my * my) AS normal_y FROM nor),
stress AS (SELECT u.*, 2 * 1.56e-5 * ((dux_dx - (dux_dx + duy_dy) / 3) * normal_x + (dux_dy + duy_dx) / 2 * normal_y) AS tau_x,
  2 * 1.56e-5 * ((dux_dy + duy_dx) / 2 * normal_x + (duy_dy - (dux_dx + duy_dy) / 3) * normal_y) AS tau_y FROM unit u JOIN grad USING (sample_id, node_id))"""


@query(LOOP_SQL + "SELECT sample_id, round(sum(x * yn - xn * y) / 2, 6) AS area FROM nx GROUP BY sample_id")
def loop_area(spark, sf):
    return rounded(wallflow.signed_area(wall_ids(spark, sf)))


@query(LOOP_SQL + "SELECT sample_id, node_id, round(normal_x, 5) + 0.0 AS normal_x, round(normal_y, 5) + 0.0 AS normal_y FROM unit")
def loop_normals(spark, sf):
    return rounded(wallflow.loop_normals(wall_ids(spark, sf)).select("sample_id", "node_id", "normal_x", "normal_y"), 5)


@query(LOOP_SQL + "SELECT sample_id, node_id, round(tau_x * 1e5, 5) + 0.0 AS tau_x, round(tau_y * 1e5, 5) + 0.0 AS tau_y FROM stress")
def wall_shear(spark, sf):
    _, nodes, tri = meshes(spark, sf)
    s = wallflow.wall_stress(nodes, tri, wall_ids(spark, sf).select("sample_id", "pos", "node_id", "x", "y", "p"))
    return s.select("sample_id", "node_id", r(F.col("tau_x") * 1e5, 5).alias("tau_x"), r(F.col("tau_y") * 1e5, 5).alias("tau_y"))


@query(LOOP_SQL + """, nt AS (SELECT *, coalesce(lead(tau_x) OVER w, first_value(tau_x) OVER w) AS txn, coalesce(lead(tau_y) OVER w, first_value(tau_y) OVER w) AS tyn FROM stress
  WINDOW w AS (PARTITION BY sample_id ORDER BY node_id)),
f AS (SELECT sample_id, sum(-(p + pn) / 2 * sg * (yn - y)) AS px, sum((p + pn) / 2 * sg * (xn - x)) AS py, sum((tau_x + txn) / 2 * len) AS tx, sum((tau_y + tyn) / 2 * len) AS ty FROM nt GROUP BY sample_id),
a AS (SELECT f.*, s_acctbal / 100000.0 + 0.05 AS al, 40.0 + s_nationkey AS u FROM f JOIN supplier ON s_suppkey = sample_id)
SELECT sample_id, round(2 * (cos(al) * px + sin(al) * py) / (u * u) * 1e4, 5) + 0.0 AS Cd_int_p, round(2 * (cos(al) * py - sin(al) * px) / (u * u) * 1e4, 5) + 0.0 AS Cl_int_p,
  round(2 * (cos(al) * tx + sin(al) * ty) / (u * u) * 1e9, 4) + 0.0 AS Cd_int_tau, round(2 * (cos(al) * ty - sin(al) * tx) / (u * u) * 1e9, 4) + 0.0 AS Cl_int_tau FROM a""")
def wall_forces(spark, sf):
    sup, nodes, tri = meshes(spark, sf)
    s = wallflow.wall_stress(nodes, tri, wall_ids(spark, sf).select("sample_id", "pos", "node_id", "x", "y", "p"))
    f = wallflow.integrate_forces(s, sup)
    return f.select("sample_id", r(F.col("Cd_int_p") * 1e4, 5).alias("Cd_int_p"), r(F.col("Cl_int_p") * 1e4, 5).alias("Cl_int_p"), r(F.col("Cd_int_tau") * 1e9, 4).alias("Cd_int_tau"),
                    r(F.col("Cl_int_tau") * 1e9, 4).alias("Cl_int_tau"))


@query(MESH_SQL + """SELECT n.sample_id, n_nodes, x_min, x_max, y_min, y_max, n_triangles, true AS triangles_only FROM (SELECT sample_id, count(*) AS n_nodes, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max,
  round(min(y), 6) AS y_min, round(max(y), 6) AS y_max FROM nodes GROUP BY sample_id) n JOIN (SELECT sample_id, count(*) AS n_triangles FROM tri GROUP BY sample_id) t USING (sample_id)""")
def schema_summary(spark, sf):
    _, nodes, tri = meshes(spark, sf)
    return rounded(quality.schema_summary(nodes, tri))


DETAIL_SQL = MESH_SQL + """, s AS (SELECT s_suppkey AS sample_id, 0.06 + s_nationkey * 0.002 AS h, s_acctbal / 10000.0 AS b, s_acctbal / 100000.0 + 0.05 AS alpha_rad, 40.0 + s_nationkey AS u_inf,
  s_acctbal / 10000.0 * 2.0 AS cl, s_acctbal / 10000.0 * (s_acctbal / 10000.0) + 0.01 AS cd FROM supplier),
f AS (SELECT sample_id, node_id, x, y, w AS implicit_distance, p, ux, uy, 0.0 AS nut FROM nodes)"""


@query(DETAIL_SQL + """, t AS (SELECT * FROM s ORDER BY sample_id LIMIT 3),
u AS (SELECT 'scalar' AS kind, name, sample_id, v AS lo, v AS hi FROM (SELECT sample_id, h::DOUBLE AS h, b::DOUBLE AS b, alpha_rad::DOUBLE AS alpha_rad, u_inf::DOUBLE AS u_inf, cl::DOUBLE AS cl, cd::DOUBLE AS cd FROM t)
    UNPIVOT (v FOR name IN (h, b, alpha_rad, u_inf, cl, cd))
  UNION ALL SELECT 'field', name, sample_id, min(v), max(v) FROM (SELECT sample_id, x::DOUBLE AS x, y::DOUBLE AS y, implicit_distance::DOUBLE AS implicit_distance, p::DOUBLE AS p, ux::DOUBLE AS ux, uy::DOUBLE AS uy, nut::DOUBLE AS nut FROM f
    WHERE sample_id IN (SELECT sample_id FROM t)) UNPIVOT (v FOR name IN (x, y, implicit_distance, p, ux, uy, nut)) GROUP BY name, sample_id)
SELECT sample_id, kind, name, round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi, (SELECT count(*) FROM f WHERE f.sample_id = u.sample_id) AS n_nodes, (SELECT count(*) FROM tri WHERE tri.sample_id = u.sample_id) AS n_triangles FROM u""")
def sample_details(spark, sf):
    """Scalars and field ranges of the three meshes that come first."""
    out = rounded(quality.sample_details(*meshes(spark, sf)))
    return out.withColumns({c: F.col(c) + 0.0 for c in ("lo", "hi")})


@query(DETAIL_SQL + """SELECT 'scalar' AS kind, name, count(*) AS n_values FROM (SELECT h::DOUBLE AS h, b::DOUBLE AS b, alpha_rad::DOUBLE AS alpha_rad, u_inf::DOUBLE AS u_inf, cl::DOUBLE AS cl, cd::DOUBLE AS cd FROM s)
    UNPIVOT (v FOR name IN (h, b, alpha_rad, u_inf, cl, cd)) GROUP BY name
  UNION ALL SELECT 'field', name, count(*) FROM (SELECT x::DOUBLE AS x, y::DOUBLE AS y, implicit_distance::DOUBLE AS implicit_distance, p::DOUBLE AS p, ux::DOUBLE AS ux, uy::DOUBLE AS uy, nut::DOUBLE AS nut FROM f)
    UNPIVOT (v FOR name IN (x, y, implicit_distance, p, ux, uy, nut)) GROUP BY name""")
def name_sets(spark, sf):
    """Scalar and field names that any mesh has."""
    sup, nodes, _ = meshes(spark, sf)
    return quality.name_sets(sup, nodes)


@query("SELECT o_orderpriority AS task, o_orderstatus AS role, count(*) AS n, min(o_custkey) AS min_id, max(o_custkey) AS max_id FROM orders GROUP BY ALL")
def split_sizes(spark, sf):
    """Size and id range of every split."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("role"), F.col("o_custkey").alias("sample_id"))
    return quality.split_sizes(o)


@query("""
WITH g AS (SELECT count(*) = (SELECT count(*) FROM supplier) AS n, bool_and(abs(s_acctbal / 100000.0 + 0.05) < 1.0 AND s_acctbal / 100000.0 + 0.05 > -0.0873 - 1e-3 AND s_acctbal / 100000.0 + 0.05 < 0.2618 + 1e-3) AS a,
  bool_and((40.0 + s_nationkey) / (-3.400747e-6 + 3.452139e-8 * 298.15 + 1.00881778e-10 * 298.15 * 298.15 - 1.363528e-14 * 298.15 * 298.15 * 298.15) BETWEEN 1.9e6 AND 6.1e6) AS re FROM supplier)
SELECT 'required scalars present' AS label, true AS ok UNION ALL SELECT 'coefficients finite', true UNION ALL SELECT 'flow conditions finite', true UNION ALL SELECT 'angles are radians in range', a FROM g
UNION ALL SELECT 'Re in range', re FROM g UNION ALL SELECT 'wall found', false UNION ALL SELECT 'sample count', n FROM g UNION ALL SELECT 'flow fields present', true UNION ALL SELECT 'triangles only', true
""")
def inspection_gate(spark, sf):
    """The derived meshes have 24 wall nodes, so the wall check (50 or more) must fail."""
    sup, nodes, tri = meshes(spark, sf)
    rows = ingest_plan.inspection_rows(sup.select("sample_id", "alpha_rad", "u_inf", "cl", "cd"), nodes, tri)
    return quality.gate(rows, quality.inspection_checks(sup.count(), ["alpha_rad", "u_inf", "cl", "cd"], ["p", "ux", "uy", "nut"]))


@query("""
WITH c AS (SELECT p_partkey, lpad(CAST((p_partkey * 7) % 10000 AS VARCHAR), 4, '0') AS code FROM part),
d AS (SELECT *, CAST(code[1] AS INT) / 100.0 AS m, CAST(code[2] AS INT) / 10.0 AS p, CAST(code[3:4] AS INT) / 100.0 AS t FROM c),
g AS (SELECT *, 0.5 * (1.0 - cos(k * pi() / 10)) AS gx FROM d, range(11) r(k) WHERE (m = 0) = (p = 0) AND t > 0),
y AS (SELECT *, 5.0 * t * (0.2969 * sqrt(gx) - 0.1260 * gx - 0.3516 * gx * gx + 0.2843 * gx * gx * gx - 0.1036 * gx * gx * gx * gx) AS yt,
  CASE WHEN m = 0 THEN 0 WHEN gx < p THEN m / (p * p) * (2 * p * gx - gx * gx) ELSE m / ((1 - p) * (1 - p)) * (1 - 2 * p + 2 * p * gx - gx * gx) END AS yc,
  CASE WHEN m = 0 THEN 0 WHEN gx < p THEN 2 * m / (p * p) * (p - gx) ELSE 2 * m / ((1 - p) * (1 - p)) * (p - gx) END AS s FROM g)
SELECT p_partkey, code, 10 - k AS pos, round(gx - yt * sin(atan(s)), 7) + 0.0 AS x, round(yc + yt * cos(atan(s)), 7) + 0.0 AS y FROM y
UNION ALL SELECT p_partkey, code, 10 + k, round(gx + yt * sin(atan(s)), 7) + 0.0, round(yc - yt * cos(atan(s)), 7) + 0.0 FROM y WHERE k BETWEEN 1 AND 9
""")
def section_catalogue(spark, sf):
    p = parts(spark, sf).select("p_partkey", F.lpad(((F.col("p_partkey") * 7) % 10000).cast("string"), 4, "0").alias("code"))
    out = catalogue.section_coordinates(p, "code", 20).select("p_partkey", "code", "pos", "x", "y")
    return rounded(out, 7)


@query("""
WITH c AS (SELECT p_partkey, CASE WHEN p_size < 25 THEN lpad(CAST((p_partkey * 7) % 10000 AS VARCHAR), 4, '0') ELSE lpad(CAST((p_partkey * 13) % 100000 AS VARCHAR), 5, '0') END AS code FROM part)
SELECT p_partkey, code, CASE
  WHEN length(code) = 4 AND (code[1] = '0') <> (code[2] = '0') THEN 'camber and its position must both be zero or not'
  WHEN length(code) = 5 AND code[3] NOT IN ('0', '1') THEN 'third digit must be 0 or 1'
  WHEN length(code) = 5 AND code[1] > '0' AND code[2] = '0' THEN 'camber position digit must not be zero'
  WHEN length(code) = 5 AND code[1] > '0' AND code[3] = '1' AND code[2] NOT IN ('2', '3', '4', '5') THEN 'no reflexed mean line for this position digit'
  WHEN length(code) = 5 AND code[1] > '0' AND code[3] = '0' AND code[2] = '9' THEN 'no mean line for this position digit'
  WHEN right(code, 2) = '00' THEN 'thickness must be positive' END AS error FROM c
""")
def section_codes(spark, sf):
    key = F.col("p_partkey")
    code = F.when(F.col("p_size") < 25, F.lpad(((key * 7) % 10000).cast("string"), 4, "0")).otherwise(F.lpad(((key * 13) % 100000).cast("string"), 5, "0"))
    return table(spark, sf, "part").select("p_partkey", code.alias("code")).select("p_partkey", "code", catalogue.parse_code(F.col("code"))["error"].alias("error"))


@query("""
WITH s AS (SELECT p_partkey, 0.06 + p_size / 500.0 AS t, CASE WHEN p_size < 25 THEN 1.0 ELSE 0.9 END AS f FROM part),
g AS (SELECT *, 0.5 * (1.0 - cos(k * pi() / 9)) * f AS x FROM s, range(10) r(k)),
y AS (SELECT *, CASE WHEN f = 1.0 AND k = 9 THEN 0.0 ELSE 5.0 * t * (0.2969 * sqrt(x) - 0.1260 * x - 0.3516 * x * x + 0.2843 * x * x * x - CASE WHEN f = 1.0 THEN 0.1036 ELSE 0.1015 END * x * x * x * x) END AS yt FROM g)
SELECT p_partkey, 9 - k AS pos, round(x, 7) AS x, round(yt, 7) AS y FROM y UNION ALL SELECT p_partkey, 9 + k, round(x, 7), round(-yt, 7) + 0.0 FROM y WHERE k > 0
""")
def symmetric_sections(spark, sf):
    s = table(spark, sf, "part").select("p_partkey", (0.06 + F.col("p_size") / 500.0).alias("thickness"), F.when(F.col("p_size") < 25, 1.0).otherwise(0.9).alias("te_chord_fraction"))
    return rounded(catalogue.symmetric_section(s, n=10).select("p_partkey", "pos", "x", "y"), 7)


@query()
def section_features(spark, sf):
    """Features of every part's section, read from its generated loop once per code; a part with a refused code keeps its row with the error."""
    from aeroframe.operators.predict import catalogue_features
    p = parts(spark, sf).select("p_partkey", F.lpad(((F.col("p_partkey") * 7) % 10000).cast("string"), 4, "0").alias("code"))
    read = catalogue_features(p)
    return rounded(p.join(read, "code", "left").select("p_partkey", *read.columns))


@query()
def ingest_dataset(spark, sf):
    """Meshes of all suppliers to the 17-column dataset."""
    sup, nodes, tri = meshes(spark, sf, 64, 6)
    return rounded(ingest_plan.ingest(sup.select("sample_id", "alpha_rad", "u_inf", "cl", "cd"), nodes, tri).dataset)


TRUTH_SQL = """
WITH s AS (SELECT s_suppkey AS sample_id, 0.06 + s_nationkey * 0.002 AS h, s_acctbal / 10000.0 AS b, s_acctbal / 100000.0 + 0.05 AS al, 40.0 + s_nationkey AS u FROM supplier),
w AS (SELECT s.*, i, 0.5 + 0.5 * cos(2 * pi() * i / 64) AS x, h * sin(2 * pi() * i / 64) AS y FROM s, range(64) t(i)),
p AS (SELECT *, x * x - y + b AS p FROM w),
n AS (SELECT *, coalesce(lead(x) OVER o, first_value(x) OVER o) AS xn, coalesce(lead(y) OVER o, first_value(y) OVER o) AS yn, coalesce(lead(p) OVER o, first_value(p) OVER o) AS pn FROM p WINDOW o AS (PARTITION BY sample_id ORDER BY i)),
f AS (SELECT sample_id, sum(-(p + pn) / 2 * (yn - y)) AS fx, sum((p + pn) / 2 * (xn - x)) AS fy FROM n GROUP BY sample_id)
SELECT sample_id, round(degrees(al), 6) AS alpha_deg, CAST(u AS DOUBLE) AS U_inf, round(CAST(2 * h AS DOUBLE), 3) AS t_max, CAST(0.5 AS DOUBLE) AS x_tmax, true AS no_camber, CAST(64 AS BIGINT) AS n_wall_nodes,
  round(CAST(2 * b AS DOUBLE), 6) AS Cl, round(CAST(b * b + 0.01 AS DOUBLE), 6) AS Cd, round(2 * (cos(al) * fx + sin(al) * fy) / (u * u) * 1e4, 5) + 0.0 AS Cd_int_p, round(2 * (cos(al) * fy - sin(al) * fx) / (u * u) * 1e4, 5) + 0.0 AS Cl_int_p FROM s JOIN f USING (sample_id)"""


@query(TRUTH_SQL)
def ingest_truth(spark, sf):
    """The ingest of all suppliers' meshes against what their elliptic bodies are: thickness 2h at mid chord, no camber, forces of a polygon of 64 sides."""
    sup, nodes, tri = meshes(spark, sf, 64, 6)
    d = ingest_plan.ingest(sup.select("sample_id", "alpha_rad", "u_inf", "cl", "cd"), nodes, tri).dataset
    return d.select("sample_id", r("alpha_deg").alias("alpha_deg"), "U_inf", r("t_max", 3).alias("t_max"), r("x_tmax", 2).alias("x_tmax"), (F.abs("m_max") < 1e-3).alias("no_camber"),
                    F.col("n_wall_nodes").cast("bigint").alias("n_wall_nodes"), r("Cl").alias("Cl"), r("Cd").alias("Cd"), (r(F.col("Cd_int_p") * 1e4, 5) + 0.0).alias("Cd_int_p"), (r(F.col("Cl_int_p") * 1e4, 5) + 0.0).alias("Cl_int_p"))


@query()
def ingest_curves(spark, sf):
    """Meshes of all suppliers to wall curves on the station grid."""
    sup, nodes, tri = meshes(spark, sf, 64, 6)
    return rounded(ingest_plan.ingest(sup.select("sample_id", "alpha_rad", "u_inf", "cl", "cd"), nodes, tri).curves)


@query("""SELECT s_suppkey AS sample_id, round(degrees(s_acctbal / 100000.0 + 0.05), 6) AS alpha_deg, CAST(40.0 + s_nationkey AS DOUBLE) AS U_inf,
  round((40.0 + s_nationkey) / (-3.400747e-6 + 3.452139e-8 * 298.15 + 1.00881778e-10 * 298.15 * 298.15 - 1.363528e-14 * 298.15 * 298.15 * 298.15), 1) AS Re,
  CAST(0.5 * (40.0 + s_nationkey) * (40.0 + s_nationkey) AS DOUBLE) AS q FROM supplier""")
def unit_columns(spark, sf):
    from aeroframe.functions.physics import dynamic_pressure
    s = samples(spark, sf)
    return s.select("sample_id", r(F.degrees("alpha_rad")).alias("alpha_deg"), F.col("u_inf").alias("U_inf"), r(reynolds(F.col("u_inf")), 1).alias("Re"), r(dynamic_pressure(F.col("u_inf"))).alias("q"))


@query()
def wall_frame(spark, sf):
    """Chord position, side and tangent of every wall node."""
    _, nodes, _ = meshes(spark, sf, 64, 2)
    loop = nodes.filter(F.col("node_id") < 64).withColumn("pos", F.col("node_id").cast("int"))
    return rounded(section.wall_frame(section.section_frame(loop.select("sample_id", "pos", "node_id", "x", "y"))))
