import numpy as np
import pandas as pd
import pytest
from helpers import code_loops, ring_mesh, strip_mesh
from pyspark.sql import functions as F

from aeroframe.operators import section, topology, wallflow


def test_boundary_edges_of_strip(spark):
    nodes, tri, ids = strip_mesh()
    got = topology.boundary_edges(spark.createDataFrame(tri)).count()
    assert got == 2 * (20 + 5)


def test_ring_wall_is_inner_loop(spark):
    n1, t1 = ring_mesh(0)
    n2, t2 = ring_mesh(7, around=32, layers=3)
    nodes, tri = spark.createDataFrame(pd.concat([n1, n2])), spark.createDataFrame(pd.concat([t1, t2]))
    loop, errors = topology.wall_loops(nodes, tri)
    assert errors.count() == 0
    got = loop.orderBy("sample_id", "pos").toPandas()
    for sid, around in ((0, 24), (7, 32)):
        order = got[got.sample_id == sid].node_id.to_numpy()
        assert sorted(order) == list(range(around))
        assert order[0] == 0 and order[1] == 1
        assert set(np.abs(np.diff(order))) == {1}
    mask = topology.wall_node_mask(nodes, topology.wall_edges(nodes, tri)).groupBy("sample_id").agg(F.count_if("on_wall").alias("n"))
    assert {r.sample_id: r.n for r in mask.collect()} == {0: 24, 7: 32}


def test_box_nodes_use_relative_slack(spark):
    nodes, _ = ring_mesh()
    got = topology.box_nodes(spark.createDataFrame(nodes)).count()
    assert got == 24
    # a node 3e-5 inside x = 4 still counts as on the box, one 1e-4 inside does not
    far = spark.createDataFrame([(0, 0, 4.0, 0.0), (0, 1, 4.0 - 3e-5, 0.1), (0, 2, 4.0 - 1e-4, 0.2), (0, 3, -2.0, 1.0), (0, 4, 0.0, -1.0)],
                                "sample_id long, node_id long, x double, y double")
    assert sorted(r.node_id for r in topology.box_nodes(far).collect()) == [0, 1, 3, 4]


def test_refused_loops(spark):
    edges = spark.createDataFrame(
        [(1, 0, 1), (1, 1, 2), (1, 0, 2), (1, 2, 3), (1, 3, 4), (1, 2, 4),      # node 2 has four edges
         (2, 0, 1), (2, 1, 2), (2, 0, 2), (2, 5, 6), (2, 6, 7), (2, 5, 7)], "sample_id long, a long, b long")
    assert [r.sample_id for r in topology.degree_errors(edges).collect()] == [1]
    chained = topology.chain_loops(edges)
    assert [(r.sample_id, r.error) for r in topology.loop_errors(chained).collect()] == [(2, "the wall has more than one loop")]


def test_linear_shear_is_exact(spark):
    nodes, tri, ids = strip_mesh()
    wall = spark.createDataFrame(pd.DataFrame({"sample_id": 0, "node_id": ids[0]}))
    got = wallflow.wall_gradients(spark.createDataFrame(nodes), spark.createDataFrame(tri), wall).toPandas()
    assert len(got) == 21
    assert np.allclose(got.dux_dy, 250.0) and np.allclose(got[["dux_dx", "duy_dx", "duy_dy"]], 0, atol=1e-9)
    tau = wallflow.wall_shear(1.5e-5)
    flat = spark.createDataFrame(got.assign(normal_x=0.0, normal_y=1.0)).withColumns(tau).toPandas()
    assert np.allclose(flat.tau_x, 1.5e-5 * 250) and np.allclose(flat.tau_y, 0, atol=1e-12)


def _samples(spark, n, alpha=0.1, u=30.0):
    return spark.createDataFrame([(i, alpha, u) for i in range(n)], "sample_id long, alpha_rad double, u_inf double")


def test_uniform_pressure_has_no_force(spark):
    wall = code_loops(spark, ["2412"]).withColumns({"p": F.lit(7.3), "tau_x": F.lit(0.0), "tau_y": F.lit(0.0)})
    r = wallflow.integrate_forces(wall, _samples(spark, 1)).first()
    assert abs(r.Cd_int_p) < 1e-12 and abs(r.Cl_int_p) < 1e-12 and r.Cd_int_tau == 0


def test_uniform_shear_drags_by_perimeter(spark):
    loop = code_loops(spark, ["2412"])
    pts = loop.orderBy("pos").toPandas()[["x", "y"]].to_numpy()
    perimeter = np.hypot(*(np.roll(pts, -1, 0) - pts).T).sum()
    wall = loop.withColumns({"p": F.lit(0.0), "tau_x": F.lit(1.0), "tau_y": F.lit(0.0)})
    r = wallflow.integrate_forces(wall, _samples(spark, 1, 0.0)).first()
    assert r.Cd_int_tau == pytest.approx(2 * perimeter / 900) and abs(r.Cl_int_tau) < 1e-12


@pytest.mark.parametrize("reverse", [False, True])
def test_normals_point_into_the_fluid(spark, reverse):
    loop = code_loops(spark, ["0012"])
    if reverse:
        loop = loop.withColumn("pos", -F.col("pos"))
    got = wallflow.loop_normals(loop).toPandas()
    top = got[(got.y > 0) & (got.x.between(0.25, 0.35))]
    assert (top.normal_y > 0.99).all()
    assert got.loc[got.x.idxmin()].normal_x < -0.99
    area = wallflow.signed_area(loop).first().area
    assert (area < 0) == reverse and abs(area) == pytest.approx(0.0822, abs=1e-3)


def test_meshes_are_dealt_out_and_never_broadcast(spark, sf):
    """A mesh is made of a row of a few bytes: Spark takes it for small, and one file split would make all meshes."""
    from aeroframe.plans import queries_mesh, workload
    assert queries_mesh.meshes(spark, sf)[2].rdd.getNumPartitions() >= 8
    for name in ("wall_edges", "wall_mask", "wall_gradients", "wall_shear", "wall_forces"):
        plan = workload.QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan, name


def test_errors_of_curves_are_never_broadcast(spark, sf):
    """Errors and forces of a sample meet by merging: Spark takes both for as small as the table of suppliers."""
    from aeroframe.plans.queries_models import curve_surface_errors
    plan = curve_surface_errors(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_loops_are_walked_and_framed_without_pandas(spark):
    """A wall is so few rows that a pandas frame for each would cost more than its geometry."""
    edges = spark.createDataFrame([(7, 1, 2), (7, 2, 3), (7, 3, 4), (7, 1, 4)], "sample_id long, a long, b long")
    loop = topology.chain_loops(edges)
    frame = section.section_frame(loop.select("sample_id", "pos", "node_id", F.col("pos").cast("double").alias("x"), F.lit(0.0).alias("y")))
    for df in (loop, frame):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    assert [r.node_id for r in loop.orderBy("pos").collect()] == [1, 2, 3, 4]


def test_filter_of_several_blocks(spark):
    """A filter larger than a block has the bits of all its keys."""
    from aeroframe.operators import joins
    keys = spark.range(300_000).select(F.col("id").alias("s"), (F.col("id") * 3).alias("n"))
    rows = spark.range(600_000).select(F.col("id").alias("s"), (F.col("id") * 3).alias("n"))
    got = joins.likely_in(rows, keys, ["s", "n"], 1000)
    assert got.filter("s < 300000").count() == 300_000 and got.filter("s >= 300000").count() < 15_000


def test_parts_are_dealt_out_before_sections(spark, sf):
    from aeroframe.plans import queries_mesh
    p = queries_mesh.parts(spark, sf)
    assert p.rdd.getNumPartitions() >= 8 and p.count() == spark.read.parquet(f"{sf}/part.parquet").count()
