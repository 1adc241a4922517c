"""Wall gradients, shear, normals and integrated forces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aeroframe.functions.physics import WALL_NU, dynamic_pressure
from aeroframe.operators.joins import likely_in
from aeroframe.operators.ordering import merge_join


def _around() -> tuple:
    """Windows over one wall loop: by position, and the whole loop."""
    loop = Window.partitionBy("sample_id").orderBy("pos")
    return loop, loop.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def next_on_loop(c: str) -> Column:
    """Value at the following loop position; the last one wraps to the first."""
    loop, whole = _around()
    return F.coalesce(F.lead(c).over(loop), F.first(c).over(whole))


def previous_on_loop(c: str) -> Column:
    loop, whole = _around()
    return F.coalesce(F.lag(c).over(loop), F.last(c).over(whole))


def triangles_at(triangles: DataFrame, wall: DataFrame, sparse: bool = False) -> DataFrame:
    """Incidences (triangle, wall node): the early filter that leaves about 1 % of the mesh.

    With ``sparse`` (for a wall that is written or cut) most other corners are dropped before anything is shuffled."""
    corners = triangles.withColumn("node_id", F.explode(F.array("n0", "n1", "n2")))
    if sparse:
        corners = likely_in(corners, wall, ["sample_id", "node_id"])
    return merge_join(corners, wall.select("sample_id", "node_id"), ["sample_id", "node_id"], "left_semi")


def wall_gradients(nodes: DataFrame, triangles: DataFrame, wall: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Velocity gradient at wall nodes: per-triangle linear gradient, averaged by triangle area.

    The node table is shuffled once: corners of the triangles at the wall are looked up together and
    brought back to one row per triangle. With ``keep`` (a cut of lineage, the wall being cut too) the incidences are computed
    once, and neither triangles nor nodes that have nothing to do with the wall are shuffled.
    """
    touching = triangles_at(triangles, wall, sparse=keep is not None)
    touching = keep(touching) if keep else touching
    kept = touching.select("sample_id", "tri_id", "n0", "n1", "n2").distinct()
    corner = kept.select("sample_id", "tri_id", F.posexplode(F.array("n0", "n1", "n2")).alias("k", "node_id"))
    values = nodes.select("sample_id", "node_id", "x", "y", "ux", "uy")
    if keep:
        values = likely_in(values, touching.select("sample_id", F.explode(F.array("n0", "n1", "n2")).alias("node_id")), ["sample_id", "node_id"])
    valued = merge_join(corner, values, ["sample_id", "node_id"])
    aggs = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(3) for c in ("x", "y", "ux", "uy")]
    tri = valued.groupBy("sample_id", "tri_id").agg(*aggs)
    two_a = ((F.col("x1") - F.col("x0")) * (F.col("y2") - F.col("y0")) - (F.col("x2") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    turns = ((0, 1, 2), (1, 2, 0), (2, 0, 1))

    def slope(u: str, axis: str) -> Column:
        # weight of corner i is the opposite side: (y_j - y_k) for d/dx, (x_k - x_j) for d/dy
        terms = [F.col(f"{u}{i}") * ((F.col(f"y{j}") - F.col(f"y{k}")) if axis == "x" else (F.col(f"x{k}") - F.col(f"x{j}")))
                 for i, j, k in turns]
        return F.try_divide(terms[0] + terms[1] + terms[2], F.col("two_a"))      # a triangle without area has no gradient

    tri = tri.withColumn("two_a", two_a).select(
        "sample_id", "tri_id", (F.abs("two_a") / 2).alias("area"),
        *[slope(u, ax).alias(f"d{u}_d{ax}") for u in ("ux", "uy") for ax in ("x", "y")])
    at_node = merge_join(touching.select("sample_id", "tri_id", "node_id"), tri, ["sample_id", "tri_id"])
    names = ("dux_dx", "dux_dy", "duy_dx", "duy_dy")
    return at_node.groupBy("sample_id", "node_id").agg(
        *[F.try_divide(F.sum(F.col(g) * F.col("area")), F.sum("area")).alias(g) for g in names])


def signed_area(loop: DataFrame) -> DataFrame:
    """Shoelace area per sample: positive for a counter-clockwise loop."""
    turned = loop.select("sample_id", "x", "y", next_on_loop("x").alias("xn"), next_on_loop("y").alias("yn"))
    return turned.groupBy("sample_id").agg((F.sum(F.col("x") * F.col("yn") - F.col("xn") * F.col("y")) / 2).alias("area"))


def loop_segments(loop: DataFrame) -> DataFrame:
    """Adds per-node segment columns: to the next node (sx, sy), its outward normal times length (nx, ny)."""
    turned = loop.withColumn("_xn", next_on_loop("x")).withColumn("_yn", next_on_loop("y"))
    cross = F.col("x") * F.col("_yn") - F.col("_xn") * F.col("y")
    sign = F.when(F.sum(cross).over(Window.partitionBy("sample_id")) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return (turned.withColumn("sx", F.col("_xn") - F.col("x")).withColumn("sy", F.col("_yn") - F.col("y"))
            .withColumn("_sign", sign)
            .withColumn("nx", F.col("_sign") * F.col("sy")).withColumn("ny", -F.col("_sign") * F.col("sx"))
            .drop("_xn", "_yn", "_sign"))


def loop_normals(loop: DataFrame) -> DataFrame:
    """Adds unit node normals (normal_x, normal_y) pointing into the fluid, whatever the loop direction."""
    seg = loop_segments(loop)
    both = seg.withColumn("_mx", F.col("nx") + previous_on_loop("nx")).withColumn("_my", F.col("ny") + previous_on_loop("ny"))
    size = F.sqrt(F.col("_mx") * F.col("_mx") + F.col("_my") * F.col("_my"))
    return (both.withColumn("normal_x", F.try_divide(F.col("_mx"), size)).withColumn("normal_y", F.try_divide(F.col("_my"), size))
            .drop("_mx", "_my", "sx", "sy", "nx", "ny"))


def wall_shear(nu: float = WALL_NU) -> dict[str, Column]:
    """Shear vector 2 nu dev(S) n from gradient and normal columns; the deviator takes a third of the trace."""
    third = (F.col("dux_dx") + F.col("duy_dy")) / 3
    sxy = (F.col("dux_dy") + F.col("duy_dx")) / 2
    two_nu = F.lit(2 * nu)
    return {"tau_x": two_nu * ((F.col("dux_dx") - third) * F.col("normal_x") + sxy * F.col("normal_y")),
            "tau_y": two_nu * (sxy * F.col("normal_x") + (F.col("duy_dy") - third) * F.col("normal_y"))}


def wall_stress(nodes: DataFrame, triangles: DataFrame, loop: DataFrame, nu: float = WALL_NU, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Loop rows with normals, gradients and the shear vector."""
    grad = wall_gradients(nodes, triangles, loop, keep)
    return merge_join(loop_normals(loop), grad, ["sample_id", "node_id"]).withColumns(wall_shear(nu))


FORCE_COLUMNS = ("Cd_int_p", "Cd_int_tau", "Cl_int_p", "Cl_int_tau")


def integrate_forces(wall: DataFrame, samples: DataFrame) -> DataFrame:
    """Drag and lift coefficients per sample, pressure and shear apart.

    ``wall`` has pos, x, y, p, tau_x, tau_y; ``samples`` has alpha_rad and u_inf.  Nodal values are
    averaged onto each segment; the force is the shear integral minus the pressure integral.
    """
    seg = loop_segments(wall.select("sample_id", "pos", "x", "y", "p", "tau_x", "tau_y"))
    for c in ("p", "tau_x", "tau_y"):
        seg = seg.withColumn(f"_{c}", (F.col(c) + next_on_loop(c)) / 2)
    length = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy"))
    force = seg.groupBy("sample_id").agg(
        F.sum(-F.col("_p") * F.col("nx")).alias("_px"), F.sum(-F.col("_p") * F.col("ny")).alias("_py"),
        F.sum(F.col("_tau_x") * length).alias("_tx"), F.sum(F.col("_tau_y") * length).alias("_ty"))
    c, s, u2 = F.cos("alpha_rad"), F.sin("alpha_rad"), F.col("u_inf") * F.col("u_inf")
    out = []
    for name, fx, fy in (("p", "_px", "_py"), ("tau", "_tx", "_ty")):
        out.append((2 * (c * F.col(fx) + s * F.col(fy)) / u2).alias(f"Cd_int_{name}"))
        out.append((2 * (c * F.col(fy) - s * F.col(fx)) / u2).alias(f"Cl_int_{name}"))
    return merge_join(force, samples.select("sample_id", "alpha_rad", "u_inf"), "sample_id").select("sample_id", *out)


def wall_coefficients(u_inf: Column) -> dict[str, Column]:
    """Cp = p/q and Cf = (tau . tangent)/q."""
    q = dynamic_pressure(u_inf)
    return {"cp": F.col("p") / q, "cf": (F.col("tau_x") * F.col("t_x") + F.col("tau_y") * F.col("t_y")) / q}
