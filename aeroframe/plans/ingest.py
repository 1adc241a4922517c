"""Mesh samples to the dataset, wall, surface and curve tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.functions.physics import reynolds
from aeroframe.operators import quality, section, topology, wallflow
from aeroframe.operators.ordering import merge_join
from aeroframe.session import cut_lineage

DATASET_COLUMNS = ("sample_id", "source_name", "alpha_deg", "U_inf", "Re", "log10_Re", "t_max", "x_tmax", "m_max", "x_m", "Cl", "Cd", "n_wall_nodes",
                   "Cl_int_p", "Cl_int_tau", "Cd_int_p", "Cd_int_tau")


@dataclass
class Ingested:
    dataset: DataFrame
    wall: DataFrame
    curves: DataFrame
    surfaces: DataFrame
    errors: DataFrame


def wall_table(samples: DataFrame, nodes: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wall, section frame, errors).  Only wall-sized tables are cut; the mesh is never copied.

    The triangles are shuffled once, for their edges. Everything else is looked up from the mesh tables through
    filters of wall-sized keys, so that no other shuffle grows with the mesh."""
    loop, errors = topology.wall_loops(nodes, triangles, cut_lineage)
    loop = cut_lineage(loop)
    seen = loop.select("sample_id").unionByName(errors.select("sample_id"))
    errors = errors.unionByName(merge_join(samples.select("sample_id").distinct(), seen, "sample_id", "left_anti").select("sample_id", F.lit("no wall edges").alias("error")))
    frame = cut_lineage(section.section_frame(loop))
    stressed = wallflow.wall_stress(nodes, triangles, loop, keep=cut_lineage)
    placed = merge_join(merge_join(stressed, section.wall_frame(frame), ["sample_id", "pos"]), samples.select("sample_id", "u_inf"), "sample_id")
    wall = placed.withColumns(wallflow.wall_coefficients(F.col("u_inf"))).select(
        "sample_id", "pos", "node_id", "x", "y", "p", "tau_x", "tau_y", "t_x", "t_y", "x_c", "upper", "u_inf", "cp", "cf")
    return cut_lineage(wall), frame, errors


def ingest(samples: DataFrame, nodes: DataFrame, triangles: DataFrame) -> Ingested:
    """All tables of a set of meshes.  Samples without a wall, or whose wall is refused, appear in ``errors`` only.

    ``samples``: sample_id, alpha_rad, u_inf, cl, cd.
    """
    wall, frame, errors = wall_table(samples, nodes, triangles)
    features = section.section_features(frame)
    forces = wallflow.integrate_forces(wall, samples)
    counts = wall.groupBy("sample_id").agg(F.count(F.lit(1)).cast("int").alias("n_wall_nodes"))
    flow = samples.select("sample_id", F.lit("").alias("source_name"), F.degrees("alpha_rad").alias("alpha_deg"), F.col("u_inf").alias("U_inf"),
                          reynolds(F.col("u_inf")).alias("Re"), F.col("cl").alias("Cl"), F.col("cd").alias("Cd")).withColumn("log10_Re", F.log10("Re"))
    dataset = merge_join(merge_join(merge_join(flow, features, "sample_id"), forces, "sample_id"), counts, "sample_id").select(*DATASET_COLUMNS)
    return Ingested(dataset, wall, section.wall_curves(wall), features.select("sample_id", "x_grid", "y_upper", "y_lower"), errors)


def dataset_gate(dataset: DataFrame, curves: DataFrame, n_expected: int) -> DataFrame:
    """(label, ok) rows of the ingest gate, wall curves included."""
    numeric = [c for c in DATASET_COLUMNS if c != "source_name"]
    rows = quality.gate(dataset, quality.ingest_checks(n_expected, numeric))
    return rows.unionByName(quality.gate(curves, {"wall curves finite": quality.every(~F.isnan("value") & (F.abs("value") != float("inf")))}))


def inspection_rows(samples: DataFrame, nodes: DataFrame, triangles: DataFrame) -> DataFrame:
    """One row per sample for the inspection gate: conditions, wall size and distance, element kinds."""
    edges = cut_lineage(topology.wall_edges(nodes, triangles, cut_lineage))
    on_wall = merge_join(topology.wall_nodes(edges), nodes.select("sample_id", "node_id", "implicit_distance"), ["sample_id", "node_id"])
    walls = on_wall.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_wall"), F.max(F.abs("implicit_distance")).alias("wall_distance"))
    names = [c for c in nodes.columns if c in ("p", "ux", "uy", "nut")]
    shapes = quality.schema_summary(nodes, triangles)
    scalars = samples.select("sample_id", F.col("alpha_rad").alias("alpha"), "u_inf", "cl", "cd", reynolds(F.col("u_inf")).alias("re"),
                          F.array(*[F.lit(c) for c in samples.columns if c != "sample_id"]).alias("scalar_names"), F.array(*[F.lit(c) for c in names]).alias("field_names"))
    return merge_join(merge_join(scalars, walls, "sample_id", "left"), shapes, "sample_id", "left")
