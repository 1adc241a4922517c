"""Cases against declared references, curves against curves, scores against published scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroframe.functions.physics import percent_error
from aeroframe.operators.joins import best_by_priority, interpolate
from aeroframe.operators.quality import tolerance_verdict
from aeroframe.operators.resample import to_linear_grid

# Governing role of a coefficient reference, source order of a pressure reference, and the
# comparison grid.
PRIMARY_ROLE = "experimental_primary"
CP_ROLES = ("engineering_reference", "cfd_reference", "experimental_primary")
CP_GRID = (0.02, 0.98, 50)


def declared_references(cases: DataFrame) -> DataFrame:
    """One row per case and declared role: case_id, seq, role and the entry's fields."""
    pairs = cases.select("case_id", "alpha_deg", F.posexplode(F.map_entries("references")).alias("seq", "_e"))
    return pairs.select("case_id", "alpha_deg", "seq", F.col("_e.key").alias("role"), "_e.value.*")


def compare_coefficients(stats: DataFrame, references: DataFrame) -> DataFrame:
    """Settled coefficients of each case against every usable reference, as signed percent errors.

    ``stats``: case_id, Cl_mean, Cl_std, Cd_mean, Cd_std, n_iters.  ``references``: case_id, seq, role,
    label, Cl, Cd; a reference with neither value is left out.
    """
    usable = references.filter(F.col("Cl").isNotNull() | F.col("Cd").isNotNull())
    joined = stats.join(usable.select("case_id", "seq", "role", F.coalesce("label", "role").alias("label"), F.col("Cl").alias("Cl_ref"), F.col("Cd").alias("Cd_ref")), "case_id")
    return joined.withColumn("Cl_err_pct", percent_error(F.col("Cl_mean"), F.col("Cl_ref"))).withColumn("Cd_err_pct", percent_error(F.col("Cd_mean"), F.col("Cd_ref")))


def case_verdicts(comparisons: DataFrame, tolerances: DataFrame | None = None) -> DataFrame:
    """One pass flag per case from its governing reference: the primary role, else the first declared."""
    governing = best_by_priority(comparisons, ["case_id"], F.col("role"), [PRIMARY_ROLE], F.lit(True), ["seq"])
    if tolerances is not None:
        governing = governing.join(tolerances, "case_id", "left")
    for c in ("Cl_tol", "Cd_tol"):
        if c not in governing.columns:
            governing = governing.withColumn(c, F.lit(None).cast("double"))
    return tolerance_verdict(governing)


def comparison_summary(stats: DataFrame, comparisons: DataFrame) -> DataFrame:
    """One row per case and reference; a case without references keeps one row."""
    refs = comparisons.select("case_id", F.col("role").alias("ref_role"), F.col("label").alias("ref_label"), "Cl_ref", "Cd_ref", "Cl_err_pct", "Cd_err_pct")
    return stats.join(refs, "case_id", "left")


def compare_curves(case_curves: DataFrame, reference_curves: DataFrame, key: str = "case_id", x: str = "x_c", value: str = "Cp") -> tuple[DataFrame, DataFrame]:
    """(stations, summary): both curves on a common grid, their difference, its RMS and largest size.

    Points outside [0, 1] are dropped; a side with fewer than five points gives no comparison.
    """
    lo, hi, n = CP_GRID

    def resampled(df: DataFrame, name: str) -> DataFrame:
        inside = df.filter(F.col(x).between(0.0, 1.0) & ~F.isnan(x)).select(key, F.col(x).cast("double").alias("_x"), F.col(value).cast("double").alias(name))
        enough = inside.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 5).select(key)
        return to_linear_grid(inside.join(enough, key, "left_semi"), [key], "_x", name, [name], lo, hi, n).select(key, "station", "x_c", name)

    stations = resampled(case_curves, "case_value").join(resampled(reference_curves, "reference_value").drop("x_c"), [key, "station"])
    stations = stations.withColumn("delta", F.col("case_value") - F.col("reference_value"))
    summary = stations.groupBy(key).agg(F.sqrt(F.avg(F.col("delta") * F.col("delta"))).alias("rms_delta"), F.max(F.abs("delta")).alias("max_abs_delta"))
    return stations, summary


def reference_agreement(references: DataFrame, sweep: DataFrame, by: Sequence[str] = (), alpha_range: tuple[float, float] | None = (-5.0, 15.0)) -> DataFrame:
    """Sweep minus reference at each reference angle, interpolated along the sweep.

    ``references``: by, reference, alpha_deg, Cl_ref, Cd_ref; ``sweep``: by, alpha_deg, Cl, Cd.
    """
    points = references.filter(F.col("alpha_deg").between(*alpha_range)) if alpha_range else references
    at = interpolate(points, sweep, by, "alpha_deg", "alpha_deg", ["Cl", "Cd"]).withColumnRenamed("Cl_at", "Cl_pred").withColumnRenamed("Cd_at", "Cd_pred")
    return at.withColumn("dCl", F.col("Cl_pred") - F.col("Cl_ref")).withColumn("dCd_pct", 100 * F.try_divide(F.col("Cd_pred") - F.col("Cd_ref"), F.col("Cd_ref")))


def zone_mean(zones: DataFrame, zone: str, grid: Column, by: Sequence[str], at: str, x: str, values: Sequence[str]) -> DataFrame:
    """Mean of several reference zones, each interpolated onto the same grid (an array expression)."""
    points = zones.select(*by, zone).distinct().withColumn(at, F.explode(grid))
    on_grid = interpolate(points, zones, [*by, zone], at, x, values)
    return on_grid.groupBy(*by, at).agg(*[F.avg(f"{v}_at").alias(v) for v in values])


def published_scores(scores: DataFrame, models: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Score arrays by model position to rows (task, model, score, component, value).

    Each field of ``scores`` is an array over models, of numbers or of arrays of components.  Places
    beyond the list of models keep their rows, with a null model.
    """
    out = None
    position = F.get(F.array(*[F.lit(m) for m in models]), F.col("_i"))
    for f in fields:
        nested = scores.schema[f].dataType.elementType.typeName() == "array"
        rows = scores.select("task", F.posexplode(f).alias("_i", "_v"))
        rows = rows.select("task", position.alias("model"), F.lit(f).alias("score"), F.posexplode(F.col("_v") if nested else F.array("_v")).alias("component", "value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def benchmark_table(published: DataFrame, ours: DataFrame) -> DataFrame:
    """Published and own scores as one long table."""
    return published.withColumn("source", F.lit("published")).unionByName(ours.withColumn("source", F.lit("own")))
