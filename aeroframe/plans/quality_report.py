"""Row flags, soft checks and the comparison with published references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.functions.grids import interpolate_fixed
from aeroframe.operators import metrics, quality

# Accepted lift slope per degree, angle tolerance of the nearest reference row, and the even
# angle grid on which the experimental zones are averaged.
SLOPE_RANGE, REFERENCE_TOLERANCE, ZONE_GRID = (0.09, 0.12), 0.5, (-4.0, 16.0, 81)


def lift_slope(dataset: DataFrame) -> DataFrame:
    fit = metrics.slope_fit(dataset.filter(quality.near_symmetric()), "alpha_deg", "Cl")
    return fit.withColumn("in_range", F.col("slope").between(*SLOPE_RANGE))


def zero_lift(dataset: DataFrame, slope: float) -> DataFrame:
    return metrics.zero_lift(dataset.filter(quality.cambered()), "alpha_deg", "Cl", slope)


def odd_interpolation(alpha, xs: Sequence[float], ys: Sequence[float]):
    """Odd extension of a curve given for angles from 0 up: sign(alpha) * f(abs(alpha))."""
    return F.signum(alpha) * interpolate_fixed(F.abs(alpha), xs, ys)


def against_fixed_reference(dataset: DataFrame, rows: Sequence[tuple[float, float, float]]) -> DataFrame:
    """Near-reference sections against a short fixed table (alpha, Cl, Cd).

    A case is kept if a table angle lies within the tolerance; lift is read at the case's own angle by odd
    interpolation, drag at the nearest table angle (the first on ties).
    """
    xs, cls, cds = (list(v) for v in zip(*rows))
    near = dataset.filter(quality.near_reference_section())
    gaps = F.array(*[F.struct(F.abs(F.col("alpha_deg") - x).alias("gap"), F.lit(i).alias("i"), F.lit(float(x)).alias("ref_alpha"), F.lit(float(cd)).alias("ref_Cd"))
                     for i, (x, cd) in enumerate(zip(xs, cds))])
    matched = near.withColumn("_n", F.array_min(gaps)).filter(F.col("_n.gap") <= REFERENCE_TOLERANCE).withColumn("ref_Cl", odd_interpolation(F.col("alpha_deg"), xs, cls))
    return matched.select("sample_id", "alpha_deg", "Re", "t_max", "Cl", "Cd", F.col("_n.ref_alpha").alias("ref_alpha"), "ref_Cl", F.col("_n.ref_Cd").alias("ref_Cd"),
                          (F.col("Cl") - F.col("ref_Cl")).alias("dCl"), (F.col("Cd") - F.col("_n.ref_Cd")).alias("dCd"),
                          ((F.col("Cd") - F.col("_n.ref_Cd")) / F.col("_n.ref_Cd")).alias("dCd_rel"))


def against_zone_mean(dataset: DataFrame, zones: Sequence[Sequence[tuple[float, float, float]]]) -> DataFrame:
    """Near-reference sections against the mean of several short fixed zones on the even angle grid."""
    lo, hi, n = ZONE_GRID
    grid = [lo + (hi - lo) * i / (n - 1) for i in range(n)]

    def mean(k: int) -> list[float]:
        return [sum(_interp(g, [r[0] for r in z], [r[k] for r in z]) for z in zones) / len(zones) for g in grid]
    near = dataset.filter(quality.near_reference_section())
    with_ref = near.withColumn("ref_Cl", interpolate_fixed(F.col("alpha_deg"), grid, mean(1))).withColumn("ref_Cd", interpolate_fixed(F.col("alpha_deg"), grid, mean(2)))
    return with_ref.withColumn("dCl", F.col("Cl") - F.col("ref_Cl")).withColumn("dCd_rel", (F.col("Cd") - F.col("ref_Cd")) / F.col("ref_Cd"))


def _interp(x: float, xs: Sequence[float], ys: Sequence[float]) -> float:
    if x <= xs[0]:
        return ys[0]
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]):
        if x < x1:
            return y0 + (y1 - y0) / (x1 - x0) * (x - x0)
    return ys[-1]
