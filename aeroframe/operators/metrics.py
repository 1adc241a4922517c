"""Accuracy metrics as grouped aggregates.

Medians, percentiles and rank correlations are exact and use the ordered-cell operators, so a group with a
third of all rows still spreads over tasks.  Everything else is one map-side-combined aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroframe.functions.bands import covered_95
from aeroframe.functions.grids import N_STATIONS, on_cosine_grid
from aeroframe.functions.physics import dynamic_pressure, relative_error
from aeroframe.operators.ordering import cell_count, exact_quantiles, join_null_safe, merge_join, selected_quantiles, spearman, value_splits
from aeroframe.operators.resample import station_array
from aeroframe.session import written

# Gate limits on relative error, tail rule, and the separation window in x/c.
GATE_LIMITS = {"Cl": 0.02, "Cd": 0.05}
TAIL_FACTOR, TAIL_FRACTION = 3.0, 0.05
SEPARATION_WINDOW = (0.02, 0.98)


def r_squared(true: str, pred: str) -> Column:
    """1 - SSE/SST as an aggregate; where the true values do not vary 1 for exact predictions, else 0."""
    error = F.col(true) - F.col(pred)
    sse = F.sum(error * error)
    return F.when(F.min(true) == F.max(true), (sse == 0).cast("double")).otherwise(1 - F.try_divide(sse, F.var_pop(true) * F.count(true)))


def share(flag: Column) -> Column:
    """Share of true among non-null flags."""
    return F.avg(flag.cast("double"))


# --- quantity summaries ----------------------------------------------------------------------------

def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: min, median, max and the number of values, ignoring null and NaN."""
    items = F.array(*[F.struct(F.lit(c).alias("quantity"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("v")) for c in columns])
    long = df.select(F.explode(items).alias("_i")).select("_i.quantity", "_i.v").filter(F.col("v").isNotNull())
    ends = long.groupBy("quantity").agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"))
    return ends.join(exact_quantiles(long, ["quantity"], "v", {"median": 0.5}), "quantity")


def envelope(df: DataFrame, groups: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Range of each feature per group: (groups, feature, lo, hi)."""
    wide = df.groupBy(*groups).agg(*[f(c).alias(f"{p}_{c}") for c in features for p, f in (("lo", F.min), ("hi", F.max))])
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"lo_{c}").cast("double").alias("lo"), F.col(f"hi_{c}").cast("double").alias("hi"))
                      for c in features])
    return wide.select(*groups, F.explode(items).alias("_e")).select(*groups, "_e.*")


def regime_bounds(df: DataFrame, group: str, dims: Sequence[str], validated: str | None = "validated") -> DataFrame:
    """Ranges, row count and whether every row is validated (null counts as not) per regime."""
    flag = F.bool_and(F.coalesce(F.col(validated), F.lit(False))) if validated and validated in df.columns else F.lit(True)
    return df.groupBy(group).agg(*[f(c).alias(f"{c}_{p}") for c in dims for p, f in (("lo", F.min), ("hi", F.max))],
                                 F.count(F.lit(1)).alias("n_train"), flag.alias("validated"))


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 40) -> DataFrame:
    """Equal-width counts over each column's own range, the last bin closed: (quantity, bin, lo, hi, n).

    Empty bins are kept with a count of 0.
    """
    items = F.array(*[F.struct(F.lit(c).alias("quantity"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("v")) for c in columns])
    ends = df.agg(*[f(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(f"{p}_{c}") for c in columns for p, f in (("lo", F.min), ("hi", F.max))]).first()
    lo = F.create_map(*[F.lit(v) for c in columns for v in (c, float(ends[f"lo_{c}"]))])
    hi = F.create_map(*[F.lit(v) for c in columns for v in (c, float(ends[f"hi_{c}"]))])
    long = df.select(F.explode(items).alias("_i")).select("_i.quantity", "_i.v").filter(F.col("v").isNotNull())
    step = (hi[F.col("quantity")] - lo[F.col("quantity")]) / bins
    cell = F.least(F.floor(F.try_divide(F.col("v") - lo[F.col("quantity")], step)).cast("int"), F.lit(bins - 1))
    counts = long.groupBy("quantity", F.coalesce(cell, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    frame = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("quantity")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return (frame.join(counts, ["quantity", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
            .withColumn("lo", lo[F.col("quantity")] + F.col("bin") * step).withColumn("hi", lo[F.col("quantity")] + (F.col("bin") + 1) * step))


# --- regression metrics ----------------------------------------------------------------------------

def regression_metrics(df: DataFrame, groups: Sequence[str], true: str, pred: str, std: str | None = None, model_true: Column | None = None,
                       model_mean: Column | None = None) -> DataFrame:
    """n_test, R2, RMSE, MAE, spearman, mean and median relative error, and 2-sigma coverage per group.

    Coverage is taken in model space (``model_true``, ``model_mean``; defaults are the columns themselves)
    over rows that have a sigma, null if none has.
    """
    groups = list(groups)
    rows = df.select(*groups, F.col(true).cast("double").alias("t"), F.col(pred).cast("double").alias("p"),
                     (model_true if model_true is not None else F.col(true)).alias("mt"),
                     (model_mean if model_mean is not None else F.col(pred)).alias("mp"),
                     (F.nanvl(F.col(std).cast("double"), F.lit(None)) if std else F.lit(None).cast("double")).alias("s")
                     ).withColumn("rel", relative_error(F.col("t"), F.col("p")))
    rows = written(rows, "metric-rows")     # six passes follow
    error = F.col("t") - F.col("p")
    base = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_test"), r_squared("t", "p").alias("R2"), F.sqrt(F.avg(error * error)).alias("RMSE"),
        F.avg(F.abs(error)).alias("MAE"), F.avg("rel").alias("rel_err_mean"),
        share(F.abs(F.col("mt") - F.col("mp")) <= 2 * F.col("s")).alias("coverage_2sigma"))
    cuts = value_splits(rows, ["rel", "t", "p"], cell_count(rows))
    out = join_null_safe(base, exact_quantiles(rows, groups, "rel", {"rel_err_median": 0.5}, cuts["rel"]), groups, "left")
    return join_null_safe(out, spearman(rows, groups, "t", "p", cuts=cuts), groups, "left")


def sliced_metrics(df: DataFrame, base: Sequence[str], slice_by: str, true: str, pred: str, bar: float) -> DataFrame:
    """Metrics over all rows and over each slice, with a pass flag: R2 at or above ``bar``.

    One pass: grouping sets (base) and (base, slice).  The all-rows line has slice 'global'.
    """
    rows = df.withColumn("_e", F.col(true) - F.col(pred)).withColumn("_rel", relative_error(F.col(true), F.col(pred)))
    sets = [[F.col(c) for c in base], [F.col(c) for c in (*base, slice_by)]]
    out = rows.groupingSets(sets, *[F.col(c) for c in (*base, slice_by)]).agg(
        F.grouping(slice_by).alias("_all"), F.count(F.lit(1)).alias("n"), r_squared(true, pred).alias("R2"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("RMSE"),
        F.avg(F.abs("_e")).alias("MAE"), F.avg("_rel").alias("rel_err_mean"))
    return out.select(*base, F.when(F.col("_all") == 1, F.lit("global")).otherwise(F.col(slice_by)).alias("slice"), "n", "R2", "RMSE", "MAE", "rel_err_mean",
                      F.coalesce(F.col("R2") >= bar, F.lit(False)).alias("passed"))


def error_criterion(df: DataFrame, groups: Sequence[str], true: str, integrated: str, limit: float) -> DataFrame:
    """Relative-error gate: median within ``limit`` and at most 5 % of rows beyond three times it."""
    groups = list(groups)
    rows = df.select(*groups, F.abs(F.col(integrated) - F.col(true)).alias("gap"), relative_error(F.col(true), F.col(integrated)).alias("rel"))
    rows = written(rows, "criterion-rows")
    base = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg("rel").alias("mean_rel"), share(F.col("rel") > TAIL_FACTOR * limit).alias("tail_fraction"))
    out = join_null_safe(base, selected_quantiles(rows, groups, {"rel": {"median_rel": 0.5, "p95_rel": 0.95}, "gap": {"median_abs": 0.5}}), groups)
    return out.withColumn("passed", (F.col("median_rel") <= limit) & (F.col("tail_fraction") <= TAIL_FRACTION))


def wall_gate(dataset: DataFrame) -> DataFrame:
    """One row: pass flags of the three force criteria, the two curve verdicts, median shear share of drag."""
    rows = dataset.select("Cl", "Cd", "Cl_int_p", (F.col("Cl_int_p") + F.col("Cl_int_tau")).alias("Cl_int"),
                          (F.col("Cd_int_p") + F.col("Cd_int_tau")).alias("Cd_int"), "Cd_int_tau")
    items = F.array(*[F.struct(F.lit(n).alias("criterion"), F.col(t).alias("t"), F.col(i).alias("i"), F.lit(GATE_LIMITS[t]).alias("limit"))
                      for n, t, i in (("Cl_pressure_only", "Cl", "Cl_int_p"), ("Cl", "Cl", "Cl_int"), ("Cd", "Cd", "Cd_int"))])
    long = rows.select(F.explode(items).alias("_c")).select("_c.*").withColumn("rel", relative_error(F.col("t"), F.col("i")))
    tail = long.groupBy("criterion").agg(share(F.col("rel") > TAIL_FACTOR * F.col("limit")).alias("tail"), F.first("limit").alias("limit"))
    verdict = tail.join(exact_quantiles(long, ["criterion"], "rel", {"median": 0.5}), "criterion").withColumn(
        "ok", (F.col("median") <= F.col("limit")) & (F.col("tail") <= TAIL_FRACTION))
    wide = verdict.agg(*[F.bool_or(F.when(F.col("criterion") == n, F.col("ok"))).alias(f"{n}_ok") for n in ("Cl_pressure_only", "Cl", "Cd")])
    shear = exact_quantiles(rows.select(F.try_divide("Cd_int_tau", "Cd_int").alias("s")), [], "s", {"median_shear_share": 0.5})
    gate = wide.withColumn("cp_pass", F.col("Cl_pressure_only_ok")).withColumn("cf_pass", F.col("Cl_pressure_only_ok") & F.col("Cl_ok") & F.col("Cd_ok"))
    return join_null_safe(gate, shear, [])


def worst_rows(df: DataFrame, true: str, pred: str, k: int, tie: Sequence[str], out: str = "rel_err") -> DataFrame:
    """``k`` rows with the largest relative error; Spark keeps k per task before merging."""
    return df.withColumn(out, relative_error(F.col(true), F.col(pred))).orderBy(F.desc(out), *tie).limit(k)


def slope_fit(df: DataFrame, x: str, y: str, ratio_from: float = 1.0) -> DataFrame:
    """Least-squares line and quantiles (5, 50, 95 %) of y/x over rows with abs(x) above ``ratio_from``."""
    line = df.agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    ratio = df.filter(F.abs(x) > ratio_from).select((F.col(y) / F.col(x)).alias("r"))
    return join_null_safe(line, exact_quantiles(ratio, [], "r", {"p5": 0.05, "median": 0.5, "p95": 0.95}), [])


def zero_lift(df: DataFrame, alpha: str, cl: str, slope: float) -> DataFrame:
    """Zero-lift angle alpha - Cl/slope: count, share negative, median, maximum, number not negative."""
    rows = df.select((F.col(alpha) - F.col(cl) / F.lit(slope)).alias("a0"))
    base = rows.agg(F.count(F.lit(1)).alias("n"), share(F.col("a0") < 0).alias("frac_negative"), F.max("a0").alias("max"), F.count_if(F.col("a0") >= 0).alias("n_nonnegative"))
    return join_null_safe(base, exact_quantiles(rows, [], "a0", {"median": 0.5}), [])


def family_summary(predictions: DataFrame, groups: Sequence[str]) -> DataFrame:
    """R2 of both targets, median absolute lift error, median and P90 percent drag error, mean 95 % coverage."""
    rows = predictions.withColumn("dCl", F.abs(F.col("Cl_pred") - F.col("Cl_true"))) \
        .withColumn("dCd", F.abs(100 * F.try_divide(F.col("Cd_pred") - F.col("Cd_true"), F.col("Cd_true"))))
    rows = written(rows, "family-rows")
    base = rows.groupBy(*groups).agg(r_squared("Cl_true", "Cl_pred").alias("R2_Cl"), r_squared("Cd_true", "Cd_pred").alias("R2_Cd"),
                                     share(covered_95("Cl")).alias("_c1"), share(covered_95("Cd")).alias("_c2"))
    base = base.withColumn("coverage_95", F.when(F.col("_c1").isNull(), F.col("_c2")).when(F.col("_c2").isNull(), F.col("_c1"))
                           .otherwise((F.col("_c1") + F.col("_c2")) / 2)).drop("_c1", "_c2")
    return join_null_safe(base, selected_quantiles(rows, groups, {"dCl": {"median_abs_dCl": 0.5}, "dCd": {"median_dCd_pct": 0.5, "p90_dCd_pct": 0.9}}), groups)


def agreement_summary(deltas: DataFrame, groups: Sequence[str], dcl: str = "dCl", dcd: str = "dCd_pct") -> DataFrame:
    """Median and mean of absolute deltas, and the signed median of the drag delta, per reference source."""
    rows = written(deltas.select(*groups, F.abs(dcl).alias("a"), F.abs(dcd).alias("b"), F.col(dcd).alias("c")), "agreement-rows")
    base = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_abs_dCl"), F.avg("b").alias("mean_abs_dCd"))
    return join_null_safe(base, selected_quantiles(rows, groups, {"a": {"median_abs_dCl": 0.5}, "c": {"median_dCd": 0.5}}), groups, "left")


def sweep_kpis(sweep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best L/D and its angle, largest Cl, smallest Cd and the zero-lift angle of each sweep.

    The zero-lift angle is the linear crossing between the largest Cl <= 0 and the smallest Cl > 0, which
    is interpolation of alpha over Cl where Cl increases; null when Cl has no sign change.
    """
    order = F.struct("L_over_D", -F.col("alpha_deg"))
    below = F.when(F.col("Cl") <= 0, F.struct(F.col("Cl"), F.col("alpha_deg")))
    above = F.when(F.col("Cl") > 0, F.struct(F.col("Cl"), F.col("alpha_deg")))
    out = sweep.groupBy(*keys).agg(
        F.max("L_over_D").alias("L_over_D_max"), F.max_by("alpha_deg", order).alias("alpha_at_best"), F.max("Cl").alias("Cl_max"),
        F.min("Cd").alias("Cd_min"), F.min("Cl").alias("_lo"), F.max(below).alias("_b"), F.min(above).alias("_a"))
    crossing = F.col("_b.alpha_deg") + (F.col("_a.alpha_deg") - F.col("_b.alpha_deg")) * (-F.col("_b.Cl")) / (F.col("_a.Cl") - F.col("_b.Cl"))
    return out.withColumn("alpha_zero_lift", F.when((F.col("_lo") < 0) & (F.col("Cl_max") > 0), crossing)).drop("_lo", "_b", "_a")


# --- curve metrics ---------------------------------------------------------------------------------

def separation(curves: DataFrame, keys: Sequence[str], cf: str, x: str = "x_c", window: tuple[float, float] = SEPARATION_WINDOW) -> DataFrame:
    """First x with reversed flow inside the window, null if attached: a plain conditional minimum."""
    return curves.groupBy(*keys).agg(F.min(F.when((F.col(cf) < 0) & F.col(x).between(*window), F.col(x))).alias("x_separation"))


def suction_peak(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest Cp with its place and surface; the first row (upper side, then x) on ties."""
    rank = F.struct(F.col("Cp"), F.when(F.col("surface") == "upper", 0).otherwise(1).alias("s"), F.col("x_c"))
    return curves.groupBy(*keys).agg(F.min("Cp").alias("Cp_min"), F.min_by("x_c", rank).alias("x_c_Cp_min"), F.min_by("surface", rank).alias("surface_Cp_min"))


def curve_metrics(curves: DataFrame, groups: Sequence[str], sample: str = "sample_id", station: Sequence[str] = ("surface", "station"),
                  true: str = "true", pred: str = "pred", std: str | None = None) -> DataFrame:
    """RMSE, MAE, station-mean and flat R2 and 2-sigma coverage of long curves, per group.

    Two levels: the station level is the only shuffle of curve rows, and the group level is folded from
    station moments.
    """
    groups, at = list(groups), list(station)
    e = F.col(true) - F.col(pred)
    covered = F.sum((F.abs(e) <= 2 * F.col(std)).cast("double")) if std else F.lit(None).cast("double")
    with_std = F.count(F.col(std)) if std else F.lit(0)
    by_station = curves.groupBy(*groups, *at).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae"), F.avg(true).alias("m"), (F.var_pop(true) * F.count(true)).alias("sst"),
        covered.alias("cov"), with_std.alias("ncov"))
    # a station whose true values do not vary scores 1 when predicted exactly, else 0
    score = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    n, total = F.col("n"), F.sum("n")
    # pooled sum of squares = within stations + between station means
    between = F.sum(n * F.col("m") * F.col("m")) - F.pow(F.sum(n * F.col("m")), 2) / total
    return by_station.groupBy(*groups).agg(
        total.alias("n_values"), F.sqrt(F.sum("sse") / total).alias("RMSE"), (F.sum("sae") / total).alias("MAE"), F.avg(score).alias("R2_station_mean"),
        (1 - F.sum("sse") / (F.sum("sst") + between)).alias("R2_flat"), F.try_divide(F.sum("cov"), F.sum("ncov")).alias("coverage_2sigma"))


def curve_event_metrics(curves: DataFrame, groups: Sequence[str], sample: str = "sample_id", true: str = "true", pred: str = "pred") -> DataFrame:
    """Suction-peak error (Cp) and separation errors (Cf, upper side) per group.

    Expects columns quantity, surface, x_c next to the sample and the two values.
    """
    groups = list(groups)
    lo, hi = SEPARATION_WINDOW
    rows = F.col("quantity") == "Cf"
    reversed_in = lambda c: F.min(F.when(rows & (F.col("surface") == "upper") & (F.col(c) < 0) & F.col("x_c").between(lo, hi), F.col("x_c")))
    cp = F.col("quantity") == "Cp"
    by_sample = curves.groupBy(*groups, sample).agg(
        F.min(F.when(cp, F.col(true))).alias("pt"), F.min(F.when(cp, F.col(pred))).alias("pp"), reversed_in(true).alias("st"), reversed_in(pred).alias("sp"),
        F.bool_or(rows).alias("has_cf"))
    seen = F.col("has_cf")
    return by_sample.groupBy(*groups).agg(
        F.avg(F.abs(F.col("pp") - F.col("pt"))).alias("suction_peak_MAE"), F.count_if(seen & F.col("st").isNotNull()).alias("n_separated_true"),
        share(F.when(seen, F.col("st").isNotNull() == F.col("sp").isNotNull())).alias("separation_detect_accuracy"),
        F.avg(F.abs(F.col("sp") - F.col("st"))).alias("separation_xc_MAE"))


def curves_on_wall(wall: DataFrame, curves: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: each surface's station curve read at the wall nodes' own x_c.

    A curve becomes one fixed-length array, so the join is one row per (key, surface) and the lookup is
    arithmetic.
    """
    arrays = station_array(curves, [*keys, "surface"], value, "_curve")
    sided = wall.withColumn("surface", F.when(F.col("upper"), F.lit("upper")).otherwise(F.lit("lower")))
    joined = merge_join(sided, arrays, [*keys, "surface"])
    return joined.withColumn(out, on_cosine_grid(F.col("_curve"), F.col("x_c"), N_STATIONS)).drop("_curve", "surface")


def surface_errors(wall: DataFrame, groups: Sequence[str], u_inf: str = "u_inf", cp: str = "cp_pred", cf: str | None = "cf_pred") -> DataFrame:
    """Mean relative error of pressure and both shear components: over nodes, then over samples.

    Predicted shear lies along the true wall tangent.
    """
    q = dynamic_pressure(F.col(u_inf))
    items = {"mean_rel_p": relative_error(F.col("p"), F.col(cp) * q)}
    if cf:
        for ax in ("x", "y"):
            items[f"mean_rel_wss_{ax}"] = relative_error(F.col(f"tau_{ax}"), F.col(cf) * q * F.col(f"t_{ax}"))
    per_sample = wall.groupBy(*groups, "sample_id").agg(*[F.avg(e).alias(n) for n, e in items.items()])
    return per_sample.groupBy(*groups).agg(*[F.avg(n).alias(n) for n in items])


def integrated_coefficients(wall: DataFrame, samples: DataFrame, cp: str = "cp_pred", cf: str | None = "cf_pred") -> DataFrame:
    """Cl and Cd of predicted curves integrated on each sample's own wall; no shear without ``cf``."""
    from aeroframe.operators.wallflow import integrate_forces
    q = dynamic_pressure(F.col("u_inf"))
    placed = merge_join(wall, samples.select("sample_id", "u_inf"), "sample_id") if "u_inf" not in wall.columns else wall
    tau = [(F.col(cf) * q * F.col(f"t_{ax}") if cf else F.lit(0.0)).alias(f"tau_{ax}") for ax in ("x", "y")]
    f = integrate_forces(placed.select("sample_id", "pos", "x", "y", (F.col(cp) * q).alias("p"), *tau), samples)
    return f.select("sample_id", (F.col("Cl_int_p") + F.col("Cl_int_tau")).alias("Cl_curve"), (F.col("Cd_int_p") + F.col("Cd_int_tau")).alias("Cd_curve"))


# --- copies of one model ---------------------------------------------------------------------------

def ensemble_stats(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and population deviation over model copies."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_copies"), *[f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def field_scores(df: DataFrame, copy: str, sample: str, variable: str, error: Column, on_surface: Column) -> DataFrame:
    """Surface, volume and total error per variable: over nodes, then samples, then mean/deviation over copies."""
    per_sample = df.groupBy(variable, copy, sample).agg(F.avg(F.when(on_surface, error)).alias("surface"), F.avg(F.when(~on_surface, error)).alias("volume"), F.avg(error).alias("all_nodes"))
    per_copy = per_sample.groupBy(variable, copy).agg(*[F.avg(c).alias(c) for c in ("surface", "volume", "all_nodes")]).withColumn("total", F.col("surface") + F.col("volume"))
    return per_copy.groupBy(variable).agg(F.count(F.lit(1)).alias("n_copies"), *[f(c).alias(f"{c}_{n}") for c in ("surface", "volume", "all_nodes", "total")
                                                                             for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def copy_spearman(df: DataFrame, copy: str, true: str, pred: str) -> DataFrame:
    """Rank correlation per copy, then mean and deviation over copies."""
    return spearman(df, [copy], true, pred).agg(F.count("spearman").alias("n_copies"), F.avg("spearman").alias("spearman_mean"), F.stddev_pop("spearman").alias("spearman_std"))


# --- picks and counts ------------------------------------------------------------------------------

def best_by(metrics: DataFrame, groups: Sequence[str], item: str, score: str) -> DataFrame:
    """The item with the smallest score per group, its name breaking ties."""
    return metrics.groupBy(*groups).agg(F.min_by(item, F.struct(score, item)).alias("best"), F.min(score).alias(f"best_{score}"))


def targets_met(metrics: DataFrame, keys: Sequence[str], limits: Mapping[tuple[str, str], float]) -> DataFrame:
    """Whether each family reaches every reported target: ``limits`` maps (target, metric) to its least value."""
    flags = {f"{t}_{m}": F.max(F.when(F.col("target") == t, F.col(m))) for t, m in limits}
    wide = metrics.groupBy(*keys).agg(*[v.alias(k) for k, v in flags.items()])
    ok = [F.coalesce(F.col(f"{t}_{m}") >= bar, F.lit(False)) for (t, m), bar in limits.items()]
    met = ok[0]
    for c in ok[1:]:
        met = met & c
    return wide.withColumn("n_met", sum(c.cast("int") for c in ok)).withColumn("all_met", met)


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts per row value with one column per given value, 0 where none."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def ranked_picks(df: DataFrame, groups: Sequence[str], score: str, row_id: str) -> DataFrame:
    """Rows at the lowest, middle (n div 2, 0-based) and highest score of each group, ties by id.

    Positions come from the ordered value counts, so only the few rows at those three values are sorted.
    """
    from aeroframe.operators.ordering import ordered_counts
    counts = ordered_counts(df, groups, score)
    wanted = F.array(F.struct(F.lit("lowest").alias("pick"), F.lit(0).cast("long").alias("i")),
                     F.struct(F.lit("middle").alias("pick"), F.floor(F.col("total") / 2).alias("i")),
                     F.struct(F.lit("highest").alias("pick"), (F.col("total") - 1).alias("i")))
    held = (counts.select(*groups, score, "before", "n", F.explode(wanted).alias("_w"))
            .filter((F.col("before") <= F.col("_w.i")) & (F.col("_w.i") < F.col("before") + F.col("n")))
            .select(*groups, score, F.col("_w.pick").alias("pick"), (F.col("_w.i") - F.col("before") + 1).alias("_at")))
    # at most three values per group are looked up, so this side is three rows per group
    rows = df.join(held, [*groups, score])
    return top_rows_at(rows, [*groups, "pick"], row_id)


def top_rows_at(rows: DataFrame, groups: Sequence[str], row_id: str) -> DataFrame:
    """The row at position ``_at`` (by id) of each group of equal scores."""
    from aeroframe.operators.ordering import add_bucket, row_numbers, value_splits
    cut = value_splits(rows, [row_id])[row_id]
    numbered = row_numbers(add_bucket(rows, row_id, cut), groups, "_b", [row_id], "_rn")
    return numbered.filter(F.col("_rn") == F.col("_at")).drop("_rn", "_at", "_b")
