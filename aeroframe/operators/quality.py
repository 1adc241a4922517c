"""Gates and row checks.  Rows are never edited; verdicts are side tables or extra columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroframe.functions.physics import is_finite
from aeroframe.operators.ordering import first_of_duplicates, merge_join

# Hard-check limits, failing share allowed, and the convergence limits per regime
# (rows, lift deviation, drag deviation, target y+).
CD_RANGE, CL_LIMIT, MAX_FAIL_FRACTION = (0.0, 0.3), 2.5, 0.02
CONVERGENCE = {"A": (800, 0.005, 0.005, 30.0), "B": (1500, 0.010, 0.010, 0.5), "C": (1500, 0.005, 0.005, 0.5), "D": (800, 0.005, 0.005, 50.0)}
HARD_COLUMNS = ("alpha_deg", "Re", "t_max", "x_tmax", "m_max", "x_m", "Cl", "Cd")


def ordered_reasons(rules: Sequence[tuple[Column, Column]]) -> Column:
    """Texts of the rules that hold, in rule order."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), t) for c, t in rules]), lambda r: r.isNotNull())


def gate(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(label, ok) per check: each check is one boolean aggregate, all in one pass."""
    wide = df.agg(*[F.coalesce(c, F.lit(True)).alias(f"c{i}") for i, c in enumerate(checks.values())])
    items = F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"c{i}").alias("ok")) for i, k in enumerate(checks)])
    return wide.select(F.explode(items).alias("_g")).select("_g.label", "_g.ok")


def every(flag: Column) -> Column:
    """True if the flag holds on every row; null counts as failing."""
    return F.bool_and(F.coalesce(flag, F.lit(False)))


def within(c: str, lo: float, hi: float) -> Column:
    """Range test that NaN fails (NaN sorts above every number)."""
    return every(F.col(c).between(lo, hi) & ~F.isnan(F.col(c).cast("double")))


def ingest_checks(n_expected: int, numeric: Sequence[str]) -> dict[str, Column]:
    """Checks of the ingested dataset: size, no missing numbers, ranges."""
    missing = F.lit(False)
    for c in numeric:
        missing = missing | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    return {
        "row count": F.count(F.lit(1)) == n_expected,
        "no missing numbers": every(~missing),
        "t_max in [0.04, 0.22]": within("t_max", 0.04, 0.22),
        "abs m_max <= 0.08": within("m_max", -0.08, 0.08),
        "alpha_deg in [-5, 15]": within("alpha_deg", -5.0, 15.0),
        "Re in [1.9e6, 6.1e6]": within("Re", 1.9e6, 6.1e6),
    }


def inspection_checks(n_expected: int, required_scalars: Sequence[str], required_fields: Sequence[str]) -> dict[str, Column]:
    """Checks over per-sample inspection rows.

    Columns: scalar_names, field_names (arrays), alpha, u_inf, cl, cd, re, n_wall, wall_distance,
    triangles_only.  Angles must be radians: every absolute value below 1.
    """
    names = lambda need, c: every(F.size(F.array_except(F.array(*[F.lit(x) for x in need]), F.col(c))) == 0)
    return {
        "required scalars present": names(required_scalars, "scalar_names"),
        "coefficients finite": every(is_finite(F.col("cl")) & is_finite(F.col("cd"))),
        "flow conditions finite": every(is_finite(F.col("alpha")) & is_finite(F.col("u_inf"))),
        "angles are radians in range": every((F.abs("alpha") < 1.0) & (F.col("alpha") > -0.0873 - 1e-3) & (F.col("alpha") < 0.2618 + 1e-3)),
        "Re in range": every((F.col("re") > 1.9e6) & (F.col("re") < 6.1e6)),
        "wall found": every((F.col("n_wall") >= 50) & (F.col("wall_distance") < 1e-3)),
        "sample count": F.count(F.lit(1)) == n_expected,
        "flow fields present": names(required_fields, "field_names"),
        "triangles only": every(F.col("triangles_only")),
    }


def schema_summary(nodes: DataFrame, triangles: DataFrame) -> DataFrame:
    """Per sample: node and element counts, bounding box and whether every element is a triangle."""
    box = nodes.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_nodes"), *[f(c).alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))])
    whole = F.col("n0").isNotNull() & F.col("n1").isNotNull() & F.col("n2").isNotNull()
    return merge_join(box, triangles.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_triangles"), F.bool_and(whole).alias("triangles_only")), "sample_id", "left")


def sample_details(samples: DataFrame, nodes: DataFrame, triangles: DataFrame, n: int = 3) -> DataFrame:
    """Detail of the ``n`` samples that come first: one line per scalar and per node field, with its range, and the sample's sizes.

    sample_id, kind ('scalar' or 'field'), name, lo, hi, n_nodes, n_triangles. The mesh tables are cut to those samples before anything else."""
    first = samples.orderBy("sample_id").limit(n)
    keys = F.broadcast(first.select("sample_id"))      # n rows
    mesh, faces = nodes.join(keys, "sample_id", "left_semi"), triangles.join(keys, "sample_id", "left_semi")
    fields = [c for c in nodes.columns if c not in ("sample_id", "node_id")]
    scalars = [c for c in samples.columns if c != "sample_id"]
    ends = mesh.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_nodes"), *[f(c).cast("double").alias(f"_{p}_{c}") for c in fields for p, f in (("lo", F.min), ("hi", F.max))])
    lines = F.array(*[F.struct(F.lit("scalar").alias("kind"), F.lit(c).alias("name"), F.col(f"_s_{c}").alias("lo"), F.col(f"_s_{c}").alias("hi")) for c in scalars],
                    *[F.struct(F.lit("field").alias("kind"), F.lit(c).alias("name"), F.col(f"_lo_{c}").alias("lo"), F.col(f"_hi_{c}").alias("hi")) for c in fields])
    sizes = faces.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_triangles"))
    wide = first.select("sample_id", *[F.col(c).cast("double").alias(f"_s_{c}") for c in scalars]).join(ends, "sample_id", "left").join(sizes, "sample_id", "left")
    return wide.select("sample_id", F.explode(lines).alias("_l"), F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_triangles", F.lit(0)).alias("n_triangles")).select("sample_id", "_l.*", "n_nodes", "n_triangles")


def name_sets(samples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct names over all samples that hold at least one value: kind, name, n_values (of the schema's columns, in one pass each)."""
    out = None
    for kind, df, skip in (("scalar", samples, ("sample_id",)), ("field", nodes, ("sample_id", "node_id"))):
        names = [c for c in df.columns if c not in skip]
        counts = df.agg(*[F.count(c).alias(c) for c in names])
        part = counts.select(F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("name"), F.col(c).alias("n_values")) for c in names])).alias("_n")).select("_n.*")
        out = part if out is None else out.unionByName(part)
    return out.filter(F.col("n_values") > 0)


def split_sizes(membership: DataFrame, split: Sequence[str] = ("task", "role"), row: str = "sample_id") -> DataFrame:
    """Rows, least and largest row id of every split."""
    return membership.groupBy(*split).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("min_id"), F.max(row).alias("max_id"))


def duplicate_keys() -> list[Column]:
    """Rounding of the repeat test, half to even: angle to 1e-3, Re to 1e3, features to 1e-5."""
    return [F.bround("alpha_deg", 3), F.bround(F.col("Re") / 1e3, 0), *[F.bround(c, 5) for c in ("t_max", "x_tmax", "m_max", "x_m")]]


def hard_checks(df: DataFrame, row_id: str = "sample_id", numeric: Sequence[str] = HARD_COLUMNS, keys: Sequence[Column] | None = None) -> DataFrame:
    """(row_id, qa_pass, qa_reason, rules): every failed rule in order, as text and as rule ids."""
    finite = F.lit(True)
    for c in numeric:
        finite = finite & is_finite(F.col(c))
    marked = first_of_duplicates(df.select(row_id, *dict.fromkeys([*numeric])), list(keys) if keys is not None else duplicate_keys(), row_id, "first_copy")
    cd_ok = (F.col("Cd") > CD_RANGE[0]) & (F.col("Cd") < CD_RANGE[1]) & ~F.isnan("Cd")
    cl_ok = (F.abs("Cl") < CL_LIMIT) & ~F.isnan("Cl")
    rules = [("non_finite", ~finite, F.lit("non-finite value")),
             ("cd_range", ~F.coalesce(cd_ok, F.lit(False)), F.concat(F.lit("Cd="), F.format_string("%.4g", "Cd"), F.lit(" outside (0, 0.3)"))),
             ("cl_range", ~F.coalesce(cl_ok, F.lit(False)), F.concat(F.lit("|Cl|="), F.format_string("%.4g", F.abs("Cl")), F.lit(" >= 2.5"))),
             ("duplicate", F.col("first_copy").isNotNull(), F.concat(F.lit("duplicate of sample "), F.col("first_copy").cast("string")))]
    texts = ordered_reasons([(c, t) for _, c, t in rules])
    ids = ordered_reasons([(c, F.lit(i)) for i, c, _ in rules])
    return marked.select(row_id, (F.size(ids) == 0).alias("qa_pass"), F.concat_ws("; ", texts).alias("qa_reason"), ids.alias("rules"))


def failure_gate(flags: DataFrame, limit: float = MAX_FAIL_FRACTION) -> DataFrame:
    """Number and share of failing rows, and whether the share is within the limit."""
    out = flags.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("qa_pass")).alias("n_fail"), F.avg((~F.col("qa_pass")).cast("double")).alias("fail_fraction"))
    return out.withColumn("ok", F.col("fail_fraction") <= limit)


def near_symmetric() -> Column:
    return (F.abs("m_max") < 0.005) & (F.abs("alpha_deg") <= 8)


def cambered() -> Column:
    return (F.col("m_max") > 0.005) & (F.abs("alpha_deg") <= 8)


def near_reference_section() -> Column:
    return (F.abs("m_max") < 0.003) & F.col("t_max").between(0.11, 0.13)


def _limit(regime: Column, i: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in CONVERGENCE.items() for x in (k, float(v[i]))])[regime]


def convergence(df: DataFrame, unvalidated: Sequence[str] = ()) -> DataFrame:
    """Adds converged, reason (the first failing rule), include and validated.

    Columns: regime, fatal, n_iters, Cl_std, Cd_std, y_plus_mean, y_plus_target (null: the regime's own).
    A row that failed is still included, unvalidated, when its regime is listed and it has coefficients.
    """
    regime = F.col("regime")
    target = F.coalesce(F.nullif(F.col("y_plus_target"), F.lit(0.0)), _limit(regime, 3))

    def beyond(c: str, i: int) -> Column:
        return ~F.isnan(c) & (F.col(c) >= _limit(regime, i))       # NaN is beyond no limit
    reason = (F.when(F.coalesce("fatal", F.lit(False)), "fatal error in solver log")
              .when(F.col("n_iters").isNull(), "force history unreadable or missing")
              .when(F.col("n_iters") < _limit(regime, 0), "too few force rows")
              .when(beyond("Cl_std", 1), "lift not settled")
              .when(beyond("Cd_std", 2), "drag not settled")
              .when(F.col("y_plus_mean").isNull(), "y+ missing")
              .when(target.isNull(), "no y+ target for this regime")
              .when(~F.isnan("y_plus_mean") & (F.abs(F.col("y_plus_mean") - target) > 0.5 * target), "y+ outside half of its target")
              .otherwise("converged"))
    done = df.withColumn("reason", reason).withColumn("converged", F.col("reason") == "converged")
    listed = regime.isin(*unvalidated) if unvalidated else F.lit(False)
    return (done.withColumn("include", F.col("converged") | F.coalesce(listed & F.col("n_iters").isNotNull(), F.lit(False)))
            .withColumn("validated", F.col("converged")))


def mesh_quality(df: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """Adds ``errors`` (blocking) and ``advisories`` arrays for parsed mesh metrics.

    ``limits``: non_orthogonality_max, skewness_max, aspect_ratio_max, and optionally min_hex_fraction
    (0.999), target_cells_min, target_cells_max.
    """
    never = F.lit(False)
    blocking = [(F.col("max_non_orthogonality").isNull(), "non-orthogonality not found"), (F.col("max_skewness").isNull(), "skewness not found"),
                (F.col("max_non_orthogonality") >= limits["non_orthogonality_max"], "non-orthogonality"),
                (F.col("max_skewness") >= limits["skewness_max"], "skewness"), (F.col("max_aspect_ratio") >= limits["aspect_ratio_max"], "aspect ratio"),
                (F.col("hex_fraction") < limits.get("min_hex_fraction", 0.999), "hex fraction")]
    low, high = limits.get("target_cells_min"), limits.get("target_cells_max")
    soft = [((F.col("cells_total") < low) if low is not None else never, "cells below target"),
            ((F.col("cells_total") > high) if high is not None else never, "cells above target")]
    return df.withColumn("errors", ordered_reasons([(c, F.lit(t)) for c, t in blocking])).withColumn("advisories", ordered_reasons([(c, F.lit(t)) for c, t in soft]))


def tolerance_verdict(df: DataFrame, cl_tol: str = "Cl_tol", cd_tol: str = "Cd_tol") -> DataFrame:
    """Pass flag of the governing reference: a null error passes, NaN fails; defaults 5 and 10 percent."""
    def ok(error: str, tol: str, default: float) -> Column:
        e = F.col(error)
        return e.isNull() | (~F.isnan(e) & (F.abs(e) <= F.coalesce(F.col(tol), F.lit(default))))
    return df.withColumn("passed", ok("Cl_err_pct", cl_tol, 5.0) & ok("Cd_err_pct", cd_tol, 10.0))
