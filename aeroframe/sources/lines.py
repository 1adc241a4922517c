"""Text files as ordered lines.

A file is read in splits like any other table.  A line's place is (block, seq): the byte offset of its
split and its order inside the split, so a log of any size is never one row or one task.  Running state
(zone titles, step numbers) is carried across blocks by ``operators.ordering``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aeroframe.functions import text
from aeroframe.operators.ordering import forward_fill, lookup_join, row_numbers, running_sum, top_rows
from aeroframe.session import written

PLACE = ("block", "seq")

# Patterns of the log lines, columns of a force history, and rename table of polar headers.
RESIDUAL = r"Solving for (\w+), Initial residual = ([-+0-9.eE]+), Final residual = ([-+0-9.eE]+)"
EXECUTION_TIME = r"ExecutionTime\s*=\s*([\d.eE+-]+)\s*s"
STEP_MARK = "Time = "
FATAL = "FOAM FATAL ERROR"
FORCE_COLUMNS = ("t", "Cm", "Cd", "Cl", "Cl_f", "Cl_r")
LEAST_FORCE_ROWS, TAIL_ROWS = 50, 200
POLAR_NAMES = {"alpha": "alpha_deg", "cl": "Cl", "cd": "Cd", "cdp": "Cdp", "cm": "Cm", "top_xtr": "x_trans_upper", "bot_xtr": "x_trans_lower"}
MESH_METRICS = {
    "max_non_orthogonality": r"Mesh non-orthogonality Max:\s*([0-9.eE+-]+)",
    "max_skewness": r"Max skewness =\s*([0-9.eE+-]+)",
    "max_aspect_ratio": r"Max aspect ratio[:=]\s*([0-9.eE+-]+)",
    "cells_total": r"cells:\s*([0-9]+)",
    "points_total": r"points:\s*([0-9]+)",
    "faces_total": r"faces:\s*([0-9]+)",
    "hexahedra": r"hexahedra:\s*([0-9]+)",
    "prisms": r"prisms:\s*([0-9]+)",
    "wedges": r"wedges:\s*([0-9]+)",
    "pyramids": r"pyramids:\s*([0-9]+)",
    "tet_wedges": r"tet wedges:\s*([0-9]+)",
    "tetrahedra": r"tetrahedra:\s*([0-9]+)",
    "polyhedra": r"polyhedra:\s*([0-9]+)",
}


def read_lines(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """(file, block, seq, line) of text files."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    df = reader.option("recursiveFileLookup", True).text(paths)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))


def lines_of(df: DataFrame, file: str, body: str) -> DataFrame:
    """Lines of a text column, for documents already held in a table."""
    return df.select(F.col(file).alias("file"), F.lit(0).cast("long").alias("block"), F.posexplode(F.split(body, "\r?\n")).alias("seq", "line"))


def _place() -> Column:
    return F.struct(*PLACE)


# --- zone tables -----------------------------------------------------------------------------------

def read_zones(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Numeric rows of zone-structured tables: file, block, seq, zone, values, bad.

    Comment, blank and ``variables`` lines are dropped.  A line before any zone belongs to 'default'
    (strict) or '' (tolerant).  A zone without a title gets 'zone' and the number of titles before it.  Tolerant reading skips lines that are not all numbers; strict reading keeps
    them with ``bad`` true, for ``refuse_bad``.
    """
    low = F.lower(F.trim("line"))
    kept = lines.withColumn("line", F.trim("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    is_zone = low.startswith("zone") if strict else F.col("line").rlike(r'(?i)^\s*zone\s*,\s*t\s*=\s*"[^"]*"')
    title = (F.when(F.contains("line", F.lit("=")), F.regexp_replace(F.trim(F.regexp_extract("line", r"^[^=]*=(.*)$", 1)), '^"+|"+$', "")) if strict
             else F.regexp_extract("line", r'(?i)^\s*zone\s*,\s*t\s*=\s*"([^"]*)"', 1))
    is_names = low.startswith("variables") if strict else F.col("line").rlike(r"(?i)^\s*variables\s*=")
    # lines are read, matched and marked once: titles, cells and rows are passes over what is written
    marked = written(kept.filter(~is_names).select("file", *PLACE, "line", is_zone.alias("_zone")), "zone-lines")
    # only zone lines are numbered: few, whatever the length of a file
    heads = marked.filter("_zone").withColumn("_title", title)
    first = F.row_number().over(Window.partitionBy("file", "_title").orderBy("block", "seq")) == 1
    so_far = F.sum((F.col("_title").isNull() | F.col("_first")).cast("int")).over(Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, -1))
    named = heads.withColumn("_first", first).withColumn("_title", F.coalesce("_title", F.concat(F.lit("zone"), F.coalesce(so_far, F.lit(0)).cast("string")))).drop("_first")
    every = marked.filter(~F.col("_zone")).withColumn("_title", F.lit(None).cast("string")).unionByName(named)
    titled = forward_fill(every, ["file"], "block", ["seq"], F.col("_title"), "zone").drop("_title")
    rows = titled.filter(~F.col("_zone")).withColumn("zone", F.coalesce("zone", F.lit("default" if strict else ""))).withColumn("values", text.numbers(F.col("line")))
    rows = rows.withColumn("bad", ~text.all_numeric(F.col("values")))
    return (rows if strict else rows.filter(~F.col("bad"))).select("file", "block", "seq", "zone", "values", "bad")


def refuse_bad(zones: DataFrame) -> DataFrame:
    """Fails the job on the first line that is not all numbers."""
    message = F.concat(F.lit("not a numeric row in "), F.col("file"))
    return zones.withColumn("values", F.when(F.col("bad"), F.raise_error(message).cast("array<double>")).otherwise(F.col("values"))).drop("bad")


def zone_columns(lines: DataFrame) -> DataFrame:
    """Clean column names declared by the last ``variables`` line of each file."""
    declared = lines.withColumn("_raw", F.regexp_extract("line", r"(?i)^\s*variables\s*=\s*(.+)$", 1)).filter(F.col("_raw") != "")
    return declared.groupBy("file").agg(F.max_by("_raw", _place()).alias("_raw")).select("file", text.column_names(F.col("_raw")).alias("columns"))


def zone_table(zones: DataFrame, names: Sequence[str], constants: dict[str, object] | None = None, zone: str | None = None, least: int | None = None) -> DataFrame:
    """Typed reference rows: leading values as ``names``, constant provenance columns, optional exact zone."""
    rows = zones.filter(F.col("zone") == zone) if zone is not None else zones
    rows = rows.filter(F.size("values") >= (least if least is not None else len(names)))
    typed = rows.select("file", "block", "seq", "zone", *[F.get("values", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return typed.withColumns({k: F.lit(v) for k, v in (constants or {}).items()})


def pressure_table(zones: DataFrame, source: str, re: float = 6.0e6, mach: float = 0.15) -> DataFrame:
    """x_c, Cp and the angle named in each zone title."""
    rows = zone_table(zones, ["x_c", "Cp"], {"source": source, "Re": re, "M": mach})
    return rows.withColumn("alpha_deg", text.alpha_in_title(F.col("zone")))


def surfaced_pressure_table(zones: DataFrame, constants: dict[str, object]) -> DataFrame:
    """x_c, y_c, Cp of a walk round the section; y_c >= 0 is the upper surface."""
    rows = zone_table(zones, ["x_c", "y_c", "Cp"], constants)
    return rows.withColumn("surface", F.when(F.col("y_c") >= 0.0, "upper").otherwise("lower"))


# --- solver output ---------------------------------------------------------------------------------

def force_history(lines: DataFrame) -> DataFrame:
    """Rows of force histories: file, block, seq and up to six named columns, by the width of the first row."""
    rows = lines.withColumn("line", F.trim("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("_v", text.numbers(F.col("line")))
    width = rows.groupBy("file").agg(F.min_by(F.least(F.size("_v"), F.lit(len(FORCE_COLUMNS))), _place()).alias("_width"), F.count(F.lit(1)).alias("_n"))
    wide = lookup_join(rows, width, ["file"], "_n")
    return wide.select("file", "block", "seq", *[F.when(F.col("_width") > i, F.get("_v", F.lit(i))).alias(c) for i, c in enumerate(FORCE_COLUMNS)])


def tail_stats(history: DataFrame, keys: Sequence[str] = ("file",), window: int = TAIL_ROWS, least: int = LEAST_FORCE_ROWS, order: Sequence[Column] | None = None,
               values: Sequence[str] = ("Cl", "Cd", "Cm")) -> DataFrame:
    """Mean and sample deviation of the last ``window`` rows; keys with fewer than ``least`` rows get an error.

    The tail is cut inside every map task before the shuffle.
    """
    order = order or [F.desc("block"), F.desc("seq")]
    sizes = history.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_iters"))
    tail = top_rows(history, keys, order, window, "_p").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_window"), *[f(c).alias(f"{c}_{s}") for c in values for s, f in (("mean", F.avg), ("std", F.stddev_samp))])
    return sizes.join(tail, list(keys)).withColumn("error", F.when(F.col("n_iters") < least, F.lit("too few force rows for a tail")))


def residual_steps(lines: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], is_mark: Column, field: Column, value: Column) -> DataFrame:
    """First value per (step, field) in long form: keys, step, field, value.

    A marker line starts a step; markers with no field lines before the next one make no step, and field
    lines before any marker make the first step.  A step therefore starts at a field line whose previous
    marker or field line is a marker (or nothing).
    """
    keys = list(keys)
    kind = F.when(is_mark, F.lit(1)).when(field.isNotNull(), F.lit(0))
    relevant = lines.withColumn("_kind", kind).withColumn("_field", field).withColumn("_value", value).filter(F.col("_kind").isNotNull())
    before = forward_fill(relevant, keys, bucket, order, F.col("_kind"), "_before", inclusive=False)
    starts = (F.col("_kind") == 0) & (F.coalesce("_before", F.lit(1)) == 1)
    numbered = running_sum(before, keys, bucket, order, starts.cast("long"), "step").filter(F.col("_kind") == 0)
    return numbered.groupBy(*keys, "step", F.col("_field").alias("field")).agg(F.min_by("_value", F.struct(bucket, *order)).alias("value"))


def residual_history(lines: DataFrame) -> DataFrame:
    """Initial residuals of solver logs, first of each field per step: file, step, field, value."""
    # the JVM rejects text after a bare sign, so the value is cast safely
    hit = F.col("line").rlike(RESIDUAL)
    return residual_steps(lines, ["file"], "block", ["seq"], F.col("line").startswith(STEP_MARK), F.when(hit, F.regexp_extract("line", RESIDUAL, 1)),
                          F.when(hit, F.regexp_extract("line", RESIDUAL, 2).try_cast("double")))


def widen_steps(history: DataFrame, fields: Sequence[str], keys: Sequence[str] = ("file",)) -> DataFrame:
    """One row per step with one column per named field, null where a field was not solved."""
    return history.groupBy(*keys, "step").pivot("field", list(fields)).agg(F.first("value"))


def final_residuals(history: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Fields of the last step of each log as a map; fields missing there are left out."""
    last = history.groupBy(*keys, "step").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("residuals"))
    return last.groupBy(*keys).agg(F.max_by("residuals", "step").alias("residuals_final"))


def log_flags(lines: DataFrame) -> DataFrame:
    """Per log: last execution time and whether a fatal error was written."""
    seconds = text.last_metric(F.col("line"), EXECUTION_TIME)
    return lines.groupBy("file").agg(F.max_by(seconds, F.when(seconds.isNotNull(), _place())).alias("runtime_s"), F.bool_or(F.contains("line", F.lit(FATAL))).alias("fatal"))


def last_y_plus(lines: DataFrame, patch: str = "aerofoil") -> DataFrame:
    """Last well-formed y+ row of a patch: file, y_plus_min, y_plus_max, y_plus_mean."""
    tokens = F.split(F.trim("line"), r"\s+")
    rows = lines.filter(~F.trim("line").startswith("#")).withColumn("_t", tokens).filter((F.size("_t") >= 5) & (F.get("_t", F.lit(1)) == patch))
    three = [F.get("_t", F.lit(i)).try_cast("double") for i in (2, 3, 4)]
    good = rows.withColumn("_v", F.array(*three)).filter(text.all_numeric(F.col("_v")))
    return good.groupBy("file").agg(F.max_by("_v", _place()).alias("_v")).select("file", *[F.get("_v", F.lit(i)).alias(n) for i, n in enumerate(("y_plus_min", "y_plus_max", "y_plus_mean"))])


def mesh_metrics(lines: DataFrame) -> DataFrame:
    """The first value of each mesh-check metric per log, and the share of hexahedra."""
    aggs = []
    for name, pattern in MESH_METRICS.items():
        v = text.metric(F.col("line"), pattern)
        aggs.append(F.min_by(v, F.when(v.isNotNull(), _place())).alias(name))
    cells = F.coalesce("cells_total", F.lit(0.0))
    return lines.groupBy("file").agg(*aggs).withColumn("hex_fraction", F.when(cells > 0, F.try_divide(F.coalesce("hexahedra", F.lit(0.0)), cells)))


# --- polars, pressures, polygons -------------------------------------------------------------------

def polar_rows(lines: DataFrame) -> DataFrame:
    """Rows of polar tables as maps from column name to value.

    The header is the first line naming alpha, cl and cd; the dashed line after it and lines that are not
    all numbers are skipped.
    """
    low = F.lower("line")
    named = F.contains(low, F.lit("alpha")) & F.contains(low, F.lit("cl")) & F.contains(low, F.lit("cd"))
    heads = lines.filter(named).groupBy("file").agg(F.min(_place()).alias("_at"), F.min_by(F.split(F.trim(low), r"\s+"), _place()).alias("_names"))
    body = lines.join(heads, "file").filter(_place() > F.col("_at")).withColumn("_v", text.numbers(F.col("line"))).filter((F.trim("line") != "") & text.all_numeric(F.col("_v")))
    renames = F.create_map(*[F.lit(x) for kv in POLAR_NAMES.items() for x in kv])
    names = F.transform(F.slice("_names", F.lit(1), F.size("_v")), lambda n: F.coalesce(renames[n], n))
    return body.select("file", *PLACE, F.map_from_arrays(names, F.slice("_v", F.lit(1), F.size(names))).alias("row"))


def pressure_rows(lines: DataFrame) -> DataFrame:
    """Two-column pressure text: file, block, seq, x_c, Cp; comments, names and malformed lines skipped."""
    s = F.trim("line")
    rows = lines.filter((s != "") & ~s.startswith("#") & ~F.lower(s).startswith("variables")).withColumn("_v", text.numbers(F.col("line")))
    return rows.select("file", *PLACE, F.get("_v", F.lit(0)).alias("x_c"), F.get("_v", F.lit(1)).alias("Cp")).filter(F.col("x_c").isNotNull() & F.col("Cp").isNotNull())


def surface_samples(lines: DataFrame, params: DataFrame, key: Column) -> DataFrame:
    """Raw surface samples to x_c and Cp: first and last token; Cp = p / (U^2 / 2) with U = Re nu.

    ``params``: case_id, Re, nu (null: the default viscosity).
    """
    from aeroframe.functions.physics import LEGACY_NU, dynamic_pressure
    s = F.trim("line")
    rows = lines.filter((s != "") & ~s.startswith("#")).withColumn("_v", text.numbers(F.col("line"))).withColumn("case_id", key)
    placed = rows.join(params.select("case_id", (F.col("Re") * F.coalesce("nu", F.lit(LEGACY_NU))).alias("U_inf")), "case_id")
    return placed.select("case_id", *PLACE, F.get("_v", F.lit(0)).alias("x_c"), (F.element_at("_v", F.lit(-1)) / dynamic_pressure(F.col("U_inf"))).alias("Cp"), "U_inf")


def polygon_points(lines: DataFrame, least: int = 10) -> DataFrame:
    """Two-column polygons: file, pos, x, y, error; a repeated closing point is dropped.

    A file with fewer than ``least`` points, or a row without exactly two numbers, has an error on its rows.
    """
    rows = lines.filter((F.trim("line") != "") & ~F.trim("line").startswith("#")).withColumn("_v", text.numbers(F.col("line")))
    numbered = row_numbers(rows, ["file"], "block", ["seq"], "pos", total="_n")
    point = F.struct(F.get("_v", F.lit(0)).alias("x"), F.get("_v", F.lit(1)).alias("y"))
    firsts = rows.groupBy("file").agg(F.min_by(point, _place()).alias("_first"), F.bool_and((F.size("_v") == 2) & text.all_numeric(F.col("_v"))).alias("_shaped"))
    from aeroframe.functions.physics import is_close
    at = numbered.join(firsts, "file").withColumn("x", F.get("_v", F.lit(0))).withColumn("y", F.get("_v", F.lit(1)))
    closing = (F.col("pos") == F.col("_n")) & is_close(F.col("_first.x"), F.col("x")) & is_close(F.col("_first.y"), F.col("y"))
    error = F.when(~F.col("_shaped"), F.lit("needs two columns of numbers")).when(F.col("_n") < least, F.lit("too few points"))
    return at.withColumn("error", error).filter(F.col("error").isNotNull() | ~closing).select("file", (F.col("pos") - 1).alias("pos"), "x", "y", "error")
