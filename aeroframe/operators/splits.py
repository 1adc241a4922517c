"""Train/test membership: frozen tables, stratified and k-fold assignment, set checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroframe.operators.ordering import row_numbers

HASH_CELLS = 65536


def membership_rows(split_lists: DataFrame) -> DataFrame:
    """Rows (name, array of ids) to one row per (name, sample_id)."""
    return split_lists.select("name", F.explode("ids").alias("sample_id"))


def passing_members(membership: DataFrame, flags: DataFrame) -> DataFrame:
    """Members whose flag is true: a semi join, nothing is copied onto them."""
    return membership.join(flags.filter("qa_pass").select("sample_id"), "sample_id", "left_semi")


def task_rows(dataset: DataFrame, membership: DataFrame, task: str, role: str, check: bool = True) -> DataFrame:
    """Dataset rows of a task and role; refuses a split that contains rows failing quality checks."""
    ids = membership.filter((F.col("task") == task) & (F.col("role") == role)).select("sample_id")
    rows = dataset.join(ids, "sample_id", "left_semi")
    if check and "qa_pass" in rows.columns and rows.filter(~F.coalesce("qa_pass", F.lit(False))).limit(1).count():
        raise ValueError(f"task {task}: the {role} split contains rows that failed quality checks")
    return rows


def overlap(membership: DataFrame, left: Column, right: Column) -> DataFrame:
    """Ids on both sides."""
    return membership.filter(left).select("sample_id").intersect(membership.filter(right).select("sample_id"))


def missing_from(membership: DataFrame, part: Column, whole: Column) -> DataFrame:
    """Ids of ``part`` that are not in ``whole``: empty for a subset."""
    return membership.filter(part).select("sample_id").exceptAll(membership.filter(whole).select("sample_id"))


def same_membership(a: DataFrame, b: DataFrame, name: str = "name") -> DataFrame:
    """Per name: ids only in ``a``, only in ``b`` (multiset difference), and whether the lists agree.

    One aggregate over both lists: a count per (name, id) and side.
    """
    both = a.select(name, "sample_id", F.lit(1).alias("s")).unionByName(b.select(name, "sample_id", F.lit(-1).alias("s")))
    per_id = both.groupBy(name, "sample_id").agg(F.sum("s").alias("d"))
    out = per_id.groupBy(name).agg(F.sum(F.greatest("d", F.lit(0))).alias("only_a"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("only_b"))
    return out.withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def split_summary(dataset: DataFrame, membership: DataFrame, flags: DataFrame) -> DataFrame:
    """Per task and role: kept rows, rows dropped by quality checks, ranges of angle and Re."""
    rows = membership.join(dataset.select("sample_id", "alpha_deg", "Re"), "sample_id").join(flags.select("sample_id", "qa_pass"), "sample_id")
    ok = F.col("qa_pass")
    pick = lambda c: F.when(ok, F.col(c))
    return rows.groupBy("task", "role").agg(
        F.count_if(ok).alias("n"), F.count_if(~ok).alias("dropped"), F.min(pick("alpha_deg")).alias("alpha_lo"), F.max(pick("alpha_deg")).alias("alpha_hi"),
        F.min(pick("Re")).alias("Re_lo"), F.max(pick("Re")).alias("Re_hi"))


def band_rules(rows: DataFrame, column: str, nominal: tuple[float, float], slack: float = 0.01) -> DataFrame:
    """One row: the training band, test rows inside it, and whether its edges fit one scale.

    ``rows`` has role and the column; the two edges divided by their nominal values must agree to ``slack``.
    """
    band = rows.filter(F.col("role") == "train").agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    inside = (F.col("role") == "test") & F.col(column).between(F.lit(band["lo"]), F.lit(band["hi"]))
    out = rows.agg(F.count_if(inside).alias("test_inside"))
    ratio = (band["lo"] / nominal[0]) / (band["hi"] / nominal[1])
    return out.select(F.lit(band["lo"]).alias("lo"), F.lit(band["hi"]).alias("hi"), "test_inside", (F.col("test_inside") == 0).alias("sharp_cut"),
                      F.lit(abs(ratio - 1) < slack).alias("edges_agree"))


def angle_rules(rows: DataFrame, column: str, lo: float, hi: float, slack: float = 1e-3) -> DataFrame:
    """One row: training rows inside [lo, hi] and test rows outside (lo, hi), to ``slack``."""
    train, test, v = F.col("role") == "train", F.col("role") == "test", F.col(column)
    return rows.agg(F.bool_and(F.when(train, v.between(lo - slack, hi + slack))).alias("train_inside"),
                    F.bool_and(F.when(test, (v < lo + slack) | (v > hi - slack))).alias("test_outside"))


# --- assignment by hash order ----------------------------------------------------------------------

def _hash_order(df: DataFrame, row_id: Sequence[str], seed: int, digest: Column | None = None) -> DataFrame:
    """Adds a shuffling hash ``_h`` and its uniform cell ``_b``: cells are even for any distribution of ids.

    ``digest`` is a hex digest to order by instead of the seeded 64-bit hash.
    """
    if digest is not None:
        return df.withColumn("_h", digest).withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    h = F.xxhash64(*[F.col(c) for c in row_id], F.lit(seed))
    return df.withColumn("_h", h).withColumn("_b", F.shiftrightunsigned("_h", 64 - HASH_CELLS.bit_length() + 1).cast("int"))


def stratified_split(df: DataFrame, stratum: str, row_id: str, fraction: float = 0.2, seed: int = 42, out: str = "role", digest: Column | None = None) -> DataFrame:
    """Marks round(fraction * n) rows of every stratum as test, in hash order."""
    numbered = row_numbers(_hash_order(df, [row_id], seed, digest), [stratum], "_b", ["_h", row_id], "_rn", total="_n")
    return numbered.withColumn(out, F.when(F.col("_rn") <= F.round(F.col("_n") * fraction), F.lit("test")).otherwise(F.lit("train"))).drop("_h", "_b", "_rn", "_n")


def fold_column(df: DataFrame, row_id: str, folds: int = 5, seed: int = 42, out: str = "fold", digest: Column | None = None) -> DataFrame:
    """Balanced shuffled folds 0..folds-1: sizes differ by at most one."""
    numbered = row_numbers(_hash_order(df, [row_id], seed, digest), [], "_b", ["_h", row_id], "_rn")
    return numbered.withColumn(out, F.pmod(F.col("_rn") - 1, F.lit(folds)).cast("int")).drop("_h", "_b", "_rn")


def latin_hypercube(boxes: DataFrame, dims: Sequence[str], seed: int = 42, group: str = "regime", n: str = "n", digest: Callable[[int], Column] | None = None) -> DataFrame:
    """One design row per (group, 0..n-1): every dimension has exactly one point per stratum.

    ``boxes`` has group, n and <dim>_lo / <dim>_hi.  The permutation of a dimension is the order of a
    seeded hash; each point is placed inside its stratum by a second hash. ``digest`` gives a hex digest of a row (group, i) for
    each number asked instead: k orders dimension k, 500 + k places its points.
    """
    points = boxes.withColumn("i", F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1)))
    for k, d in enumerate(dims):
        order = _hash_order(points, [group, "i"], seed * 1000 + k, digest(k) if digest else None)
        points = row_numbers(order, [group], "_b", ["_h", "i"], "_rn").drop("_h", "_b")
        jitter = F.pmod(F.xxhash64(F.col(group), F.col("i"), F.lit(seed * 1000 + 500 + k)), F.lit(1 << 30)) / float(1 << 30)
        if digest:
            jitter = F.conv(F.substring(digest(500 + k), 1, 7), 16, 10).cast("long") / float(1 << 28)
        unit = (F.col("_rn") - 1 + jitter) / F.col(n)
        points = points.withColumn(d, F.col(f"{d}_lo") + unit * (F.col(f"{d}_hi") - F.col(f"{d}_lo"))).drop("_rn")
    return points


def sequential_ids(df: DataFrame, group: str, position: str, out: str = "case_id") -> DataFrame:
    """0-based id over groups laid end to end, in (group, position) order: group sizes prefix-summed."""
    from pyspark.sql.window import Window
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(group, (F.sum("_n").over(Window.orderBy(group)) - F.col("_n")).alias("_start"))
    local = row_numbers(df.withColumn("_b", F.floor(F.col(position) / 65536)), [group], "_b", [position], "_rn")
    return local.join(starts, group).withColumn(out, (F.col("_start") + F.col("_rn") - 1).cast("long")).drop("_start", "_rn", "_b")
