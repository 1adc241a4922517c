"""Ordered computations that never sort one whole group in one task.

Ranks, exact quantiles, running sums and forward fills need an order inside a group, and one group may
hold a large share of all rows.  Every operator here splits a group into ordered *buckets*, works inside
(group, bucket) cells, and carries one summary row per cell across the buckets of a group.  The only
windows over a whole group run on those summaries, of which a group has at most one per bucket.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_BUCKETS = 16384
HOT_KEYS = 256          # size bound of the broadcast side in `lookup_join`
SALTS = 1024
CUT_SAMPLE = 0.1
CELL_ROWS = 500_000     # rows of a cell that `cell_count` aims at


# --- joins that keep null keys and hot keys safe ---------------------------------------------------

def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null matches null; the key columns of ``left`` are kept.

    Rows that all have their line in a table of cells are joined "left": Spark may then send the table to every task, but never the
    rows, whose size it reads from files and underestimates where values repeat or arrays were exploded."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    if not keys:
        # both sides are whole-table aggregates of exactly one row: a key of 0 that is not folded away
        zero = F.pmod(F.spark_partition_id(), F.lit(1))
        left, renamed = left.withColumn("_one", zero), renamed.withColumn("_r__one", zero)
        return left.join(renamed, F.col("_one") == F.col("_r__one"), how).drop("_one", "_r__one")
    cond = None
    for k in keys:
        term = left[k].eqNullSafe(renamed[f"_r_{k}"])
        cond = term if cond is None else cond & term
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def merge_join(left: DataFrame, right: DataFrame, keys: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """A join whose sides may both be large: sorted and merged, never sent whole to the driver and every task.

    Spark takes a table made by exploding arrays for as small as the file it came from, also after a cut of lineage."""
    return left.join(right.hint("merge"), keys, how)


def lookup_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, drop_weight: bool = True) -> DataFrame:
    """Left-join a one-row-per-key ``table`` onto ``rows`` without sending a hot key to one task.

    ``weight`` is the number of rows a key stands for.  The ``HOT_KEYS`` heaviest keys are broadcast (a
    fixed count, whatever the data size); rows they match are spread over salts in the second, shuffled
    join, which serves every remaining key.
    """
    keys = list(keys)
    values = [c for c in table.columns if c not in keys and (c != weight or not drop_weight)]
    packed = table.select(*keys, F.col(weight).alias("_w"), F.struct(*values).alias("_v"))
    hot = packed.orderBy(F.desc("_w"), *keys).limit(HOT_KEYS)
    cond = [rows[k].eqNullSafe(F.col(f"_h_{k}")) for k in keys]
    hot_side = F.broadcast(hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.col("_v").alias("_hv")))
    first = rows.join(hot_side, _all(cond), "left").drop(*[f"_h_{k}" for k in keys])
    # the salt repeats when a task is retried; the task number keeps equal rows of different tasks apart
    salt = F.pmod(F.xxhash64(*[F.col(c) for c, t in rows.dtypes if "map<" not in t], F.spark_partition_id()), F.lit(SALTS)) + 1
    spread = first.withColumn("_salt", F.when(F.col("_hv").isNull(), F.lit(0)).otherwise(salt).cast("int"))
    cold = packed.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_v").alias("_cv"),
                         F.pmod("_w", F.lit(1)).cast("int").alias("_c_salt"))   # 0, but not foldable: stays a join key
    cond = [spread[k].eqNullSafe(F.col(f"_c_{k}")) for k in keys] + [F.col("_salt") == F.col("_c_salt")]
    joined = spread.join(cold, _all(cond), "left")
    value = F.coalesce("_hv", "_cv")
    return joined.select(*rows.columns, *[value[c].alias(c) for c in values])


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


# --- buckets ---------------------------------------------------------------------------------------

def bucket_count(df: DataFrame) -> int:
    return max(2, min(MAX_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def cell_count(df: DataFrame) -> int:
    """Number of cells for rows that are ranked one by one: as many as partitions, more where cells would exceed ``CELL_ROWS``. Counts the rows."""
    return min(MAX_BUCKETS, max(bucket_count(df), -(-df.count() // CELL_ROWS)))


class Cuts(list):
    """Sorted cut points; ``hot`` is true if some value may hold more than about two cells' share of rows.

    Such a value fills several neighbouring quantiles, so it shows up as a repeated one.
    """

    hot: bool = False


def value_splits(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> dict[str, Cuts]:
    """Cut points that split each numeric column into about equal shares: one pass, a bounded result.

    A group holding a third of the rows gets about a third of the cut points, whatever its value range.
    Only the cut points come from a sample of rows, as in any range partitioning; every row is placed.
    """
    n = buckets or bucket_count(df)
    found = df.sample(CUT_SAMPLE, 7).approxQuantile(list(columns), [i / n for i in range(1, n)], 1.0 / (4 * n))
    out = {}
    for c, qs in zip(columns, found or [[] for _ in columns]):
        finite = [q for q in qs if math.isfinite(q)]
        cuts = Cuts(sorted(set(finite)))
        cuts.hot = len(cuts) < len(qs)
        out[c] = cuts
    return out


def add_bucket(df: DataFrame, value: str, cuts: Sequence[float], out: str = "_b") -> DataFrame:
    """Index of the cell of ``value`` between sorted ``cuts``; NaN goes last, as Spark sorts it."""
    if not cuts:
        return df.withColumn(out, F.when(F.isnan(F.col(value).cast("double")), F.lit(1)).otherwise(F.lit(0)))
    tmp = f"_{out}_x"
    model = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=tmp, outputCol=out, handleInvalid="keep")
    return (model.transform(df.withColumn(tmp, F.col(value).cast("double")))
            .withColumn(out, F.col(out).cast("int")).drop(tmp))


# --- ordered value counts, ranks, exact quantiles --------------------------------------------------

def ordered_counts(df: DataFrame, groups: Sequence[str], value: str, cuts: Sequence[float] | None = None) -> DataFrame:
    """One row per (group, distinct value): ``n``, ``before`` (rows with a smaller value), ``total``.

    Equal values are combined before the first shuffle, so a value shared by many rows is one row here.
    """
    groups = list(groups)
    present = df.select(*groups, value).filter(F.col(value).isNotNull())
    cuts = value_splits(present, [value])[value] if cuts is None else cuts
    counts = present.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    cells = add_bucket(counts, value, cuts)
    offsets = _cell_starts(cells.groupBy(*groups, "_b").agg(F.sum("n").alias("_cell")), groups).drop("_cell")
    within = Window.partitionBy(*groups, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (join_null_safe(cells, offsets, [*groups, "_b"], "left")
            .select(*groups, value, "n",
                    (F.col("_start") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("before"), "total"))


def _cell_starts(cells: DataFrame, groups: Sequence[str], cell: str = "_b") -> DataFrame:
    """Rows before each (group, cell) and the group's total; ``cells`` has a count ``_cell``."""
    across = Window.partitionBy(*groups)
    return cells.select(*groups, cell, "_cell", (F.sum("_cell").over(across.orderBy(cell)) - F.col("_cell")).alias("_start"), F.sum("_cell").over(across).alias("total"))


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float],
                    cuts: Sequence[float] | None = None) -> DataFrame:
    """Linear-interpolated exact quantiles of one column per group, named by the keys of ``probs``."""
    return selected_quantiles(df, groups, {value: probs}, None if cuts is None else {value: cuts})


def long_cells(df: DataFrame, groups: Sequence[str], cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """groups, _c (which column), _b (cell), _v: one row for each non-null value of each column of ``cuts``."""
    celled = df.select(*groups, *[F.col(c).alias(f"_v{i}") for i, c in enumerate(cuts)])
    for i, cut in enumerate(cuts.values()):
        celled = add_bucket(celled, f"_v{i}", cut, f"_b{i}")
    items = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(f"_b{i}").alias("_b"), F.col(f"_v{i}").cast("double").alias("_v")) for i in range(len(cuts))])
    return celled.select(*groups, F.explode(items).alias("_i")).select(*groups, "_i.*").filter(F.col("_v").isNotNull())


def selected_quantiles(df: DataFrame, groups: Sequence[str], wanted: Mapping[str, Mapping[str, float]], cuts: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """Linear-interpolated exact quantiles of several columns at once: one row per group, a column per name.

    ``wanted`` maps a column to its names and probabilities. One pass counts the cells of all columns (map-side combined); a second
    keeps the values of the few cells that hold a wanted position, equal ones combined before the shuffle, and
    orders those. A group without a value in any column has no row; one without values in a column has nulls there.
    """
    groups, columns = list(groups), list(wanted)
    cuts = {c: cuts[c] for c in columns} if cuts else value_splits(df.select(*columns), columns)
    long = long_cells(df, groups, cuts)
    by = [*groups, "_c"]
    starts = _cell_starts(long.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_cell")), by)

    def inside(i: int, index: Column, start: str, size: str) -> Column:
        return (F.col("_c") == i) & (F.col(start) <= index) & (index < F.col(start) + F.col(size))

    places = [(i, name, float(q)) for i, c in enumerate(columns) for name, q in wanted[c].items()]
    index = lambda q, f: f(F.lit(q) * (F.col("total") - 1))
    here = None
    for i, _, q in places:
        for f in (F.floor, F.ceil):
            one = inside(i, index(q, f), "_start", "_cell")
            here = one if here is None else here | one
    cells = starts.filter(here).drop("_cell")
    # a left join can only send the cells to tasks, not the rows; rows of other cells fall into one line a group and go after the count
    held = join_null_safe(long, cells, [*by, "_b"], "left")
    mine = F.col("_start").isNotNull()
    counts = (held.groupBy(*by, F.when(mine, F.col("_b")).alias("_b"), F.when(mine, F.col("_v")).alias("_v"))
              .agg(F.count(F.lit(1)).alias("n"), F.first("_start").alias("_start"), F.first("total").alias("total")).filter(mine))
    within = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.col("_start") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    aggs, outs = [], []
    for i, name, q in places:
        for side, f in (("lo", F.floor), ("hi", F.ceil)):
            aggs.append(F.max(F.when(inside(i, index(q, f), "before", "n"), F.col("_v"))).alias(f"_{name}_{side}"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        at = F.lit(q) * (F.col(f"_total{i}") - 1)
        outs.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    totals = [F.max(F.when(F.col("_c") == i, F.col("total"))).alias(f"_total{i}") for i in range(len(columns))]
    return placed.groupBy(*groups).agg(*aggs, *totals).select(*groups, *outs)


def average_ranks(df: DataFrame, groups: Sequence[str], value: str, out: str, cuts: Sequence[float] | None = None) -> DataFrame:
    """Table (group, value) -> tie-averaged rank ``out``, with ``n`` and ``total``."""
    return ordered_counts(df, groups, value, cuts).select(
        *groups, value, (F.col("before") + (F.col("n") + 1) / 2.0).alias(out), "n", "total")


def rank_in_cells(rows: DataFrame, counted: DataFrame, groups: Sequence[str], value: str, cell: str, out: str, cells: int = 0) -> DataFrame:
    """Adds the tie-averaged rank ``out`` and the group size ``total`` to every row.

    For columns without hot values (see ``Cuts``): equal values share a cell, so a cell stays small.
    ``counted`` is any table with the same (group, cell) rows: cells are counted there. Cells are dealt out over a fixed number of
    partitions, ``cells`` or more: adaptive ones are merged by their compressed bytes, of which repeated values have next to none.
    """
    starts = _cell_starts(counted.groupBy(*groups, cell).agg(F.count(F.lit(1)).alias("_cell")), groups, cell).drop("_cell")
    within = Window.partitionBy(*groups, cell).orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*groups, cell, value))
    parts = max(cells, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (join_null_safe(rows, starts, [*groups, cell], "left").repartition(parts, *groups, cell)
            .withColumn(out, F.col("_start") + F.rank().over(within) + (ties - 1) / 2.0).drop(cell, "_start"))


def spearman(df: DataFrame, groups: Sequence[str], a: str, b: str, out: str = "spearman", cuts: dict[str, Cuts] | None = None) -> DataFrame:
    """Rank correlation per group: null where either column is constant.

    Without hot values rows are ranked in their cells.  With one, equal pairs are combined and ranks come
    from the table of distinct values, joined so that a hot value is spread.
    """
    groups = list(groups)
    both = df.select(*groups, F.col(a).alias("_va"), F.col(b).alias("_vb")).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    cuts = cuts or value_splits(df, [a, b], cell_count(df))
    ca, cb = cuts[a], cuts[b]
    if ca.hot or cb.hot:
        pairs = both.groupBy(*groups, "_va", "_vb").agg(F.count(F.lit(1)).alias("_n"))
        ranked = lookup_join(pairs, average_ranks(both, groups, "_va", "_ra", ca), [*groups, "_va"], "n")
        ranked = lookup_join(ranked, average_ranks(both, groups, "_vb", "_rb", cb).drop("total"), [*groups, "_vb"], "n")
    else:
        celled = add_bucket(add_bucket(both, "_va", ca, "_ca"), "_vb", cb, "_cb")
        ranked = rank_in_cells(celled.withColumn("_n", F.lit(1)), celled, groups, "_va", "_ca", "_ra", len(ca) + 1).drop("total")
        ranked = rank_in_cells(ranked, celled, groups, "_vb", "_cb", "_rb", len(cb) + 1)
    mid = (F.col("total") + 1) / 2.0
    da, db, n = F.col("_ra") - mid, F.col("_rb") - mid, F.col("_n")
    return (ranked.groupBy(*groups)
            .agg(F.sum(n * da * db).alias("_ab"), F.sum(n * da * da).alias("_aa"), F.sum(n * db * db).alias("_bb"))
            .select(*groups, F.when((F.col("_aa") > 0) & (F.col("_bb") > 0),
                                    F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb"))).alias(out)))


# --- running computations over pre-bucketed rows ---------------------------------------------------

def running_sum(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` in (bucket, order) order inside each key."""
    keys = list(keys)
    rows = df.withColumn("_val", value)
    starts = (rows.groupBy(*keys, bucket).agg(F.sum("_val").alias("_cell"))
              .select(*keys, bucket, F.coalesce(
                  F.sum("_cell").over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)),
                  F.lit(0)).alias("_start")))
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (join_null_safe(rows, starts, [*keys, bucket], "left")
            .withColumn(out, F.col("_start") + F.coalesce(F.sum("_val").over(within), F.lit(0)))
            .drop("_val", "_start"))


def row_numbers(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], out: str, total: str | None = None) -> DataFrame:
    """1-based position of each row in (bucket, order) order inside each key; optionally the key's size."""
    keys = list(keys)
    across = Window.partitionBy(*keys)
    cells = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_cell"))
    starts = cells.select(*keys, bucket,
                          (F.sum("_cell").over(across.orderBy(bucket)) - F.col("_cell")).alias("_start"),
                          F.sum("_cell").over(across).alias(total or "_total"))
    within = Window.partitionBy(*keys, bucket).orderBy(*order)
    joined = join_null_safe(df, starts, [*keys, bucket], "left")
    numbered = joined.withColumn(out, F.col("_start") + F.row_number().over(within)).drop("_start")
    return numbered if total else numbered.drop("_total")


def forward_fill(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: Column, out: str,
                 inclusive: bool = True) -> DataFrame:
    """Last non-null ``value`` up to (``inclusive``) or before this row, in (bucket, order) order per key."""
    keys = list(keys)
    rows = df.withColumn("_val", value)
    position = F.struct(*order)
    tails = (rows.filter(F.col("_val").isNotNull()).groupBy(*keys, bucket).agg(F.max_by("_val", position).alias("_tail")))
    every = rows.select(*keys, bucket).distinct()
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = (join_null_safe(every, tails, [*keys, bucket], "left")
               .select(*keys, bucket, F.last("_tail", ignorenulls=True).over(before).alias("_carry")))
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return (join_null_safe(rows, carried, [*keys, bucket], "left")
            .withColumn(out, F.coalesce(F.last("_val", ignorenulls=True).over(within), F.col("_carry")))
            .drop("_val", "_carry"))


# --- per-group picks -------------------------------------------------------------------------------

def top_rows(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, position: str = "position") -> DataFrame:
    """First ``k`` rows per group.  A small ``k`` is cut inside every map task before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(position, F.row_number().over(w)).filter(F.col(position) <= k)


def first_of_duplicates(df: DataFrame, keys: Sequence[Column], row_id: str, out: str = "first_id") -> DataFrame:
    """Id of the first row sharing the rounded keys, null where this row is the first.

    The first id per key is a map-side aggregate; only keys that repeat are joined back, hot keys by
    broadcast, so a group of copies is never gathered.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select("*", *[k.alias(n) for k, n in zip(keys, names)])
    repeated = (keyed.groupBy(*names).agg(F.min(row_id).alias("_first"), F.count(F.lit(1)).alias("_copies"))
                .filter(F.col("_copies") > 1))
    joined = lookup_join(keyed, repeated, names, "_copies")
    return (joined.withColumn(out, F.when(F.col("_first") != F.col(row_id), F.col("_first")))
            .drop("_first", *names))
