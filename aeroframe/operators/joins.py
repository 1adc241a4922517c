"""Joins the reference work needs beyond plain equi-joins.

Interpolation and nearest-value lookups bracket each query between its two neighbours in an ordered cell
(see ``ordering``), so they never pair a query with every knot of its group.  Tolerance and range joins
hash both sides on grid cells as wide as the tolerance and check only neighbouring cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aeroframe.operators.ordering import add_bucket, join_null_safe, lookup_join, selected_quantiles, value_splits
from aeroframe.session import written


class RepeatedKeyError(ValueError):
    """A side of a validated join repeats a key."""


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def one_to_one(left: DataFrame, right: DataFrame | None, key: str, defaults: Mapping[str, Column], validate: bool = True) -> DataFrame:
    """Left join of a side table that must have unique keys on both sides.

    Without a side table the ``defaults`` stand in for its columns.
    """
    if right is None:
        return left.withColumns(dict(defaults))
    if validate:
        for name, side in (("left", left), ("right", right)):
            if repeated_keys(side.select(key), [key]).limit(1).count():
                raise RepeatedKeyError(f"{key} repeats on the {name} side")
    return left.join(right, key, "left")


def snapshot_compare(new: DataFrame, old: DataFrame, key: str, columns: Sequence[str],
                     rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """Per column: rows missing on a side, rows that differ beyond tolerance, largest, mean and median difference.

    One full outer join on the key, whose differences are written; one aggregate and one selection of all medians read them.
    """
    a = new.select(F.col(key).alias("_ka"), *[F.col(c).cast("double").alias(f"a_{c}") for c in columns])
    b = old.select(F.col(key).alias("_kb"), *[F.col(c).cast("double").alias(f"b_{c}") for c in columns])
    joined = a.join(b, F.col("_ka") == F.col("_kb"), "full_outer")
    both = written(joined.select(F.col("_ka").isNotNull().alias("_ka"), F.col("_kb").isNotNull().alias("_kb"), *[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"d_{c}") for c in columns],
                                 *[(rtol * F.abs(F.col(f"b_{c}")) + atol).alias(f"t_{c}") for c in columns]), "snapshot-gaps")
    aggs = [F.count_if(~F.col("_ka")).alias("only_old"), F.count_if(~F.col("_kb")).alias("only_new")]
    for c in columns:
        gap = F.col(f"d_{c}")
        within = gap <= F.col(f"t_{c}")
        matched = F.col("_ka") & F.col("_kb")
        aggs += [F.count_if(matched & ~F.coalesce(within, F.lit(False))).alias(f"n_{c}"), F.max(gap).alias(f"m_{c}"),
                 F.avg(gap).alias(f"g_{c}")]
    wide = join_null_safe(both.agg(*aggs), selected_quantiles(both, [], {f"d_{c}": {f"q_{c}": 0.5} for c in columns}), [], "left")
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n_different"),
                                 F.col(f"m_{c}").alias("max_difference"), F.col(f"g_{c}").alias("mean_difference"), F.col(f"q_{c}").alias("median_difference")) for c in columns])
    return wide.select("only_new", "only_old", F.explode(entries).alias("e")).select("e.*", "only_new", "only_old")


# --- filters before a shuffle -----------------------------------------------------------------------

#: Keys of two longs that are sent to every task as they are, the most bytes of a Bloom filter sent instead, and those of one of its blocks.
SENT_KEYS, FILTER_BYTES, FILTER_BLOCK = 200_000, 64 << 20, 256 << 10


def _places(pdf: pd.DataFrame, bits: int, hashes: int) -> np.ndarray:
    """Bits of each key (two longs) in the filter: rows x hashes."""
    a, b = (pdf.iloc[:, i].to_numpy(np.int64).view(np.uint64) for i in (0, 1))
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15) + b
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
        step = (h >> np.uint64(17)) | np.uint64(1)
        return np.stack([(h + np.uint64(i) * step) % np.uint64(bits) for i in range(hashes)], axis=1)


def bloom_filter(keys: DataFrame, n: int, most_bytes: int = FILTER_BYTES, hashes: int = 4) -> np.ndarray:
    """Bytes of a Bloom filter of the two long columns of ``keys``: tasks list the bits to set, each block is put together in a group
    of its own, and the driver lays the blocks side by side.

    10 bits a key, as far as ``most_bytes`` allow; a fuller filter lets more rows pass, never fewer."""
    size = int(min(most_bytes, max(1024, n * 10 // 8)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.unique(_places(pdf, size * 8, hashes)).astype(np.int64)
            block, first = np.unique(at // (8 * FILTER_BLOCK), return_index=True)
            bits = np.split((at % (8 * FILTER_BLOCK)).astype(np.int32), first[1:])
            yield pd.DataFrame({"block": block.astype(np.int32), "bits": [b.tobytes() for b in bits]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros(FILTER_BLOCK, np.uint8)
        for bits in pdf["bits"]:
            at = np.frombuffer(bits, np.int32)
            np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "bytes": [table.tobytes()]})

    out = np.zeros(-(-size // FILTER_BLOCK) * FILTER_BLOCK, np.uint8)
    for r in keys.mapInPandas(run, "block int, bits binary").groupBy("block").applyInPandas(join, "block int, bytes binary").toLocalIterator():
        out[r.block * FILTER_BLOCK:(r.block + 1) * FILTER_BLOCK] = np.frombuffer(r.bytes, np.uint8)
    return out[:size]


def likely_in(rows: DataFrame, keys: DataFrame, on: Sequence[str], sent_keys: int = SENT_KEYS, most_bytes: int = FILTER_BYTES) -> DataFrame:
    """Rows of ``rows`` whose two long columns ``on`` may be among ``keys``: all that are, and few that aren't.

    To be called before a join that shuffles a large table for a small share of its rows. Keys of a counted, small number are
    broadcast; more are sent as a Bloom filter of bounded size. ``keys`` is read twice: pass a written or cut table."""
    on = list(on)
    wanted = keys.select(*[F.col(c).cast("long").alias(c) for c in on]).distinct()
    n = wanted.count()
    if n <= sent_keys:
        return rows.join(F.broadcast(wanted), on, "left_semi")
    held = rows.sparkSession.sparkContext.broadcast(bloom_filter(wanted, n, most_bytes))

    @F.pandas_udf("boolean")
    def inside(a: pd.Series, b: pd.Series) -> pd.Series:
        table = held.value
        at = _places(pd.DataFrame({"a": a, "b": b}), len(table) * 8, 4)
        return pd.Series(((table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1))

    whole = rows.filter(F.col(on[0]).isNotNull() & F.col(on[1]).isNotNull())
    return whole.filter(inside(*[F.col(c).cast("long") for c in on]))


# --- ordered neighbours ----------------------------------------------------------------------------

def bracket(points: DataFrame, knots: DataFrame, by: Sequence[str], q: str, x: str, values: Sequence[str]) -> DataFrame:
    """For each distinct (by, q): the last knot with x <= q and the first with x > q, as structs.

    ``knots`` must be unique in (by, x).  Returns by, q, ``n`` (query rows), ``left`` and ``right`` structs
    with fields x and ``values``.
    """
    by = list(by)
    # cut where either side is dense, so neither crowds into one cell
    cuts = sorted({*value_splits(knots, [x])[x], *value_splits(points, [q])[q]})
    distinct = points.filter(F.col(q).isNotNull()).groupBy(*by, q).agg(F.count(F.lit(1)).alias("n"))
    knot = F.struct(F.col(x).cast("double").alias("x"), *[F.col(v) for v in values])
    k = knots.filter(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("_at"), knot.alias("_knot"), F.lit(None).cast("long").alias("n"))
    p = distinct.select(*by, F.col(q).cast("double").alias("_at"), F.lit(None).cast(k.schema["_knot"].dataType).alias("_knot"), "n")
    both = add_bucket(k.unionByName(p), "_at", cuts)
    # one summary row per (by, cell): its first and last knot, carried to the neighbouring cells
    ends = both.groupBy(*by, "_b").agg(F.min_by("_knot", F.when(F.col("_knot").isNotNull(), F.col("_at"))).alias("_first"),
                                       F.max_by("_knot", F.when(F.col("_knot").isNotNull(), F.col("_at"))).alias("_last"))
    # looking ahead is looking back in reverse order: a frame that ends at the last row is quadratic
    back = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*by, "_b", F.last("_last", True).over(back).alias("_before"), F.last("_first", True).over(ahead).alias("_after"))
    # a knot at the same place as a query sorts first, so it is the query's left neighbour
    up = Window.partitionBy(*by, "_b").orderBy("_at", F.col("_knot").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by, "_b").orderBy(F.desc("_at"), F.col("_knot").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    near = join_null_safe(both, carry, [*by, "_b"], "left").select(
        *by, "_at", "_knot", "n", F.coalesce(F.last("_knot", True).over(up), F.col("_before")).alias("left"),
        F.coalesce(F.last("_knot", True).over(down), F.col("_after")).alias("right"))
    return near.filter(F.col("_knot").isNull()).select(*by, F.col("_at").alias(q), "n", "left", "right")


def interpolate(points: DataFrame, knots: DataFrame, by: Sequence[str], q: str, x: str, values: Sequence[str]) -> DataFrame:
    """Adds ``<value>_at`` columns: piecewise-linear in the knots of the same group, clamped at both ends.

    A NaN query gives NaN; knots at NaN are no knots."""
    typed = points.withColumn(q, F.col(q).cast("double"))
    b = bracket(typed, knots.filter(~F.isnan(F.col(x).cast("double"))), by, q, x, values)
    lx, rx = F.col("left.x"), F.col("right.x")
    out = []
    for v in values:
        lv, rv = F.col(f"left.{v}"), F.col(f"right.{v}")
        between = lv + (rv - lv) / (rx - lx) * (F.col(q) - lx)
        out.append(F.when(F.isnan(q), F.lit(float("nan"))).when(F.col("left").isNull(), rv).when(F.col("right").isNull(), lv).otherwise(between).alias(f"{v}_at"))
    return lookup_join(typed, b.select(*by, q, "n", *out), [*by, q], "n")


def nearest(points: DataFrame, reference: DataFrame, by: Sequence[str], q: str, x: str, rank: str,
            values: Sequence[str], tolerance: float) -> DataFrame:
    """Adds ``near_<x>`` and ``near_<value>`` of the closest reference row within ``tolerance``, else null.

    Ties go to the smaller ``rank`` (reference order); repeated x keep their first row.
    """
    unique = reference.groupBy(*by, x).agg(F.min_by(F.struct(rank, *values), rank).alias("_row")).select(*by, x, "_row.*")
    typed = points.withColumn(q, F.col(q).cast("double"))
    b = bracket(typed, unique, by, q, x, [rank, *values])
    dl, dr = F.col(q) - F.col("left.x"), F.col("right.x") - F.col(q)
    take_left = F.col("right").isNull() | (dl < dr) | ((dl == dr) & (F.col(f"left.{rank}") < F.col(f"right.{rank}")))
    pick = F.when(F.col("left").isNotNull() & take_left, F.col("left")).otherwise(F.col("right"))
    held = b.withColumn("_pick", pick).withColumn("_pick", F.when(F.abs(F.col(q) - F.col("_pick.x")) <= tolerance, F.col("_pick")))
    table = held.select(*by, q, "n", F.col("_pick.x").alias(f"near_{x}"), *[F.col(f"_pick.{v}").alias(f"near_{v}") for v in values])
    return lookup_join(typed, table, [*by, q], "n")


# --- tolerance and range joins ---------------------------------------------------------------------

def first_match(points: DataFrame, reference: DataFrame, by: Sequence[str], q: str, x: str, rank: str,
                values: Sequence[str], atol: float, rtol: float = 1e-5) -> DataFrame:
    """Adds ``match_<value>`` of the first reference row (by ``rank``) with abs(q - x) <= atol + rtol*abs(x).

    Each reference row is listed in every cell its tolerance reaches; a query looks into one cell.  Within
    a cell the candidates of a query are reduced to the first one before anything is kept.
    """
    by = list(by)
    width = max(atol, 1e-12)
    reach = F.lit(atol) + F.lit(rtol) * F.abs(F.col("_x"))
    listed = (reference.select(*by, F.col(x).cast("double").alias("_x"), F.col(rank).alias("_rank"), F.struct(*values).alias("_row"))
              .withColumn("_cell", F.explode(F.sequence(F.floor((F.col("_x") - reach) / width), F.floor((F.col("_x") + reach) / width)))))
    distinct = (points.filter(F.col(q).isNotNull()).groupBy(*by, q).agg(F.count(F.lit(1)).alias("n"))
                .withColumn("_cell", F.floor(F.col(q).cast("double") / width)))
    near = join_null_safe(distinct, listed, [*by, "_cell"]).filter(F.abs(F.col(q) - F.col("_x")) <= reach)
    table = (near.groupBy(*by, q).agg(F.min_by("_row", "_rank").alias("_row"), F.first("n").alias("n"))
             .select(*by, q, "n", *[F.col(f"_row.{v}").alias(f"match_{v}") for v in values]))
    return lookup_join(points, table, [*by, q], "n")


def _slack(q: Column, band: Column) -> Column:
    """More than the rounding of an end of the band, much less than the band."""
    return F.lit(1e-9) * (F.abs(q) + F.abs(band))


def _in_cells(rows: DataFrame, queries: DataFrame, by: Sequence[str], bands: Mapping[str, tuple[str, Column, float]], finer: int = 1) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows with their cell, queries once in each cell their band reaches, and the names both share.

    The largest band sets the cell width of a coordinate, that of the first is ``finer`` times smaller. Cells are listed a little
    beyond the band, as its ends are rounded and the filter is not.
    """
    left, right, keys = rows, queries, list(by)
    for i, (c, (qc, band, widest)) in enumerate(bands.items()):
        width = widest / finer if i == 0 else widest
        left = left.withColumn(f"_cell{i}", F.floor(F.col(c) / width))
        right = right.withColumn(f"_cell{i}", F.explode(F.sequence(F.floor((F.col(qc) - band - _slack(F.col(qc), band)) / width), F.floor((F.col(qc) + band + _slack(F.col(qc), band)) / width))))
        keys.append(f"_cell{i}")
    return left, right, keys


def _within(paired: DataFrame, bands: Mapping[str, tuple[str, Column, float]]) -> DataFrame:
    for c, (qc, band, _) in bands.items():
        paired = paired.filter(F.abs(F.col(c) - F.col(qc)) <= band)
    return paired


def range_join(rows: DataFrame, queries: DataFrame, by: Sequence[str], bands: Mapping[str, tuple[str, Column, float]]) -> DataFrame:
    """Pairs of a row and a query whose coordinates differ by no more than the query's band.

    ``bands`` maps a row column to (query column, band expression over query columns, largest band).  Each query is listed
    in the cells its band reaches, each row sits in one cell, so this is an equi-join with a residual filter.
    """
    left, right, keys = _in_cells(rows, queries, by, bands)
    return _within(left.join(right, keys), bands).drop(*[k for k in keys if k.startswith("_cell")])


#: Cells with their sums that are sent to every task; more meet their queries in a merge join.
SENT_CELLS = 50_000
#: Pairs that one slice of a cell compares, the rows it holds at most, and the queries that meet its rows at a time.
SLICE_PAIRS, SLICE_ROWS, CHUNK = 20_000_000, 500_000, 128


def range_pairs(rows: DataFrame, queries: DataFrame, by: Sequence[str], bands: Mapping[str, tuple[str, Column, float]], finer: int = 4) -> DataFrame:
    """``range_join`` for results much larger than both inputs: pairs are made in an order that columnar files hold in few bytes.

    Rows of a cell follow each other in order of their coordinates, last one first (name those with few values last), and meet
    ``CHUNK`` like queries at a time. So a row is a run of its column, and the queries of a row repeat those of the row before,
    near enough for a page's codec to see. Cells are counted first. Both sides are dealt out by cell and slice, in as many
    partitions as the pairs to compare need; a cell with more than ``SLICE_PAIRS`` or ``SLICE_ROWS`` is cut into slices of its
    rows, each of which meets all queries of the cell. Neither side is broadcast.
    """
    left, right, keys = _in_cells(rows, queries, by, bands, finer)
    n, m = F.count(F.lit(1)).alias("_n"), F.count(F.lit(1)).alias("_m")
    pairs = F.col("_n") * F.col("_m")
    slices = F.greatest(F.ceil(pairs / SLICE_PAIRS), F.ceil(F.col("_n") / SLICE_ROWS))
    cells = written(left.groupBy(*keys).agg(n).join(right.groupBy(*keys).agg(m).hint("merge"), keys).select(*keys, pairs.alias("_pairs"), slices.alias("_slices")), "range-cells")
    compared = cells.agg(F.sum("_pairs")).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-compared // SLICE_PAIRS))
    cut = F.broadcast(cells.filter(F.col("_slices") > 1).select(*keys, "_slices"))
    count = F.coalesce("_slices", F.lit(1).cast("long"))
    left = left.join(cut, keys, "left").withColumn("_slice", F.pmod(F.xxhash64(*rows.columns), count)).drop("_slices")
    right = right.join(cut, keys, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).drop("_slices")
    keys = [*keys, "_slice"]
    # a join drops a plain sort of its side; numbered rows stay in order
    left = left.repartition(parts, *keys).withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*reversed(list(bands))))).filter(F.col("_place") > 0)
    near = Window.partitionBy(*keys).orderBy(*reversed([qc for qc, _, _ in bands.values()]))
    right = right.repartition(parts, *keys).withColumn("_chunk", F.floor((F.row_number().over(near) - 1) / CHUNK))
    # where a chunk's bands begin and end, so that most rows pass it by
    ends = [e for i, (qc, band, _) in enumerate(bands.values()) for e in (F.min(F.col(qc) - band - _slack(F.col(qc), band)).alias(f"_lo{i}"), F.max(F.col(qc) + band + _slack(F.col(qc), band)).alias(f"_hi{i}"))]
    chunks = right.groupBy(*keys, "_chunk").agg(F.collect_list(F.struct(*[c for c in queries.columns if c not in by])).alias("_queries"), *ends)
    paired = chunks.join(left.hint("merge"), keys)
    for i, c in enumerate(bands):
        paired = paired.filter(F.col(c).between(F.col(f"_lo{i}"), F.col(f"_hi{i}")))
    paired = paired.select(*rows.columns, F.explode("_queries").alias("_query")).select(*rows.columns, "_query.*")
    return _within(paired, bands).select(*by, *[c for c in paired.columns if c not in by])


def range_aggregate(rows: DataFrame, queries: DataFrame, by: Sequence[str], bands: Mapping[str, tuple[str, Column, float]], value: str, query_id: str, parts: int = 4) -> DataFrame:
    """Per query the number of rows within its bands, and the sum, least and largest of their ``value``: query_id, n, total, lo, hi.

    Cells are ``parts`` times finer than the largest band. Rows are first folded into one line a cell, so a hot cell crosses the
    shuffle once; cells that lie inside a query's bands in every dimension count as wholes, and only the cells on its border
    list their rows. A query without rows has n = 0 and nulls.

    A query reaches hundreds of cells, which Spark takes for as few bytes as the queries: they are made by many tasks and never sent
    whole to the driver. Cells with their sums, counted, are sent up to ``SENT_CELLS``. Border cells meet their rows in as many
    partitions as the pairs to compare need, full cells in slices.
    """
    names = list(bands)
    by = list(by)
    cells = [f"_cell{i}" for i in range(len(names))]
    width = {c: bands[c][2] / parts for c in names}
    left = rows.select(*by, *[F.col(c).cast("double").alias(c) for c in names], F.col(value).cast("double").alias("_v"), *[F.floor(F.col(c) / width[c]).alias(k) for c, k in zip(names, cells)])
    keep = None
    for c in names:
        ok = F.col(c).isNotNull() & ~F.isnan(c)
        keep = ok if keep is None else keep & ok
    left = left.filter(keep)
    sums = written(left.groupBy(*by, *cells).agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("total"), F.min("_v").alias("lo"), F.max("_v").alias("hi")), "range-sums")
    how = "broadcast" if sums.count() <= SENT_CELLS else "merge"
    asked = queries.repartition(rows.sparkSession.sparkContext.defaultParallelism, query_id).select(F.col(query_id).alias("_q"), *by, *[e for i, c in enumerate(names) for e in (F.col(bands[c][0]).cast("double").alias(f"_at{i}"), bands[c][1].cast("double").alias(f"_band{i}"))])
    looked, inner = asked, F.lit(True)
    for i, (c, k) in enumerate(zip(names, cells)):
        lo, hi, slack = F.col(f"_at{i}") - F.col(f"_band{i}"), F.col(f"_at{i}") + F.col(f"_band{i}"), _slack(F.col(f"_at{i}"), F.col(f"_band{i}"))
        looked = looked.withColumn(k, F.explode(F.sequence(F.floor((lo - slack) / width[c]), F.floor((hi + slack) / width[c]))))
        # a cell strictly between the cells of both ends is inside, whatever rounding does to the ends
        inner = inner & (F.col(k) > F.floor((lo + slack) / width[c])) & (F.col(k) < F.floor((hi - slack) / width[c]))
    looked = looked.withColumn("_inner", inner)
    whole = looked.filter("_inner").select("_q", *by, *cells).join(sums.hint(how), [*by, *cells]).select("_q", "n", "total", "lo", "hi")
    within = None
    for i, c in enumerate(names):
        near = F.abs(F.col(c) - F.col(f"_at{i}")) <= F.col(f"_band{i}")
        within = near if within is None else within & near
    # border cells without rows are dropped before rows are listed
    keys = [*by, *cells]
    border = looked.filter(~F.col("_inner")).drop("_inner").join(sums.select(*keys, F.col("n").alias("_n")).hint(how), keys)
    pairs = F.count(F.lit(1)) * F.first("_n")
    counted = written(border.groupBy(*keys).agg(pairs.alias("_pairs"), F.greatest(F.ceil(pairs / SLICE_PAIRS), F.ceil(F.first("_n") / SLICE_ROWS)).alias("_slices")), "range-border")
    compared = counted.agg(F.sum("_pairs")).first()[0] or 0
    into = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-compared // SLICE_PAIRS))
    cut = F.broadcast(counted.filter(F.col("_slices") > 1).select(*keys, "_slices"))
    count = F.coalesce("_slices", F.lit(1).cast("long"))
    many = left.join(cut, keys, "left").withColumn("_slice", F.pmod(F.xxhash64(*left.columns), count)).drop("_slices")
    few = border.drop("_n").join(cut, keys, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).drop("_slices")
    keys = [*keys, "_slice"]
    met = many.repartition(into, *keys).join(few.repartition(into, *keys).hint("merge"), keys)
    listed = met.filter(within).select("_q", F.lit(1).cast("long").alias("n"), F.col("_v").alias("total"), F.col("_v").alias("lo"), F.col("_v").alias("hi"))
    found = whole.unionByName(listed).groupBy("_q").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return (asked.select("_q").join(found.hint("merge"), "_q", "left").select(F.col("_q").alias(query_id), F.coalesce("n", F.lit(0)).alias("n"), "total", "lo", "hi"))


def best_by_priority(rows: DataFrame, keys: Sequence[str], role: Column, priority: Sequence[str], usable: Column,
                     tie: Sequence[str]) -> DataFrame:
    """One row per key: the usable row whose role comes first in ``priority``, other roles after, then ``tie``.

    A map-side ``min_by``: no window over a key's rows.
    """
    position = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in priority]), role), F.lit(0)), F.lit(len(priority) + 1))
    order = F.struct(position.alias("p"), *tie)
    others = [c for c in rows.columns if c not in keys]
    return (rows.filter(usable).groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_row"))
            .select(*keys, "_row.*"))
