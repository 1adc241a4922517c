"""Rows that become many are dealt out before they do: small tables are one file split."""

import numpy as np
from pyspark.sql import functions as F

from aeroframe.operators import joins, ordering, predict
from aeroframe.plans import queries_joins, queries_sources
from aeroframe.sources.lines import read_zones


def tasks(df):
    """Tasks that hold rows of ``df``."""
    return df.select(F.spark_partition_id().alias("task")).distinct().count()


def test_points_of_users_are_made_by_many_tasks(spark, sf, monkeypatch):
    seen = {}
    monkeypatch.setattr(queries_joins.joins, "interpolate", lambda points, knots, *a: seen.setdefault("points", points))
    queries_joins.interpolation_join(spark, sf)
    users = queries_joins.table(spark, sf, "events").select("user_id").distinct().count()
    assert seen["points"].count() == 120 * users
    assert tasks(seen["points"]) > 1


def test_mesh_check_logs_are_written_by_many_tasks(spark, sf):
    lines = queries_sources.check_lines(spark, sf)
    assert lines.count() == 8 * queries_sources.table(spark, sf, "part").count()
    assert tasks(lines) > 1


def test_zone_lines_are_made_once(spark):
    """Titles, cells and rows all come from one reading of the lines."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(line):
        calls.add(1)
        return line

    text = [("a", 0, 0, 'zone, t="one"'), ("a", 0, 1, "1 2"), ("a", 1, 2, "3 4"), ("a", 1, 3, 'zone, t="two"'), ("a", 1, 4, "5 6")]
    lines = spark.createDataFrame(text, "file string, block long, seq long, line string").withColumn("line", seen.asNondeterministic()("line"))
    got = read_zones(lines, strict=False).orderBy("seq").collect()
    assert [(r.zone, list(r["values"])) for r in got] == [("one", [1.0, 2.0]), ("one", [3.0, 4.0]), ("two", [5.0, 6.0])]
    assert calls.value == len(text)


def test_repeated_values_are_ranked_by_many_tasks(spark):
    """Cells of repeated values have few compressed bytes but many rows: they are not merged into one task."""
    rows = spark.range(4000).select(F.lit("g").alias("g"), (F.col("id") % 40).cast("double").alias("v"))
    cuts = [9.5, 19.5, 29.5]
    celled = ordering.add_bucket(rows, "v", cuts, "c")
    ranked = ordering.rank_in_cells(celled, celled, ["g"], "v", "c", "rank", len(cuts) + 1)
    assert tasks(ranked) > 1
    got = {r.v: (r["rank"], r.total, r.n) for r in ranked.groupBy("v", "rank", "total").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {float(v): (100 * v + 50.5, 4000, 100) for v in range(40)}


def test_cells_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CELL_ROWS", 100)
    assert ordering.cell_count(spark.range(2000)) == 20
    assert ordering.cell_count(spark.range(10)) == 8


def near_inputs(spark, n, asked):
    """Rows with few thicknesses and cambers, queries, and the pairs that are near."""
    rng = np.random.default_rng(7)
    re, t, m = rng.uniform(1e6, 3e6, n), 0.1 + 0.01 * rng.integers(0, 3, n), 0.005 * rng.integers(0, 3, n)
    q = np.column_stack([rng.uniform(1e6, 3e6, asked), 0.1013 + 0.005 * rng.integers(0, 3, asked), 0.0022 + 0.002 * rng.integers(0, 3, asked)])
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(re, t, m))], "id long, Re double, t_max double, m_max double").repartition(4)
    queries = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(q)], "q long, q_Re double, q_t_max double, q_m_max double")
    near = (abs(re - q[:, :1]) <= np.maximum(0.08 * q[:, :1], 75_000.0)) & (abs(t - q[:, 1:2]) <= 0.01) & (abs(m - q[:, 2:]) <= 0.01)
    return rows, queries, near


def test_near_pairs_are_written_in_few_bytes(spark, tmp_path):
    """Neighbours follow each other and meet the same queries in the same order: files hold the repeats in few bytes."""
    rows, queries, near = near_inputs(spark, 6000, 1500)
    out = str(tmp_path / "pairs")
    predict.nearby_rows(rows, queries, 320_000.0).select("q", "id").write.parquet(out)
    got = spark.read.parquet(out)
    assert got.count() == got.distinct().count() == near.sum()
    assert got.agg(F.sum("q"), F.sum("id"), F.sum(F.col("q") * F.col("id"))).first() == (near.sum(1) @ np.arange(1500), near.sum(0) @ np.arange(6000), np.arange(1500) @ near @ np.arange(6000))
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.7 * near.sum()


def test_full_cells_meet_their_queries_in_slices(spark, monkeypatch):
    """A cell that holds most rows is many tasks' work; no side is broadcast whole."""
    monkeypatch.setattr(joins, "SLICE_PAIRS", 3000)
    rows = spark.range(2000).select("id", (F.col("id") % 5).cast("double").alias("x"))
    rows = rows.unionByName(spark.createDataFrame([(-1, None), (-2, float("nan")), (-3, 70.0), (-4, -0.5)], "id long, x double"))
    queries = spark.range(20).select(F.col("id").alias("q"), (F.col("id") % 7).cast("double").alias("at"))
    paired = joins.range_pairs(rows, queries, [], {"x": ("at", F.lit(1.0), 20.0)}, finer=1)
    want = sorted([(i, q) for i in range(2000) for q in range(20) if abs(i % 5 - q % 7) <= 1] + [(-4, q) for q in range(20) if q % 7 == 0])
    assert sorted((r.id, r.q) for r in paired.collect()) == want
    assert tasks(paired) > 4
    assert joins.range_pairs(rows.limit(0), queries, [], {"x": ("at", F.lit(1.0), 20.0)}).count() == 0


def test_cells_of_queries_are_made_by_tasks_and_not_broadcast(spark, monkeypatch):
    """Queries listed in all cells they reach are many rows from few bytes: no plan sends them, or the rows, whole to the driver."""
    monkeypatch.setattr(joins, "SLICE_PAIRS", 3000)
    rows, queries, near = near_inputs(spark, 3000, 400)
    rows = rows.withColumn("v", F.col("id") % 50 * 1.0)
    for sent in (joins.SENT_CELLS, 0):
        monkeypatch.setattr(joins, "SENT_CELLS", sent)
        got = predict.nearby_summary(rows, queries, 320_000.0, "v", "q")
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join Inner, ") >= 2 and plan.count("strategy=merge") >= (2 if sent else 4)
        v = np.arange(3000) % 50
        want = {i: (n.sum(), v[n].sum(), v[n].min(), v[n].max()) if n.any() else (0, None, None, None) for i, n in enumerate(near)}
        assert {r.q: (r.n, r.total, r.lo, r.hi) for r in got.collect()} == want
