"""Quantiles of several columns in one selection, filters before shuffles, loop ranking and range aggregates, each against a plain search."""

import numpy as np
import pandas as pd
import pytest
from helpers import ring_mesh
from pyspark.sql import functions as F

from aeroframe.operators import joins, ordering, topology, wallflow
from aeroframe.plans import ingest
from aeroframe.plans.queries_mesh import meshes
from aeroframe.session import cut_lineage


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(4)
    n = 4000
    t = pd.DataFrame({"g": np.where(np.arange(n) % 3 == 0, "hot", (np.arange(n) % 7).astype(str)), "a": rng.normal(size=n).round(2), "b": rng.integers(0, 4, n) * 1.0, "c": rng.exponential(size=n)})
    t.loc[t.g == "5", "c"] = np.nan
    rows = spark.createDataFrame(t).withColumn("c", F.nanvl("c", F.lit(None))).withColumn("g", F.when(F.col("g") != "6", F.col("g"))).repartition(5).cache()
    return t.assign(g=t.g.where(t.g != "6", None)), rows


def test_quantiles_of_many_columns(values):
    """Hot groups, null groups, ties and a group without values in one column."""
    t, rows = values
    wanted = {"a": {"a05": 0.05, "a50": 0.5}, "b": {"b50": 0.5, "b99": 0.99}, "c": {"c50": 0.5}}
    got = {r.g: r for r in ordering.selected_quantiles(rows, ["g"], wanted).collect()}
    groups = t.groupby(t.g.fillna("none"))
    assert len(got) == len(groups)
    for g, part in groups:
        r = got[None if g == "none" else g]
        for c, names in wanted.items():
            v = part[c].dropna()
            for name, q in names.items():
                assert r[name] is None if not len(v) else r[name] == pytest.approx(np.quantile(v, q), abs=1e-12)
    whole = ordering.selected_quantiles(rows, [], {"a": {"m": 0.5}, "c": {"q": 0.25}}).collect()
    assert len(whole) == 1 and whole[0].m == pytest.approx(t.a.median()) and whole[0].q == pytest.approx(t.c.quantile(0.25))
    assert ordering.selected_quantiles(rows.filter("false"), ["g"], {"a": {"m": 0.5}}).collect() == []


def test_quantiles_read_their_rows_twice(spark, values, tmp_path):
    """One pass counts the cells of all columns, one keeps the values of wanted cells, whatever the number of columns."""
    values[1].select("g", "a", "b").withColumn("c", F.col("a") * 2).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    cuts = ordering.value_splits(rows, ["a", "b", "c"])
    plan = ordering.selected_quantiles(rows, ["g"], {c: {f"{c}50": 0.5, f"{c}90": 0.9} for c in ("a", "b", "c")}, cuts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2


@pytest.mark.parametrize("sent, most_bytes", [(10_000, 1 << 20), (0, 1 << 20), (0, 64)])
def test_filters_keep_all_wanted_rows(spark, sent, most_bytes):
    rows = spark.range(20_000).select((F.col("id") % 40).alias("s"), F.col("id").alias("n"), F.lit("x").alias("other")).unionByName(spark.createDataFrame([(None, 5, "x"), (3, None, "x")], "s long, n long, other string"))
    keys = spark.range(0, 20_000, 97).select((F.col("id") % 40).alias("s"), F.col("id").alias("n"))
    got = joins.likely_in(rows, keys.unionByName(keys), ["s", "n"], sent, most_bytes)
    ids = {r.n for r in got.collect()}
    assert {r.n for r in keys.collect()} <= ids and got.columns == rows.columns
    assert len(ids) <= {64: 20_001, 1 << 20: 600}[most_bytes]       # about 1 % of the others pass a filter of 10 bits a key
    assert joins.likely_in(rows, keys.filter("false"), ["s", "n"], 0, 64).count() == 0 if most_bytes == 64 else True


def shuffled(spark, run):
    """Records written to shuffles by each stage that ``run`` starts."""
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (all_.apply(i) for all_ in [store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())] for i in range(all_.size()))}
    before = set(stages())
    run()
    return [n for i, n in stages().items() if i not in before]


def test_ingest_shuffles_the_mesh_once(spark, sf):
    """On meshes of 100,000 nodes only the edges of the triangles cross a shuffle as a whole; nodes come through filters."""
    sup, nodes, tri = meshes(spark, sf, 100, 100)
    n = nodes.count()
    assert n >= 100_000
    sup, nodes, tri = (cut_lineage(t) for t in (sup, nodes, tri))
    found = []
    writes = shuffled(spark, lambda: found.append(ingest.wall_table(sup, nodes, tri)))
    assert sum(w > 0.2 * n for w in writes) == 1, sorted(writes)[-5:]
    wall, _, errors = found[0]
    assert wall.count() == 100 * sup.count() and errors.count() == 0


def test_filtered_gradients_are_the_same(spark):
    n, t = ring_mesh(3, around=30, layers=5)
    nodes, tri = spark.createDataFrame(n), spark.createDataFrame(t)
    wall = cut_lineage(nodes.filter("node_id < 30").select("sample_id", "node_id"))
    rows = lambda df: sorted(map(tuple, df.select(*[F.round(c, 9) if c.startswith("d") else c for c in df.columns]).collect()))
    assert rows(wallflow.wall_gradients(nodes, tri, wall, keep=cut_lineage)) == rows(wallflow.wall_gradients(nodes, tri, wall))


def test_ranked_loops_equal_walked_loops(spark):
    rng = np.random.default_rng(1)
    parts = []
    for sample, n in ((1, 3), (2, 4), (5, 257), (9, 1000)):
        ids = rng.permutation(10 * n)[:n]
        parts += [(sample, int(min(a, b)), int(max(a, b))) for a, b in zip(ids, np.roll(ids, -1))]
    parts += [(20, 0, 1), (20, 1, 2), (20, 0, 2), (20, 7, 8), (20, 8, 9), (20, 7, 9)]       # two loops
    edges = spark.createDataFrame(parts, "sample_id long, a long, b long")
    want, got = topology.chain_loops(edges), topology.rank_loops(edges)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    mixed = topology.chain_loops(edges, group_edges=200)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, want.collect()))


def test_a_long_loop_without_a_group(spark):
    """A wall of 200,000 edges, ordered by joins only."""
    n = 200_000
    edges = spark.range(n).select(F.lit(1).cast("long").alias("sample_id"), F.least("id", (F.col("id") + 1) % n).alias("a"), F.greatest("id", (F.col("id") + 1) % n).alias("b"))
    got = topology.rank_loops(edges).agg(F.count(F.lit(1)), F.count_if(F.col("pos") == F.col("node_id")), F.min("n_visited"), F.max("n_nodes")).first()
    assert tuple(got) == (n, n, n, n)


def test_range_aggregate_equals_plain_search(spark):
    """Cells inside a query's bands count as wholes; a hot place holds half of all rows."""
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 10, (3000, 2))
    x[:1500] = [4.2, 6.1]
    rows = pd.DataFrame({"g": np.arange(3000) % 2, "x": x[:, 0], "y": x[:, 1], "v": rng.normal(size=3000)})
    asked = pd.DataFrame({"q": np.arange(60), "g": np.arange(60) % 3, "qx": rng.uniform(-1, 11, 60), "qy": rng.uniform(-1, 11, 60), "band": rng.uniform(0, 2, 60)})
    asked.loc[:5, ["g", "qx", "qy", "band"]] = [0, 4.0, 6.0, 2.0]
    bands = {"x": ("qx", F.col("band"), 2.0), "y": ("qy", F.col("band") / 2, 1.0)}
    left, right = spark.createDataFrame(rows).unionByName(spark.createDataFrame([(0, None, 1.0, 1.0), (0, float("nan"), 1.0, 1.0)], "g long, x double, y double, v double")), spark.createDataFrame(asked)
    got = {r.q: r for r in joins.range_aggregate(left, right, ["g"], bands, "v", "q").collect()}
    assert len(got) == 60
    for a in asked.itertuples():
        near = rows[(rows.g == a.g) & (abs(rows.x - a.qx) <= a.band) & (abs(rows.y - a.qy) <= a.band / 2)].v
        r = got[a.q]
        assert r.n == len(near)
        assert (r.total, r.lo, r.hi) == ((None,) * 3 if not len(near) else (pytest.approx(near.sum()), near.min(), near.max()))
    pairs = joins.range_join(left, right, ["g"], bands).groupBy("q").count().collect()
    assert {r["q"]: r["count"] for r in pairs} == {q: r.n for q, r in got.items() if r.n}


def test_drift_medians(spark):
    new = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 3.0, 5.0), (4, 9.0, None)], "k long, a double, b double")
    old = spark.createDataFrame([(1, 1.0, 5.5), (2, 2.5, 6.0), (3, 4.0, 5.0), (5, 9.0, 1.0)], "k long, a double, b double")
    got = {r.column: r for r in joins.snapshot_compare(new, old, "k", ["a", "b"]).collect()}
    assert (got["a"].median_difference, got["b"].median_difference) == (0.5, 0.5) and (got["a"].only_new, got["a"].only_old, got["a"].n_different, got["b"].max_difference) == (1, 1, 2, 1.0)


def test_ranges_judge_the_distance_not_the_rounded_ends(spark):
    """|row - query| <= band, as the pairs are judged: 0.3 - 0.1 rounds below 0.2 and 0.8 + 0.1 above 0.9, the distances do not."""
    values = [0.1 * i for i in range(12)] + [0.3 - 0.1, 0.8 + 0.1]
    rows = spark.createDataFrame([(i, v, 1.0) for i, v in enumerate(values)], "id long, x double, v double")
    asked = spark.createDataFrame([(i, 0.1 * i) for i in range(12)], "q long, q_x double")
    bands = {"x": ("q_x", F.lit(0.1), 0.1)}
    want = {i: sum(abs(v - 0.1 * i) <= 0.1 for v in values) for i in range(12)}
    assert {r.q: r.n for r in joins.range_aggregate(rows, asked, [], bands, "v", "q").collect()} == want
    pairs = joins.range_join(rows, asked, [], bands).groupBy("q").count().collect()
    assert {r.q: r["count"] for r in pairs} == want
