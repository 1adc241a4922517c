import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aeroframe.operators import joins, metrics, ordering


@pytest.fixture(scope="module")
def skewed(spark):
    """Group a holds most rows and one value a third of all; group b is small, c has one row, null is a group."""
    rng = np.random.default_rng(5)
    n = 6000
    v = np.where(rng.random(n) < 0.34, 7.0, rng.lognormal(size=n) * 3)
    g = rng.choice(["a", "b", None], p=[0.9, 0.08, 0.02], size=n).astype(object)
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "v": v, "w": np.round(v * 0.5 + rng.normal(size=n), 1)})
    pdf = pd.concat([pdf, pd.DataFrame({"id": [n], "g": ["c"], "v": [1.5], "w": [2.0]})])
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


def test_quantiles_equal_numpy(skewed):
    pdf, df = skewed
    got = {r.g: r for r in ordering.exact_quantiles(df, ["g"], "v", {"q0": 0.0, "q1": 0.1, "m": 0.5, "q9": 0.95, "q10": 1.0}).collect()}
    for g, part in pdf.groupby("g", dropna=False):
        want = np.quantile(part.v, [0, 0.1, 0.5, 0.95, 1])
        r = got[None if pd.isna(g) else g]
        assert np.allclose([r.q0, r.q1, r.m, r.q9, r.q10], want, atol=1e-12)


@pytest.mark.parametrize("columns,hot", [(("v", "w"), True), (("id", "w2"), False)])
def test_rank_correlation_equals_pandas(skewed, columns, hot):
    pdf, df = skewed
    pdf = pdf.assign(w2=pdf.w * 1000 + pdf.id % 17)
    df = df.withColumn("w2", F.col("w") * 1000 + F.col("id") % 17)
    a, b = columns
    cuts = ordering.value_splits(df, [a, b])
    assert (cuts[a].hot or cuts[b].hot) == hot
    got = {r.g: r.spearman for r in ordering.spearman(df, ["g"], a, b).collect()}
    for g, part in pdf.groupby("g", dropna=False):
        key = None if pd.isna(g) else g
        if len(part) < 2:
            assert got[key] is None
        else:
            assert got[key] == pytest.approx(part[a].rank().corr(part[b].rank()), abs=1e-9)


def test_ordered_counts_and_picks(skewed):
    pdf, df = skewed
    got = ordering.ordered_counts(df, ["g"], "v").filter("g = 'a'").orderBy("v").toPandas()
    part = np.sort(pdf[pdf.g == "a"].v)
    assert np.array_equal(np.repeat(got.v, got.n), part)
    assert np.array_equal(got.before, np.searchsorted(part, got.v)) and (got.total == len(part)).all()
    picks = {(r.g, r.pick): r.id for r in metrics.ranked_picks(df, ["g"], "v", "id").collect()}
    order = pdf[pdf.g == "a"].sort_values(["v", "id"]).id.to_numpy()
    assert picks[("a", "lowest")] == order[0] and picks[("a", "middle")] == order[len(order) // 2] and picks[("a", "highest")] == order[-1]


def test_running_and_fill_equal_pandas(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.choice(["x", "y"], p=[0.8, 0.2], size=500), "t": rng.permutation(500)})
    pdf["blk"] = pdf.t // 60
    pdf["mark"] = np.where(rng.random(500) < 0.05, pdf.t.astype(float), np.nan)
    df = spark.createDataFrame(pdf).withColumn("mark", F.nanvl("mark", F.lit(None)))
    out = ordering.forward_fill(df, ["k"], "blk", ["t"], F.col("mark"), "f")
    out = ordering.forward_fill(out, ["k"], "blk", ["t"], F.col("mark"), "before", inclusive=False)
    out = ordering.running_sum(out, ["k"], "blk", ["t"], F.col("t"), "s")
    got = ordering.row_numbers(out, ["k"], "blk", ["t"], "rn", total="n").orderBy("k", "t").toPandas()
    want = pdf.sort_values(["k", "t"])
    g = want.groupby("k")
    assert np.array_equal(got.s, g.t.cumsum()) and np.array_equal(got.rn, g.cumcount() + 1)
    assert np.array_equal(got.f.fillna(-1), g.mark.ffill().fillna(-1))
    assert np.array_equal(got.before.fillna(-1), g.mark.ffill().groupby(want.k).shift().fillna(-1))
    assert (got.n == got.groupby("k").k.transform("size")).all()


def test_hot_lookup_keeps_every_row(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    got = ordering.lookup_join(rows, table, ["k"], "n")
    assert got.count() == 3000 and got.filter(F.col("first").isNull()).count() == 0
    assert {r.first for r in got.filter("k = 'hot'").select("first").distinct().collect()} == {1}
    mapped = rows.withColumn("m", F.create_map(F.lit("a"), F.col("id")))
    assert ordering.lookup_join(mapped, table, ["k"], "n").filter(F.col("first").isNull()).count() == 0
    dup = ordering.first_of_duplicates(rows, [F.col("k")], "id")
    assert dup.filter("first_id is not null").count() == 999 + 999


@pytest.mark.parametrize("seed", range(3))
def test_interpolation_equals_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    knots = pd.concat([pd.DataFrame({"g": g, "x": np.unique(np.round(rng.normal(size=n), 3))}) for g, n in (("a", 400), ("b", 3), ("c", 1))])
    knots["y"] = rng.normal(size=len(knots))
    pts = pd.DataFrame({"id": np.arange(900), "g": rng.choice(["a", "b", "c"], size=900), "q": np.where(rng.random(900) < 0.3, 0.25, rng.normal(size=900) * 2)})
    got = joins.interpolate(spark.createDataFrame(pts), spark.createDataFrame(knots), ["g"], "q", "x", ["y"]).orderBy("id").toPandas()
    assert len(got) == 900
    for g, part in got.groupby("g"):
        k = knots[knots.g == g].sort_values("x")
        assert np.allclose(part.y_at, np.interp(part.q, k.x, k.y), atol=1e-9)


def test_nearest_and_first_match(spark):
    rng = np.random.default_rng(9)
    ref = pd.DataFrame({"x": [0.0, 10.0, 15.0, 5.0, 10.0], "rank": range(5), "tag": list("abcde")})
    pts = pd.DataFrame({"id": range(400), "q": np.round(rng.uniform(-2, 18, 400), 2)})
    pts.loc[0, "q"], pts.loc[1, "q"], pts.loc[2, "q"] = 7.5, 12.5, 2.5
    p, r = spark.createDataFrame(pts), spark.createDataFrame(ref)
    near = joins.nearest(p, r, [], "q", "x", "rank", ["tag"], 2.5).orderBy("id").toPandas()
    match = joins.first_match(p, r, [], "q", "x", "rank", ["tag"], 2.6).orderBy("id").toPandas()
    for i, q in enumerate(pts.q):
        d = np.abs(ref.x - q)
        j = int(np.argmin(d))
        assert near.near_tag[i] == (ref.tag[j] if d[j] <= 2.5 else None), q
        hits = np.flatnonzero(d <= 2.6 + 1e-5 * np.abs(ref.x))
        assert match.match_tag[i] == (ref.tag[hits[0]] if len(hits) else None), q


def test_range_join_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"id": range(300), "a": rng.uniform(-5, 5, 300), "b": rng.uniform(0, 1, 300)})
    qs = pd.DataFrame({"qid": range(20), "qa": rng.uniform(-5, 5, 20), "qb": rng.uniform(0, 1, 20)})
    got = joins.range_join(spark.createDataFrame(rows), spark.createDataFrame(qs), [], {"a": ("qa", F.abs("qa") * 0.1 + 0.2, 0.7), "b": ("qb", F.lit(0.1), 0.1)})
    have = {(r.id, r.qid) for r in got.select("id", "qid").collect()}
    want = {(i, k) for i, a, b in rows.itertuples(index=False) for k, qa, qb in qs.itertuples(index=False) if abs(a - qa) <= abs(qa) * 0.1 + 0.2 and abs(b - qb) <= 0.1}
    assert have == want and got.count() == len(want)


def test_rows_are_never_broadcast_to_their_cells(spark, tmp_path):
    """Many rows of few values are a small file: Spark must not take them for the small side of a join."""
    spark.range(200_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 11 / 1.0).alias("v")).write.parquet(str(tmp_path / "few"))
    rows = spark.read.parquet(str(tmp_path / "few"))
    cuts = ordering.value_splits(rows, ["v"])
    for out in (ordering.selected_quantiles(rows, ["g"], {"v": {"m": 0.5}}, cuts), ordering.ordered_counts(rows, ["g"], "v", cuts["v"]),
                ordering.running_sum(ordering.add_bucket(rows, "v", cuts["v"]), ["g"], "_b", ["v"], F.col("v"), "s"),
                ordering.rank_in_cells(ordering.add_bucket(rows, "v", cuts["v"]), ordering.add_bucket(rows, "v", cuts["v"]), ["g"], "v", "_b", "r")):
        assert "BuildLeft" not in out._jdf.queryExecution().sparkPlan().toString()
    got = ordering.selected_quantiles(rows, ["g"], {"v": {"m": 0.5}}, cuts)
    assert {(r.g, r.m) for r in got.collect()} == {(0, 5.0), (1, 5.0), (2, 5.0)}
