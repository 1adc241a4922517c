import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroframe.operators import compare, metrics
from aeroframe.plans import ingest, quality_report, queries_mesh, training, workload

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return ("f", "nan" if math.isnan(v) else repr(v + 0.0))
    return (type(v).__name__, str(v))


@pytest.mark.parametrize("name", sorted(workload.SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = workload.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted([tuple(_norm(r[c]) for c in cols) for r in df.collect()], key=str)
    cur = con.execute(workload.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted([tuple(_norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()], key=str)
    assert got == want


def test_ingest_of_derived_meshes(spark, sf):
    sup, nodes, tri = queries_mesh.meshes(spark, sf, 64, 6)
    got = ingest.ingest(sup.select("sample_id", "alpha_rad", "u_inf", "cl", "cd"), nodes, tri)
    d = got.dataset.toPandas()
    assert list(d.columns) == list(ingest.DATASET_COLUMNS) and len(d) == sup.count() and (d.n_wall_nodes == 64).all()
    thick = sup.select("sample_id", "h").toPandas().set_index("sample_id").h
    assert np.allclose(d.set_index("sample_id").t_max, 2 * thick.loc[d.sample_id], rtol=0.02)
    assert np.allclose(d.Re * 1.0, d.U_inf / 1.5508e-5, rtol=0.01) and got.errors.count() == 0
    c = got.curves.groupBy("sample_id", "quantity").count().toPandas()
    assert (c["count"] == 202).all() and len(c) == 2 * len(d)
    ends = got.curves.filter("station in (0, 100)").groupBy("sample_id", "quantity", "station").agg(F.count_distinct("value").alias("n"))
    assert ends.filter("n > 1").count() == 0          # both sides share their end nodes
    gate = {r.label: r.ok for r in ingest.dataset_gate(got.dataset, got.curves, len(d)).collect()}
    assert gate["row count"] and gate["no missing numbers"] and gate["wall curves finite"]


def test_surface_errors_of_exact_curves(spark, sf):
    sup, nodes, tri = queries_mesh.meshes(spark, sf, 64, 4)
    wall, _, _ = ingest.wall_table(sup, nodes, tri)
    # curves linear in x_c are read back exactly, so a 2 % change gives a 2 % error everywhere
    from aeroframe.functions.grids import cosine_station
    long = sup.select("sample_id").withColumn("surface", F.explode(F.array(F.lit("upper"), F.lit("lower")))).withColumn("station", F.explode(F.sequence(F.lit(0), F.lit(100))))
    long = long.withColumn("value", 1.0 + cosine_station(F.col("station"), 101))
    on = metrics.curves_on_wall(wall, long, ["sample_id"], "value", "cp_pred")
    q = 0.5 * F.col("u_inf") * F.col("u_inf")
    on = on.withColumn("p", F.col("cp_pred") * q / 1.02)
    r = metrics.surface_errors(on, [], cf=None).first()
    assert r.mean_rel_p == pytest.approx(0.02, rel=1e-9)


def test_fixed_reference_reports(spark):
    df = spark.createDataFrame([(0, 0.2, 6e6, .12, .0, .03, .0085), (1, -9.7, 6e6, .12, .0, -1.0, .012), (2, 5.0, 6e6, .12, .0, .55, .009), (3, 0.0, 6e6, .15, .0, 0., .01)],
                               "sample_id int, alpha_deg double, Re double, t_max double, m_max double, Cl double, Cd double")
    table = [(0.0, 0.0, 0.008), (10.0, 1.05, 0.012), (15.0, 1.5, 0.02)]
    got = {r.sample_id: r for r in quality_report.against_fixed_reference(df, table).collect()}
    assert set(got) == {0} and got[0].ref_Cl == pytest.approx(0.2 * 0.105) and got[0].dCd_rel == pytest.approx(0.0005 / 0.008)
    zones = [[(-4.0, -0.4, 0.009), (16.0, 1.6, 0.02)], [(-4.0, -0.42, 0.0095), (16.0, 1.7, 0.021)]]
    z = {r.sample_id: r for r in quality_report.against_zone_mean(df, zones).collect()}
    grid = np.linspace(-4, 16, 81)
    want = np.mean([np.interp(grid, [r[0] for r in zn], [r[1] for r in zn]) for zn in zones], axis=0)
    for i, a in ((0, 0.2), (1, -9.7), (2, 5.0)):
        assert z[i].ref_Cl == pytest.approx(np.interp(a, grid, want), abs=1e-12)


def test_splits_are_frozen(spark, tmp_path):
    m = spark.createDataFrame([("full", "train", 1), ("full", "train", 2), ("full", "test", 3)], "task string, role string, sample_id int")
    flags = spark.createDataFrame([(1, True), (2, False), (3, True)], "sample_id int, qa_pass boolean")
    path = str(tmp_path / "m")
    assert training.freeze_membership(m, flags, path) and not training.freeze_membership(m, flags, path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        training.freeze_membership(m, flags.withColumn("qa_pass", F.lit(True)), path)
    with pytest.raises(ValueError, match="overlap"):
        training.freeze_membership(m.unionByName(spark.createDataFrame([("full", "test", 1)], m.schema)), flags, path)


def test_gated_quantities(spark):
    ok = spark.createDataFrame([(True, False)], "cp_pass boolean, cf_pass boolean")
    assert training.gated_quantities(ok) == ["Cp"]
    with pytest.raises(ValueError):
        training.gated_quantities(spark.createDataFrame([(False, False)], "cp_pass boolean, cf_pass boolean"))


def test_curve_comparison_needs_five_points(spark):
    a = spark.createDataFrame([("c", i / 9, i / 9 * 2.0) for i in range(10)] + [("d", 0.5, 1.0)], "case_id string, x_c double, Cp double")
    b = spark.createDataFrame([("c", i / 9, i / 9 * 2.0 + 0.1) for i in range(10)] + [("d", i / 9, 1.0) for i in range(10)], "case_id string, x_c double, Cp double")
    stations, summary = compare.compare_curves(a, b)
    assert [(r.case_id, round(r.rms_delta, 9), round(r.max_abs_delta, 9)) for r in summary.collect()] == [("c", 0.1, 0.1)]
    assert stations.count() == 50


def test_published_scores(spark):
    doc = json.dumps([{"task": "full", "rho": [[0.1, 0.9], [0.2, 0.8]], "err": [3.0, 4.0]}])
    s = spark.read.schema("task string, rho array<array<double>>, err array<double>").json(spark.sparkContext.parallelize([doc]))
    got = {(r.model, r.score, r.component): r.value for r in compare.published_scores(s, ["A", "B"], ["rho", "err"]).collect()}
    assert got == {("A", "rho", 0): 0.1, ("A", "rho", 1): 0.9, ("B", "rho", 0): 0.2, ("B", "rho", 1): 0.8, ("A", "err", 0): 3.0, ("B", "err", 0): 4.0}


def test_rows_run_on_a_stream(spark, tmp_path):
    from aeroframe.functions.bands import add_95_band
    from aeroframe.streaming.rows import arriving, score_arriving
    schema = "Cl double, Cd double, L_over_D double, Cl_std double, Cd_std double"
    src = str(tmp_path / "in")
    spark.createDataFrame([(0.5, 0.01, 50.0, 0.01, 0.0002)], schema).write.parquet(src)
    q = score_arriving(arriving(spark, src, schema), add_95_band, str(tmp_path / "out"), f"scores-{tmp_path.name}")
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first().Cl_hi95 == pytest.approx(0.5 + 1.96 * 0.01)


def test_task_from_split_to_scores(spark, sf):
    from aeroframe.operators import modes, predict, splits
    from aeroframe.plans import queries_models as qm
    data = qm.part_dataset(spark, sf).withColumn("qa_pass", F.lit(True)).cache()
    roles = splits.stratified_split(data.withColumn("s", F.floor("alpha_deg")), "s", "sample_id")
    member = roles.select(F.lit("full").alias("task"), "role", "sample_id").cache()
    curves = qm.part_curves(spark, sf, 21)
    out = training.train_task(data, member, "full", ["gp"], waves=40)
    test = splits.task_rows(data, member, "full", "test")
    m = {r.target: r for r in training.coefficient_metrics(training.score_cases(test, out["models"], "full")).collect()}
    assert m["Cl"].R2 > 0.9 and m["Cd"].R2 > 0.9 and m["Cl"].n_test == test.count()
    fitted = training.train_curves(splits.task_rows(data, member, "full", "train"), modes.curve_vectors(curves), ["Cp", "Cf"], n_modes=4, waves=40)
    scores = {r.quantity: r for r in training.evaluate_curves(test, curves, fitted, "full", "gp").collect()}
    assert scores["Cp"].R2_flat > 0.9 and scores["Cf"].separation_detect_accuracy > 0.9 and scores["Cp"].suction_peak_MAE < 0.2
    with pytest.raises(ValueError):
        splits.task_rows(data.withColumn("qa_pass", F.col("sample_id") > 5), member, "full", "train")
    near = predict.nearby_rows(data.select("sample_id", "Re", "t_max", "m_max"), spark.createDataFrame([(2.6e6, 0.12, 0.01)], "q_Re double, q_t_max double, q_m_max double"), 400_000.0)
    p = data.toPandas()
    want = p[(abs(p.Re - 2.6e6) <= 0.08 * 2.6e6) & (abs(p.t_max - 0.12) <= 0.01) & (abs(p.m_max - 0.01) <= 0.01)]
    assert sorted(r.sample_id for r in near.collect()) == sorted(want.sample_id)
