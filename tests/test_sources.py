import hashlib
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from aeroframe.functions import text
from aeroframe.operators import quality
from aeroframe.sources import cases, lines, samples, tabular


def write(path, body):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(body)
    return str(path)


def test_zone_table_strict_and_tolerant(spark, tmp_path):
    body = '# note\nvariables="alpha, deg","cl","cd"\n1 2 3\n\nzone, t="80 grit, alpha=.0169"\n-4.0 -0.43 0.0087\n 0.0 0.0 0.008\nzone, t="alpha=10"\n10 1.0 0.01\n'
    a = write(tmp_path / "a" / "x.dat", body)
    z = lines.refuse_bad(lines.read_zones(lines.read_lines(spark, a)))
    got = lines.zone_table(z, ["alpha_deg", "Cl", "Cd"], {"source": "s", "Re": 6.0e6}).orderBy("block", "seq").collect()
    assert [r.zone for r in got] == ["default", "80 grit, alpha=.0169", "80 grit, alpha=.0169", "alpha=10"]
    assert got[1].Cl == -0.43 and got[1].source == "s" and got[0].Re == 6.0e6
    alphas = [r.alpha_deg for r in lines.pressure_table(z, "p").orderBy("block", "seq").collect()]
    assert math.isnan(alphas[0]) and alphas[1] == 0.0169 and alphas[3] == 10.0
    assert lines.zone_columns(lines.read_lines(spark, a)).first()["columns"] == ["alpha_deg", "cl", "cd"]
    b = write(tmp_path / "b" / "x.dat", body + "stray words here\n20 1.1 0.02\n")
    with pytest.raises(Exception, match="not a numeric row"):
        lines.refuse_bad(lines.read_zones(lines.read_lines(spark, b))).collect()
    assert lines.read_zones(lines.read_lines(spark, b), strict=False).count() == 5
    only = lines.zone_table(z, ["alpha_deg", "Cl"], zone="alpha=10").collect()
    assert len(only) == 1 and only[0].alpha_deg == 10.0


def test_lines_keep_order_over_many_splits(spark, tmp_path):
    body = "".join(f'zone, t="z{i // 50}"\n' if i % 50 == 0 else f"{i} {i * 2}\n" for i in range(3000))
    path = write(tmp_path / "big.dat", body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        ls = lines.read_lines(spark, path)
        assert ls.select("block").distinct().count() > 3
        rows = lines.read_zones(ls).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert len(rows) == 3000 - 60 and all(r.zone == f"z{int(r['values'][0]) // 50}" for r in rows)


def test_solver_log(spark, tmp_path):
    one = "Solving for {f}, Initial residual = {a}, Final residual = 1e-9, No Iterations 2\n"
    log = (one.format(f="Ux", a=0.9) + "Time = 1\n\nTime = 2\n" + "x:  " + one.format(f="Ux", a=0.5) + one.format(f="p", a=0.4) + one.format(f="p", a=0.3)
           + "ExecutionTime = 1.5 s  ClockTime = 2 s\nTime = 3\n" + one.format(f="Ux", a="1e-03") + "ExecutionTime = 3.25 s\n")
    path = write(tmp_path / "case_0001" / "log", log)
    ls = lines.read_lines(spark, path)
    h = lines.residual_history(ls)
    wide = lines.widen_steps(h, ["Ux", "p"]).orderBy("step").collect()
    assert [(r.step, r.Ux, r.p) for r in wide] == [(1, 0.9, None), (2, 0.5, 0.4), (3, 1e-3, None)]
    assert lines.final_residuals(h).first().residuals_final == {"Ux": 1e-3}
    flags = lines.log_flags(ls).first()
    assert flags.runtime_s == 3.25 and not flags.fatal
    assert lines.residual_history(lines.lines_of(spark.createDataFrame([("f", "nothing\nTime = 1")], "f string, b string"), "f", "b")).count() == 0


def test_force_history_and_tail(spark, tmp_path):
    long = "# Time Cm Cd Cl\n" + "".join(f"{i}\t0.1  {0.01 + i * 1e-5}  {0.5 + (i % 2) * 0.01}\n" for i in range(300))
    a = write(tmp_path / "a.dat", long)
    b = write(tmp_path / "b.dat", "# t\n" + "1 2 3 4 5 6 7\n" * 10)
    h = lines.force_history(lines.read_lines(spark, [a, b]))
    assert h.filter("Cl_f is not null").count() == 10 and h.filter("Cl is null").count() == 0
    got = {os.path.basename(r.file): r for r in lines.tail_stats(h).collect()}
    assert got["a.dat"].n_iters == 300 and got["a.dat"].n_window == 200 and got["a.dat"].error is None
    assert got["a.dat"].Cl_mean == pytest.approx(0.505) and got["a.dat"].Cl_std == pytest.approx(0.005 * math.sqrt(200 / 199))
    assert got["b.dat"].error is not None


def test_y_plus_polar_pressure_polygon(spark, tmp_path):
    y = write(tmp_path / "y.dat", "# t patch min max mean\n1 aerofoil 0.1 0.9 0.4\n2 farfield 1 1 1\n3 aerofoil 0.2 0.8 0.5\n4 aerofoil x 0.8 0.5\n")
    r = lines.last_y_plus(lines.read_lines(spark, y)).first()
    assert (r.y_plus_min, r.y_plus_max, r.y_plus_mean) == (0.2, 0.8, 0.5)
    p = write(tmp_path / "p.txt", "title\n   alpha    CL        CD       Top_Xtr\n  ------ -------- ------- ------\n  1.0 0.11 0.006 0.5\nbad row\n  2.0 0.22 0.007 0.4\n")
    rows = [r.row for r in lines.polar_rows(lines.read_lines(spark, p)).orderBy("block", "seq").collect()]
    assert rows == [{"alpha_deg": 1.0, "Cl": 0.11, "Cd": 0.006, "x_trans_upper": 0.5}, {"alpha_deg": 2.0, "Cl": 0.22, "Cd": 0.007, "x_trans_upper": 0.4}]
    c = write(tmp_path / "c.dat", '# x\nvariables="x/c","Cp"\n0.0 1.0\n0.5\n0.5 -0.2\n')
    assert [(r.x_c, r.Cp) for r in lines.pressure_rows(lines.read_lines(spark, c)).orderBy("block", "seq").collect()] == [(0.0, 1.0), (0.5, -0.2)]
    ring = "".join(f"{math.cos(t / 2)} {math.sin(t / 2)}\n" for t in range(12)) + "1.0 0.0\n"
    g = write(tmp_path / "g.dat", ring)
    few = write(tmp_path / "few.dat", "0 0\n1 1\n")
    pts = lines.polygon_points(lines.read_lines(spark, [g, few]))
    assert pts.filter("error is null").count() == 12 and pts.filter("error = 'too few points'").count() == 2


def test_surface_samples_and_latest_time(spark, tmp_path):
    for t in ("100", "20", "junk"):
        write(tmp_path / "case_0007" / "samples" / t / "aerofoil.xy", "# x y z p\n0.0 0 0 50\n1.0 0 0 -25\n")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path")
    best = samples.latest_path(files, cases.case_of(F.col("path")), F.regexp_extract("path", r"/([^/]+)/aerofoil\.xy$", 1)).first()
    assert "/100/" in best.path
    params = spark.createDataFrame([("case_0007", 1.0e6, None)], "case_id string, Re double, nu double")
    got = lines.surface_samples(lines.read_lines(spark, best.path), params, cases.case_of(F.col("file"))).orderBy("x_c").collect()
    q = 0.5 * (1e6 * 1.5e-5) ** 2
    assert [(r.x_c, r.Cp) for r in got] == [(0.0, 50 / q), (1.0, -25 / q)]


def test_cases_manifest_and_clean_dataset(spark, tmp_path):
    write(tmp_path / "case_0001" / "params.json", json.dumps({"alpha_deg": 2.0, "Re": 2e6, "thickness": 0.12}))
    write(tmp_path / "case_0002" / "params.json", json.dumps({"alpha_deg": 12.0, "Re": 2e6, "thickness": 0.2, "regime": "B"}))
    p = cases.read_params(spark, str(tmp_path)).orderBy("case_id").collect()
    assert [(r.case_id, r.regime) for r in p] == [("case_0001", "A"), ("case_0002", "B")]
    body = write(tmp_path / "ref" / "a.txt", "hello")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "ref"))
    expected = spark.createDataFrame([("a.txt", "u1"), ("b.txt", "u2")], "relpath string, url string")
    m = {r.relpath: r for r in cases.file_manifest(expected, files, str(tmp_path / "ref")).collect()}
    assert m["a.txt"].sha256 == hashlib.sha256(b"hello").hexdigest() and m["a.txt"].size == 5 and m["b.txt"].status == "missing"
    assert os.path.exists(body)
    cs = spark.createDataFrame([("c1", "A", 2.0, 2e6, .12, None), ("c2", "B", 12.0, 2e6, .2, None), ("c3", "C", 2.0, 5e5, .1, 0.5), ("c4", "A", 1.0, 2e6, .1, None)],
                               "case_id string, regime string, alpha_deg double, Re double, thickness double, y_plus_target double")
    st = spark.createDataFrame([("c1", 900, .5, .001, .01, .0001, None), ("c2", 900, .9, .001, .02, .0001, None), ("c3", 1600, .4, .02, .01, .0001, None)],
                               "case_id string, n_iters long, Cl_mean double, Cl_std double, Cd_mean double, Cd_std double, error string")
    lg = spark.createDataFrame([("c1", 10.0, False), ("c2", 11.0, False), ("c3", 12.0, False)], "case_id string, runtime_s double, fatal boolean")
    yp = spark.createDataFrame([("c1", 31.0), ("c3", 0.5)], "case_id string, y_plus_mean double")
    clean = cases.clean_dataset(cs, st, lg, yp, ["C"])
    got = {r.case_id: r for r in clean.collect()}
    assert set(got) == {"c1", "c3"} and got["c1"].validated and not got["c3"].validated and got["c1"].L_over_D == pytest.approx(50)
    counts = {r.status: r.n for r in cases.harvest_counts(cs, st, clean).collect()}
    assert counts == {"converged": 2, "failed": 1, "not_run": 1}
    assert [r.case_id for r in cases.missing_cases(cs, st).collect()] == ["c4"]


def test_validation_metadata(spark, tmp_path):
    from aeroframe.operators import compare
    doc = {"validation_cases": [{"case_id": "v1", "airfoil": "0012", "alpha_deg": 4.0, "Re": 6e6, "references": {
        "cfd_reference": {"label": "cfd", "Cl": 0.45, "Cd": 0.008}, "experimental_primary": {"label": "exp", "Cl": 0.44}, "engineering_reference": {"tool": "xfoil"}}}],
        "tolerances": {"delta_Cl_pct": 3.0}}
    v = cases.validation_cases(spark, write(tmp_path / "m.json", json.dumps(doc)))
    stats = spark.createDataFrame([("v1", 0.45, 0.0081)], "case_id string, Cl_mean double, Cd_mean double")
    c = compare.compare_coefficients(stats, compare.declared_references(v).drop("alpha_deg"))
    got = {r.role: r for r in c.collect()}
    assert set(got) == {"cfd_reference", "experimental_primary"} and got["experimental_primary"].Cd_err_pct is None
    verdict = compare.case_verdicts(c, v.select("case_id", "Cl_tol", "Cd_tol")).first()
    assert verdict.role == "experimental_primary" and verdict.passed and verdict.Cl_err_pct == pytest.approx(100 * 0.01 / 0.44)
    assert compare.comparison_summary(stats, c).count() == 2


def test_shards_and_global_row(spark, tmp_path):
    root = str(tmp_path / "s")
    os.makedirs(root)
    for i in range(3):
        spark.range(i * 10, i * 10 + 4).coalesce(1).write.parquet(f"{root}/t{i}")
        part = [f for f in os.listdir(f"{root}/t{i}") if f.endswith(".parquet")][0]
        os.rename(f"{root}/t{i}/{part}", f"{root}/all-{i:05d}-of-00003.parquet")
    got = samples.global_row_index(samples.read_shards(spark, root)).orderBy("sample_id").collect()
    assert [(r.sample_id, r.id) for r in got] == [(k, (k // 4) * 10 + k % 4) for k in range(12)]
    os.rename(f"{root}/all-00002-of-00003.parquet", f"{root}/gone.bak")
    with pytest.raises(FileNotFoundError):
        samples.read_shards(spark, root)
    with pytest.raises(FileNotFoundError):
        samples.resolve_folder(None, "NO_SUCH_VARIABLE")


def test_nested_samples(spark):
    from aeroframe.tables import SAMPLE_STRUCTS
    df = spark.createDataFrame([(3, {"aoa": 0.1}, [(0.0, 1.0, 0.5, 7.0, 1.0, 2.0, 0.0), (1.0, 1.0, 0.0, 8.0, 1.0, 2.0, 0.0)], [(0, 1, 0)])], SAMPLE_STRUCTS)
    assert [(r.node_id, r.p) for r in samples.nodes_of(df).collect()] == [(0, 7.0), (1, 8.0)]
    assert samples.nodes_of(df, flow=False).columns == ["sample_id", "node_id", "x", "y", "implicit_distance"]
    assert samples.triangles_of(df).first().n1 == 1 and samples.scalars_of(df, {"alpha_rad": "aoa", "u": "none"}).first().u is None
    assert samples.pick_samples(df, [4]).count() == 0 and samples.pick_samples(df, spark.createDataFrame([(3,)], "sample_id int")).count() == 1


def test_csv_frozen_and_merge(spark, tmp_path):
    c = write(tmp_path / "t.csv", "sample_id,name,v\n1,NA,0.5\n2,,\n")
    got = tabular.read_csv(spark, c, "sample_id int, name string, v double").orderBy("sample_id").collect()
    assert got[0].name == "NA" and got[1].name is None and got[1].v is None
    out = str(tmp_path / "out")
    tabular.write_csv(spark.createDataFrame([(1, 1 / 3)], "k int, v double").coalesce(1), out, digits=6)
    assert "0.333333" in "".join(open(f"{out}/{f}").read() for f in os.listdir(out) if f.endswith(".csv"))
    ids = spark.createDataFrame([(1,), (2,)], "sample_id int")
    fz = str(tmp_path / "frozen")
    assert tabular.write_frozen(ids, fz) and not tabular.write_frozen(ids, fz)
    with pytest.raises(ValueError, match="frozen"):
        tabular.write_frozen(ids.limit(1), fz)
    assert tabular.read_optional(spark, str(tmp_path / "none"), "task string, v double", {"task": "full"}).count() == 0
    old = spark.createDataFrame([(1, 0.1), (2, 0.2)], "sample_id int, gp double")
    new = spark.createDataFrame([(1, 0.3), (2, 0.4)], "sample_id int, rf double")
    assert set(tabular.merge_columns(old, new, "sample_id").columns) == {"sample_id", "rf", "gp"}
    assert tabular.merge_columns(old, new.limit(1), "sample_id").columns == ["sample_id", "rf"]
    kept = tabular.overlay_entries(spark.createDataFrame([("a", 1), ("b", 2)], "family string, v int"), spark.createDataFrame([("b", 9)], "family string, v int"), ["family"])
    assert sorted((r.family, r.v) for r in kept.collect()) == [("a", 1), ("b", 9)]
    fl = write(tmp_path / "splits.json", json.dumps({"full_train": [3, 1], "full_test": [2]}))
    assert {r.name: list(r.ids) for r in samples.split_lists(spark, fl).collect()} == {"full_train": [3, 1], "full_test": [2]}


def test_text_helpers(spark):
    df = spark.createDataFrame([('"alpha, deg","x/c","C_p "',), ("a, b deg",)], "t string")
    assert [r[0] for r in df.select(text.column_names(F.col("t"))).collect()] == [["alpha_deg", "x_c", "c_p"], ["a", "b_deg"]]
    ids, bad = cases.expand_ids(spark.createDataFrame([("1-5",), ("8",), ("4",), ("7-3",), ("x",)], "item string"))
    assert [r.case_number for r in ids.collect()] == [1, 2, 3, 4, 5, 8] and sorted(r.item for r in bad.collect()) == ["7-3", "x"]


def test_hard_checks_with_missing_numbers(spark):
    nan = float("nan")
    rows = [(0, 1.0, 3e6, .12, .3, 0., 0., .5, .01), (1, 1.0, 3e6, .12, .3, 0., 0., .5, nan), (2, 1.0, 3e6, .12, .3, 0., 0., 2.6, .01), (3, 2.0, 3e6, .12, .3, 0., 0., .5, .4), (4, 3.0, 3e6, .12, .3, 0., 0., None, .01)]
    df = spark.createDataFrame(rows, "sample_id int, alpha_deg double, Re double, t_max double, x_tmax double, m_max double, x_m double, Cl double, Cd double")
    got = {r.sample_id: r for r in quality.hard_checks(df).collect()}
    assert got[0].qa_pass and got[0].qa_reason == ""
    assert got[1].rules == ["non_finite", "cd_range", "duplicate"] and got[2].rules == ["cl_range", "duplicate"] and got[3].rules == ["cd_range"]
    assert got[4].rules == ["non_finite", "cl_range"] and "duplicate of sample 0" in got[1].qa_reason
    assert not quality.failure_gate(quality.hard_checks(df)).first().ok


def test_published_tables(spark, tmp_path):
    from aeroframe.sources import references
    body = 'variables="alpha, deg","cl","cd"\nzone, t="80 grit"\n-4.0 -0.43 0.0087\n0 0 0.008\nzone, t="120 grit"\n0 0.01 0.0081\n'
    ls = lines.read_lines(spark, write(tmp_path / "f.dat", body))
    f = references.force_reference(ls, "ladson_forces")
    assert f.count() == 2 and f.first().source.endswith("(80 grit)") and references.force_reference(ls, "ladson_forces", all_zones=True).count() == 3
    lift = references.force_reference(ls, "abbott_lift")
    both = references.all_references(f, lift)
    assert both.count() == 5 and both.filter("Cd is null").count() == 3
    loop = references.loop_pressure_reference(lines.read_lines(spark, write(tmp_path / "c.dat", "1 0.0 0.2\n0 0.1 -2\n1 -0.01 0.2\n")))
    assert sorted(r.surface for r in loop.collect()) == ["lower", "upper", "upper"] and loop.first().alpha_deg == 13.87
    cp = references.pressure_reference(lines.read_lines(spark, write(tmp_path / "p.dat", 'zone, t="alpha=0"\n0 1\nzone, t="alpha=10"\n0 0.5\n')), "s")
    assert references.zone_at(cp, 10.2).count() == 1 and references.zone_at(cp, 5.0).count() == 2


def test_reference_choice_and_polars(spark):
    from aeroframe.sources import references
    refs = spark.createDataFrame([("c1", 0, "experimental_primary", None, "e.dat", None), ("c1", 1, "cfd_reference", None, "f.dat", None), ("c1", 2, "engineering_reference", "xfoil", None, None),
                                  ("c2", 0, "engineering_reference", "xfoil", None, "x.dat"), ("c2", 1, "cfd_reference", None, "f.dat", None), ("c3", 0, "other", None, "z.dat", None)],
                                 "case_id string, seq int, role string, tool string, file_cp string, expected_file string")
    assert {r.case_id: r.file for r in references.chosen_pressure_source(refs).collect()} == {"c1": "f.dat", "c2": "x.dat"}
    asked = spark.createDataFrame([(1, "p", 4.03, "xfoil", None, None), (2, "p", 4.2, "xfoil", None, None), (3, "p", 4.0, "xfoil", 0.5, None), (4, None, 4.0, None, 0.1, 0.2)],
                                  "id int, polar string, alpha_deg double, tool string, Cl double, Cd double")
    polars = spark.createDataFrame([("p", 0, 4.0, 0.44, 0.007), ("p", 1, 4.05, 0.45, 0.008)], "polar string, seq int, alpha_deg double, Cl double, Cd double")
    got = {r.id: (r.Cl, r.Cd) for r in references.fill_from_polars(asked, polars).collect()}
    assert got == {1: (0.44, 0.007), 2: (None, None), 3: (0.5, None), 4: (0.1, 0.2)}
