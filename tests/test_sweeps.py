"""Groups of transcripts, and grids of runs that go on where they broke off."""

import json

import pytest

from fraglens import cli
from fraglens.operators import sweeps
from tests.test_quantify import GENES


def frame(spark):
    rows = [("a", "r", 1, 0, 100, 2), ("b", "r", 1, 50, 300, 1), ("c", "r", 2, 60, 90, 2), ("d", "r", 1, 400, 500, 1), ("e", "q", 1, 0, 10, 1), ("f", "r", 1, 500, 620, 3), ("g", "r", 1, 501, 621, 3)]
    return spark.createDataFrame([(n, ref, s, lo, hi, [(lo, hi)] * k) for n, ref, s, lo, hi, k in rows], "t_id string, ref string, strand int, start int, end int, exons array<struct<s:int,e:int>>")


def test_groups(spark):
    got = {r.label: (list(r.members), r.strand, r.start, r.end, r.carrier) for r in sweeps.nascent_groups(frame(spark)).collect()}
    assert got == {"nrna_a": (["a", "b"], 1, 0, 300, "a"), "nrna_c": (["c"], 2, 60, 90, "c"), "nrna_d": (["d", "f", "g"], 1, 400, 621, "f"), "nrna_e": (["e"], 1, 0, 10, "e")}
    given = spark.createDataFrame([("mine", "a"), ("mine", "d"), ("nrna_b", "c")], "label string, t_id string")
    got = {r.label: (list(r.members), r.start, r.end, r.carrier) for r in sweeps.nascent_groups(frame(spark), given).collect()}
    assert got == {"mine": (["a", "d"], 0, 500, "a"), "nrna_b": (["c"], 60, 90, "c"), "nrna_1_50_300": (["b"], 50, 300, "b"), "nrna_e": (["e"], 0, 10, "e"), "nrna_f": (["f", "g"], 500, 621, "f")}
    for bad, says in (([("x", "zz")], "unknown"), ([("x", "a"), ("x", "c")], "different"), ([("x", "a"), ("x", "e")], "different")):
        with pytest.raises(Exception, match=says):
            sweeps.nascent_groups(frame(spark), spark.createDataFrame(bad, "label string, t_id string")).collect()


def test_grid_goes_on_where_it_broke_off(spark, tmp_path):
    ran = []

    def run(point):
        ran.append(point)
        if point["b"] == 2 and len(ran) < 3:
            raise RuntimeError("broken off")
        return spark.createDataFrame([("mrna", "t", 10.0, 10.0 + point["a"])], "pool string, t_id string, expected double, observed double")

    specs = {"a": {"start": 0, "stop": 2, "step": 2}, "b": [1, 2]}
    with pytest.raises(RuntimeError):
        sweeps.sweep(spark, specs, f"{tmp_path}/p", run)
    assert sweeps.sweep(spark, specs, f"{tmp_path}/p", run) == (3, 1)
    assert sweeps.sweep(spark, specs, f"{tmp_path}/p", run) == (0, 4) and len(ran) == 5
    assert sweeps.sweep(spark, specs | {"b": [1, 2, 3]}, f"{tmp_path}/p", run) == (2, 4)
    got = sweeps.sweep_results(spark, f"{tmp_path}/p").collect()
    assert sorted((r.settings["a"], r.settings["b"], r.abs_diff, r.rel_err) for r in got) == [(a, b, float(a), float(a) / 10) for a in "02" for b in "123"]
    assert sweeps.point_name({"x": 1, "y": 2}) == sweeps.point_name({"y": 2, "x": 1}) != sweeps.point_name({"x": 2, "y": 1})


def test_a_simulated_point_through_the_command_line(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "a.gtf").write_text("\n".join(GENES))
    (tmp_path / "g.fai").write_text("chr1\t30000\t6\t71\t72\n")
    (tmp_path / "grid.json").write_text(json.dumps({"mrna": 300, "gdna": 30, "seed": 5, "assignment_mode": "map", "abundance_t1": [5.0]}))
    cli.main(["index", "--gtf", f"{d}/a.gtf", "--out", f"{d}/index"], spark)
    cli.main(["sweep", "--index", f"{d}/index", "--references", f"{d}/g.fai", "--grid", f"{d}/grid.json", "--out", f"{d}/out"], spark)
    got = sweeps.sweep_results(spark, f"{d}/out/points")
    by = {(r.pool, r.t_id): r for r in got.collect()}
    assert sum(r.expected for (pool, _), r in by.items() if pool == "mrna") == 300 and by["gdna", None].expected == 30
    assert by["mrna", "t3"].observed == pytest.approx(by["mrna", "t3"].expected, rel=0.3, abs=12)
    assert {(r.pool, r.expected) for r in sweeps.sweep_summary(got).collect()} == {("mrna", 300.0), ("nrna", 0.0), ("gdna", 30.0)}
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{d}/out/summary").count() == 3
    with pytest.raises(ValueError, match="unknown"):
        sweeps.simulated_point(spark.read.parquet(f"{d}/index/transcripts"), None, {"mrna": 1, "wrong": 2})
