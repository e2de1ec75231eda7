"""Readers of what the writers wrote, and of folders with other files in them."""

from __future__ import annotations

import json

from veilmark.operators import scores
from veilmark.sources import tables


def test_results_survive_a_session_and_condense(spark, tmp_path):
    rows = [("d1", "train", "all", "o", "close", "", 0.5), ("d1", "anon_k5", "all", "o", "aia", "price", 0.25), ("d2", "synth", "qid", "h", "close", "", None)]
    df = spark.createDataFrame(rows, tables.RESULT_SCHEMA)
    tables.write_results(df, f"{tmp_path}/r")
    back = tables.read_results(spark, f"{tmp_path}/r")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    wide = {(r["dataset"], r["family"], r["release"]): r["close"] for r in scores.condense(back, ["close", "aia__price"]).collect()}
    assert wide["d1", "a", "train"] == wide["d1", "s", "train"] == 0.5


def test_result_trees(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"train": {"reg": {"mae": 1.5, "r2": 0.5}}, "1_0": {"cls": {"f1": 0.25}}}, indent=2))
    (tmp_path / "b.json").write_text("{}")
    got = sorted(map(tuple, tables.read_result_trees(spark, str(tmp_path)).collect()))
    assert got == [("1_0", "cls", "f1", 0.25), ("train", "reg", "mae", 1.5), ("train", "reg", "r2", 0.5)]


def test_metric_names(spark):
    df = spark.createDataFrame([("nn_accuracy_o_qid_mean",), ("close",)], "metric string")
    assert [tuple(r) for r in tables.split_metric(df).collect()] == [("nn_accuracy_o_qid_mean", "nn_accuracy", "o", "qid", "mean"), ("close", "close", None, None, None)]


def test_settings_configs_statistics(spark, tmp_path):
    tables.write_settings(spark, [("k=5", ["age", "sex"], ["income"]), ("k=10", ["age"], [])], f"{tmp_path}/s")
    got = sorted((r["privacy_models"], r["qid"], r["sa"]) for r in tables.read_settings(spark, f"{tmp_path}/s").collect())
    assert got == [("k=10", ["age"], []), ("k=5", ["age", "sex"], ["income"])]
    tables.write_configs(spark, [{"k": 5, "qid": "a"}, {"k": 10, "qid": "b"}], f"{tmp_path}/c")
    assert spark.read.csv(f"{tmp_path}/c", sep=";", header=True, inferSchema=True).orderBy("config").select("k").collect() == [(5,), (10,)]
    tables.write_statistics(spark.createDataFrame([("0_1", 3)], "node string, n long"), f"{tmp_path}/x")
    tables.write_statistics(spark.createDataFrame([("1_1", 0.5)], "node string, loss double"), f"{tmp_path}/y")
    both = {r["dataset"]: (r["node"], r["n"], r["loss"]) for r in tables.read_statistics(spark, {"x": f"{tmp_path}/x", "y": f"{tmp_path}/y"}).collect()}
    assert both == {"x": ("0_1", 3, None), "y": ("1_1", None, 0.5)}


def test_releases_are_told_from_other_files(spark, tmp_path):
    for name in ("1/0_1_2.csv", "2/synth.csv", "2/settings.csv", "hierarchies/age.csv", "configs.csv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("age,zip\n1,2\n" if "hier" not in name else "1;*\n")
    got = {r["name"]: r["levels"] for r in tables.read_releases(spark, str(tmp_path), ["age", "zip"]).collect()}
    assert got == {"0_1_2": [0, 1, 2], "synth": None}


def test_index_and_bad_rows(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,age\n7,***\n8,41\n")
    assert sorted(map(tuple, tables.read_microdata(spark, f"{tmp_path}/m.csv", ["id", "age"], "id").collect())) == [(7, "*"), (8, "41")]
    (tmp_path / "t.csv").write_text("id,age\n1,30\n2,old\n3,é\n4,31\n")
    assert [r["id"] for r in tables.read_typed(spark, f"{tmp_path}/t.csv", "id int, age int").orderBy("id").collect()] == [1, 4]
