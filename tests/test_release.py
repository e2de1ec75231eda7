"""Hand-computed cases and identities of hierarchies, distances, releases and metrics."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilmark.functions.geo import haversine_km
from veilmark.functions.ranges import half_open_midpoint, midpoint, parse_range
from veilmark.operators import counts, distance, facility, knn, models, prep, privacy, report, scores, synth
from veilmark.operators import generalize as G
from veilmark.operators import hierarchy as H
from veilmark.sources import tables
from veilmark.spec import DatasetSpec


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_interval_hierarchy(spark):
    h = H.interval_hierarchy(spark, "age", 1, 100).check()
    rows = {r["l0"]: list(r)[1:] for r in h.frame.collect()}
    assert rows["20"] == ["[16, 21[", "[11, 21[", "[1, 21[", "[1, 41[", "*"]
    assert rows["100"] == ["[96, 101[", "[91, 101[", "[81, 101[", "[81, 101[", "*"]
    assert len(rows) == 100


def test_redaction_and_order(spark):
    z = spark.createDataFrame([("12345",), ("12345",)], "zip string")
    assert list(H.redaction_hierarchy(z, "zip", 5).frame.first())[2] == "123**"
    s = spark.createDataFrame([("never smoked",), ("smokes",), ("formerly smoked",)], "s string")
    h = H.order_hierarchy(s, "s", F.when(F.col("s") == "never smoked", F.col("s")).otherwise("ever smoked"))
    nodes = {r["node"]: (r["level"], r["leaves"]) for r in H.node_leaves(h).collect()}
    assert nodes["never smoked"] == (1, ["never smoked"])  # a leaf and a group of the same name
    assert nodes["*"][1] == ["formerly smoked", "never smoked", "smokes"]


def test_hierarchy_check_fails(spark):
    with pytest.raises(ValueError):
        H.Hierarchy("a", spark.createDataFrame([("x", "y"), ("z", "w")], "l0 string, l1 string"), 2).check()
    with pytest.raises(ValueError):
        DatasetSpec("t", ("a",), ("b",), ("a",))


@pytest.mark.parametrize(("text", "lo", "hi"), [("[1, 6[", 1, 5), ("12***", 12000, 12999), ("*", 1, 100), ("*****", 1, 100), ("7", 7, 7), ("odd", None, None), (None, None, None)])
def test_parse_range(spark, text, lo, hi):
    r = one(spark, parse_range(F.lit(text).cast("string"), 1, 100))
    assert (r["lo"], r["hi"]) == (lo, hi)


def test_midpoints(spark):
    assert one(spark, midpoint(F.lit("[1, 6["), 1, 100)) == 3
    assert one(spark, midpoint(F.lit("*"), 1, 100)) == 50.5
    assert one(spark, half_open_midpoint(F.lit("[1, 6["), 42)) == 3
    assert one(spark, half_open_midpoint(F.lit("*"), 42)) == 42


def test_numeric_distances(spark):
    lit = F.lit
    assert one(spark, distance.numeric(lit(30), lit(40), 99)) == pytest.approx(10 / 99)
    covered = lambda x, lo, hi: one(spark, distance.numeric_covered(lit(x), lit(lo), lit(hi), 99.0))
    assert covered(3, 1, 5) == pytest.approx(1.6 / 99)
    assert covered(3, 1, 100) == pytest.approx(33.33 / 99)
    assert covered(10, 1, 5) == 99
    same = lambda a, b: one(spark, distance.numeric_ranges(lit(a[0]), lit(a[1]), lit(b[0]), lit(b[1]), 99))
    assert same((1, 5), (6, 10)) == 99 and same((1, 5), (1, 5)) == 0


def test_category_distances(spark):
    lits = lambda *v: [F.lit(x) for x in v]
    assert one(spark, distance.edge(lits("Female", "*"), lits("Male", "*"))) == 1
    assert one(spark, distance.edge_covered(lits("Female", "*"), F.lit("*"))) == 0.5
    formerly, smokes, never = lits("formerly", "ever", "*"), lits("smokes", "ever", "*"), lits("never", "never", "*")
    assert one(spark, distance.edge(formerly, smokes)) == 0.5
    assert one(spark, distance.edge(never, smokes)) == 1
    assert one(spark, distance.edge_covered(smokes, F.lit("ever"))) == 0.25
    assert one(spark, distance.edge_covered(never, F.lit("ever"))) == 4
    assert one(spark, distance.edge_covered(smokes, F.lit("*"))) == 0.5
    assert one(spark, distance.record({"a": F.lit(0.3), "b": F.lit(0.4)})) == pytest.approx(0.353553, abs=1e-6)


def test_suppression(spark):
    rows = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",)], "q string")
    out = [tuple(r) for r in G.suppress(rows, ["q"], 2).collect()]
    assert sorted(out) == [("*", True)] + [("a", False)] * 3 + [("b", False)] * 2
    assert G.suppress(rows.limit(0), ["q"], 2).count() == 0


def test_level_zero_is_identity_and_sampling_stays_below(spark):
    h = {"v": H.interval_hierarchy(spark, "v", 1, 20)}
    rows = spark.range(1, 21).select(F.col("id").alias("rid"), F.col("id").cast("string").alias("v"))
    assert sorted(map(tuple, G.generalize(rows, h, {"v": 0}).collect())) == sorted(map(tuple, rows.collect()))
    g = G.generalize(rows, h, {"v": 1})
    back = {r["rid"]: int(r["v"]) for r in G.sample_to_original(g, h, ["v"], "rid").collect()}
    assert all((rid - 1) // 5 == (v - 1) // 5 for rid, v in back.items()) and len(back) == 20


def test_lattice_agrees_with_rows(spark):
    h = {"v": H.interval_hierarchy(spark, "v", 1, 20)}
    rows = spark.range(0, 60).select((F.col("id") % 20 + 1).alias("v"))
    classes = G.lattice_classes(G.distinct_combinations(rows, ["v"]), h, ["v"])
    stats = {r["node"]: r for r in G.lattice_statistics(classes, 5).collect()}
    assert stats["0"]["n_suppressed"] == 60 and stats["0"]["discernibility"] == 3600
    assert stats["1"]["n_classes"] == 4 and stats["5"]["max_class"] == 60


def test_classification_metric(spark):
    rows = spark.createDataFrame([("a", True), ("a", True), ("a", False), ("b", False)], "q string, t boolean")
    assert G.classification_metric(rows, ["q"], F.col("t")).first()["cm"] == 0.25


def test_count_estimate(spark):
    nodes = H.leaf_nodes(H.interval_hierarchy(spark, "age", 1, 100)).select(F.col("attribute").alias("column"), "node", "leaf")
    combos = spark.createDataFrame([("[1, 6[", 10)], "age string, n long")
    asked = spark.createDataFrame([(0, "age", x) for x in ("1", "2", "50")] + [(1, "age", "99")], "query_id long, column string, leaf string")
    got = {r["query_id"]: r["estimate"] for r in counts.estimate(combos, ["age"], asked, nodes).collect()}
    assert got == {0: 4.0, 1: 0.0}
    real = spark.createDataFrame([(0, 10.0), (1, 0.0)], "query_id long, estimate double")
    guess = spark.createDataFrame([(0, 8.0), (1, 3.0)], "query_id long, estimate double")
    assert counts.relative_error(real, guess).first()[0] == pytest.approx(0.2)


def test_random_workload_is_seeded(spark):
    leaves = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "1"), ("b", "2"), ("b", "3")], "column string, leaf string")
    first, again = (sorted(map(tuple, counts.random_workload(leaves.repartition(k), 40).collect())) for k in (1, 3))
    assert first == again and {r[0] for r in first} == set(range(40)) and len(first) == len(set(first))
    per = {q: {r[1:] for r in first if r[0] == q} for q in range(40)}
    assert {len({c for c, _ in v}) for v in per.values()} == {1, 2} and max(len(v) for v in per.values()) == 5
    other = sorted(map(tuple, counts.random_workload(leaves, 40, seed=1).collect()))
    assert other != first


def test_privacy_ratios(spark):
    nn = lambda v: spark.createDataFrame([(i, x) for i, x in enumerate(v)], "query_id long, dist double")
    assert privacy.similarity_ratio(nn([0.1, 0.5]), nn([0.2, 0.2])).first()[0] == 0.5
    assert privacy.distance_summary(nn([0.0, 0.1, 0.2])).first()["median"] == pytest.approx(0.1)
    _, overlap, inside = privacy.overlap_scores(F.lit(10.0), F.lit(11.0), F.lit(2.0), F.lit(4.0))
    assert one(spark, overlap) == 0.5 and one(spark, inside) == 1
    assert one(spark, privacy.generalization_score(F.lit(True), F.lit(5))) == 0.2


def test_identity_release(spark):
    rows = spark.createDataFrame([(i, float(i % 7)) for i in range(40)], "rid long, x double")
    d, keys = distance.numeric(F.col("q_x"), F.col("c_x"), 6), ["x"]
    near = knn.nearest(rows, rows, d, keys)
    assert near.agg(F.max("dist")).first()[0] == 0
    other = knn.nearest_other(rows, d, keys)
    assert privacy.adversarial_accuracy(near, other, near, other).first()[0] == 0


def test_top_k_ties_and_cells(spark):
    rows = spark.createDataFrame([(i, float(i // 2)) for i in range(30)], "rid long, x double")
    d = distance.numeric(F.col("q_x"), F.col("c_x"), 1)
    p = knn.pairs(rows, rows, cell_rows=7)
    assert p.count() == 900
    got = {(r["query_id"], r["rank"]): r["cand_id"] for r in knn.top_k(rows, rows, d, 3).collect()}
    assert [got[4, k] for k in (1, 2, 3)] == [4, 5, 2]


def test_imputation(spark):
    rows = spark.createDataFrame([(1, "g", "b", 1.0), (2, "g", "a", 2.0), (3, "g", None, None), (4, "h", None, None), (5, None, "z", 3.0), (6, None, None, None)], "rid int, g string, s string, x double")
    mode = {r["rid"]: r["s"] for r in prep.impute_mode(rows, ["g"], "s").collect()}
    assert mode == {1: "b", 2: "a", 3: "a", 4: None, 5: "z", 6: "z"}
    mean = {r["rid"]: r["x"] for r in prep.impute_mean(rows, ["g"], "x").collect()}
    assert mean[3] == 1.5 and mean[4] is None and mean[6] == 3.0
    assert [one(spark, prep.tens(F.lit(v))) for v in (25, 35)] == [20, 40]
    sick = spark.createDataFrame([("F", 5, "smokes", 15.0), ("F", 41, "smokes", 20.0), ("F", 44, None, 30.06), ("F", 43, "smokes", None)], "gender string, age int, smoking_status string, bmi double")
    got = {r["age"]: (r["smoking_status"], r["bmi"]) for r in prep.clean_patients(sick).collect()}
    assert got[5][0] == "never smoked" and got[44][0] == "smokes" and got[43][1] == 25.0
    assert prep.bucket_count(0.0, 0.0, 34.9) == 10
    edge = lambda v: one(spark, prep.bucketize(F.lit(v), 0.0, 10.0, 5))
    assert [edge(v) for v in (0.0, 1.999, 2.0, 10.0, 10.009, 10.01, -0.001, None)] == [0, 0, 1, 4, 4, None, None, None]


def test_facility(spark):
    km = one(spark, haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))
    assert km == pytest.approx(3.14159265 * 6371.0088, rel=1e-6)
    w = facility.patient_weight(F.lit(1), F.lit(50), F.lit(1), F.lit(100), F.lit(30), F.lit(1.0), F.lit(50000))
    assert one(spark, w) == pytest.approx(54.5556, abs=1e-3)
    rows = spark.createDataFrame(
        [("Male", "50", "1", "100", "30", "smokes", "50000"), ("Male", "[50, 51[", "1", "100", "30", "smokes", "50000"), ("*", "*", "0", "55", None, "odd", "0")],
        "gender string, age string, hypertension string, avg_glucose_level string, bmi string, smoking_status string, Income string",
    )
    got = [r["weight"] for r in facility.weigh_patients(rows).collect()]
    assert got[0] == got[1] == pytest.approx(54.5556, abs=1e-3) and got[2] == pytest.approx(100 * (0.15 * 41 / 81 + 0.15 * 18.7 / 87.3))
    zones = spark.createDataFrame([(i, float(i), 0.0) for i in range(6)], "zone int, lat double, lon double")
    need = zones.select("zone", F.lit(1.0).alias("weight"))
    sites = zones.withColumnRenamed("zone", "site")
    chosen, cost = facility.choose_sites(need, facility.distance_table(zones, sites), 2)
    assert cost == pytest.approx(4 * 111.195, rel=1e-3) and len(chosen) == 2


def test_scores(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "t string, g string")
    r = scores.classification_report(rows, "t", "g").first()
    assert r["accuracy"] == pytest.approx(2 / 3) and r["support"] == 3


def test_mixture_and_networks(spark):
    rows = spark.createDataFrame([(float(i % 2 * 10 + i % 5 / 10),) for i in range(200)], "x double")
    m = models.best_mixture(rows, ["x"], 2)
    assert len(m.weights) == 2 and sorted(round(a[0]) for a in m.means) == [0, 10]
    t = spark.createDataFrame([(str(i % 3), str(i % 3), str(i % 2)) for i in range(90)], "a string, b string, c string")
    edges = models.network_edges(t, ["a", "b", "c"], {"a": 3, "b": 3, "c": 2})
    assert edges == {frozenset("ab")} and models.relational_similarity(edges, edges) == 1
    assert synth.dependency_tree(t, ["a", "b", "c"])["b"] == "a"
    drawn = synth.tree(spark, t, {"a": None, "b": "a"}, 50)
    assert drawn.where("a <> b or a is null").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "h.csv").write_text('a;"x;y";*\nb;z;*\n')
    assert [tuple(r) for r in tables.read_hierarchy(spark, str(tmp_path / "h.csv"), 3).collect()] == [("a", "x;y", "*"), ("b", "z", "*")]
    (tmp_path / "settings.csv").write_text("privacy-models;qid;sa\nk;[a, b];[c]\n")
    assert tables.read_settings(spark, str(tmp_path / "settings.csv")).first()["qid"] == ["a", "b"]
    (tmp_path / "1_2.csv").write_text("q,s\n*****,1\n7,2\n")
    assert [r["q"] for r in tables.read_microdata(spark, str(tmp_path / "1_2.csv"), ["q", "s"]).collect()] == ["*", "7"]
    got = tables.read_releases(spark, str(tmp_path), ["q", "s"]).select("name").distinct()
    assert {r["name"] for r in got.collect()} == {"1_2", "h"}
    status = spark.createDataFrame([("d", "r", None), ("d", "s", "boom")], "dataset string, release string, error string")
    assert [r["release"] for r in tables.failed(status).collect()] == ["s"]


def test_report_keeps_failures(spark):
    metrics = {"good": lambda: spark.range(1).select(F.lit(2.0).alias("a"), F.lit(None).cast("double").alias("b")), "bad": lambda: spark.range(1).select("missing"), "skipped": lambda: 1 / 0}
    rows = [tuple(r) for r in report.measure(spark, "r", metrics, ["good", "bad"]).collect()]
    assert rows[:2] == [("r", "good", "a", 2.0, None), ("r", "good", "b", None, None)] and rows[2][1] == "bad" and rows[2][4]
    assert G.parameter_grid(k=[5, 10], qid=["a"]) == [{"k": 5, "qid": "a"}, {"k": 10, "qid": "a"}]


def test_levels_of_a_release_apply_to_the_holdout(spark):
    frame = spark.createDataFrame([("a", "x", "*"), ("b", "x", "*"), ("c", "y", "*")], "l0 string, l1 string, l2 string")
    h = {"s": H.Hierarchy("s", frame, 3)}
    train, held = spark.createDataFrame([("x",)], "s string"), spark.createDataFrame([("a",), ("c",)], "s string")
    assert sorted(r["s"] for r in G.generalize_as_released(held, train, h, [1], ["s"]).collect()) == ["*", "x"]
    for levels in ([3], [], [1, 1]):
        with pytest.raises(ValueError):
            G.generalize_as_released(held, train, h, levels, ["s"])
    assert {(r["leaf"], r["group"], r["group_size"]) for r in H.first_level(h["s"]).collect()} == {("a", "x", 2), ("b", "x", 2), ("c", "y", 1)}


def test_bands(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 19.9, 20.0, 100.0, None)], "v double")
    got = [r[0] for r in df.select(prep.banded(F.col("v"), [0, 20], ["below", "low", "high"])).collect()]
    assert got == ["below", "low", "low", "high", "high", None]
    with pytest.raises(ValueError):
        prep.banded(F.col("v"), [20, 0], ["a", "b", "c"])
