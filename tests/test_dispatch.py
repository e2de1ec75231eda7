"""The method of a column follows from its specification, and each gives the hand-computed distance."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from veilmark.functions.ranges import parse_range
from veilmark.operators import distance as D
from veilmark.operators import knn, privacy
from veilmark.operators.dispatch import Distances, domains
from veilmark.operators.hierarchy import Hierarchy, interval_hierarchy
from veilmark.spec import DatasetSpec

SPEC = DatasetSpec("t", ("age", "income", "job", "city", "sex"), ("age", "income"), ("age", "job"), ("income",), {"age": (1, 100)})


@pytest.fixture(scope="module")
def how(spark):
    jobs = spark.createDataFrame([("a", "x", "*"), ("b", "x", "*"), ("c", "y", "*")], "l0 string, l1 string, l2 string")
    cities = spark.createDataFrame([("p", "q", 0.25)], "a string, b string, d double")
    return Distances(SPEC, {"age": (1, 100), "income": (0, 10)}, {"age": interval_hierarchy(spark, "age", 1, 100), "job": Hierarchy("job", jobs, 3)}, {"city": cities})


def _table(spark, rows):
    return spark.createDataFrame(rows, "age string, income double, job string, city string, sex string")


def _one(how, q, c):
    d = how.between(how.originals(q), how.originals(c))
    return knn.pairs(how.attach(q), how.attach(c)).select(d.alias("d")).first()["d"]


def test_methods(how):
    assert {c: how.method(c) for c in SPEC.columns} == {"age": "ranges", "income": "numeric", "job": "edge", "city": "given", "sex": "edge"}


def test_original_columns(spark, how):
    mixed = _table(spark, [("3", 1.0, "a", "p", "f"), ("[1, 6[", 1.0, "x", "p", "*"), (None, None, None, None, None)])
    assert how.originals(mixed) == {"income", "city"}
    assert how.originals(_table(spark, [("3", 1.0, "a", "p", "f")])) == set(SPEC.columns)
    assert how.originals(mixed.limit(0)) == set(SPEC.columns)


def test_distances_by_hand(spark, how):
    q = _table(spark, [("3", 2.0, "a", "p", "f")])
    near = [("4", 4.0, "b", "q", "m")]
    assert _one(how, q, _table(spark, near)) == pytest.approx(math.sqrt(((1 / 99) ** 2 + 0.2**2 + 0.5**2 + 0.25**2 + 1) / 5))
    wide = _table(spark, [("[1, 6[", 2.0, "x", "p", "*")])
    expected = math.sqrt(((1.6 / 99) ** 2 + 0.25**2 + 0.5**2) / 5)
    assert _one(how, q, wide) == pytest.approx(expected) == _one(how, wide, q)
    assert _one(how, wide, wide) == 0
    other = _table(spark, [("[6, 11[", 2.0, "y", "p", "*")])
    assert _one(how, wide, other) == pytest.approx(math.sqrt((99**2 + 4**2) / 5))
    assert _one(how, q, _table(spark, [("3", 2.0, "a", "unknown", "f")])) is None


def test_domains_and_mistakes(spark, how):
    assert domains(_table(spark, [("3", 2.0, "a", "p", "f"), ("4", 7.0, "a", "p", "f")]), SPEC) == {"age": (1, 100), "income": (2.0, 7.0)}
    with pytest.raises(ValueError):
        Distances(SPEC, {"age": (1, 100)})
    with pytest.raises(ValueError):
        Distances(SPEC, {"age": (1, 100), "income": (0, 1)}, weights={"none": 1.0})


def test_values_that_cannot_be_placed_are_refused(spark, how):
    good = [("3", 2.0, "a", "p", "f"), ("[1, 6[", None, "x", "q", "*"), (None,) * 5]
    how.check(_table(spark, good))
    for odd, name in ((("odd", 2.0, "a", "p", "f"), "age"), (("3", 2.0, "nowhere", "p", "f"), "job"), (("3", 2.0, "a", "unknown", "f"), "city")):
        with pytest.raises(ValueError, match=name):
            how.check(_table(spark, [*good, odd]))
    broken = Hierarchy("job", spark.createDataFrame([("a", "x", "*"), ("a", "y", "*")], "l0 string, l1 string, l2 string"), 3)
    with pytest.raises(ValueError, match="job"):
        Distances(SPEC, {"age": (1, 100), "income": (0, 10)}, {"job": broken}).check(_table(spark, [("3", 2.0, "a", "p", "f")]))


def test_a_number_that_stands_for_no_range_has_no_distance(spark):
    r = parse_range(F.lit("odd"), 1, 100)
    x, lo, hi = F.lit(3.0), F.lit(1.0), F.lit(5.0)
    row = spark.range(1).select(D.numeric_covered(x, r["lo"], r["hi"], 99), D.numeric_covered(F.lit(None).cast("double"), lo, hi, 99), D.numeric_ranges(lo, hi, r["lo"], r["hi"], 99), D.numeric_covered(F.lit(9.0), lo, hi, 99)).first()
    assert list(row) == [None, None, None, 99.0]


def test_a_matrix_of_many_values_is_looked_up_by_index(spark):
    n = 5000
    ids = spark.range(n).select(F.format_string("v%05d", "id").alias("v"), "id")
    cells = ids.toDF("a", "i").join(ids.toDF("b", "j"), F.col("i") < F.col("j")).where("j < 300").select("a", "b", (F.col("j") - F.col("i") + 0.5).alias("d"))
    spec = DatasetSpec("m", ("v",), (), ())
    how = Distances(spec, {}, matrices={"v": cells})
    q, c = (ids.where(w).select("v") for w in ("id < 40", "id between 100 and 140"))
    attached = how.attach(q)
    assert [f.dataType.simpleString() for f in attached.schema] == ["struct<value:string,code:int>"]
    got = knn.pairs(attached, how.attach(c)).select("q_v.value", F.col("c_v.value").alias("other"), how.between(frozenset("v"), frozenset("v")).alias("d")).collect()
    assert len(got) == 40 * 41 and all(r["d"] == pytest.approx(abs(int(r["value"][1:]) - int(r["other"][1:])) + 0.5) for r in got)
    with pytest.raises(ValueError, match="no distance between v00003 and v00007"):
        Distances(spec, {}, matrices={"v": cells.where("not (a = 'v00003' and b = 'v00007')")}).triangles
    wide = Distances(spec, {}, matrices={"v": ids.where("id > 0").select(F.lit("v00000").alias("a"), F.col("v").alias("b"), F.lit(1.0).alias("d"))})
    with pytest.raises(ValueError, match="no distance"):
        wide.triangles


def test_codes_refuse_unknown_values(spark):
    codes = privacy.value_codes(spark.createDataFrame([("b",), ("a",), ("c",)], "v string"), "v")
    some = spark.createDataFrame([(1, "a"), (2, "c"), (3, None)], "rid long, v string")
    assert sorted((r["rid"], r["code"]) for r in privacy.encode(some, "v", codes, "code").collect()) == [(1, 0), (2, 2), (3, None)]
    with pytest.raises(Exception, match="no code for zz"):
        privacy.encode(spark.createDataFrame([("zz",)], "v string"), "v", codes).collect()
