"""Boosting against hand computations, falling losses, and odd tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from veilmark.operators import boosting, models


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double, __y double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="__x").transform(df)


def test_one_round_is_the_newton_step_of_each_leaf(spark):
    rows = [(0.0, 0.0, 0.0)] * 6 + [(0.0, 0.0, 1.0)] * 2 + [(1.0, 0.0, 1.0)] * 7 + [(1.0, 0.0, 2.0)] * 5
    m = boosting.fit(vectors(spark, rows), 3, rounds=1, depth=1)
    got = {r["a"]: r["__margins"] for r in m.margins(vectors(spark, rows)).collect()}
    third, h = 1 / 3, 2 * (1 / 3) * (2 / 3)
    for a, counts in ((0.0, (6, 2, 0)), (1.0, (0, 7, 5))):
        n = sum(counts)
        assert got[a] == pytest.approx([0.2 * (c - n * third) / (n * h) for c in counts])


def test_two_classes_and_numbers_by_hand(spark):
    rows = [(0.0, 0.0, 0.0)] * 9 + [(0.0, 0.0, 1.0)] + [(1.0, 0.0, 1.0)] * 8 + [(1.0, 0.0, 0.0)] * 2
    m = boosting.fit(vectors(spark, rows), 2, rounds=1, depth=2)
    p = 9 / 20
    got = {r["a"]: r["__margins"][0] for r in m.margins(vectors(spark, rows)).collect()}
    assert got[0.0] == pytest.approx(math.log(p / (1 - p)) + 0.2 * (1 - 10 * p) / (10 * p * (1 - p)))
    assert got[1.0] == pytest.approx(math.log(p / (1 - p)) + 0.2 * (8 - 10 * p) / (10 * p * (1 - p)))
    numbers = [(0.0, 0.0, 2.0)] * 3 + [(1.0, 0.0, 8.0)] * 3
    m = boosting.fit(vectors(spark, numbers), 0, rounds=2, depth=3)
    got = {r["a"]: r["__g"] for r in m.predict(vectors(spark, numbers)).collect()}
    assert got == pytest.approx({0.0: 5 - 3 * (1 - 0.8**2), 1.0: 5 + 3 * (1 - 0.8**2)})


@pytest.mark.parametrize("classes", [0, 2, 4])
def test_training_loss_falls_every_round(spark, classes):
    rnd = random.Random(classes)
    rows = []
    for _ in range(300):
        a, b = rnd.random(), rnd.random()
        y = a * 3 + b if classes == 0 else float(int((a + b) * classes / 2) % classes)
        rows.append((a, b, y + (rnd.random() if classes == 0 else 0.0)))
    losses = []
    m = boosting.fit(vectors(spark, rows), classes, rounds=5, depth=4, losses=losses)
    assert len(losses) == 6 and all(x > y for x, y in zip(losses, losses[1:]))
    margins = m.margins(vectors(spark, rows))
    assert margins.agg(boosting.loss(F.col("__y"), F.col("__margins"), classes)).first()[0] == pytest.approx(losses[-1])
    right = m.predict(vectors(spark, rows)).agg(F.avg((F.col("__g") == F.col("__y")).cast("double"))).first()[0]
    assert classes == 0 or right > 0.9


def test_no_rows_and_one_class(spark):
    some = vectors(spark, [(0.0, 1.0, 0.0), (1.0, 1.0, 0.0)])
    assert [r["__g"] for r in boosting.fit(some.limit(0), 0).predict(some).collect()] == [0.0, 0.0]
    assert [r["__g"] for r in boosting.fit(some, 1).predict(some).collect()] == [0.0, 0.0]
    assert [r["__g"] for r in boosting.fit(some, 2, rounds=1).predict(some).collect()] == [0.0, 0.0]


def test_learners_of_fit_predict(spark):
    rows = [(i, float(i % 10), "ab"[i % 2], "xyz"[i % 3]) for i in range(120)]
    df = spark.createDataFrame(rows, "rid long, n double, s string, t string")
    for learner in ("forest", "boosted"):
        guessed = models.fit_predict(df, df.where("rid < 40"), "s", ["n"], ["t"], False, learner=learner, rounds=3)
        assert guessed.columns == ["rid", "n", "s", "t", "guess"] and guessed.where("guess = s").count() == 40
    with pytest.raises(ValueError):
        models.fit_predict(df, df, "s", ["n"], [], False, learner="other")


@pytest.mark.parametrize("classes", [0, 2, 4])
def test_cells_grow_the_trees_of_the_rows(spark, monkeypatch, classes):
    """Counted cells against Spark ML over the rows."""
    rnd = random.Random(40 + classes)
    rows = []
    for _ in range(400):
        a, b = rnd.randrange(12), rnd.randrange(20)
        rows.append((float(a), float(b), a * b + rnd.random() if classes == 0 else float((a * b + rnd.randrange(3)) % classes)))
    df = vectors(spark, rows)
    losses = [[], []]
    cells = boosting.fit(df, classes, rounds=1, depth=3)
    boosting.fit(df, classes, rounds=3, depth=5, losses=losses[0])
    assert isinstance(cells, boosting.Counted) and [len(c) for c in cells.cuts] == [11, 19]
    monkeypatch.setattr(boosting, "TREE_CELLS", 10)
    whole = boosting.fit(df, classes, rounds=1, depth=3)
    boosting.fit(df, classes, rounds=3, depth=5, losses=losses[1])
    assert isinstance(whole, boosting.Boosted)
    got, expected = ({(r["a"], r["b"]): list(r["__margins"]) for r in m.margins(df).collect()} for m in (cells, whole))
    assert got.keys() == expected.keys() and len(got) > 100
    assert all(got[k] == pytest.approx(expected[k], rel=1e-6, abs=1e-9) for k in got)
    assert losses[0] == pytest.approx(losses[1], rel=0.03)  # further down, splits of equal gain may be taken either way


def test_a_tree_of_cells_by_hand():
    codes = np.array([[0, 0], [0, 1], [1, 0], [1, 1]], np.uint8)
    feature, cut, left, value = boosting._grow(codes, np.array([-4.0, -2.0, 2.0, 4.0]), np.array([2.0, 2.0, 2.0, 2.0]), 15)
    assert feature.tolist() == [0, 1, 1, -1, -1, -1, -1] and cut.tolist()[:3] == [0, 0, 0] and left.tolist()[:3] == [1, 3, 5]
    assert value.tolist() == [0.0, -1.5, 1.5, -2.0, -1.0, 1.0, 2.0]
    # a summed h below MIN_WEIGHT and 0.49 of the whole is no node; equal steps are not split
    assert len(boosting._grow(codes, np.array([-1.0, -1.0, 1.0, 1.0]), np.full(4, 0.4), 15)[0]) == 3
    assert len(boosting._grow(codes, np.full(4, 3.0), np.full(4, 2.0), 15)[0]) == 1


def odd_table(spark):
    """3,000 rows of few combinations with nulls and NaN, and a number of 50 values."""
    rnd = random.Random(8)
    rows = []
    for i in range(3000):
        n = rnd.choice([None, float("nan"), *map(float, range(50))] if i % 2 else [1.0, 2.0])
        s = rnd.choice(["a", "b", None])
        x = (n if n is not None and n == n else 60.0) + (9.0 if s == "a" else 0.0)
        rows.append((i, n, s, x + rnd.randrange(3), rnd.choice([None, "p"]) if i % 50 == 0 else "pqr"[int(x + rnd.randrange(9)) // 9 % 3]))
    return spark.createDataFrame(rows, "rid long, n double, s string, y double, t string")


@pytest.mark.parametrize("target", ["y", "t"])
def test_models_read_counted_combinations(spark, monkeypatch, target):
    """No table of vectors or guesses has more rows than there are combinations; guesses are those of a model of the rows."""
    df, sizes, real = odd_table(spark), [], boosting.staged

    def sized(table, label):
        out = real(table, label)
        sizes.append((label, out.count()))
        return out

    monkeypatch.setattr(boosting, "staged", sized)
    monkeypatch.setattr(models.stages, "staged", sized)
    unseen = spark.createDataFrame([(-1, 3.0, "unseen", 0.0, "p"), (-2, -7.0, None, 0.0, None)], df.schema)
    guessed = models.fit_predict(df, df.unionByName(unseen), target, ["n"], ["s"], target == "y", rounds=4)
    got = {r["rid"]: r["guess"] for r in guessed.collect()}
    assert len(got) == 3002 and None not in got.values()
    assert sizes and max(n for _, n in sizes) <= 52 * 4 * 4
    monkeypatch.undo()
    rows = df.withColumn("__y", F.col("y")) if target == "y" else df.where("t is not null").withColumn("__y", F.array_position(F.array(*map(F.lit, "pqr")), F.col("t")) - 1)
    ready = models.Pipeline(stages=models._features(["n"], ["s"])).fit(rows)
    # vectors before they are scaled: the deviation of a column with a NaN is NaN
    whole = boosting.fit(ready.transform(rows), 0 if target == "y" else 3, features="__raw", rounds=4).predict(ready.transform(df.unionByName(unseen)), features="__raw")
    expected = {r["rid"]: r["__g"] if target == "y" else "pqr"[int(r["__g"])] for r in whole.collect()}
    assert got == (pytest.approx(expected) if target == "y" else expected)


def test_more_cells_than_a_task_grows_are_read_as_rows(spark, monkeypatch):
    df = odd_table(spark).where("t is not null")
    counted = models.fit_predict(df, df, "t", ["n"], ["s"], False, rounds=3)
    share = lambda g: g.agg(F.avg((F.col("guess") == F.col("t")).cast("double"))).first()[0]
    own = share(counted)
    monkeypatch.setattr(boosting, "TREE_CELLS", 10)
    assert share(models.fit_predict(df, df, "t", ["n"], ["s"], False, rounds=3)) == pytest.approx(own, abs=0.02) and own > 0.6
