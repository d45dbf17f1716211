"""The softmax booster on held-out rows against one booster a class; missing values, one class, early stopping."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import boosting


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.random()
        y = -1 if a + b < -0.8 else 1 if a * b > 0.2 else 0
        y = rng.choice([-1, 0, 1]) if rng.random() < 0.05 else y
        out.append((a, None if rng.random() < 0.1 else b, c, y, i % 4 == 0))
    return out


def loss(df, classes):
    spots = F.array_position(F.array(*(F.lit(c) for c in classes)), F.col("y")).cast("int")
    return df.select((-F.ln(F.greatest(F.element_at("probability", spots), F.lit(1e-15)))).alias("loss")).agg(F.avg("loss")).first()[0]


def test_softmax_beats_one_against_the_rest(spark):
    names = "a double, b double, c double, y int, valid boolean"
    train, test = spark.createDataFrame(rows(2400, 1), names), spark.createDataFrame(rows(1200, 2), names)
    model = boosting.train_softmax(train, ["a", "b", "c"], "y", "valid", rounds=9, depth=2)
    assert model.classes == [-1, 0, 1] and len(model.rounds) == len(model.losses) - 1 > 3
    assert model.losses[-1] == min(model.losses) < 0.85 * model.losses[0]
    scored = boosting.predict_softmax(model, test)
    ours = loss(scored, model.classes)
    right = scored.where("prediction = y").count() / 1200
    each = []
    for c in model.classes:  # one booster a class, then normalised
        one = boosting.train_softmax(train.withColumn("t", (F.col("y") == c).cast("int")), ["a", "b", "c"], "t", "valid", rounds=9, depth=2)
        each.append([r.p for r in boosting.predict_softmax(one, test).select(F.col("probability")[1].alias("p")).collect()])
    labels = [r.y for r in test.select("y").collect()]
    rest = sum(-math.log(max(ps[model.classes.index(y)] / sum(ps), 1e-15)) for y, ps in zip(labels, zip(*each, strict=True), strict=True)) / len(labels)
    assert right > 0.7 and ours < rest + 0.02, (ours, rest)


def test_softmax_edges(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (None, "x"), (float("nan"), "y"), (1.5, None)], "f double, y string")
    model = boosting.train_softmax(df, ["f"], "y", rounds=3)
    assert len(model.rounds) == 3 and model.losses == []
    found = boosting.predict_softmax(model, df).collect()
    assert all(abs(sum(r.probability) - 1) < 1e-9 and r.prediction in ("x", "y") for r in found) and len(found) == 5
    with pytest.raises(ValueError):
        boosting.train_softmax(df.where("y = 'x'"), ["f"], "y")
