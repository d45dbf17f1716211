"""Orders dealt by ranges against one window; mutual information by neighbours against all pairs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import ranged as R


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def information(rows, k=3):
    """All pairs, one feature: rows (x, y)."""
    labels = Counter(y for _, y in rows)
    rows = [(x, y) for x, y in rows if labels[y] > 1]
    total = [0.0, 0.0, 0.0]
    for i, (x, y) in enumerate(rows):
        own = sorted((abs(v - x), v) for j, (v, w) in enumerate(rows) if w == y and j != i)
        used = min(k, labels[y] - 1)
        r, v = own[used - 1]
        low, high = (v if v < x else x - r), (v if v > x else x + r)
        m = sum(u == x for u, _ in rows) if r == 0 else sum(low < u < high for u, _ in rows)
        for j, value in enumerate((psi(used), psi(labels[y]), psi(m))):
            total[j] += value / len(rows)
    return max(0.0, psi(len(rows)) + total[0] - total[1] - total[2])


def test_nearest_information(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        y = rng.choice([0, 1, 1, 2])
        rows.append((rng.gauss(y, 0.7), rng.random(), rng.randrange(6) / 10 + y / 10, None if rng.random() < 0.1 else rng.random() + y, float("nan") if i == 5 else 1.0, None if i == 9 else y))
    rows.append((0.5, 0.5, 0.5, 0.5, 1.0, 7))  # a label of one row
    df = spark.createDataFrame(rows, "`a.b` double, noise double, ties double, gaps double, same double, y int")
    got = {r.feature: r for r in R.nearest_information(df, ["a.b", "noise", "ties", "gaps", "same"], "y").collect()}
    for i, name in enumerate(("a.b", "noise", "ties", "gaps", "same")):
        known = [(r[i], r[5]) for r in rows if r[i] is not None and not math.isnan(r[i]) and r[5] is not None]
        assert got[name].mutual_info == pytest.approx(information(known), abs=1e-9), name
    assert got["a.b"].mutual_info > 0.3 > 0.1 > got["noise"].mutual_info
    assert R.nearest_information(df.where("false"), ["noise"], "y").count() == 0


def test_sums_by_ranges(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.choice(["a", "a", "a", None]), rng.randrange(9), k, k % 3) for k in range(500)], "g string, x int, k int, w int")
    got = R.ranged(df, ["g"], ["x", "k"], F.col("w"))
    over = Window.partitionBy("g").orderBy("x", "k").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"place": F.sum("w").over(over), "total": F.sum("w").over(Window.partitionBy("g"))})
    assert got.count() == 500 and got.exceptAll(want).count() == 0
    near = R.in_ranges(df, ["g"], ["x", "k"], {"back": ("k", -2), "on": ("k", 1)}, block=16)
    one = Window.partitionBy("g").orderBy("x", "k")
    assert near.exceptAll(df.withColumns({"back": F.lag("k", 2).over(one), "on": F.lead("k", 1).over(one)})).count() == 0


def test_digamma(spark):
    found = spark.range(1, 60).select("id", R.digamma(F.col("id").cast("double")).alias("d")).collect()
    assert all(abs(r.d - psi(r.id)) < 1e-12 for r in found)


def test_stability_of_fits(spark):
    from tickloom.operators import stability

    rng = random.Random(6)
    rows = []
    for i in range(900):
        x = rng.gauss(0, 1)
        y = int(x + rng.gauss(0, 0.5) > 0) if i < 600 else rng.randrange(2)  # the last third knows nothing
        rows.append((i, x, None if i % 10 == 0 else rng.random(), y))
    df = spark.createDataFrame(rows, "t int, signal double, noise double, y int")
    got = {r.part: r for r in stability.stability_of_fit(df, ["signal", "noise"], "y", ["t"]).collect()}
    assert set(got) == {0, 1, 2} and {r.n for r in got.values()} == {90}
    assert got[0].roc_auc > 0.85 and got[1].roc_auc > 0.85 and 0.3 < got[2].roc_auc < 0.7
    assert stability.stability_of_fit(df.withColumn("y", F.lit(1)), ["signal"], "y", ["t"]).count() == 0
    one = stability.ranking_by(df.withColumn("y", F.lit(1)), [], "y", "signal").first()
    assert one.roc_auc is None and one.average_precision == 1.0
    names = ["imbalance_5", "imbalance_1_delta_5s", "order_flow_imbalance_3s", "realized_vol_30s", "spread_ticks", "mid_px"]
    assert stability.family_counts(names) == [("imbalance", 2), ("order_flow", 1), ("volatility", 1), ("spread", 1), ("other", 1)]
