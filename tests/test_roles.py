"""Roles of the builders' own columns: nothing that looks ahead is a feature; exits from the entry price against one window."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import roles
from tickloom.functions.timewin import SECOND
from tickloom.operators import assemble, labels, passage
from tickloom.plans import views as V

SF = "/root/testdata/sf0.001"
AHEAD = ("_move_ticks", "_dir", "profitable", "tp_sl", "_hit_", "excursion", "mfe_", "mae_", "future", "exact")


@pytest.fixture(scope="module")
def modelling(spark):
    return assemble.modeling_dataset(V.book(spark, SF))


def test_features_of_the_modelling_table(spark, modelling, tmp_path):
    used, why = roles.model_features(modelling, "mid_h500_dir")
    assert "mid_return_h500" in used and len(used) > 50
    assert not [c for c in used if any(x in c for x in AHEAD) or "_up_" in c or "_down_" in c]
    assert not {"event_id", "inst_id", "ts_us", "mid_px", "value"} & set(used)
    targets = {c for c, about in roles.roles(modelling).items() if about["role"] == "target"}
    assert len(targets) == 6 * (3 * 8 + 6) + 48  # moves, directions and thresholds of three prices, profits; exits
    assert targets <= set(why) and set(why) - targets >= {"event_id", "mid_px"}
    with_inputs, _ = roles.model_features(modelling, "mid_h500_dir", with_inputs=True)
    assert set(used) < set(with_inputs) and not targets & set(with_inputs)
    # a column that nobody declared, and roles after a round trip through Parquet
    assert roles.model_features(modelling.withColumn("fresh", F.lit(1)), "mid_h500_dir")[1]["fresh"] == "is an undeclared"
    modelling.limit(5).write.parquet(str(tmp_path / "m"))
    assert roles.model_features(spark.read.parquet(str(tmp_path / "m")), "mid_h500_dir")[0] == used
    assert [roles.choose_target(modelling, 500, f) for f in (["net", "gross"], ["gross"], ["mid_dir"])] == ["net_profitable_any_h500", "gross_profitable_any_h500", "mid_h500_dir"]


def test_features_of_the_target_table(spark):
    built = passage.targets_dataset(V.ticks(spark, SF), 0.01, (3600,), (300,), passage.half_pairs((300,)))
    assert roles.model_features(built, "long_hit_up_300t_within_3600s")[0] == []
    assert {about["role"] for c, about in roles.roles(built).items() if "within" in c} == {"target"}


def test_wall_clock_regimes_are_in_no_short_group(spark):
    built = assemble.wallclock_features(V.book(spark, SF).where("event_id < 40"), 0.01, (60, 300))
    used, why = roles.model_features(built, "none")
    assert {"activity_regime", "volatility_regime", "spread_regime"} <= set(built.columns) and "mid_return_60s" in used
    short = roles.group_features(built.columns, "SHORT_ONLY")
    assert not [c for c in short if "regime" in c or c.endswith(("_60s", "_300s")) or c == "seconds_since_large_move"]
    assert "mid_return_300s" in roles.group_features(used, "SHORT_PLUS_300") and "mid_return_60s" not in roles.group_features(used, "SHORT_PLUS_300")


@pytest.mark.parametrize("block", [8, 1 << 16])
def test_exits_from_the_entry_price(spark, block, monkeypatch):
    rng = random.Random(5)
    rows = []
    for inst in ("a", "b", None):
        mid = 100.0
        for i in range(150):
            mid += rng.choice([-0.2, -0.1, 0.0, 0.1, 0.2])
            gap = rng.choice([0.05, 0.1, None])
            m = None if rng.random() < 0.1 else mid
            rows.append((inst, i, i // 2 * SECOND, m, None if gap is None else mid - gap, mid + 0.1))
    df = spark.createDataFrame(rows, "inst_id string, event_id long, ts_us long, mid_px double, bid_px_01 double, ask_px_01 double")
    original = passage.entry_passage
    monkeypatch.setattr(passage, "entry_passage", lambda *a, **k: original(*a, **k | {"block": block}))
    got = passage.entry_exits(df, 0.1, (1, 4), (1, 3), {"r1": 1, "r7": 7, "r100": 100})
    over = Window.partitionBy("inst_id").orderBy("ts_us", "event_id")
    want = df
    for side in ("long", "short"):
        for a in (1, 4):
            for b in (1, 3):
                for n in (1, 7, 100):
                    want = want.withColumn(f"tp_sl_{side}_tp{a}_sl{b}_r{n}", labels.tp_sl_label(side, 0.1, a, b, n, over))
    assert len(got.columns) == len(want.columns) and got.count() == len(rows)
    assert got.select(*want.columns).exceptAll(want).count() == 0
    assert passage.entry_exits(df, 0.1, (), (), {}).columns == df.columns
