"""Target, feature-group and window-list names."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The name patterns of the targets, tried in this order. Fixed formats.
PATTERNS = {
    "asymmetric": r"^(long|short)_hit_(?:up|down)_(\d+)t_before_(?:up|down)_(\d+)t_within_(\d+)s$",
    "symmetric": r"^(long|short)_hit_(?:up|down)_(\d+)t_before_(?:up|down)()_within_(\d+)s$",
    "hit": r"^(long|short)_hit_(?:up|down)_(\d+)t()_within_(\d+)s$",
    "excursion": r"^(long|short)_max_(?:favorable|adverse)()()_excursion_ticks_within_(\d+)s$",
}


def pattern_fields(name: Column) -> dict[str, Column]:
    """The same fields as target_fields, but kind is the pattern's name, symmetric tells whether it is the symmetric one, and adverse is
    what the name says."""
    kind = F.coalesce(*(F.when(name.rlike(p), k) for k, p in PATTERNS.items()))
    group = lambda i: F.coalesce(*(F.when(name.rlike(p), F.nullif(F.regexp_extract(name, p, i), F.lit(""))) for p in PATTERNS.values()))
    return {
        "kind": kind, "direction": group(1), "threshold": group(2).cast("int"), "adverse": group(3).cast("int"), "horizon_s": group(4).cast("int"),
        "symmetric": F.when(kind.isNotNull(), (kind == "symmetric").cast("int")),
        "excursion_type": F.when(kind == "excursion", F.regexp_extract(name, "_max_(favorable|adverse)_", 1)),
    }


def windows_of(text: str) -> list[int]:
    """Unique positive window lengths of a comma list, rising."""
    try:
        found = [int(x) for x in text.split(",") if x.strip()]
    except ValueError as e:
        raise ValueError(f"bad window list {text!r}") from e
    if not found or min(found) <= 0 or len(set(found)) < len(found):
        raise ValueError(f"windows must be unique positive numbers: {text!r}")
    return sorted(found)


def is_target(name: str) -> bool:
    return any(re.match(p, name) for p in PATTERNS.values())


def file_token(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", name)


#: Suffixes of feature names with long horizons.
LONG_SUFFIX = r"_(?:60|300|900|1800|3600)s$"


def target_fields(name: Column) -> dict[str, Column]:
    """kind (binary or regression), direction, threshold_ticks, adverse_ticks, horizon_sec, symmetric and excursion_type of a target's
    name; NULL for what is no target. A symmetric name's adverse ticks are its threshold; a plain hit has neither of the two."""
    found = {k: name.rlike(p) for k, p in PATTERNS.items()}
    of = lambda k, i: F.when(found[k], F.nullif(F.regexp_extract(name, PATTERNS[k], i), F.lit("")))
    number = lambda *x: F.coalesce(*x).cast("int")
    threshold = number(*(of(k, 2) for k in ("asymmetric", "symmetric", "hit")))
    adverse = number(of("asymmetric", 3), of("symmetric", 2))
    return {
        "kind": F.when(found["excursion"], "regression").when(found["asymmetric"] | found["symmetric"] | found["hit"], "binary"),
        "direction": F.coalesce(*(of(k, 1) for k in PATTERNS)), "threshold_ticks": threshold, "adverse_ticks": adverse,
        "horizon_sec": number(*(of(k, 4) for k in PATTERNS)), "symmetric": threshold == adverse,
        "excursion_type": F.when(found["excursion"], F.regexp_extract(name, "_max_(favorable|adverse)_", 1)),
    }


def favorable_ticks(name: Column) -> Column:
    """Threshold of a binary target, NULL for any other name."""
    fields = target_fields(name)
    return F.when(fields["kind"] == "binary", fields["threshold_ticks"])


def modeling_eligible(name: Column, least: int = 260) -> Column:
    return F.coalesce(favorable_ticks(name) >= least, F.lit(False))


def int_list(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x.strip()]


def is_long_horizon(name: str) -> bool:
    return re.search(LONG_SUFFIX, name) is not None


def feature_groups(windows_s: Sequence[int]) -> dict[str, list[str]]:
    """Names of the wall-clock builder's columns by group, for summaries."""
    each = lambda *patterns: [p.format(w) for p in patterns for w in windows_s]
    flows = [f"{s}_{what}" for s in ("bid", "ask") for what in ("added", "removed", "net_flow")]
    sides = [f"{s}_{what}" for s in ("bid", "ask") for what in (*(f"dist_{i:02d}" for i in range(1, 11)), *(f"sz_norm_{i:02d}" for i in range(1, 11)), *(f"cum_{k}" for k in (1, 3, 5, 10)), *(f"cum_ratio_{k}" for k in (1, 3, 5, 10)), "slope", "convexity")]
    return {
        "price": ["spread_ticks", "spread_over_mid", *each("mid_return_{}s", "mid_velocity_{}s"), "mid_acceleration_1s", *each("realized_vol_{}s")],
        "depth": sides,
        "imbalance": [*(f"imbalance_{k}" for k in (1, 3, 5, 10)), *(f"imbalance_{k}_delta_{w}s" for w in windows_s for k in (1, 3, 5, 10)), "imbalance_5_acceleration_1s"],
        "order_flow": [*(f"{f}_{w}s" for w in windows_s for f in (*flows, "order_flow_imbalance")), *each("update_intensity_{}s")],
        "regime": ["volatility_regime", "spread_regime", "activity_regime", "seconds_since_large_move"],
    }
