"""What each column of a built table is: identifier, input, feature or target, with horizon and family, kept in the schema's metadata."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import PATTERNS

#: Keys in a column's metadata.
ROLE, FAMILY, HORIZON_MS = "role", "family", "horizon_ms"
#: Columns that name a row.
IDENTIFIERS = frozenset("inst_id event_id ts_us ts_event ts_ingest anchor_snapshot_us anchor_snapshot_ts reconstruction_mode rn tick_size date mode".split())
#: Families of targets and how their names look: this library's builders' and, after a prefix, those of tables built elsewhere. Fixed formats.
TARGETS: dict[str, str] = {
    "net": r"^(?:target_)?net_profitable_(?:any_|long_|short_)?h(\d+)$",
    "gross": r"^(?:target_)?gross_profitable_(?:any_|long_|short_)?h(\d+)$",
    "mid_dir": r"^(?:mid_h(\d+)_dir|target_mid_dir_h(\d+))$",
    "move": r"^(?:(?:mid|bid|ask)_h(\d+)_(?:move_ticks|dir|up_\d+t|down_\d+t)|(?:mid|best_bid|best_ask)_move_ticks_.*)$",
    "exit": r"^(?:label_)?tp_sl_.*_h(\d+)$",
    "passage": "|".join(f"(?:{p})" for p in PATTERNS.values()),
    "excursion": r"^m[fa]e_(?:long|short)$",
    "future": r"^(?:future_|fwd_|forward_|exact_|target_|label_).*$",
}
_SECONDS = re.compile(r"_(\d+)s$")
#: Horizons in seconds from which a feature counts as long. Fixed values.
LONG_SECONDS = frozenset((60, 300, 900, 1800, 3600))


def target_of(name: str) -> tuple[str, int | None] | None:
    """(family, horizon in ms) of a target's name, None for what is none. The horizon is None where the name holds none."""
    for family, pattern in TARGETS.items():
        if m := re.match(pattern, name):
            if family == "passage":
                return family, 1000 * int(re.search(r"_within_(\d+)s$", name)[1])
            found = next((g for g in m.groups() if g), None)
            return family, int(found) if found else None
    return None


def is_regime(name: str) -> bool:
    return name.endswith("_regime") or name == "seconds_since_large_move"


def seconds_of(name: str) -> int | None:
    m = _SECONDS.search(name)
    return int(m[1]) if m else None


def _about(name: str, given: bool) -> dict:
    """A column's metadata; given: it was in the builder's input, which holds the past only."""
    if name in IDENTIFIERS:
        return {ROLE: "identifier"}
    if not given and (found := target_of(name)):
        return {ROLE: "target", FAMILY: found[0]} | ({HORIZON_MS: found[1]} if found[1] else {})
    family = "regime" if is_regime(name) else "input" if given else "feature"
    return {ROLE: "input" if given else "feature", FAMILY: family} | ({HORIZON_MS: 1000 * s} if (s := seconds_of(name)) else {})


def declare(df: DataFrame, given: Sequence[str]) -> DataFrame:
    """df whose columns say what they are; given: the columns of the builder's input. What is declared already stays; a builder's output
    that is neither an identifier nor a target by its family's name is a feature."""
    had = {f.name: f.metadata for f in df.schema if f.metadata.get(ROLE)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.select(*(quoted(c).alias(c, metadata=had.get(c) or _about(c, c in set(given))) for c in df.columns))


def roles(df: DataFrame) -> dict[str, dict]:
    """Each column's metadata. In a table that declares nothing, such as one built elsewhere, names decide, and whatever may be a target is one."""
    declared = {f.name: f.metadata for f in df.schema if f.metadata.get(ROLE)}
    return {c: declared.get(c, {ROLE: "undeclared"} if declared else _about(c, False)) for c in df.columns}


def model_features(df: DataFrame, target: str, candidates: Sequence[str] | None = None, with_inputs: bool = False) -> tuple[list[str], dict[str, str]]:
    """(columns that a model may use, why each other candidate may not): declared features, and inputs if asked for, of numeric type. A column
    that no builder declared is left out of a table that declares others, so nothing new slips through."""
    kinds, known, used, why = dict(df.dtypes), roles(df), [], {}
    allowed = {"feature", "input"} if with_inputs else {"feature"}
    for c in candidates or df.columns:
        role = known[c][ROLE]
        if c == target:
            why[c] = "is the target"
        elif role not in allowed:
            why[c] = f"is {'an' if role[0] in 'iu' else 'a'} {role}"
        elif not re.match(r"(?:tinyint|smallint|int|bigint|float|double|decimal|boolean)", kinds[c]):
            why[c] = f"is of type {kinds[c]}"
        else:
            used.append(c)
    return used, why


def choose_target(df: DataFrame, horizon_ms: int, families: Sequence[str] = ("net", "gross", "mid_dir")) -> str:
    """The target of the horizon whose family comes first; of one family that of either side (`any`) before that of one side."""
    if unknown := [f for f in families if f not in TARGETS]:
        raise ValueError(f"no family of targets: {unknown}; there are {list(TARGETS)}")
    ranked = {}
    for c, about in roles(df).items():
        if about[ROLE] == "target" and about.get(FAMILY) in families and about.get(HORIZON_MS) == horizon_ms:
            ranked[c] = (families.index(about[FAMILY]), "_long_" in c or "_short_" in c, c)
    if not ranked:
        raise ValueError(f"no target of the families {list(families)} looks {horizon_ms} ms ahead")
    return min(ranked, key=ranked.get)


def _short(name: str) -> bool:
    return name != "mid_px" and not is_regime(name) and seconds_of(name) not in LONG_SECONDS


#: Groups of features of the comparison of models: name, rule, whether the result is sorted. The names are fixed.
GROUPS: dict[str, tuple[Callable[[str], bool], bool]] = {
    "SHORT_ONLY": (_short, False),
    "SHORT_PLUS_300": (lambda c: _short(c) or seconds_of(c) == 300, True),
    "SHORT_PLUS_3600": (lambda c: _short(c) or seconds_of(c) == 3600, True),
    "ALL_WITHOUT_PRICE": (lambda c: c != "mid_px", False),
    "ALL_FEATURES": (lambda c: True, False),
}


def group_features(features: Sequence[str], group: str) -> list[str]:
    if group not in GROUPS:
        raise ValueError(f"no feature group {group!r}; there are {list(GROUPS)}")
    rule, in_order = GROUPS[group]
    found = list(filter(rule, features))
    return sorted(found) if in_order else found


def declared_columns(df: DataFrame) -> DataFrame:
    """(column, role, family, horizon_ms, n, total): a row a column of df that is no identifier, with its count of values and their sum, in one aggregation."""
    known = {c: about for c, about in roles(df).items() if about[ROLE] != "identifier" and re.match(r"(?:int|bigint|float|double)", dict(df.dtypes)[c])}
    sums = df.agg(*(x for c in known for x in (F.count(c).alias(f"n_{c}"), F.sum(F.col(c).cast("double")).alias(f"s_{c}"))))
    rows: list[Column] = [
        F.struct(
            F.lit(c).alias("column"), F.lit(about[ROLE]).alias("role"), F.lit(about.get(FAMILY)).cast("string").alias("family"),
            F.lit(about.get(HORIZON_MS)).cast("bigint").alias("horizon_ms"), F.col(f"n_{c}").alias("n"), F.col(f"s_{c}").alias("total"),
        )
        for c, about in known.items()
    ]
    return sums.select(F.inline(F.array(*rows)))
