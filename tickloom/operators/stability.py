"""Does a signal hold over time: thirds of rows by rank, ranking metrics of each, a logistic fit of each, families of features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranged import ranged

#: Families of features and words in their names, first match first.
FAMILIES = {"order_flow": ("flow", "added", "removed"), "imbalance": ("imbalance",), "volatility": ("vol",), "spread": ("spread",)}


def with_parts(df: DataFrame, order: Sequence[str], parts: int = 3, out: str = "part") -> DataFrame:
    """df with `out`: 0 .. parts - 1, equal numbers of rows by rank in order, which must be unique. No task sorts the table."""
    placed = ranged(df, [], order, out="__place", total="__rows")
    return placed.select(*df.columns, F.least(F.expr(f"(__place - 1) * {parts} div __rows"), F.lit(parts - 1)).cast("int").alias(out))


def ranking_by(df: DataFrame, by: Sequence[str], y: str, score: str) -> DataFrame:
    """(by, n, positive_rate, roc_auc, average_precision) of each group at once: rows are counted by score, and running counts over scores dealt
    by ranges say how many stand above. Ties are averaged in the area; NULL where a group has one label only. Rows without label or score go."""
    known = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    per = known.groupBy(*by, (-F.col(score)).alias("__s")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count("*").alias("rows_of"))
    above = ranged(per, by, ["__s"], F.col("rows_of"), "above", "n")
    both = ranged(above, by, ["__s"], F.col("pos"), "tp", "ones")
    neg, zeros = F.col("rows_of") - F.col("pos"), F.col("n") - F.col("ones")
    before = F.col("above") - F.col("tp") - neg
    found = both.groupBy(*by).agg(
        F.first("n").alias("n"), F.first("ones").alias("ones"), F.sum(F.col("pos") * (zeros - before - neg / 2)).alias("area"), F.sum(F.col("pos") * (F.col("tp") / F.col("above"))).alias("steps")
    )
    pairs = F.nullif(F.col("ones") * (F.col("n") - F.col("ones")), F.lit(0))
    return found.select(*by, "n", (F.col("ones") / F.col("n")).alias("positive_rate"), (F.col("area") / pairs).alias("roc_auc"), (F.col("steps") / F.nullif("ones", F.lit(0))).alias("average_precision"))


def stability_of_score(df: DataFrame, y: str, score: str, order: Sequence[str], parts: int = 3) -> DataFrame:
    """ranking_by of a score over equal parts of the rows in time."""
    return ranking_by(with_parts(df.select(*{*order}, y, score), order, parts), ["part"], y, score)


def stability_of_fit(df: DataFrame, features: Sequence[str], y: str, order: Sequence[str], parts: int = 3, fit_share: float = 0.7, seed: int = 42) -> DataFrame:
    """(part, n, positive_rate, roc_auc, average_precision): in each part a logistic model of scaled, median-imputed features is fitted on the first
    fit_share of its rows and measured on the rest. A part whose first rows have one label only has no row."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = with_parts(df.where(F.col(y).isNotNull()).select(*{*order, *features}, y), order, parts * 10, "__tenth")
    rows = rows.select(F.expr("__tenth div 10").cast("int").alias("part"), (F.col("__tenth") % 10 < round(fit_share * 10)).alias("__fit"), F.col(y).cast("int").alias("y"), *(F.col(c).cast("double").alias(c) for c in features))
    filled, scored = [f"__{c}" for c in features], None
    for part in range(parts):
        fit = rows.where((F.col("part") == part) & F.col("__fit"))
        if fit.select("y").distinct().count() < 2:
            continue
        stages = [Imputer(inputCols=list(features), outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="__raw", handleInvalid="skip")]
        stages += [StandardScaler(inputCol="__raw", outputCol="features", withMean=True), LogisticRegression(labelCol="y", regParam=0.01)]
        model = Pipeline(stages=stages).fit(fit)
        own = model.transform(rows.where((F.col("part") == part) & ~F.col("__fit"))).select("part", "y", F.round(vector_to_array("probability")[1], 6).alias("score"))
        scored = own if scored is None else scored.unionByName(own)
    if scored is None:
        return rows.sparkSession.createDataFrame([], "part int, n bigint, positive_rate double, roc_auc double, average_precision double")
    return ranking_by(scored, ["part"], "y", "score")


def family_of(name: str) -> str:
    return next((family for family, words in FAMILIES.items() if any(w in name for w in words)), "other")


def family_counts(features: Sequence[str]) -> list[tuple[str, int]]:
    """How many of the named features (such as the leading ones of several models) fall into each family, most first."""
    return Counter(map(family_of, features)).most_common()
