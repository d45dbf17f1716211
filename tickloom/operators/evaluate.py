"""Evaluation of signals and classifiers: every metric is an aggregation over rows (y, score or prediction)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timewin import value_sums


def _share(hit: Column, among: Column) -> Column:
    return F.coalesce(F.avg(F.when(among, F.coalesce(hit, F.lit(False)).cast("int"))), F.lit(0.0))


def signal_metrics(pred: str, label: str) -> dict[str, Column]:
    p, y = F.col(pred), F.col(label)
    return {"hit_rate": _share(p == y, p != 0), "precision_long": _share(y == 1, p == 1), "precision_short": _share(y == -1, p == -1), "n_signals": F.count_if(p != 0)}


def time_split(df: DataFrame, order: Sequence[str], train: float = 0.7, valid: float = 0.15, least: int = 1000, out: str = "split") -> DataFrame:
    """df with train, valid or test by place in time. Places are counted by time buckets (pre-aggregated) and within them, so no task
    sorts all rows; order[0] is a number. Under `least` rows raise."""
    n = df.count()
    if n < least:
        raise ValueError(f"{n} rows, at least {least} needed")
    span = df.agg(F.min(order[0]).alias("lo"), F.max(order[0]).alias("hi")).first()
    width = max(1, (span["hi"] - span["lo"]) // 1000 + 1)
    dealt = df.withColumn("__b", F.floor((F.col(order[0]) - span["lo"]) / width))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("__b").count().select("__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__o"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy(*order)) - 1 + F.col("__o")
    a, b = int(n * train), int(n * train) + int(n * valid)
    return dealt.join(F.broadcast(offsets), "__b").withColumn("__place", place).withColumn(out, F.when(F.col("__place") < a, "train").when(F.col("__place") < b, "valid").otherwise("test")).select(*df.columns, out)


def split_report(df: DataFrame, time_col: str, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("n"), F.min(time_col).alias("first"), F.max(time_col).alias("last"))


def class_report(df: DataFrame, y: str) -> DataFrame:
    """n, share (of all rows, NULL ones too) and inverse-frequency weight total / (classes * n) of each value that is not NULL."""
    counts = df.groupBy(y).agg(F.count("*").alias("n"))
    every, known = Window.partitionBy(), F.sum(F.when(F.col(y).isNotNull(), F.col("n")))
    return counts.select(
        y, "n", (F.col("n") / F.sum("n").over(every)).alias("share"), (known.over(every) / (F.count(y).over(every) * F.col("n"))).alias("weight")
    ).where(F.col(y).isNotNull())


def confidence_buckets(df: DataFrame, y: str, score: str, edges: Sequence[float] = (0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)) -> DataFrame:
    """Rows by the probability of label 1 in [low, high), the last bucket closed: n, share of all rows (coverage) and share of label 1
    (hit_rate); empty buckets are left out."""
    p = F.col(score)
    bucket = F.when(p == edges[-1], len(edges) - 2)
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        bucket = bucket.when((p >= low) & (p < high), i)
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg(y).alias("hit_rate"))
    return counts.withColumn("coverage", F.col("n") / F.sum("n").over(Window.partitionBy())).where("bucket is not null")


def reliability(df: DataFrame, y: str, score: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(y).alias("positive_rate"))


def _by_score(df: DataFrame, y: str, score: str) -> DataFrame:
    """A row a distinct score: positives, negatives, and both at or above it."""
    per = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count("*").alias("n"))
    return value_sums(per, "s", ["pos", "n"], descending=True).withColumnsRenamed({"cum_pos": "tp", "cum_n": "above"})


def ranking_metrics(df: DataFrame, y: str, score: str) -> DataFrame:
    """roc_auc (rank sum with averaged ties) and average_precision (step sum over distinct scores)."""
    per = _by_score(df, y, score)
    neg = F.col("n") - F.col("pos")
    fp_before = F.col("above") - F.col("tp") - neg
    total = per.agg(F.sum("pos").alias("ones"), F.sum(neg).alias("zeros"))
    return per.crossJoin(F.broadcast(total)).agg(
        (F.sum(F.col("pos") * (F.col("zeros") - fp_before - neg / 2)) / F.nullif(F.first("ones") * F.first("zeros"), F.lit(0))).alias("roc_auc"),
        (F.sum(F.col("pos") * (F.col("tp") / F.col("above"))) / F.nullif(F.first("ones"), F.lit(0))).alias("average_precision"),
    )


def confusion(df: DataFrame, y: str, pred: Column) -> DataFrame:
    t, p = F.col(y) == 1, pred == 1
    return df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))


def binary_metrics(df: DataFrame, y: str, score: str, threshold: float = 0.5) -> DataFrame:
    c = confusion(df, y, (F.col(score) >= threshold).cast("int"))
    d = lambda a, b: F.coalesce(F.try_divide(F.expr(a), F.expr(b)), F.lit(0.0))
    brier = df.agg(F.avg((F.col(score) - F.col(y)) * (F.col(score) - F.col(y))).alias("brier"))
    return c.crossJoin(brier).select(
        "tp", "fp", "fn", "tn", d("tp + tn", "tp + tn + fp + fn").alias("accuracy"), d("tp", "tp + fp").alias("precision"), d("tp", "tp + fn").alias("recall"),
        d("2 * tp", "2 * tp + fp + fn").alias("f1"), ((d("tp", "tp + fn") + d("tn", "tn + fp")) / 2).alias("balanced_accuracy"), "brier",
    )


def threshold_table(df: DataFrame, y: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """n, coverage and hit rate of score >= each threshold."""
    grid = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    hit = F.col(score) >= F.col("threshold")
    return df.select(y, score, grid).groupBy("threshold").agg(
        F.count_if(hit).alias("n"), F.avg(hit.cast("int")).alias("coverage"), _share(F.col(y) == 1, hit).alias("hit_rate")
    )


def best_f1(df: DataFrame, y: str, score: str, points: int = 399) -> DataFrame:
    """(threshold, f1) with the best F1 of `points` thresholds from 0.001 to 0.999; the lowest of equals. Scores are first grouped to
    the highest threshold that they reach, so rows are not multiplied by the grid."""
    step = 0.998 / (points - 1)
    slot = F.floor((F.col(score) - 0.001) / step + 1e-9).cast("int")
    per = df.groupBy(F.least(slot, F.lit(points - 1)).alias("slot")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count("*").alias("n"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("slot"))
    up = Window.orderBy(F.desc("slot"))
    every = per.agg(F.sum("pos").alias("ones"))
    found = grid.join(per, "slot", "left").select("slot", F.sum(F.coalesce("pos", F.lit(0))).over(up).alias("tp"), F.sum(F.coalesce("n", F.lit(0))).over(up).alias("above")).crossJoin(every)
    f1 = F.coalesce(F.try_divide(F.col("tp") * 2, F.col("above") + F.col("ones")), F.lit(0.0))
    return found.select((F.lit(0.001) + F.col("slot") * step).alias("threshold"), f1.alias("f1")).orderBy(F.desc("f1"), "threshold").limit(1)


def top_precision(df: DataFrame, y: str, score: str, share: float = 0.1, tie: str = "doc_id") -> DataFrame:
    """Precision of the max(1, floor(share * n)) highest scores. The cut is found by counts a distinct score; only rows at the cut's own
    score are ranked by `tie`, so no task holds the top tenth of the table."""
    per = df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("all"))
    unscored = per.where("s is null").crossJoin(F.broadcast(total)).select("s", "n", F.col("all").alias("cum_n"))  # NULLs come last
    summed = value_sums(per.where("s is not null"), "s", ["n"], descending=True).unionByName(unscored).crossJoin(F.broadcast(total))
    cut = summed.withColumns({"k": F.greatest(F.lit(1), F.floor(F.col("all") * share)), "above": F.col("cum_n") - F.col("n")})
    cut = cut.where("above < k and cum_n >= k").select(F.col("s").alias("__s"), (F.col("k") - F.col("above")).alias("__left"))
    rows = df.crossJoin(F.broadcast(cut))
    sure = rows.where((F.col(score) > F.col("__s")) | (F.col("__s").isNull() & F.col(score).isNotNull())).agg(F.count("*").alias("n"), F.sum(y).alias("hits"))
    at = rows.where(F.col(score).eqNullSafe(F.col("__s"))).withColumn("__r", F.row_number().over(Window.partitionBy("__s").orderBy(tie)))
    edge = at.where("__r <= __left").agg(F.count("*").alias("n"), F.sum(y).alias("hits"))
    return sure.unionByName(edge).agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("precision"))


def calibration_curve(df: DataFrame, y: str, score: str, q: int = 5) -> DataFrame:
    from ..functions.bins import quantile_bin

    return quantile_bin(df, score, "bin", q).groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(y).alias("positive_rate"))


def multiclass_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support of each class of y or pred."""
    pairs = df.groupBy(F.col(y).alias("y"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    by = lambda c, name: pairs.groupBy(F.col(c).alias("k")).agg(F.sum("n").alias(name))
    hit = pairs.where("y = p").select(F.col("y").alias("k"), F.col("n").alias("tp"))
    all_ = by("y", "support").join(by("p", "predicted"), "k", "full").join(hit, "k", "left").na.fill(0, ["support", "predicted", "tp"])
    d = lambda a, b: F.coalesce(F.try_divide(F.expr(a), F.expr(b)), F.lit(0.0))
    return all_.select(F.col("k").alias("class"), "support", d("tp", "predicted").alias("precision"), d("tp", "support").alias("recall"), d("2 * tp", "support + predicted").alias("f1"))


def train_gbt(train: DataFrame, features: Sequence[str], label: str, rounds: int = 20, depth: int = 5, seed: int = 42, weights: tuple[str, Column] | None = None):
    """Gradient-boosted trees over median-imputed features (Spark ML); rows with validation = true stop it early, if there is such a column."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler

    filled = [f"__{c}" for c in features]
    stages = [Imputer(inputCols=list(features), outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="features")]
    booster = GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=depth, seed=seed)
    if weights:
        train, booster = train.withColumn(*weights), booster.setWeightCol(weights[0])
    if "validation" in train.columns:
        booster = booster.setValidationIndicatorCol("validation")
    return Pipeline(stages=[*stages, booster]).fit(train)


def target_kind(df: DataFrame, y: str) -> str:
    """binary for at most two values, else multiclass."""
    return "binary" if df.where(F.col(y).isNotNull()).select(y).distinct().limit(3).count() <= 2 else "multiclass"


def class_codes(df: DataFrame, y: str, out: str = "code") -> DataFrame:
    """df with labels as 0 .. K-1 in rising order; the labels are one broadcast row each, at most `K` of them."""
    labels = df.where(F.col(y).isNotNull()).select(F.col(y).alias("__y")).distinct().withColumn(out, F.row_number().over(Window.orderBy("__y")) - 1)
    return df.join(labels, F.col(y) == F.col("__y"), "left").drop("__y")


def class_confidence_buckets(df: DataFrame, y: str, pred: str, confidence: str, edges: Sequence[float] = (0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """Rows by confidence in [low, high) from 0 to 1, the last closed: n, coverage of all rows, share of right predictions; empty ones are left out."""
    bounds = [0.0, *edges, 1.0]
    conf, bucket = F.col(confidence), F.when(F.col(confidence) == 1.0, len(bounds) - 2)
    for i in range(len(bounds) - 1):
        bucket = bucket.when((conf >= bounds[i]) & (conf < bounds[i + 1]), i)
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg((F.col(y) == F.col(pred)).cast("int")).alias("top1_correct_rate"))
    return counts.withColumn("coverage", F.col("n") / F.sum("n").over(Window.partitionBy())).where("bucket is not null")


def multiclass_summary(df: DataFrame, y: str, pred: str) -> DataFrame:
    """accuracy, macro and weighted F1, balanced accuracy, one row, from the report of the classes."""
    per = multiclass_report(df, y, pred)
    total = F.sum("support")
    return per.agg(
        (F.sum(F.col("recall") * F.col("support")) / total).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), total.alias("n"),
    )


def train_multiclass(train: DataFrame, features: Sequence[str], label: str, classes: int, rounds: int = 20, depth: int = 5, seed: int = 42):
    """One booster a class against the rest (Spark ML has binary boosting only), over median-imputed features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.feature import Imputer, VectorAssembler

    filled = [f"__{c}" for c in features]
    booster = OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed), labelCol=label, featuresCol="features")
    return Pipeline(stages=[Imputer(inputCols=list(features), outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="features"), booster]).fit(train)


def feature_importance(model, features: Sequence[str], top: int = 20) -> list[tuple[str, float]]:
    """The booster's most important features, best first."""
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))[:top]


def group_experiment(df: DataFrame, label: str, features: Sequence[str], groups: Sequence[str], order: Sequence[str], train: float = 0.7, **options) -> DataFrame:
    """(group, n_features, roc_auc, average_precision): a booster for each feature group, fitted on the first `train` of the rows in
    time and scored on the rest."""
    from functools import reduce

    from pyspark.ml.functions import vector_to_array

    from ..functions.roles import group_features

    split, parts = time_split(df, order, train, 1 - train, least=options.pop("least", 1000)), []
    for group in groups:
        chosen = group_features(features, group)
        scored = train_gbt(split.where("split = 'train'"), chosen, label, **options).transform(split.where("split <> 'train'"))
        scored = scored.select(F.col(label).alias("y"), F.round(vector_to_array("probability")[1], 6).alias("p"))
        parts.append(ranking_metrics(scored, "y", "p").select(F.lit(group).alias("group"), F.lit(len(chosen)).alias("n_features"), "roc_auc", "average_precision"))
    return reduce(DataFrame.unionByName, parts)


def univariate_screen(df: DataFrame, features: Sequence[str], y: str, bins: int = 20) -> DataFrame:
    """(feature, corr, auc, mutual_info, score): correlation, AUC of the feature as a score, mutual information with y over quantile bins
    (natural logarithm), and the mean of |corr|, 2 |auc - 1/2| and mutual information as a share of y's entropy."""
    from functools import reduce

    from ..functions.bins import quantile_bin

    parts = []
    for c in features:
        known = df.where(F.col(c).isNotNull() & F.col(y).isNotNull()).select(F.col(c).cast("double").alias("x"), F.col(y).cast("int").alias("y"))
        cells = quantile_bin(known, "x", "b", bins).groupBy("b", "y").agg(F.count("*").alias("n"))
        every = Window.partitionBy()
        p, pb, py = (F.col("n") / F.sum("n").over(every)), F.sum("n").over(Window.partitionBy("b")) / F.sum("n").over(every), F.sum("n").over(Window.partitionBy("y")) / F.sum("n").over(every)
        info = cells.select((p * F.ln(p / (pb * py))).alias("i"), (-p * F.ln(py)).alias("h")).agg(F.sum("i").alias("mutual_info"), F.sum("h").alias("entropy"))
        auc = ranking_metrics(known, "y", "x").select(F.col("roc_auc").alias("auc"))
        parts.append(known.agg(F.corr("x", "y").alias("corr")).crossJoin(auc).crossJoin(info).select(F.lit(c).alias("feature"), "corr", "auc", "mutual_info", "entropy"))
    rows = reduce(DataFrame.unionByName, parts)
    share = F.coalesce(F.try_divide("mutual_info", "entropy"), F.lit(0.0))
    return rows.select("feature", "corr", "auc", "mutual_info", ((F.abs("corr") + 2 * F.abs(F.col("auc") - 0.5) + share) / 3).alias("score"))


def experiment_report(results: list[dict], importance: dict[str, list[tuple[str, float]]], watched: Sequence[str] = ("mid_px",)) -> str:
    """A text report of group_experiment's collected rows: groups by AUC, and where a watched feature leads the importances."""
    lines = ["group | features | ROC AUC | average precision"]
    for r in sorted(results, key=lambda r: -(r["roc_auc"] or 0)):
        lines.append(f"{r['group']} | {r['n_features']} | {r['roc_auc'] or 0:.4f} | {r['average_precision'] or 0:.4f}")
    for group, found in importance.items():
        if found and found[0][0] in watched:
            lines.append(f"{group}: {found[0][0]} dominates with {found[0][1]:.3f}")
    return "\n".join(lines)


def train_model(df: DataFrame, label: str, features: Sequence[str], order: Sequence[str], weight_below: float = 0.3, least: int = 1000, **options):
    """(model, scored test rows (y, score), metrics): split by time, rows weighted by class if label 1 has under `weight_below` of them,
    a booster, ranking and threshold metrics on the test part."""
    from pyspark.ml.functions import vector_to_array

    split = time_split(df.where(F.col(label).isNotNull()), order, least=least)
    fit = split.where("split <> 'test'").withColumn("validation", F.col("split") == "valid")
    share = fit.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    if 0 < share < weight_below:
        options["weights"] = ("__w", F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    model = train_gbt(fit, features, label, **options)
    scored = model.transform(split.where("split = 'test'")).select(F.col(label).alias("y"), F.round(vector_to_array("probability")[1], 6).alias("score"))
    return model, scored, ranking_metrics(scored, "y", "score").crossJoin(binary_metrics(scored, "y", "score"))
