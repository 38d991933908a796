"""Agreement of predictions with truth: overlaps, label metrics, score curves and thresholds."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incident_signals import fixed_values as fixed
from incident_signals.functions.numbers import ratio, share
from incident_signals.operators.density import density_of_all, top_by_volume_per_dimension
from incident_signals.session import cut_lineage

VALIDATED = {
    "activity": "predicted_activity",
    "hazard": "predicted_hazards",
    "barrier_failure": "predicted_barrier_failures",
}
ERROR_SAMPLES = 15
# Distinct scores of one bucket of a curve, about.
SCORES_PER_BUCKET = 100_000


# --- leading values, predicted against truth ------------------------------------------------


def _overlap(sides: DataFrame, keys: list[str], k: int, full: Column) -> DataFrame:
    """Rows (keys, side, rank, name) to the two lists and their overlap."""
    item = F.struct("rank", "name")
    names = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, item)))["name"]
    lists = sides.groupBy(*keys).agg(names("predicted").alias("predicted_top5"), names("truth").alias("ground_truth_top5"))
    common = F.array_intersect("predicted_top5", "ground_truth_top5")
    return lists.select(
        *keys,
        "predicted_top5",
        "ground_truth_top5",
        F.size(common).alias("overlap_count"),
        F.round(F.size(common) / full, 2).alias("overlap_ratio"),
        F.array_sort(common).alias("overlapping_items"),
    )


def _shown(k: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(k), F.size("predicted_top5")))


def validate_dimensions(df: DataFrame, k: int = fixed.PROFILE_TOP_K) -> DataFrame:
    """Most frequent predicted values against most frequent true values, per dimension."""
    used = {t: p for t, p in VALIDATED.items() if t in df.columns and p in df.columns}
    tops = top_by_volume_per_dimension(density_of_all(df, [*used, *used.values()]), k)
    dimension = F.create_map(*[F.lit(x) for t, p in used.items() for x in (t, t, p, t)])
    sides = tops.select(
        dimension[F.col("dim")].alias("dimension"),
        F.when(F.col("dim").isin(list(used)), "truth").otherwise("predicted").alias("side"),
        "rank",
        "name",
    )
    return _overlap(sides, ["dimension"], k, _shown(k))


def validate_sites(df: DataFrame, k: int = fixed.PROFILE_TOP_K) -> DataFrame:
    """Sites of highest density by prediction and by truth."""
    counts = (
        df.where(F.col("site").isNotNull())
        .groupBy("site")
        .agg(
            F.count("sif_prediction").alias("total"),
            ratio(F.sum("sif_prediction"), F.count("sif_prediction")).alias("predicted"),
            F.try_divide(F.sum("sif_label"), F.count("sif_label")).alias("truth"),
        )
    )
    one = lambda side, total: F.struct(F.lit(side).alias("side"), F.col(side).alias("density"), total.alias("total"))
    long = counts.select(F.col("site").alias("name"), F.inline(F.array(one("predicted", F.col("total")), one("truth", F.lit(0)))))
    order = Window.partitionBy("side").orderBy(F.desc("density"), F.desc("total"), "name")
    sides = long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return _overlap(sides.withColumn("dimension", F.lit("site_sif_density")), ["dimension"], k, _shown(k))


# --- labels -----------------------------------------------------------------------------------


def label_outcomes(df: DataFrame, truth: str, predicted: str, key: str = "report_id") -> DataFrame:
    """One row per report and label that is true or predicted, for two arrays on the same row."""
    marked = lambda labels, outcome: F.transform(
        labels, lambda v: F.named_struct(F.lit("label"), v, F.lit("outcome"), F.lit(outcome))
    )
    both = F.array_intersect(truth, predicted)
    return df.select(
        key,
        F.inline(
            F.concat(
                marked(both, "tp"),
                marked(F.array_except(predicted, truth), "fp"),
                marked(F.array_except(truth, predicted), "fn"),
            )
        ),
    )


def outcomes_of_tables(truth: DataFrame, predicted: DataFrame, key: str = "report_id") -> DataFrame:
    """The same for two long tables (key, label): one shuffle on key and label."""
    sided = truth.select(key, "label", F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(
        predicted.select(key, "label", F.lit(0).alias("t"), F.lit(1).alias("p"))
    )
    flags = sided.groupBy(key, "label").agg(F.max("t").alias("t"), F.max("p").alias("p"))
    outcome = F.when((F.col("t") == 1) & (F.col("p") == 1), "tp").when(F.col("p") == 1, "fp").otherwise("fn")
    return flags.select(key, "label", outcome.alias("outcome"))


def _prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def _outcome_counts() -> list[Column]:
    return [F.count_if(F.col("outcome") == name).alias(name) for name in ("tp", "fp", "fn")]


def label_metrics(outcomes: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label."""
    counts = outcomes.groupBy("label").agg(*_outcome_counts())
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("label", "tp", "fp", "fn", *_prf(tp, fp, fn), (tp + fn).alias("support"))


def micro_metrics(outcomes: DataFrame) -> DataFrame:
    """One row over all labels; zeros when there are none."""
    counts = outcomes.agg(*_outcome_counts())
    return counts.select("tp", "fp", "fn", *_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def error_samples(outcomes: DataFrame, key: str = "report_id", k: int = ERROR_SAMPLES) -> DataFrame:
    """First k false positives and first k false negatives, by report id."""
    order = Window.partitionBy("outcome").orderBy(key, "label")
    wrong = outcomes.where(F.col("outcome") != "tp")
    return wrong.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def readiness(metrics: DataFrame, gates: dict[str, float] = fixed.READINESS_F1) -> DataFrame:
    """Whether every gated dimension reaches its F1; ``metrics`` has (dimension, f1)."""
    tests = [F.coalesce(F.max(F.when(F.col("dimension") == d, F.col("f1"))), F.lit(0.0)) >= gate for d, gate in gates.items()]
    return metrics.agg(F.array_min(F.array(*tests)).alias("ready"))


def multilabel_metrics(
    df: DataFrame, truth: str, predicted: str, classes: list[str] = fixed.LIFE_SAVING_RULES, key: str = "report_id"
) -> DataFrame:
    """Micro and macro scores over fixed classes, hamming loss and exact match, in one row."""
    known = F.array(*[F.lit(c) for c in classes])
    rows = df.select(
        key,
        F.array_intersect(truth, known).alias("truth"),
        F.array_intersect(predicted, known).alias("predicted"),
    )
    exact = (F.size(F.array_except("truth", "predicted")) == 0) & (F.size(F.array_except("predicted", "truth")) == 0)
    whole = F.array(
        F.named_struct(F.lit("label"), F.lit(""), F.lit("outcome"), F.when(exact, "exact").otherwise("other"))
    )
    mark = lambda labels, outcome: F.transform(
        labels, lambda v: F.named_struct(F.lit("label"), v, F.lit("outcome"), F.lit(outcome))
    )
    counts = (
        rows.select(
            F.inline(
                F.concat(
                    whole,
                    mark(F.array_intersect("truth", "predicted"), "tp"),
                    mark(F.array_except("predicted", "truth"), "fp"),
                    mark(F.array_except("truth", "predicted"), "fn"),
                )
            )
        )
        .groupBy("label")
        .agg(*_outcome_counts(), F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "exact").alias("exact"))
    )
    real = F.col("label") != ""
    tp, fp, fn = [F.sum(F.when(real, F.col(c)).otherwise(0)) for c in ("tp", "fp", "fn")]
    reports = F.max(F.when(~real, F.col("n")).otherwise(0))
    own = {
        "precision": share(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": share(F.col("tp"), F.col("tp") + F.col("fn")),
        "f1": share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
    }
    return counts.agg(
        share(tp, tp + fp).alias("micro_precision"),
        share(tp, tp + fn).alias("micro_recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("micro_f1"),
        *[(F.sum(F.when(real, v).otherwise(0.0)) / len(classes)).alias(f"macro_{n}") for n, v in own.items()],
        share(fp + fn, reports * len(classes)).alias("hamming_loss"),
        share(F.sum("exact"), reports).alias("exact_match_ratio"),
    )


# --- scores -----------------------------------------------------------------------------------


def _rates(tp: Column, fp: Column, tn: Column, fn: Column) -> list[Column]:
    return [
        share(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        *_prf(tp, fp, fn),
        share(tn, tn + fp).alias("specificity"),
        share(fn, fn + tp).alias("false_negative_rate"),
        share(fp, fp + tn).alias("false_positive_rate"),
    ]


def binary_metrics(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """Confusion counts and rates at one threshold, in one row."""
    hit, positive = F.col(score) >= threshold, F.col(label) == 1
    counts = df.agg(
        F.count_if(hit & positive).alias("tp"),
        F.count_if(hit & ~positive).alias("fp"),
        F.count_if(~hit & ~positive).alias("tn"),
        F.count_if(~hit & positive).alias("fn"),
    )
    return counts.select("tp", "fp", "tn", "fn", *_rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))


def score_curve(df: DataFrame, label: str, score: str, buckets: int | None = None) -> DataFrame:
    """Cumulative positives and negatives at or above every distinct score.

    Equal scores are merged before the shuffle and written once, so a model
    behind them runs once.  Distinct scores are split at the quantiles of a
    mergeable sketch (any monotone split gives the exact result) into as many
    buckets as their number asks for; the running sums work per bucket, with
    bucket totals as offsets, and no task sees the whole curve.
    """
    positive = (F.col(label) == 1).cast("bigint")
    scores = (
        df.where(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
    )
    scores = cut_lineage(scores)
    buckets = buckets or scores.count() // SCORES_PER_BUCKET + 1
    marks = [i / buckets for i in range(1, buckets)]
    accuracy = max(10_000, 10 * buckets)
    splits = (scores.agg(F.percentile_approx("score", marks, accuracy).alias("s")).first()["s"] if marks else None) or []
    bounds = sorted(set(splits)) or [0.0]
    placed = Bucketizer(inputCol="score", outputCol="bucket", splits=[-float("inf"), *bounds, float("inf")])
    bucketed = placed.transform(scores)
    higher = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = bucketed.groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    offsets = sums.select(
        "bucket",
        F.coalesce(F.sum("pos").over(higher), F.lit(0)).alias("pos_above"),
        F.coalesce(F.sum("neg").over(higher), F.lit(0)).alias("neg_above"),
    )
    inside = Window.partitionBy("bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        bucketed.withColumn("tp_in", F.sum("pos").over(inside))
        .withColumn("fp_in", F.sum("neg").over(inside))
        .join(offsets, "bucket")
        .select(
            "score",
            "pos",
            "neg",
            (F.col("pos_above") + F.col("tp_in")).alias("tp"),
            (F.col("neg_above") + F.col("fp_in")).alias("fp"),
        )
    )


def ranking_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC area with averaged ties and step-wise average precision, in one row."""
    curve = score_curve(df, label, score)
    pos, neg, tp, fp = [F.col(c) for c in ("pos", "neg", "tp", "fp")]
    area = F.sum(neg.cast("double") * (tp - pos / 2.0))
    steps = F.sum(pos * F.try_divide(tp, tp + fp))
    return curve.agg(
        F.try_divide(area, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("roc_auc"),
        F.try_divide(steps, F.sum("pos").cast("double")).alias("pr_auc"),
    )


def curve_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """False and true positive rate, precision and recall at every distinct score."""
    curve = score_curve(df, label, score)
    totals = curve.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("t")).scalar()
    tp, fp = F.col("tp"), F.col("fp")
    return curve.select(
        F.col("score").alias("threshold"),
        share(fp, totals["n"]).alias("false_positive_rate"),
        share(tp, totals["p"]).alias("true_positive_rate"),
        share(tp, tp + fp).alias("precision"),
        share(tp, totals["p"]).alias("recall"),
    )


def threshold_metrics(
    df: DataFrame, label: str, score: str, grid: list[float] = fixed.SIF_THRESHOLD_GRID
) -> DataFrame:
    """Metrics at every threshold of a grid.

    A row is only assigned to the number of thresholds it reaches; the grid is
    applied to those few counts, not to the rows.
    """
    thresholds = F.array(*[F.lit(t) for t in sorted(grid)])
    reached = F.size(F.filter(thresholds, lambda t: F.col(score) >= t))
    positive = F.col(label) == 1
    counts = df.groupBy(reached.alias("reached")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    per = counts.select("*", F.posexplode(thresholds).alias("position", "threshold"))
    hit = F.col("reached") > F.col("position")
    total = lambda condition, name: F.sum(F.when(condition, F.col(name)).otherwise(0))
    sums = per.groupBy("threshold").agg(
        total(hit, "pos").alias("tp"), total(hit, "neg").alias("fp"),
        total(~hit, "neg").alias("tn"), total(~hit, "pos").alias("fn"),
    )
    return sums.select("threshold", "tp", "fp", "tn", "fn", *_rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))


def choose_threshold(
    metrics: DataFrame, min_recall: float = fixed.SIF_MIN_RECALL, default: float = fixed.SIF_DEFAULT_THRESHOLD
) -> DataFrame:
    """Best F1 among thresholds with enough recall, the lowest on ties; otherwise the default."""
    order = F.when(F.col("recall") >= min_recall, F.struct((-F.col("f1")).alias("f"), "threshold"))
    return metrics.agg(
        F.coalesce(F.min_by("threshold", order), F.lit(default)).alias("threshold"),
        F.max(F.when(F.col("recall") >= min_recall, F.col("f1"))).alias("f1"),
    )


def comparison_table(results: list[tuple[str, str, DataFrame]], metrics: list[str]) -> DataFrame:
    """Metrics of (feature mode, split) results side by side: one row per mode and metric."""
    long = None
    for mode, split, result in results:
        items = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        rows = result.select(F.lit(mode).alias("mode"), F.lit(split).alias("split"), F.inline(items))
        long = rows if long is None else long.unionByName(rows)
    splits = list(dict.fromkeys(split for _, split, _ in results))
    return long.groupBy("mode", "metric").pivot("split", splits).agg(F.first("value"))
