"""Scores of long prediction tables.

Predictions are kept long: one row per (dataset, model, subset, row) with
``truth`` and ``pred``. One partially aggregated count by (group, truth, pred)
is the only pass over them; every metric is derived from those few counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import MODEL_KINDS

GROUP = ("dataset", "model", "subset")


def long_predictions(
    rows: DataFrame, dataset: str, model: str, keep: Sequence[str], truth: str = "phase", pred: str = "pred", subset: str = "all"
) -> DataFrame:
    return rows.select(
        F.lit(dataset).alias("dataset"), F.lit(model).alias("model"), F.lit(subset).alias("subset"),
        *keep, F.col(truth).alias("truth"), F.col(pred).alias("pred"),
    )


def melt_predictions(
    rows: DataFrame, dataset: str, preds: Mapping[str, str], keep: Sequence[str], truth: str = "phase", subset: str = "all"
) -> DataFrame:
    """Wide prediction columns (model name -> column) to long rows in one pass over ``rows``."""
    entries = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("pred")) for m, c in preds.items()])
    long = rows.select(*keep, F.col(truth).alias("truth"), F.inline(entries))
    return long.select(F.lit(dataset).alias("dataset"), "model", F.lit(subset).alias("subset"), *keep, "truth", "pred")


def union_metrics(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def with_subset(preds: DataFrame, member: Column, model: str, subset: str) -> DataFrame:
    """Add a second copy of one model's rows, restricted to ``member``, under a subset name."""
    tags = F.when((F.col("model") == model) & member, F.array(F.col("subset"), F.lit(subset))).otherwise(F.array("subset"))
    return preds.withColumn("subset", F.explode(tags))


def confusion(preds: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    return preds.groupBy(*group, "truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def label_stats(counts: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Per label: true positives, predicted, support, precision, recall, F1 (0 on a zero denominator).

    A missing prediction counts in the support of its true label and is no label itself.
    """
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), zero.alias("predicted"), hit.cast("long").alias("tp")),
        F.struct(F.col("pred").alias("label"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
    )
    sums = counts.select(*group, F.inline(sides)).where(F.col("label").isNotNull()).groupBy(*group, "label").agg(
        *[F.sum(c).alias(c) for c in ("tp", "predicted", "support")]
    )
    return sums.withColumns(_scores(F.col("tp"), F.col("predicted"), F.col("support")))


def _scores(tp: Column, predicted: Column, support: Column) -> dict[str, Column]:
    def safe(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    return {
        "precision": safe(tp, predicted),
        "recall": safe(tp, support),
        "f1": safe(F.lit(2.0) * tp, predicted + support),
    }


def summary_metrics(preds: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Accuracy, weighted F1 and macro F1 over the labels seen in truth or prediction."""
    stats = label_stats(confusion(preds, group), group)
    return stats.groupBy(*group).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.avg("f1").alias("macro_f1"),
    )


def class_report(preds: DataFrame, labels: Sequence[str], group: Sequence[str] = GROUP) -> DataFrame:
    """Report over a fixed label list: one row per label plus accuracy, macro and weighted averages.

    A label of the list without rows scores 0. When the list misses a label that
    occurs, the overall row is the micro average over the list instead of accuracy.
    Accuracy is the share of all rows that were hit, rows without a prediction included.
    """
    stats = label_stats(confusion(preds, group), group)
    names = sorted(labels)
    counts = ("tp", "predicted", "support")
    by_label = F.map_from_entries(F.collect_list(F.struct("label", F.struct(*counts))))
    found = stats.groupBy(*group).agg(by_label.alias("_of"))
    listed = [F.struct(F.lit(n).alias("label"), *[F.coalesce(F.col("_of")[n][c], F.lit(0).cast("long")).alias(c) for c in counts]) for n in names]
    covered = F.size(F.array_except(F.map_keys("_of"), F.array(*map(F.lit, names)))) == 0
    rows = found.select(*group, covered.alias("_covered"), F.inline(F.array(*listed)))
    rows = rows.withColumns(_scores(F.col("tp"), F.col("predicted"), F.col("support")))

    measures = ("precision", "recall", "f1")
    support = F.sum("support")
    micro = _scores(F.sum("tp"), F.sum("predicted"), support)
    overall = {c: F.when(F.col("_covered"), micro["recall"]).otherwise(micro[c]) for c in measures}
    share = {c: F.coalesce(F.sum(F.col(c) * F.col("support")) / F.nullif(support, F.lit(0)), F.lit(0.0)) for c in measures}

    def line(name: Column, values: Mapping[str, Column]) -> Column:
        return F.struct(name.alias("label"), *[values[c].alias(c) for c in measures], support.alias("support"))

    # One pass: the lines of the labels and the averages leave the same aggregation.
    lines = rows.groupBy(*group, "_covered").agg(
        F.concat(
            F.collect_list(F.struct("label", *measures, "support")),
            F.array(
                line(F.when(F.col("_covered"), F.lit("accuracy")).otherwise(F.lit("micro avg")), overall),
                line(F.lit("macro avg"), {c: F.avg(c) for c in measures}),
                line(F.lit("weighted avg"), share),
            ),
        ).alias("_lines")
    )
    return lines.select(*group, F.inline("_lines"))


def model_kind(model: Column | str, kinds: Mapping[str, str] = MODEL_KINDS, default: str = "Machine Learning") -> Column:
    """Kind of a model by name; a subset suffix in parentheses does not matter."""
    name = F.regexp_replace(F.col(model) if isinstance(model, str) else model, r" \(.*\)$", "")
    chain = None
    for m, k in kinds.items():
        chain = F.when(name == m, F.lit(k)) if chain is None else chain.when(name == m, F.lit(k))
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def compare_models(preds: DataFrame, kinds: Mapping[str, str] = MODEL_KINDS) -> DataFrame:
    """One row per dataset and model; a subset row carries the subset in its model name."""
    scores = summary_metrics(preds)
    name = F.when(F.col("subset") == "all", F.col("model")).otherwise(F.format_string("%s (%s)", "model", "subset"))
    return scores.select(
        "dataset", name.alias("model"), model_kind("model", kinds).alias("type"), "accuracy", "weighted_f1", "macro_f1"
    )


def best_per_group(table: DataFrame, group: Sequence[str] = ("dataset",), score: str = "weighted_f1", name: str = "model") -> DataFrame:
    """Row with the highest score per group; equal scores go to the first name."""
    rest = [c for c in table.columns if c not in group]
    pick = F.min_by(F.struct(*rest), F.struct(-F.col(score), F.col(name)))
    return table.groupBy(*group).agg(pick.alias("_best")).select(*group, "_best.*")


def best_of_group(table: DataFrame, models: Sequence[str], out: str, group: Sequence[str] = ("dataset",), score: str = "weighted_f1") -> DataFrame:
    """Highest score among the listed models per group."""
    return table.groupBy(*group).agg(F.max(F.when(F.col("model").isin(*models), F.col(score))).alias(out))


def top_k_features(importances: DataFrame, k: int = 5, group: Sequence[str] = ("model",), value: str = "importance") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.desc(value), "feature")
    return importances.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sort_values(table: DataFrame, value: str, *ties: str) -> DataFrame:
    return table.orderBy(value, *ties)
