"""Classification metrics as single-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from placewise.constants import TARGET_RECALL, THRESHOLDS


def _ratio(a: Column, b: Column) -> Column:
    """``a / b``, and 0 where there is nothing to divide by."""
    return F.coalesce(a.cast("double") / F.nullif(b, F.lit(0)), F.lit(0.0))


def _counts(label: str, positive: Column) -> list[Column]:
    actual = F.col(label) == 1
    return [
        F.count_if(actual & positive).alias("tp"), F.count_if(~actual & positive).alias("fp"),
        F.count_if(actual & ~positive).alias("fn"), F.count_if(~actual & ~positive).alias("tn"),
    ]


def _scores() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {"accuracy": _ratio(tp + tn, tp + fp + fn + tn), "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn)}


def threshold_sweep(scored: DataFrame, label: str, prob: str, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Accuracy, precision and recall at each cut-off, from one pass over the scored rows."""
    rows = scored.where(F.col(label).isNotNull() & F.col(prob).isNotNull())
    packed = rows.agg(*[
        F.struct(F.lit(t).cast("double").alias("threshold"), *_counts(label, F.col(prob) >= F.lit(t))).alias(f"t{i}")
        for i, t in enumerate(thresholds)])
    sweep = packed.select(F.inline(F.array(*packed.columns)))
    return sweep.select("threshold", *[c.alias(name) for name, c in _scores().items()]).orderBy("threshold")


def pick_threshold(sweep: DataFrame, target_recall: float = TARGET_RECALL) -> DataFrame:
    """The row of highest precision among those that reach the recall; if none does, of highest F1.
    Ties go to the lower threshold."""
    p, r = F.col("precision"), F.col("recall")
    reached = r >= target_recall
    f1 = 2 * p * r / (p + r + F.lit(1e-9))
    return sweep.orderBy(reached.desc(), F.when(reached, p).otherwise(f1).desc(), "threshold").limit(1)


def binary_metrics(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    return scored.agg(*_counts(label, F.col(prediction) == 1)).select(
        *[c.alias(name) for name, c in _scores().items()])


def confusion(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """The four cells of a 0/1 confusion matrix, empty ones included."""
    cells = [F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(c).alias("rows"))
             for a, b, c in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]]
    return scored.agg(*_counts(label, F.col(prediction) == 1)).select(F.inline(F.array(*cells)))


def class_report(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy (under F1), macro and weighted averages."""
    pairs = scored.groupBy(F.col(label).cast("string").alias("actual"),
                           F.col(prediction).cast("string").alias("predicted")).agg(F.count("*").alias("rows"))
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("rows")).otherwise(F.lit(0))
    none = F.lit(0).cast("bigint")
    sides = pairs.select(F.inline(F.array(
        F.struct(F.col("actual").alias("class"), F.col("rows").alias("support"), none.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("predicted").alias("class"), none.alias("support"), F.col("rows").alias("predicted"),
                 none.alias("tp")))))
    classes = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    p, r = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    rows = classes.select(
        "class", p.alias("precision"), r.alias("recall"),
        F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"), "support", "tp")
    n = F.sum("support")
    empty = F.lit(None).cast("double")

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / n

    totals = rows.agg(
        F.struct(F.lit("accuracy").alias("class"), empty.alias("precision"), empty.alias("recall"),
                 _ratio(F.sum("tp"), n).alias("f1"), n.alias("support")).alias("a"),
        F.struct(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                 F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), n.alias("support")).alias("m"),
        F.struct(F.lit("weighted avg").alias("class"), weighted("precision").alias("precision"),
                 weighted("recall").alias("recall"), weighted("f1").alias("f1"), n.alias("support")).alias("w"),
    ).select(F.inline(F.array("a", "m", "w")))
    return rows.drop("tp").unionByName(totals)
