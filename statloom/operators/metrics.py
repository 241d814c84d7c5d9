"""Classification and regression metrics from counts and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.core import double, with_stats


def confusion(predicted: Column, actual: Column, positive=1) -> dict[str, Column]:
    p, a = predicted == positive, actual == positive
    count = lambda c: F.count(F.when(c, 1))
    return {"tp": count(p & a), "fp": count(p & ~a), "tn": count(~p & ~a), "fn": count(~p & a)}


def confusion_matrix(df: DataFrame, predicted: str, actual: str, positive=1, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, tn, fn and accuracy (0 of nothing), precision, recall and f1 (null where a denominator is 0)."""
    made = df.groupBy(*by).agg(*(c.alias(n) for n, c in confusion(F.col(predicted), F.col(actual), positive).items()))
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    made = made.withColumns({"accuracy": F.coalesce(F.try_divide(tp + tn, tp + fp + tn + fn), F.lit(0.0)), "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn)})
    return made.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def classification_report(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """(label, precision, recall, f1, support) of every actual or predicted class, from one grouping of the pairs of labels."""
    pairs = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("label"), F.lit(True).alias("actual")), F.struct(F.col("p").alias("label"), F.lit(False).alias("actual")))).alias("s")
    made = pairs.select("a", "p", "n", sides).groupBy(F.col("s.label").alias("label")).agg(
        F.coalesce(F.sum(F.when(F.col("s.actual"), F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(~F.col("s.actual"), F.col("n"))), F.lit(0)).alias("_predicted"),
        F.coalesce(F.sum(F.when(F.col("s.actual") & (F.col("a") == F.col("p")), F.col("n"))), F.lit(0)).alias("_tp"),
    )
    made = made.select("label", F.try_divide("_tp", "_predicted").alias("precision"), F.try_divide("_tp", "support").alias("recall"), "support")
    return made.select("label", "precision", "recall", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def report_averages(report: DataFrame) -> DataFrame:
    """Rows macro (undefined classes are left out) and weighted (they count as 0, over all support), and accuracy on both."""
    whole = F.sum("support")
    parts = ("precision", "recall", "f1")
    macro = F.struct(F.lit("macro").alias("average"), *(F.avg(c).alias(c) for c in parts))
    weighted = F.struct(F.lit("weighted").alias("average"), *(F.coalesce(F.try_divide(F.sum(F.coalesce(c, F.lit(0.0)) * F.col("support")), whole), F.lit(0.0)).alias(c) for c in parts))
    accuracy = F.coalesce(F.try_divide(F.sum(F.coalesce("recall", F.lit(0.0)) * F.col("support")), whole), F.lit(0.0))
    return report.agg(F.array(macro, weighted).alias("rows"), accuracy.alias("accuracy"), whole.alias("support")).select(F.explode("rows").alias("r"), "accuracy", "support").select("r.*", "accuracy", "support")


def regression_metrics(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """r2 (0 without spread of the actual values), mse and rmse."""
    y, p = double(actual), double(predicted)
    made = with_stats(df.where(y.isNotNull() & p.isNotNull()), _m=F.avg(y))
    rest, all_ = F.sum((y - p) * (y - p)), F.sum((y - F.col("_m")) * (y - F.col("_m")))
    mse = F.avg((y - p) * (y - p))
    return made.agg(F.when(all_ == 0, 0.0).otherwise(1 - F.try_divide(rest, all_)).alias("r2"), mse.alias("mse"), F.sqrt(mse).alias("rmse"))
