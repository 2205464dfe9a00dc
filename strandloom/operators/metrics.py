"""Classification metrics, losses, and early stopping."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def confusion(rows: DataFrame, keys: list[str] | None = None, label: str = "label", pred: str = "pred", weight: str | None = None) -> DataFrame:
    """(keys, label, pred, n) over rows whose weight is not 0; everything below is made from these few rows."""
    if weight:
        rows = rows.where(F.col(weight) != 0)
    return rows.groupBy(*(keys or []), label, pred).agg(F.count("*").alias("n"))


def accuracy(matrix: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """The share on the diagonal; null without rows."""
    right = F.sum(F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0))
    return matrix.agg(F.try_divide(right, F.sum("n")).alias("accuracy"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def f1(matrix: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """(class, tp, fp, fn, f1) for every class that is a label or a prediction; 0 where nothing was right."""
    hit = F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0)
    miss = F.when(F.col(label) != F.col(pred), F.col("n")).otherwise(0)
    sides = matrix.select(F.explode(F.array(F.struct(F.col(label).alias("class"), hit.alias("tp"), F.lit(0).cast("long").alias("fp"), miss.alias("fn")), F.struct(F.col(pred).alias("class"), F.lit(0).cast("long").alias("tp"), miss.alias("fp"), F.lit(0).cast("long").alias("fn")))).alias("x")).select("x.*")
    totals = sides.groupBy("class").agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    return totals.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def weighted_cross_entropy(p_label: Column, weight: Column, class_weight: Column) -> Column:
    """An aggregate: the mean over all rows, those of weight 0 included, of weighted -ln p."""
    from strandloom.functions.sequence import safe_log

    return F.avg(F.when(weight * class_weight == 0, F.lit(0.0)).otherwise(-safe_log(p_label) * weight * class_weight))


def total_loss(base: Column, transition: Column, phase: Column) -> Column:
    return base + 10 * transition + 10 * phase


def early_stop(scores: DataFrame, patience: int, delta: float = 0.0, keys: list[str] | None = None, epoch: str = "epoch", score: str = "score") -> DataFrame:
    """(keys, epoch, score) with best (the best score so far), streak (epochs in a row without a better one), improved and stopped.

    An epoch is better if its score exceeds the best by more than delta; those
    are the ones (`improved`) whose state is kept as a checkpoint. The best
    depends on the epochs before in order, so each series is one group.
    """
    keys = keys or []
    rows = scores.select(*keys, F.col(epoch).cast("long").alias("epoch"), F.col(score).cast("double").alias("score"))

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("epoch")
        best, streak, stopped, out = None, 0, False, []
        for x in table["score"].to_pylist():
            better = best is None or x > best + delta
            best, streak = (x, 0) if better else (best, streak + 1)
            stopped = stopped or streak >= patience
            out.append((best, streak, better, stopped))
        columns = list(zip(*out, strict=True))
        for name, kind, values in zip(("best", "streak", "improved", "stopped"), (pa.float64(), pa.int32(), pa.bool_(), pa.bool_()), columns, strict=True):
            table = table.append_column(name, pa.array(values, kind))
        return table

    more = [T.StructField("best", T.DoubleType()), T.StructField("streak", T.IntegerType()), T.StructField("improved", T.BooleanType()), T.StructField("stopped", T.BooleanType())]
    return rows.groupBy(*keys).applyInArrow(fold, T.StructType([*rows.schema.fields, *more]))


def checkpoint_metric(tasks: list[DataFrame]) -> DataFrame:
    """(macro_f1): the mean of the tasks' macro F1, each over the classes of its confusion counts."""
    macros = None
    for counts in tasks:
        one = f1(counts).agg(F.avg("f1").alias("macro"))
        macros = one if macros is None else macros.union(one)
    return macros.agg(F.avg("macro").alias("macro_f1"))
