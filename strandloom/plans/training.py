"""Training of a per-base classifier on sample windows: rounds over all windows, weights as a table, restarts where a run was lost.

The model is a softmax per task over one-hot context; tasks share features and
are learned together, as the samples have them (class, change, phase). A round
is one pass over the training windows, in which tasks sum gradients that Spark
adds up, a step with momentum on the driver, whose size is that of the weights
alone, and one pass over the validation windows. Gradients are summed as whole
numbers of 2**-SCALE, so a round does not depend on how windows are dealt out,
and a run that is resumed gives what an unbroken one gives, bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import metrics

SCALE = 24
LOG = "round long, loss double, macro_f1 double"
_WEIGHTS = "feature int, output int, value double, velocity double"

_LETTERS = np.zeros((256, 4))
_LETTERS[[ord(c) for c in "NMWRYKBSDHV"]] = 0.25
_LETTERS[[ord(c) for c in "ACGT"]] = np.eye(4)
#: The different rows of that table, and which of them a letter has.
_KINDS, _KIND_OF = np.unique(_LETTERS, axis=0, return_inverse=True)
_KIND_OF = _KIND_OF.reshape(-1).astype(np.int16)


@dataclass(frozen=True)
class Task:
    """A label of every base: its column, number of classes, column of weights, share of the loss, and weights of the classes (1 where none are given)."""

    label: str
    classes: int
    weight: str
    factor: float = 1.0
    class_weights: tuple[float, ...] = ()


TASKS = (Task("ann", 4, "weight"), Task("transition", 2, "transition_mask", 10.0), Task("phase", 4, "weight", 10.0))


class ContextClassifier:
    """Class probabilities from the bases up to `reach` before and behind; the last row of weights is the bias."""

    def __init__(self, weights: np.ndarray, reach: int, tasks: tuple[Task, ...] = TASKS) -> None:
        self.weights, self.reach, self.tasks = weights, reach, tasks
        self.cuts = np.cumsum([t.classes for t in tasks])[:-1]

    @staticmethod
    def features(reach: int) -> int:
        return 4 * (2 * reach + 1) + 1

    def one_hot(self, seq: str, flank: int) -> np.ndarray:
        letters = _LETTERS[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
        return letters[flank - self.reach : len(seq) - flank + self.reach]

    def probabilities(self, letters: np.ndarray) -> list[np.ndarray]:
        """By task, (bases, classes), of one-hot letters with `reach` more on either side."""
        n, wide = len(letters) - 2 * self.reach, self.weights[:-1].reshape(2 * self.reach + 1, 4, -1)
        z = sum((letters[k : k + n] @ wide[k] for k in range(len(wide))), start=np.tile(self.weights[-1], (n, 1)))
        out = []
        for part in np.split(z, self.cuts, axis=1):
            powers = np.exp(part - part.max(1, keepdims=True))
            out.append(powers / powers.sum(1, keepdims=True))
        return out

    def _together(self, codes: np.ndarray) -> list[np.ndarray]:
        """probabilities of many windows of one length, (classes, windows, bases) by task, of _KINDS codes with `reach` more on either side.

        Three neighbours are looked up at once. Nothing depends on which windows are beside one.
        """
        wide, n = self.weights[:-1].reshape(2 * self.reach + 1, 4, -1), codes.shape[1] - 2 * self.reach
        z = np.empty((self.weights.shape[1], len(codes), n))
        z[:] = self.weights[-1][:, None, None]
        for k in range(0, len(wide), 3):
            place, table = np.zeros((len(codes), n), np.int16), np.zeros((1, z.shape[0]))
            for j in range(k, min(k + 3, len(wide))):
                place = place * len(_KINDS) + codes[:, j : j + n]
                table = (table[:, None] + (_KINDS @ wide[j])[None]).reshape(-1, z.shape[0])
            for out, column in zip(z, np.ascontiguousarray(table.T), strict=True):
                out += column[place]
        out = []
        for part in np.split(z, self.cuts):
            powers = np.exp(part - part.max(0))
            out.append(powers / powers.sum(0))
        return out

    def gradients(self, codes: np.ndarray, labels: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of each of many windows of one length the sums over its bases of the loss's gradient and of the loss."""
        loss, errors = np.zeros(len(codes)), []
        for task, p, label, weight in zip(self.tasks, self._together(codes), labels, weights, strict=True):
            w = weight * np.array(task.class_weights or (1.0,) * task.classes)[label] * task.factor
            own = np.maximum(np.take_along_axis(p, label[None], 0)[0], 1e-300)
            loss -= (np.log(own) * w).sum(1)
            for k in range(task.classes):
                errors.append(p[k] * w - np.where(label == k, w, 0.0))
        each, n = np.ascontiguousarray(np.stack(errors, 2)), codes.shape[1] - 2 * self.reach
        hot = np.ascontiguousarray(_KINDS[codes].transpose(0, 2, 1))
        parts = [np.matmul(hot[:, :, k : k + n], each) for k in range(2 * self.reach + 1)]
        return np.concatenate([*parts, each.sum(1, keepdims=True)], 1), loss


#: Bases that are dealt with at once.
TOGETHER = 1 << 14


def _windows(batch: pa.RecordBatch, model: ContextClassifier, flank: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """By groups of windows of one length: codes of their letters with the model's reach, and their labels and weights by task."""
    texts = [seq.encode("latin-1", "replace") for seq in batch.column("seq").to_pylist()]
    columns = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for t in model.tasks for c in (t.label, t.weight)}
    lengths = batch.column(model.tasks[0].label).value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == n)
        step = max(1, TOGETHER // max(n, 1))
        for k in range(0, len(own), step):
            some = own[k : k + step]
            letters = np.frombuffer(b"".join(texts[i] for i in some), np.uint8).reshape(len(some), n + 2 * flank)
            codes = _KIND_OF[letters[:, flank - model.reach : n + flank + model.reach]]
            at = starts[some][:, None] + np.arange(n)
            one = {c: v[at] for c, v in columns.items()}
            yield codes, [one[t.label] for t in model.tasks], [one[t.weight] for t in model.tasks]


def gradient_sums(windows: DataFrame, model: ContextClassifier, flank: int) -> tuple[np.ndarray, float, int]:
    """Sums over all windows of gradient and loss, and the number of bases."""
    shape, names = model.weights.shape, [f"c{k}" for k in range(model.weights.shape[1])]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows beyond the features: the loss, and the bases.
        total = np.zeros((shape[0] + 2, shape[1]), np.int64)
        for batch in batches:
            for codes, labels, weights in _windows(batch, model, flank):
                gradient, loss = model.gradients(codes, labels, weights)
                total[:-2] += np.rint(gradient * 2**SCALE).astype(np.int64).sum(0)
                total[-2, 0] += np.rint(loss * 2**SCALE).astype(np.int64).sum()
                total[-1, 0] += labels[0].size
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), *(pa.array(np.ascontiguousarray(total[:, k])) for k in range(shape[1]))], names=["i", *names])

    columns = ["seq", *dict.fromkeys(c for t in model.tasks for c in (t.label, t.weight))]
    parts = windows.select(*columns).mapInArrow(add, "i int, " + ", ".join(f"{c} long" for c in names))
    found = parts.groupBy("i").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names)).orderBy("i").collect()
    if not found:
        raise ValueError("no windows to train on")
    sums = np.array([[float(r[c]) for c in names] for r in found])
    return sums[:-2] / 2**SCALE, float(sums[-2, 0]) / 2**SCALE, int(sums[-1, 0])


def confusions(windows: DataFrame, model: ContextClassifier, flank: int) -> DataFrame:
    """(task, label, pred, n) over bases with a weight other than 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for codes, labels, weights in _windows(batch, model, flank):
                for k, (p, label, weight) in enumerate(zip(model._together(codes), labels, weights, strict=True)):
                    some = weight != 0
                    if not some.any():
                        continue
                    low, found = int(label.min()), (label * len(p) + p.argmax(0))[some]
                    counts = np.bincount(found - low * len(p))
                    for x in np.flatnonzero(counts).tolist():
                        key = (k, low + x // len(p), x % len(p))
                        rows[key] = rows.get(key, 0) + int(counts[x])
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int32()) for j in range(3)] + [pa.array(list(rows.values()), pa.int64())], names=["task", "label", "pred", "n"])

    columns = ["seq", *dict.fromkeys(c for t in model.tasks for c in (t.label, t.weight))]
    return windows.select(*columns).mapInArrow(count, "task int, label int, pred int, n long").groupBy("task", "label", "pred").agg(F.sum("n").alias("n"))


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def log(spark: SparkSession, path: str) -> DataFrame:
    """The rounds that are done: round, loss before its step over the training windows, macro F1 behind it over the others."""
    return spark.read.schema(LOG).parquet(f"{path}/log") if _exists(spark, f"{path}/log") else spark.createDataFrame([], LOG)


def load(spark: SparkSession, path: str, number: int, reach: int, tasks: tuple[Task, ...] = TASKS) -> tuple[ContextClassifier, np.ndarray]:
    """The classifier behind a round, and its velocity."""
    values = np.zeros((2, ContextClassifier.features(reach), sum(t.classes for t in tasks)))
    for r in spark.read.schema(_WEIGHTS).parquet(f"{path}/weights/round={number}").collect():
        values[:, r["feature"], r["output"]] = r["value"], r["velocity"]
    return ContextClassifier(values[0], reach, tasks), values[1]


def train(
    windows: DataFrame, validation: DataFrame, path: str, flank: int, reach: int = 10, rounds: int = 50, rate: float = 0.2, momentum: float = 0.9,
    patience: int = 5, delta: float = 0.0, tasks: tuple[Task, ...] = TASKS,
) -> DataFrame:
    """The log of a run under `path`, with what metrics.early_stop says of each round; goes on behind the last round that is done there.

    windows and validation are rows of samples.samples with that flank. The run
    ends after `rounds`, or once `patience` rounds in a row have not bettered the
    best macro F1 by more than delta. A round is done when it is in the log,
    which is written last. Call it with the same parameters again to resume.
    """
    if reach > flank:
        raise ValueError("the context reaches beyond the flank")
    spark = windows.sparkSession
    while True:
        done = metrics.early_stop(log(spark, path), patience, delta, epoch="round", score="macro_f1").withColumnRenamed("epoch", "round")
        last = done.orderBy(F.desc("round")).first()
        number = last["round"] + 1 if last else 0
        if number >= rounds or last and last["stopped"]:
            return log(spark, path).join(done.drop("score"), "round")
        if number:
            model, velocity = load(spark, path, number - 1, reach, tasks)
        else:
            model = ContextClassifier(np.zeros((ContextClassifier.features(reach), sum(t.classes for t in tasks))), reach, tasks)
            velocity = np.zeros_like(model.weights)
        gradient, loss, n = gradient_sums(windows, model, flank)
        velocity = momentum * velocity - rate * gradient / max(n, 1)
        model = ContextClassifier(model.weights + velocity, reach, tasks)
        rows = [(i, k, float(model.weights[i, k]), float(velocity[i, k])) for i in range(velocity.shape[0]) for k in range(velocity.shape[1])]
        spark.createDataFrame(rows, _WEIGHTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/weights/round={number}")
        counts = confusions(validation, model, flank).persist()
        score = metrics.checkpoint_metric([counts.where(F.col("task") == k) for k in range(len(tasks))]).first()["macro_f1"]
        counts.unpersist()
        spark.createDataFrame([(number, loss / max(n, 1), score)], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")
