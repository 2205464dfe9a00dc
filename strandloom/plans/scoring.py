"""Scorers: whatever gives five class probabilities per base of a window."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.tiling import kept_range
from strandloom.operators.tracks import PACKED, pack


class Scorer(Protocol):
    """Given windows of equal length, flanks included, the probabilities (windows, bases, 5)."""

    def score(self, windows: list[str]) -> np.ndarray: ...


class TrackScorer(Protocol):
    """Given windows as a Scorer gets them, the older model's tracks: four classes, the chances to stay and to change behind a base, and places in a codon."""

    def score(self, windows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]: ...


class CompositionTracks:
    """A deterministic stand-in for the older model: CompositionScorer's classes, half of what is intergenic near a gene as untranslated, changes where classes do."""

    def __init__(self, reach: int = 45) -> None:
        self.inner = CompositionScorer(reach)

    def score(self, windows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = self.inner.score(windows)
        beside = np.minimum(p[:, :, 0], 1 - p[:, :, 0])
        classes = np.stack([p[:, :, 0] - beside / 2, beside / 2, p[:, :, 1:4].sum(2), p[:, :, 4]], 2)
        turn = np.minimum(np.abs(np.diff(p[:, :, 0], axis=1, append=p[:, -1:, 0])) + beside / 10 + 0.01, 0.5)
        places = np.concatenate([p[:, :, 1:4], p[:, :, :1] + p[:, :, 4:]], 2)
        return classes, np.stack([1 - turn, turn], 2), places


class CompositionScorer:
    """A deterministic scorer for tests and benches: bases in GC-rich stretches are coding, with phases by turns of three."""

    def __init__(self, reach: int = 45) -> None:
        self.reach = reach

    def score(self, windows: list[str]) -> np.ndarray:
        data = np.frombuffer("".join(windows).encode(), np.uint8).reshape(len(windows), -1)
        rich = np.pad(((data == ord("G")) | (data == ord("C"))).astype(float), ((0, 0), (self.reach, self.reach)), mode="edge")
        sums = np.cumsum(np.pad(rich, ((0, 0), (1, 0))), 1)
        share = (sums[:, 2 * self.reach + 1 :] - sums[:, : -2 * self.reach - 1]) / (2 * self.reach + 1)
        genic = 1 / (1 + np.exp(-30 * (share - 0.38)))
        out = np.empty((*data.shape, 5))
        place = np.arange(data.shape[1]) % 3
        out[:, :, 0] = 1 - genic
        for k, c in enumerate((1, 3, 2)):
            out[:, :, c] = genic * np.where(place == k, 0.8, 0.05)
        out[:, :, 4] = genic * 0.1
        return out


class DenseScorer:
    """A one-hidden-layer network over one-hot context, for weights given as arrays; padding is all zeros."""

    def __init__(self, hidden: np.ndarray, bias: np.ndarray, out: np.ndarray, out_bias: np.ndarray) -> None:
        self.hidden, self.bias, self.out, self.out_bias = hidden, bias, out, out_bias

    def score(self, windows: list[str]) -> np.ndarray:
        table = np.zeros((256, 4))
        table[[ord(c) for c in "NMWRYKBSDHV"]] = 0.25
        table[[ord(c) for c in "ACGT"]] = np.eye(4)
        x = table[np.frombuffer("".join(windows).encode(), np.uint8)].reshape(len(windows), -1, 4)
        reach = self.hidden.shape[0] // 8
        padded = np.pad(x, ((0, 0), (reach, reach), (0, 0)))
        context = np.concatenate([padded[:, k : k + x.shape[1]] for k in range(2 * reach + 1)], 2)
        logits = np.maximum(context @ self.hidden[: context.shape[2]] + self.bias, 0) @ self.out + self.out_bias
        powers = np.exp(logits - logits.max(2, keepdims=True))
        return powers / powers.sum(2, keepdims=True)


def _nested(values: list[np.ndarray]) -> pa.Array:
    """Matrices as a list of lists each."""
    flat, width = np.concatenate([v.ravel() for v in values]), values[0].shape[1]
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(v) for v in values)], dtype=np.int32)), inner)


def scored(tiles: DataFrame, scorer: Scorer | TrackScorer, window: int, flank: int, batch: int = 32, tracks: tuple[str, ...] = ("probs",), cells: bool = False) -> DataFrame:
    """(seq_id, strand, length, start, seq, tracks): the contig's own bases of each window on its strand, flanks and padding cut off.

    A scorer of several tracks gives an array for each; with `cells`, all of a row are one cell of operators.tracks.
    """
    low, high = kept_range(window)
    extra = F.ceil(F.col("length") / window) * window - F.col("length")
    skip = F.when((F.col("strand") == -1) & (F.col("win_idx") == 0), extra).otherwise(0)
    rows = tiles.select("seq_id", "strand", "length", low.alias("start"), (high - low + 1).alias("n"), (skip + flank).cast("long").alias("skip"), "seq")
    kept, names = ("seq_id", "strand", "length", "start"), (PACKED,) if cells else tracks

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                seqs = part.column("seq").to_pylist()
                found = scorer.score(seqs)
                found = [p.astype(np.float32) for p in (found if isinstance(found, tuple) else (found,))]
                cut = [(int(s), int(s) + int(n)) for s, n in zip(part.column("skip").to_pylist(), part.column("n").to_pylist(), strict=True)]
                if cells:
                    columns = [pa.array([pack([p[i, a:b] for p in found]) for i, (a, b) in enumerate(cut)], pa.binary())]
                else:
                    columns = [_nested([p[i, a:b] for i, (a, b) in enumerate(cut)]) for p in found]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array([s[a:b] for s, (a, b) in zip(seqs, cut, strict=True)]), *columns], names=[*kept, "seq", *names])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(work, f"seq_id {kinds['seq_id']}, strand tinyint, length long, start long, seq string, " + ", ".join(f"{t} {'binary' if cells else 'array<array<float>>'}" for t in names))
