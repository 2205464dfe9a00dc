"""What several corpus operators share: words, word hashes, checkpoints, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in BLANKS]] = True
#: Bytes hashed in one go; a worker keeps tables of twice as many powers.
_SEGMENT = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODES[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]
_POWERS: dict[str, np.ndarray] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    On a cluster that setting must name a folder all executors share. Only a
    local session without it gets a temporary folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandloom-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, kept in the shared folder; lost executors cost no work done before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    blank = F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.filter(F.split(blank, " +"), lambda w: w != "")


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers (the splitmix64 finaliser)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, _SEGMENT * 2)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


class Words:
    """The words of a batch of texts as byte ranges and 64-bit hashes.

    A-Z count as a-z in the hashes. `start` and `end` are byte offsets into
    `data`; `first[i]:first[i + 1]` are the words of text i. A null has none.
    """

    def __init__(self, texts: pa.Array) -> None:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        n = len(texts)
        self.at = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        low, high = int(self.at[0]), int(self.at[-1])
        self.at = self.at - low
        self.data = np.frombuffer(data, np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8)
        inside = ~_BLANK[self.data]
        before = np.empty(len(inside), bool)
        before[:1], before[1:] = False, inside[:-1]
        edge = self.at[1:-1]
        edge = edge[edge < len(inside)]
        before[edge] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(len(inside), bool)
        after[-1:], after[:-1] = False, inside[1:]
        after[edge[edge > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.at)
        self.hash = self.hashes(self.start, self.end)

    def __len__(self) -> int:
        return len(self.at) - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of non-empty byte ranges, given in order."""
        out, k = np.empty(len(starts), np.uint64), 0
        while k < len(starts):
            stop = max(k + 1, int(np.searchsorted(ends, starts[k] + _SEGMENT, "right")))
            low, high = starts[k], ends[stop - 1]
            up, down = _powers(int(high - low) + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_CODES[self.data[low:high]] * up[: high - low], out=sums[1:])
            a, b = starts[k:stop] - low, ends[k:stop] - low
            out[k:stop] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _M2)
            k = stop
        return out

    def of(self, i: int) -> np.ndarray:
        return self.hash[self.first[i] : self.first[i + 1]]


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of text, so that arrays stay small."""
    if batch.num_rows == 0:
        return
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        base = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (a, b) reaches.

    Alternating large-star and small-star rounds: each keeps the components and
    brings every node nearer to the smallest. A round is one aggregation with
    map-side combine and one join that adaptive execution can split, so a hub
    with a third of all nodes makes no large task. Self links and repeats are
    harmless; no edges give no rows.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = checkpointed(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
