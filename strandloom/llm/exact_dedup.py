"""Exact duplicates by a log-structured merge index of text digests.

Each task is a memtable: it folds its rows into one entry per digest and, when
full, flushes them as a run sorted by digest. Runs are files in the shared
folder. A level with more than FAN_IN runs is compacted: groups of FAN_IN runs
are merged into one run of the next level, and an entry keeps the smallest and
the largest identifier and the number of rows. Every run that is left has a
filter for each range of digests, sized by its entries. An entry of one row is
looked up in another run only if that run's filter may hold it, so entries
without a copy move no further. Entries of more than one row are hits, and
every hit is verified on the bytes of the texts: two texts with one digest but
different bytes stay apart.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import checkpointed, mix, shared_folder

#: Entries that a memtable holds before it flushes.
MEMTABLE_ROWS = 200_000
#: Runs that are merged into one; a level keeps no more.
FAN_IN = 16
#: Entries of a run in one range of digests, about.
RANGE_ENTRIES = 200_000
#: Filter bits for each entry, and probes.
BITS, PROBES = 10, 4
#: Most bits of the filter over hits, which goes to every task (32 MB).
#: With more hits than a tenth of that it lets more texts through, each once; results stay the same.
MOST_FILTER_BITS = 1 << 28
_PLACES = 1 << 32


def _sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _numbers(digests: list[bytes]) -> np.ndarray:
    """64 bits of each digest, short ones padded."""
    return np.frombuffer(b"".join((d + bytes(8))[:8] for d in digests), ">u8").astype(np.uint64)


class Filter:
    """A Bloom filter of at most `most` bits over `entries` digests, kept as 64-bit words."""

    def __init__(self, entries: int, most: int = MOST_FILTER_BITS, words: np.ndarray | None = None) -> None:
        bits = 1 << max(6, int(max(1, BITS * entries) - 1).bit_length())
        self.words = np.zeros(min(bits, most) // 64, np.uint64) if words is None else words

    def spots(self, digests: list[bytes]) -> np.ndarray:
        """A row of PROBES bit positions for each digest."""
        a = mix(_numbers(digests))
        b = mix(a) | np.uint64(1)
        return (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(len(self.words) * 64 - 1)

    def add(self, digests: list[bytes]) -> None:
        at = self.spots(digests).ravel()
        np.bitwise_or.at(self.words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))

    def may_hold(self, digests: list[bytes]) -> np.ndarray:
        at = self.spots(digests)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(1)


def _flusher(digest: Callable[[bytes], bytes], most: int) -> Callable:
    def flush(run: int, table: dict[bytes, list], kind: pa.DataType) -> pa.RecordBatch:
        keys = sorted(table)
        rows = [table[k] for k in keys]
        place = (_numbers(keys) >> np.uint64(32)).astype(np.int64)
        columns = [pa.array(np.full(len(keys), run)), pa.array(place), pa.array(keys, pa.binary()), *(pa.array([r[i] for r in rows], kind) for i in range(2)), pa.array([r[2] for r in rows], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["run", "place", "digest", "smallest", "largest", "n"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, list] = {}
        run = TaskContext.get().partitionId() << 20
        for batch in batches:
            kind = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                key = digest(b"" if (raw := text.as_buffer()) is None else raw.to_pybytes())
                entry = table.setdefault(key, [i, i, 0])
                entry[2] += 1
                if i is not None:
                    entry[0] = i if entry[0] is None else min(entry[0], i)
                    entry[1] = i if entry[1] is None else max(entry[1], i)
                if len(table) >= most:
                    yield flush(run, table, kind)
                    run, table = run + 1, {}
        if table:
            yield flush(run, table, kind)

    return runs


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def _merged() -> tuple[Column, ...]:
    return F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("n").alias("n")


class MergeIndex:
    """Runs of (digest, smallest, largest, n) in the shared folder, by level.

    Documents may be inserted in several lots; each lot's runs are new files,
    and a run once written never changes. `id_type` is the identifiers' type.
    """

    def __init__(self, spark: SparkSession, id_type: str, digest: Callable[[bytes], bytes] = _sha256, memtable: int = MEMTABLE_ROWS, fan_in: int = FAN_IN) -> None:
        self.spark, self.digest, self.memtable, self.fan_in = spark, digest, memtable, fan_in
        self.folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        self.fields = f"digest binary, smallest {id_type}, largest {id_type}, n long"
        #: Files of each level's runs.
        self.levels: list[list[str]] = [[]]

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Flush the rows of docs as runs of level 0."""
        runs = _texts(docs, id_col, text_col).mapInArrow(_flusher(self.digest, self.memtable), f"run long, place long, {self.fields}")
        path = f"{self.folder}/0-{uuid.uuid4().hex}"
        runs.write.parquet(path)
        self.levels[0].append(path)

    def runs(self, level: int) -> DataFrame:
        """The entries of a level, with their run; runs of different lots differ."""
        parts = [self.spark.read.schema(f"run long, place long, {self.fields}").parquet(p).withColumn("lot", F.lit(k)) for k, p in enumerate(self.levels[level])]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.withColumn("level", F.lit(level))

    def compact(self) -> None:
        """Merge runs until no level has more than fan_in of them."""
        level = 0
        while level < len(self.levels):
            if self.levels[level]:
                now = self.runs(level)
                many, entries = now.agg(F.countDistinct("lot", "run"), F.count("*")).first()
                if many > self.fan_in:
                    if level + 1 == len(self.levels):
                        self.levels.append([])
                    run = F.pmod(F.xxhash64("lot", "run"), F.lit(-(-many // self.fan_in)))
                    merged = now.withColumn("run", run).groupBy("run", "place", "digest").agg(*_merged())
                    parts = max(1, -(-entries // RANGE_ENTRIES))
                    path = f"{self.folder}/{level + 1}-{uuid.uuid4().hex}"
                    merged.repartition(parts, "run", _range(parts)).sortWithinPartitions("run", "digest").write.parquet(path)
                    self.levels[level + 1].append(path)
                    self.levels[level] = []
            level += 1

    def hits(self) -> DataFrame:
        """(digest, smallest, largest, n) of all digests that more than one row has."""
        self.compact()
        levels = [self.runs(k) for k, paths in enumerate(self.levels) if paths]
        if not levels:
            return self.spark.createDataFrame([], self.fields)
        now = levels[0]
        for more in levels[1:]:
            now = now.union(more)
        runs = now.groupBy("level", "lot", "run").agg(F.count("*").alias("n"))
        longest = runs.agg(F.max("n")).first()[0] or 1
        now = now.withColumn("range", _range(max(1, -(-longest // RANGE_ENTRIES)))).withColumn("run", F.xxhash64("level", "lot", "run")).drop("level", "lot", "place")
        filters = now.groupBy("range", "run").applyInArrow(_filter_of, "range long, run long, bits binary")
        # A range of a run meets the filters that the other runs have for that range: at most fan_in a level.
        others = filters.select("range", F.col("run").alias("other"), "bits")
        asked = filters.select("range", "run").join(others, "range").where("run <> other").select("range", "run", "bits")
        seen = now.groupBy("range", "run").cogroup(asked.groupBy("range", "run")).applyInArrow(_candidates, self.fields)
        return seen.groupBy("digest").agg(*_merged()).where("n > 1")


def _range(many: int) -> Column:
    return F.expr(f"place * {many}L div {_PLACES}L").alias("range")


def _filter_of(key: tuple, entries: pa.Table) -> pa.Table:
    one = Filter(len(entries))
    one.add(entries.column("digest").to_pylist())
    return pa.table({"range": [key[0].as_py()], "run": [key[1].as_py()], "bits": pa.array([one.words.tobytes()], pa.binary())})


def _candidates(entries: pa.Table, filters: pa.Table) -> pa.Table:
    """The entries of several rows, and those that another run may hold."""
    keys = entries.column("digest").to_pylist()
    take = entries.column("n").to_numpy() > 1
    for bits in filters.column("bits"):
        take = take | Filter(0, words=np.frombuffer(bits.as_buffer(), np.uint64)).may_hold(keys)
    return entries.select(["digest", "smallest", "largest", "n"]).filter(pa.array(take))


def _hit_filter(hits: DataFrame, most: int) -> Filter:
    """A filter of the digests with hits; its words come to the driver, never more than `most` bits."""
    out = Filter(hits.count(), most)

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(out.spots(batch.column(0).to_pylist())) if batch.num_rows else np.zeros(0, np.uint64)
            bit = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bit)], names=["at", "word"])

    parts = hits.select("digest").mapInArrow(spots, "at long, word long").groupBy("at").agg(F.expr("bit_or(word)").alias("word")).toPandas()
    out.words[parts["at"].to_numpy(np.int64)] = parts["word"].to_numpy(np.int64).view(np.uint64)
    return out


def groups(
    docs: DataFrame,
    keep: str = "smallest",
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[bytes], bytes] = _sha256,
    memtable: int = MEMTABLE_ROWS,
    fan_in: int = FAN_IN,
    most_filter_bits: int = MOST_FILTER_BITS,
) -> DataFrame:
    """One row per row of docs: its group of equal texts and the row that stays.

    Columns: id_col, keep_id, group_size (rows with the text), kept,
    text_sha256. `keep` is "smallest" or "largest" identifier; identifiers keep
    their type. A null text equals an empty one. Rows that repeat both
    identifier and text are returned each, count each, and are kept or not
    together. A null identifier stays only where its text has no other. A table
    without rows gives none. Other columns of docs are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    kind = docs.schema[id_col].dataType.simpleString()
    index = MergeIndex(docs.sparkSession, kind, digest, memtable, fan_in)
    index.insert(docs, id_col, text_col)
    merged = checkpointed(index.hits().select("digest", keep, "n"))
    sent = docs.sparkSession.sparkContext.broadcast(_hit_filter(merged, most_filter_bits))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            texts = [b"" if (raw := t.as_buffer()) is None else raw.to_pybytes() for t in batch.column(1)]
            keys = [digest(t) for t in texts]
            maybe = sent.value.may_hold(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(keys, pa.binary()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts] if digest is not _sha256 else [k.hex() for k in keys]),
                    pa.array(maybe),
                    pa.array([t if m else None for t, m in zip(texts, maybe, strict=True)], pa.binary()),
                ],
                names=["id", "digest", "sha", "maybe", "bytes"],
            )

    probed = _texts(docs, id_col, text_col).mapInArrow(probe, f"id {kind}, digest binary, sha string, maybe boolean, bytes binary")
    probed = checkpointed(probed)
    alone = probed.where("not maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    hits = probed.where("maybe")
    # Equal least and greatest bytes prove that all texts of a digest are the same.
    spans = hits.groupBy("digest").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b"))
    mixed = checkpointed(spans.where("a <> b").select("digest"))
    same = hits.drop("bytes").join(merged, "digest", "left")
    if mixed.isEmpty():
        shared = same
    else:
        apart = hits.join(mixed, "digest", "left_semi")
        split = apart.groupBy("digest", "bytes").agg(best("id").alias(keep), F.count("*").alias("n"))
        shared = same.join(mixed, "digest", "left_anti").unionByName(apart.join(split, ["digest", "bytes"]).drop("bytes"))
    shared = shared.select("id", F.coalesce(keep, "id").alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), "sha")
    return alone.union(shared).select(
        F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text another row that stays has; all columns as they were.

    Identifiers are taken to name one text each: a row goes if its identifier
    was dropped. Rows whose identifier is null stay.
    """
    gone = groups(docs, keep, id_col, text_col).where("not kept").select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
