"""FASTA in pieces: files read by byte ranges, contigs of any length as rows of a fixed size.

A reader of Spark's Python data source API deals a file out in ranges of bytes.
Bases may be cut anywhere, so a range needs to know one thing about what is
before it: whether it begins within a header line, which the range with that
line's beginning reads to its end. A range's rows are its records' bases with
their place in the record as far as the range knows it. One narrow row a range
(names and lengths at its ends) then gives each record's first range and the
bases before, and rows are cut and joined to pieces.

Paths are what pyarrow's file systems open, on every executor; read_fasta reads
by Spark alone, but a record as one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from strandloom.functions.sequence import PADDING, upper
from strandloom.session import stored
from strandloom.sources.fasta import EXTENSIONS

#: A piece holds 32 windows of the annotation plan.
RANGE, PIECE = 16 << 20, 32 * 30720
#: Files of a folder that are read; Spark's text writer names its own .txt.
READ = (*EXTENSIONS, ".txt")
#: Bytes of a header line; a longer one is an error.
HEADER = 1 << 16
#: Ranges of which all tasks get the narrow row; more are joined by key.
BROADCAST_ROWS = 50_000

_SCHEMA = "file string, range long, segment int, seq_id string, at long, seq binary"
_ARROW = pa.schema([("file", pa.string()), ("range", pa.int64()), ("segment", pa.int32()), ("seq_id", pa.string()), ("at", pa.int64()), ("seq", pa.binary())])
_BLANKS = b" \t\r\n\v\f"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class ByteRange(InputPartition):
    def __init__(self, file: str, start: int, end: int) -> None:
        self.file, self.start, self.end = file, start, end


def segments(read, size: int, start: int, end: int) -> Iterator[tuple[str | None, bytes]]:
    """(identifier, bases) of the records in bytes start to end; the first goes on from before and has none.

    read(at, n) gives bytes of the file, which has `size`.
    """
    begin, before = start, read(max(0, start - HEADER), min(start, HEADER))
    line = before.rfind(b"\n") + 1
    if start and before[line : line + 1] == b">" and (line or start <= HEADER):
        begin = _line_end(read, size, start, start - (len(before) - line))
    at_line = start == 0 or before[-1:] == b"\n" or begin > start
    name, parts, at = None, [], begin
    while at < end:
        block = read(at, min(RANGE, end - at))
        place = 0
        while True:
            found = 0 if at_line and place == 0 and block[:1] == b">" else block.find(b"\n>", place) + 1 or -1
            if found < 0:
                parts.append(block[place:].translate(None, _BLANKS))
                at, at_line = at + len(block), block[-1:] == b"\n"
                break
            parts.append(block[place:found].translate(None, _BLANKS))
            yield name, b"".join(parts)
            close = _line_end(read, size, at + found, at + found)
            header = read(at + found + 1, close - at - found - 1).decode("utf-8", "replace")
            name, parts = (header.split() or [""])[0] if header[:1].strip() else "", []
            if close >= at + len(block):
                at, at_line = close, True
                break
            # The line feed before a header on the next line is still to be found.
            place = close - at - 1
    yield name, b"".join(parts)


def _line_end(read, size: int, at: int, line: int) -> int:
    """The place behind the line that `at` is in; the line began at `line`."""
    rest = read(at, min(HEADER, size - at))
    found = rest.find(b"\n")
    if found < 0 and at + len(rest) < size or (found if found >= 0 else len(rest)) + at - line > HEADER:
        raise ValueError(f"a header line of over {HEADER} bytes")
    return at + found + 1 if found >= 0 else size


class RangeReader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[ByteRange]:
        system, path = _opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else sorted(system.get_file_info(fs.FileSelector(path, recursive=True)), key=lambda f: f.path)
        files = [f for f in files if f.type == fs.FileType.File and f.path.lower().endswith(READ)]
        if not files:
            raise ValueError(f"{self.path}: no file that ends in {', '.join(READ)}")
        scheme = self.path.split("://")[0] + "://" if "://" in self.path and not self.path.startswith("file:") else ""
        return [ByteRange(scheme + f.path, at, min(at + self.size, f.size)) for f in files for at in range(0, f.size, self.size)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        system, path = _opened(partition.file)
        with system.open_input_file(path) as file:
            for number, (name, bases) in enumerate(segments(lambda at, n: file.read_at(n, at), file.size(), partition.start, partition.end)):
                # A record without bases still says that it begins here.
                for at in range(0, max(len(bases), 1), PIECE):
                    row = [[partition.file], [partition.start], [number], [name], [at], [bases[at : at + PIECE]]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _ARROW, strict=True)], schema=_ARROW)


class FastaRanges(DataSource):
    """spark.read.format("fasta_ranges").option("range", bytes).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "fasta_ranges"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> RangeReader:
        return RangeReader(self.options["path"], int(self.options.get("range", RANGE)))


def read_pieces(spark: SparkSession, path: str, size: int = PIECE, byte_range: int = RANGE) -> DataFrame:
    """(seq_id, seq_ord, length, start, seq): contigs in pieces of `size` bases, the last one shorter; seq is binary, case kept.

    A record begins at a line that begins with '>'; its identifier is the header
    up to the first white space. seq_ord is its place in the input, files by
    name. Records without an identifier or without bases have no pieces. A
    repeated identifier is an error.
    """
    spark.dataSource.register(FastaRanges)
    rows = stored(spark.read.format("fasta_ranges").option("range", byte_range).load(path), wide=True)
    n = F.octet_length("seq").cast("long")
    each = rows.groupBy("file", "range", "segment", "seq_id").agg(F.sum(n).alias("n"))
    by_range = each.groupBy("file", "range").agg(F.max("segment").alias("headers"), F.max_by("seq_id", "segment").alias("name"), F.max_by("n", "segment").alias("tail"))
    in_file, in_all = W.partitionBy("file").orderBy("range"), W.orderBy("file", "range")
    begun = by_range.withColumns({
        "record": F.sum(F.when(F.col("headers") > 0, 1).otherwise(0)).over(in_file), "first_ord": F.sum("headers").over(in_all) - F.col("headers"),
    })
    so_far = begun.withColumn("so_far", F.sum("tail").over(W.partitionBy("file", "record").orderBy("range")))
    known = so_far.select("file", "range", "first_ord", F.last("name", ignorenulls=True).over(in_file.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.coalesce(F.lag("so_far").over(in_file), F.lit(0)).alias("done"))
    known = stored(known)
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    lead = F.col("segment") == 0
    placed = rows.join(known, ["file", "range"]).select(
        F.when(lead, F.col("before")).otherwise(F.col("seq_id")).alias("seq_id"), (F.col("first_ord") + F.col("segment") - 1).cast("int").alias("seq_ord"),
        (F.col("at") + F.when(lead, F.col("done")).otherwise(0)).alias("from"), "seq", n.alias("n"), "segment",
    ).where("seq_id <> ''")
    names = placed.groupBy("seq_ord", "seq_id").agg(F.sum("n").alias("length"), F.max("segment").alias("begins"))
    again = names.groupBy("seq_id").agg(F.count("*").alias("times")).where("times > 1").select("seq_id", F.lit(True).alias("again"))
    repeated = F.raise_error(F.concat(F.lit("repeated sequence identifier "), F.col("seq_id"))).cast("bigint")
    lengths = names.join(again, "seq_id", "left").select("seq_ord", F.when(F.col("again"), repeated).otherwise(F.col("length")).alias("length"))
    cut = placed.where("n > 0").withColumn("piece", F.explode(F.expr(f"sequence(`from` div {size}, (`from` + n - 1) div {size})")))
    low = F.greatest(F.col("from"), F.col("piece") * size)
    high = F.least(F.col("from") + F.col("n"), (F.col("piece") + 1) * size)
    part = F.struct(low.alias("low"), F.substring(F.col("seq"), (low - F.col("from") + 1).cast("int"), (high - low).cast("int")).alias("seq"))
    pieces = cut.select("seq_id", "seq_ord", "piece", part.alias("part")).groupBy("seq_id", "seq_ord", "piece").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    whole = F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["seq"]))
    return pieces.join(lengths, "seq_ord").select("seq_id", "seq_ord", "length", (F.col("piece") * size).alias("start"), whole.alias("seq"))


def windows_of_pieces(pieces: DataFrame, window: int, flank: int, size: int = PIECE) -> DataFrame:
    """tiling.windows of contigs in pieces of `size` bases, a multiple of the window; each piece gets its neighbours' bases within the flank.

    A window belongs to the piece in which it begins, so it needs at most
    `flank` bases of the pieces on either side.
    """
    if size % window or flank > size:
        raise ValueError("pieces hold whole windows, and a flank is no longer than a piece")
    key = ["seq_ord", "start"]
    n = F.octet_length("seq")
    behind = pieces.select("seq_ord", (F.col("start") - size).alias("start"), F.substring("seq", 1, flank).alias("right"))
    ahead = pieces.select("seq_ord", (F.col("start") + size).alias("start"), F.substring(F.col("seq"), F.greatest(n - flank, F.lit(0)) + 1, F.lit(flank)).alias("left"))
    rows = pieces.join(ahead, key, "left").join(behind, key, "left")
    none = F.lit(b"")
    left, right = F.coalesce("left", none), F.coalesce("right", none)
    rows = rows.select("seq_id", "length", F.col("start").alias("piece"), n.alias("n"), F.concat(left, F.col("seq"), right).alias("seq"), F.octet_length(left).alias("skip"), F.octet_length(right).alias("more"))
    rows = rows.withColumn("at", F.explode(F.expr(f"sequence(0, n - 1, {window})")))
    low, high = F.greatest(F.col("at") - flank, -F.col("skip")), F.least(F.col("at") + window + flank, F.col("n") + F.col("more"))
    core = F.substring(F.col("seq"), low + F.col("skip") + 1, high - low).cast("string")
    pad_left, pad_right = F.repeat(F.lit(PADDING), low - F.col("at") + flank), F.repeat(F.lit(PADDING), F.col("at") + window + flank - high)
    start = F.col("piece") + F.col("at")
    return rows.select("seq_id", "length", F.expr(f"(piece + at) div {window}").cast("int").alias("win_idx"), start.alias("start"), upper(F.concat(pad_left, core, pad_right)).alias("seq"))
