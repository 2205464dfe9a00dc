"""Candidate regions: bins of genic probability, runs of bins over a threshold.

Bins are small and fixed, so a track is cut down by their size before anything
is ordered, and runs of bins are found block by block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import blocks

BIN = 50


def bins(track: DataFrame, keys: list[str], genic: str = "genic", most: float = 0.5) -> DataFrame:
    """Per bin of BIN positions: its mean genic probability and how many positions are above `most`; one aggregation with partial sums."""
    return track.groupBy(*keys, F.expr(f"pos div {BIN}").alias("bin")).agg(F.avg(genic).alias("mean"), F.count_if(F.col(genic) > most).alias("n_high"))


def bins_of_chunks(chunks: DataFrame, keys: list[str], most: float = 0.5) -> DataFrame:
    """bins, of a track in chunks (start, genic array) that begin at multiples of BIN and, but for a contig's last, end at one.

    The chunk is cut where it is; no position becomes a row.
    """
    cut = F.expr(f"sequence(0, size(genic) - 1, {BIN})")
    rows = chunks.where("size(genic) > 0").select(*keys, "start", "genic", F.explode(cut).alias("at"))
    part = F.slice("genic", F.col("at") + 1, BIN)
    mean = F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part)
    return rows.select(*keys, F.expr(f"(start + at) div {BIN}").alias("bin"), mean.alias("mean"), F.size(F.filter(part, lambda x: x > most)).cast("long").alias("n_high"))


def candidate_regions(binned: DataFrame, lengths: DataFrame, keys: list[str], average: float = 0.1, size: int = blocks.BLOCK) -> DataFrame:
    """(keys, region_start, region_end, is_open): runs of bins with a mean of `average` or more.

    A run that a bin below the average ends takes that bin in, and needs a
    position above the maximum in it. binned is read three times. A run that reaches the contig's end is
    open; it ends there and needs none. `lengths` has keys and length.
    """
    last = binned.groupBy(*keys).agg(F.max("bin").alias("last_bin"))
    good = blocks.runs(binned.where(F.col("mean") >= average), keys, "bin", {"high": F.sum("n_high")}, size)
    behind = binned.select(*keys, (F.col("bin") - 1).alias("end"), F.col("n_high").alias("closing"))
    runs = good.join(behind, [*keys, "end"], "left").join(last, keys).select(*keys, F.col("start").alias("first"), F.col("end").alias("last"), "high", F.coalesce("closing", F.lit(0)).alias("closing"), "last_bin")
    runs = runs.withColumn("is_open", F.col("last") == F.col("last_bin")).where("is_open or high + closing >= 1")
    end = F.when(F.col("is_open"), F.col("length")).otherwise(F.least((F.col("last") + 2) * BIN, F.col("length")))
    return runs.join(lengths.select(*keys, "length"), keys).select(*keys, (F.col("first") * BIN).alias("region_start"), end.cast("long").alias("region_end"), "is_open")
