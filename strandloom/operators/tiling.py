"""Windows over contigs: tiles with flanks, their reverse strand, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import PADDING, reverse_complement, upper


def windows(genome: DataFrame, window: int, flank: int) -> DataFrame:
    """(seq_id, length, win_idx, start, seq): tiles of `window` bases, `flank` more on either side, padded at the ends.

    The sequence may be text or binary. Cutting a long contig out of binary is
    linear in its length, out of text quadratic. Contigs without bases have no windows.
    """
    size = F.octet_length("seq") if dict(genome.dtypes)["seq"] == "binary" else F.length("seq")
    rows = genome.withColumn("length", size.cast("long")).where("length > 0")
    rows = rows.select("seq_id", "length", "seq", F.posexplode(F.expr(f"sequence(0L, length - 1, {window}L)")).alias("win_idx", "start"))
    low, high = F.greatest(F.col("start") - flank, F.lit(0)), F.least(F.col("start") + window + flank, F.col("length"))
    core = F.substring(F.col("seq"), (low + 1).cast("int"), (high - low).cast("int")).cast("string")
    left = F.repeat(F.lit(PADDING), F.greatest(F.lit(flank) - F.col("start"), F.lit(0)).cast("int"))
    right = F.repeat(F.lit(PADDING), F.greatest(F.col("start") + window + flank - F.col("length"), F.lit(0)).cast("int"))
    return rows.select("seq_id", "length", "win_idx", "start", upper(F.concat(left, core, right)).alias("seq"))


def n_windows(length: Column, window: int) -> Column:
    return F.ceil(length / window).cast("int")


def both_strands(tiles: DataFrame, window: int) -> DataFrame:
    """The tiles as strand 1, and reverse-complemented in reverse order as strand -1."""
    turned = (n_windows(F.col("length"), window) - 1 - F.col("win_idx")).cast("int")
    back = F.col("strand") == -1
    both = tiles.withColumn("strand", F.explode(F.array(F.lit(1).cast("byte"), F.lit(-1).cast("byte"))))
    return both.withColumns({"win_idx": F.when(back, turned).otherwise(F.col("win_idx")), "seq": F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))})


def kept_range(window: int) -> tuple[Column, Column]:
    """Of a scored window on its strand, the first and last strand-local position that the contig has.

    The padding after the last base stands at the front of the reverse strand.
    """
    extra = n_windows(F.col("length"), window) * window - F.col("length")
    shift = F.when(F.col("strand") == -1, extra).otherwise(F.lit(0))
    low = F.col("win_idx") * window - shift
    return F.greatest(low, F.lit(0)).cast("long"), (F.least(low + window, F.col("length")) - 1).cast("long")
