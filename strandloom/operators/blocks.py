"""Ordered work over long series without a task for a whole key: blocks of positions, and what they have to tell each other.

A window over a key puts all its positions into one task. Here windows see a
block of positions of a key at most; between blocks goes one narrow row, or two,
a block: a total to start from, the first or last row for a look beyond the
edge, a run that touches an edge. Those rows are put in order in blocks of
blocks, and what is left of them by key, so that no window holds more than some
2 * BLOCK rows for keys of up to BLOCK**3 positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BLOCK = 1 << 16


def block_of(pos: str | Column, size: int) -> Column:
    """The block that a position is in; negative positions are in negative ones."""
    at = F.col(pos) if isinstance(pos, str) else pos
    return F.call_function("div", at - F.pmod(at, F.lit(size)), F.lit(size).cast("long"))


def _edge(start: str, end: str, size: int) -> Column:
    return (F.pmod(F.col(start), F.lit(size)) == 0) | (F.pmod(F.col(end) + 1, F.lit(size)) == 0)


def _joined(runs: DataFrame, within: list[str], keys: list[str], sums: list[str]) -> DataFrame:
    """runs (keys, start, end, sums) of which touching ones are one, as far as a window over `within` sees."""
    order = W.partitionBy(*within).orderBy("start")
    new = F.when(F.lag("end").over(order) + 1 == F.col("start"), 0).otherwise(1)
    numbered = runs.withColumn("__new", new).withColumn("__run", F.sum("__new").over(order))
    totals = [F.sum(c).alias(c) for c in sums]
    return numbered.groupBy(*within, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), *totals).select(*keys, "start", "end", *sums)


def joined_at_edges(local: DataFrame, keys: list[str], sums: list[str], size: int) -> DataFrame:
    """Runs (keys, start, end, sums) found block by block, with those that touch at the blocks' edges as one."""
    keys_and_sums = [*keys, "start", "end", *sums]
    local = local.select(*keys_and_sums)
    inside, edge = local.where(~_edge("start", "end", size)), local.where(_edge("start", "end", size))
    wider = size * size
    grouped = _joined(edge.withColumn("__wide", block_of("start", wider)), [*keys, "__wide"], keys, sums)
    last = _joined(grouped.where(_edge("start", "end", wider)), keys, keys, sums)
    return inside.unionByName(grouped.where(~_edge("start", "end", wider))).unionByName(last)


def runs(series: DataFrame, keys: list[str], pos: str = "pos", sums: dict[str, Column] | None = None, size: int = BLOCK) -> DataFrame:
    """(keys, start, end, n, sums): maximal runs of adjacent positions of a key, ends inclusive; a position is there once."""
    sums = {"n": F.count("*")} | (sums or {})
    rows = series.withColumn("__block", block_of(pos, size))
    island = F.col(pos) - F.row_number().over(W.partitionBy(*keys, "__block").orderBy(pos))
    local = rows.withColumn("__island", island).groupBy(*keys, "__block", "__island").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), *(c.alias(k) for k, c in sums.items()))
    return joined_at_edges(local, keys, list(sums), size)


def with_run_start(series: DataFrame, keys: list[str], name: str, pos: str = "pos", size: int = BLOCK) -> DataFrame:
    """series with the first position of the run of adjacent positions that a position is in."""
    rows = series.withColumn("__block", block_of(pos, size))
    own = W.partitionBy(*keys, "__block")
    rows = rows.withColumn("__island", F.col(pos) - F.row_number().over(own.orderBy(pos)))
    rows = rows.withColumn("__start", F.min(pos).over(W.partitionBy(*keys, "__block", "__island")))
    # A run that begins at its block's edge may go on from the block before.
    begun = rows.where(F.pmod(F.col("__start"), F.lit(size)) == 0).select(*keys, "__start").distinct()
    whole = runs(series, keys, pos, size=size).where(block_of("end", size) > block_of("start", size))
    blocks = whole.select(*keys, F.col("start").alias("__first"), F.explode(F.sequence(block_of("start", size) + 1, block_of("end", size))).alias("__at"))
    blocks = blocks.select(*keys, "__first", (F.col("__at") * size).alias("__start"))
    on = [*keys, "__start"]
    return rows.join(begun.join(blocks, on), on, "left").withColumn(name, F.coalesce("__first", "__start")).drop("__block", "__island", "__start", "__first")


def _offsets(totals: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, __block, __before) of (keys, __block, __total): the sum of the totals of the blocks before."""
    wide = totals.withColumn("__wide", block_of("__block", size))
    far = wide.groupBy(*keys, "__wide").agg(F.sum("__total").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(W.partitionBy(*keys).orderBy("__wide").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    far = far.select(*keys, "__wide", before.alias("__far"))
    near = F.coalesce(F.sum("__total").over(W.partitionBy(*keys, "__wide").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return wide.withColumn("__near", near).join(far, [*keys, "__wide"]).select(*keys, "__block", (F.col("__far") + F.col("__near")).alias("__before"))


def running_sum(series: DataFrame, keys: list[str], value: str, name: str, pos: str = "pos", size: int = BLOCK) -> DataFrame:
    """series with the sum of a key's values up to and with a position. Null values add nothing; keys are not null."""
    rows = series.withColumn("__block", block_of(pos, size))
    totals = rows.groupBy(*keys, "__block").agg(F.coalesce(F.sum(value), F.lit(0)).alias("__total"))
    local = F.coalesce(F.sum(value).over(W.partitionBy(*keys, "__block").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    return rows.withColumn("__local", local).join(_offsets(totals, keys, size), [*keys, "__block"]).withColumn(name, F.col("__before") + F.col("__local")).drop("__block", "__local", "__before")


def with_next(series: DataFrame, keys: list[str], columns: dict[str, str], pos: str = "pos", size: int = BLOCK, back: bool = False) -> DataFrame:
    """series with columns (new name: column) of a key's next row by position, null for its last one; of the row before with `back`. Keys are not null."""
    rows = series.withColumn("__block", block_of(pos, size))
    look, first = (F.lag, F.max_by) if back else (F.lead, F.min_by)
    wanted = F.struct(*(F.col(c).alias(n) for n, c in columns.items()))
    local = rows.withColumn("__own", wanted).withColumn("__next", look("__own").over(W.partitionBy(*keys, "__block").orderBy(pos)))
    ends = rows.groupBy(*keys, "__block").agg(first(wanted, F.col(pos)).alias("__end"))
    # Blocks without rows are passed over, so the halo is what the next block that has some begins with.
    halo = ends.withColumn("__halo", look("__end").over(W.partitionBy(*keys).orderBy("__block"))).select(*keys, "__block", "__halo")
    out = local.join(halo, [*keys, "__block"]).withColumn("__next", F.coalesce("__next", "__halo"))
    return out.select(*series.columns, *(F.col("__next")[n].alias(n) for n in columns))
