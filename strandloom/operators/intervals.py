"""Joins of points and intervals with intervals of any length, as equi-joins on nested cells.

Cells of LEVELS sizes nest, each SPREAD times the one below. An interval is cut
into the fewest cells that cover it: its ends into small ones, its inside into
large ones, so a span of a whole chromosome is at most some 2 * SPREAD cells a
level. A point is in one cell of each level, and in exactly one of an interval's
cells, so pairs meet once and nothing is found twice. Pairs of intervals meet in
cells of about their own size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of the smallest cells, and how many of one level make a cell of the next; the largest holds 2**34 positions.
SMALLEST, SPREAD, LEVELS = 1 << 10, 16, 7
#: The highest level that a pair of intervals meets at, its cells of 2**58 positions; and up to how many intervals of a level are broadcast.
TOP, FEW = 12, 1000


def cells(start: Column, end: Column) -> Column:
    """An array of (level, cell): the fewest cells that cover a half-open interval; none for one without positions."""
    low, high = F.floor(start / SMALLEST).cast("long"), F.floor((end - 1) / SMALLEST).cast("long")
    parts, more = [], end > start

    def at(level: int, a: Column, b: Column, when: Column) -> Column:
        none = F.array().cast("array<struct<level:int,cell:bigint>>")
        return F.when(when & (a <= b), F.transform(F.sequence(a, F.greatest(a, b)), lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell")))).otherwise(none)

    for level in range(LEVELS):
        inner, outer = F.ceil(low / SPREAD).cast("long"), (F.floor((high + 1) / SPREAD) - 1).cast("long")
        climbs = more & (inner <= outer) if level < LEVELS - 1 else F.lit(False)
        parts += [at(level, low, high, more & ~climbs), at(level, low, inner * SPREAD - 1, climbs), at(level, (outer + 1) * SPREAD, high, climbs)]
        low, high, more = inner, outer, climbs
    return F.concat(*parts)


def _cells_of_point(at: Column) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("level"), F.floor(at / (SMALLEST * SPREAD**k)).cast("long").alias("cell")) for k in range(LEVELS)))


def containing(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str = "start", end: str = "end") -> DataFrame:
    """points with the columns of each half-open interval of the same keys that they lie in. Apart from the keys no name is in both."""
    asks = points.withColumn("__c", F.explode(_cells_of_point(F.col(at)))).select("*", "__c.*").drop("__c")
    held = intervals.withColumn("__c", F.explode(cells(F.col(start), F.col(end)))).select("*", "__c.*").drop("__c")
    return asks.join(held, [*keys, "level", "cell"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("level", "cell")


def _level(length: Column) -> Column:
    """The level of an interval's own cells: the first at which it meets at most SPREAD + 1 of them."""
    return sum((F.when(length > SMALLEST * SPREAD ** (k + 1), 1).otherwise(0) for k in range(TOP)), start=F.lit(0))


def _first_cell(at: Column, level: str) -> Column:
    bits, more = SMALLEST.bit_length() - 1, SPREAD.bit_length() - 1
    return F.call_function("shiftright", at.cast("long"), F.lit(bits) + F.lit(more) * F.col(level))


def placed(rows: DataFrame, ends: tuple[str, str], own: str, others: list[int]) -> DataFrame:
    """rows once for each cell (__level, __cell) that they meet, of their `own` level and of those of the others above it."""
    levels = F.array(F.col(own), *(F.when(F.col(own) < k, F.lit(k)) for k in others))
    each = rows.withColumn("__level", F.explode(levels)).where("__level is not null")
    return each.withColumn("__cell", F.explode(F.sequence(_first_cell(F.col(ends[0]), "__level"), _first_cell(F.col(ends[1]) - 1, "__level"))))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_ends: tuple[str, str] = ("start", "end"), right_ends: tuple[str, str] = ("low", "high")) -> DataFrame:
    """The pairs of half-open intervals of the same keys that share a position, each once. Apart from the keys no name is in both; keep both sides narrow.

    An interval has some SPREAD cells of a level of its own, by its length. A pair
    meets at the higher of its two levels, in the cell where its shared positions
    begin, so an interval is placed at its own level and at those above it that
    the other side has. Both sides are read for their levels first: pass tables.
    Of the right side, levels of at most FEW intervals are broadcast.
    """
    (a, b), (c, d) = left_ends, right_ends
    columns = [*left.columns, *(x for x in right.columns if x not in keys)]
    left = left.where(F.col(b) > F.col(a)).withColumn("__left", _level(F.col(b) - F.col(a)))
    right = right.where(F.col(d) > F.col(c)).withColumn("__right", _level(F.col(d) - F.col(c)))
    left_levels = sorted(r["__left"] for r in left.select("__left").distinct().collect())
    counts = {r["__right"]: r["count"] for r in right.groupBy("__right").count().collect()}
    few = sorted(k for k, n in counts.items() if n <= FEW)
    many = sorted(set(counts) - set(few))
    begin = F.greatest(a, c)
    out = None
    for levels, small in ((many, False), (few, True)):
        if out is not None and not levels:
            continue
        held = placed(right.where(F.col("__right").isin(levels)), right_ends, "__right", left_levels)
        asks = placed(left, left_ends, "__left", levels)
        # Cells come first, as rows sort slowly by a few keys.
        pairs = asks.join(F.broadcast(held) if small else held, ["__cell", "__level", *keys])
        once = (F.col("__level") == F.greatest("__left", "__right")) & (F.col("__cell") == _first_cell(begin, "__level"))
        pairs = pairs.where(once & (F.col(a) < F.col(d)) & (F.col(c) < F.col(b))).select(columns)
        out = pairs if out is None else out.unionByName(pairs)
    return out
