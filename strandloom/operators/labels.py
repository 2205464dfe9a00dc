"""Training labels from annotations: transcripts, painting, weights, masks, transitions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from strandloom.operators import blocks
from strandloom.operators.intervals import containing

ACCEPTED = ("mRNA", "V_gene_segment", "C_gene_segment", "J_gene_segment", "D_gene_segment")
MASKED = ("pseudogene", "cDNA_match", "ncRNA_gene")
SHORT_INTRON = 30
PHASES = (0, 2, 1)


def longest_transcripts(transcripts: DataFrame, gene: str, length: Column, order: str) -> DataFrame:
    """One row per gene: the longest transcript, the first in file order of equals."""
    best = W.partitionBy(gene).orderBy(length.desc(), F.asc(order))
    return transcripts.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")


def accepted(genes: DataFrame, keys: list[str], start: str = "start", end: str = "end", order: str = "gene_no") -> DataFrame:
    """(keys, order, start, end, accepted): in file order, a gene is accepted unless it starts before the last accepted one ends.

    What is accepted depends on all genes before, so a strand's genes, some tens
    of thousands of three numbers, are one group.
    """
    rows = genes.select(*keys, *(F.col(c).cast("long").alias(c) for c in (order, start, end)))

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        until, good = -(2**62), []
        for a, b in zip(table[start].to_pylist(), table[end].to_pylist(), strict=True):
            good.append(a >= until)
            until = b if a >= until else until
        return table.append_column("accepted", pa.array(good, pa.bool_()))

    return rows.groupBy(*keys).applyInArrow(fold, T.StructType([*rows.schema.fields, T.StructField("accepted", T.BooleanType())]))


def written(intervals: DataFrame, keys: list[str], value: str = "value", order: str = "write_seq") -> DataFrame:
    """(keys, start, end, value): what a track holds after half-open intervals are written in order, as disjoint spans.

    Intervals cut each other at their ends; the last writer of a piece counts.
    Neighbouring spans may have the same value. Keys are not null.
    """
    rows = intervals.where("end > start").select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col(value).alias("__value"), F.col(order).alias("__order"))
    cuts = rows.select(*keys, F.explode(F.array("start", "end")).alias("a")).distinct()
    pieces = blocks.with_next(cuts, keys, {"b": "a"}, "a").where("b is not null")
    held = containing(pieces, rows, keys, "a")
    return held.groupBy(*keys, "a", "b").agg(F.max_by("__value", "__order").alias(value)).select(*keys, F.col("a").alias("start"), F.col("b").alias("end"), value)


def last_written(intervals: DataFrame, keys: list[str], value: str = "value", order: str = "write_seq") -> DataFrame:
    """(keys, pos, value): the spans of `written`, a row for each position. As there is one for each in the end, intervals are cut into positions at once, and the last writer of each is an aggregate."""
    rows = intervals.where("end > start").select(*keys, F.explode(F.expr("sequence(cast(start as bigint), cast(end as bigint) - 1)")).alias("pos"), F.col(value).alias("__value"), F.col(order).alias("__order"))
    return rows.groupBy(*keys, "pos").agg(F.max_by("__value", "__order").alias(value))


def painted(transcripts: DataFrame, exons: DataFrame, cds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, class) as disjoint spans: 2 on coding bases, 1 on other exon bases, 3 on the rest of a transcript.

    Counts of open intervals of each kind, by position: one window, no join. Edges
    at one place see the same counts, and only the last of them has a span behind it.
    """
    kinds = ("transcript", "exon", "coding")
    edges = None
    for k, frame in enumerate((transcripts, exons, cds)):
        step = F.when(F.col("side") == 0, 1).otherwise(-1)
        own = frame.where("end > start").select(*keys, F.posexplode(F.array("start", "end")).alias("side", "at"))
        own = own.select(*keys, "at", *(step.alias(n) if n == kinds[k] else F.lit(0).alias(n) for n in kinds))
        edges = own if edges is None else edges.unionByName(own)
    by = W.partitionBy(*keys).orderBy("at")
    now = edges.select(*keys, F.col("at").alias("start"), F.lead("at").over(by).alias("end"), *(F.sum(n).over(by.rangeBetween(W.unboundedPreceding, 0)).alias(n) for n in kinds))
    kind = F.when(F.col("coding") > 0, 2).when(F.col("exon") > 0, 1).when(F.col("transcript") > 0, 3)
    return now.where("end > start").select(*keys, "start", "end", kind.alias("class")).where("class is not null")


def transition_windows(transcripts: DataFrame, exons: DataFrame, cds: DataFrame, keys: list[str], weights: tuple[int, ...] = (16,) * 6, strand: str | None = None) -> DataFrame:
    """Intervals of higher weight around the boundaries of transcripts, in the order they are written.

    Start codon, stop codon, transcript start, transcript end, donors, acceptors.
    `strand` names a column of all three tables; rows where it is below 0 have
    their windows mirrored. Without it all rows are forward.
    """
    reverse = F.lit(False) if strand is None else F.coalesce(F.col(strand) < 0, F.lit(False))
    ends = cds.groupBy(*keys).agg(F.min("start").alias("a"), F.max("end").alias("b"), F.bool_or(reverse).alias("r"))
    whole = transcripts.select(*keys, F.col("start").alias("a"), F.col("end").alias("b"), reverse.alias("r"))
    inner = W.partitionBy(*keys).orderBy("start")
    gaps = exons.withColumn("r", reverse).withColumn("b", F.lead("start").over(inner)).where("b is not null").select(*keys, F.col("end").alias("a"), "b", "r")

    def at(rows: DataFrame, left: tuple[int, int], right: tuple[int, int], rank: int) -> DataFrame:
        """Windows at the left boundary a and the right one b: first that at the first of the two in reading order, then the other."""
        both = []
        for k in (0, 1):
            here = F.col("r") != F.lit(k == 0)
            ends = (F.when(here, F.col("a") + x).otherwise(F.col("b") + y) for x, y in zip(left, right, strict=True))
            low, high = (e.cast("long") for e in ends)
            both.append(F.struct(F.greatest(low, F.lit(0)).cast("long").alias("start"), high.alias("end"), F.lit(weights[rank + k]).alias("value"), F.lit(rank + k).alias("write_seq")))
        return rows.select(*keys, F.inline(F.array(*both)))

    starts = at(ends, (-1, 3), (-3, 1), 0)
    return starts.unionByName(at(whole, (-1, 1), (-1, 1), 2)).unionByName(at(gaps, (-1, 2), (-2, 1), 4))


def boundary_errors(parts: DataFrame, keys: list[str], order: str = "start") -> DataFrame:
    """parts with the next one's start (after) and end (after_end), and what is wrong: a short intron between them, or an overlap."""
    w = W.partitionBy(*keys).orderBy(order)
    rows = parts.withColumn("after", F.lead("start").over(w)).withColumn("after_end", F.lead("end").over(w))
    gap = F.col("after") - F.col("end")
    return rows.withColumn("short_intron", F.coalesce((gap >= 0) & (gap <= SHORT_INTRON), F.lit(False))).withColumn("overlap", F.coalesce(gap < 0, F.lit(False)))


def codon_errors(cds: DataFrame, keys: list[str], reverse: bool = False) -> DataFrame:
    """Per transcript, of coding parts with start and seq: whether start codon, stop codon and frame are wrong."""
    from strandloom.functions.sequence import in_frame, starts_codon, stops_codon

    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "seq"))), lambda p: p["seq"]), "")
    rows = cds.groupBy(*keys).agg(joined.alias("spliced"))
    spliced = F.col("spliced")
    return rows.select(*keys, (~starts_codon(spliced, reverse)).alias("bad_start"), (~stops_codon(spliced, reverse)).alias("bad_stop"), (~in_frame(spliced)).alias("bad_frame"), F.length("spliced").alias("cds_length"))


def state_transitions(series: DataFrame, keys: list[str], pos: str = "pos", label: str = "class") -> DataFrame:
    """series with transition: 1 where the step to the next label is a change that gene structure allows, or between equal codes' neighbours.

    0 intergenic, 1 untranslated, 2 coding, 3 intron. Allowed are steps between
    neighbours 0-1, 1-2, 2-3 and 1-3; the last position is 0.
    """
    following = F.col("__following")
    low, high = F.least(F.col(label), following), F.greatest(F.col(label), following)
    allowed = (low != high) & ~((low == 0) & (high > 1))
    rows = blocks.with_next(series, keys, {"__following": label}, pos)
    return rows.withColumn("transition", F.coalesce(allowed, F.lit(False)).cast("int")).drop("__following")


def transition_mask(series: DataFrame, keys: list[str], pos: str = "pos", weight: str = "weight") -> DataFrame:
    """series with transition_mask: 0 where this or the next weight is 0, and at the last position."""
    rows = blocks.with_next(series, keys, {"__following": weight}, pos)
    return rows.withColumn("transition_mask", F.coalesce((F.col(weight) != 0) & (F.col("__following") != 0), F.lit(False)).cast("int")).drop("__following")


def filled_phase(index: Column, length: Column, phase: Column, reverse: Column) -> Column:
    """A coding part's phase per base: 0, 2, 1 by turns so that the first base, or the last on the reverse strand, has the given phase."""
    turn = F.array(*map(F.lit, PHASES))
    at = F.array_position(turn, phase.cast("int")) - 1
    step = F.when(reverse, length - 1 - index).otherwise(index)
    return F.element_at(turn, ((step + at) % 3 + 1).cast("int"))


def filled_phases(length: Column, phase: Column, reverse: Column) -> Column:
    """filled_phase of all bases of a coding part as one string: a stretch of turns from the right one on, turned around on the reverse strand."""
    turns = "".join(map(str, PHASES))
    at = F.array_position(F.array(*map(F.lit, PHASES)), phase.cast("int")).cast("int")
    stretch = F.substring(F.repeat(F.lit(turns), F.ceil(length / len(turns)).cast("int") + 1), at, length.cast("int"))
    return F.when(reverse, F.reverse(stretch)).otherwise(stretch)


def utr_lengths(exon_bases: DataFrame, keys: list[str]) -> DataFrame:
    """(total_5, total_3, n) over genes that have untranslated bases on both sides; rows have keys, utr_5 and utr_3."""
    each = exon_bases.groupBy(*keys).agg(F.sum("utr_5").alias("utr_5"), F.sum("utr_3").alias("utr_3")).where("utr_5 > 0 and utr_3 > 0")
    return each.agg(F.coalesce(F.sum("utr_5"), F.lit(0)).alias("total_5"), F.coalesce(F.sum("utr_3"), F.lit(0)).alias("total_3"), F.count("*").alias("n"))


def average_utr(totals: DataFrame, mask_length: int = 1000) -> DataFrame:
    """The averages, cut to integers; half the mask length where no gene has both."""
    half = F.lit(mask_length // 2)
    return totals.select(*(F.coalesce(F.expr(f"try_divide(total_{k}, n)").cast("long"), half).cast("long").alias(f"average_{k}") for k in (5, 3)), "n")


def kept_windows(positions: DataFrame, keys: list[str], window: int, need_genes: bool = True) -> DataFrame:
    """(keys, win_idx): windows with a weight other than 0 and, unless waived, a label other than intergenic."""
    rows = positions.groupBy(*keys, F.expr(f"pos div {window}").alias("win_idx")).agg(F.bool_or(F.col("class") != 0).alias("genic"), F.bool_or(F.col("weight") != 0).alias("weighed"), F.count("*").alias("n"))
    return rows.where(F.col("weighed") & (F.col("genic") | F.lit(not need_genes)))
