"""Maximal runs over an ordered series, and genes, coding runs and introns as such runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators import blocks


def runs(series: DataFrame, keys: list[str], wanted: Column, pos: str = "pos", size: int = blocks.BLOCK) -> DataFrame:
    """(keys, start, end, n): maximal runs of adjacent positions where `wanted` holds; ends are inclusive."""
    return blocks.runs(series.where(wanted), keys, pos, size=size)


def genes(series: DataFrame, keys: list[str], pos: str = "pos", kind: str = "class", size: int = blocks.BLOCK) -> DataFrame:
    """series with gene_start: the first position of the run of classes other than 0 that a position is in; others are left out."""
    return blocks.with_run_start(series.where(F.col(kind) != 0), keys, "gene_start", pos, size)


def within_genes(series: DataFrame, keys: list[str], kinds: list[int], pos: str = "pos", kind: str = "class", size: int = blocks.BLOCK) -> DataFrame:
    """(keys, gene_start, start, end, n): runs, inside each gene, of positions whose class is one of `kinds`."""
    return runs(genes(series, keys, pos, kind, size), [*keys, "gene_start"], F.col(kind).isin(*kinds), pos, size)
