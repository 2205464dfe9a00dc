"""Dealing contigs out to groups of about equal length."""

from __future__ import annotations

from heapq import heapify, heapreplace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def longest_first(items: DataFrame, groups: int, size: str = "length", order: str = "seq_ord", keys: list[str] | None = None) -> DataFrame:
    """(keys, order, size, chunk_id): longest first, each to the group that is smallest so far, the first of equals.

    Each choice depends on all before, so a list of contigs, two numbers each,
    is one group. There are never more groups than items.
    """
    keys = keys or []
    rows = items.select(*keys, F.col(order).cast("long").alias(order), F.col(size).cast("long").alias(size))

    def deal(table: pa.Table) -> pa.Table:
        table = table.sort_by([(size, "descending"), (order, "ascending")])
        loads = [(0, k) for k in range(min(groups, table.num_rows))]
        heapify(loads)
        chosen = []
        for length in table[size].to_pylist():
            load, k = loads[0]
            heapreplace(loads, (load + length, k))
            chosen.append(k)
        return table.append_column("chunk_id", pa.array(chosen, pa.int32()))

    return rows.groupBy(*keys).applyInArrow(deal, T.StructType([*rows.schema.fields, T.StructField("chunk_id", T.IntegerType())]))


def chunk_totals(dealt: DataFrame, size: str = "length", keys: list[str] | None = None) -> DataFrame:
    """(keys, chunk_id, n, total): items and their length in each group."""
    return dealt.groupBy(*(keys or []), "chunk_id").agg(F.count("*").alias("n"), F.sum(size).alias("total"))
