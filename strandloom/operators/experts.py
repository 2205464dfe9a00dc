"""Softmax, top-k gates and mixtures of experts over array columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import stored

#: Tokens that meet an expert's weights in one group.
PART_TOKENS = 4096
LAYERS = "array<struct<w:array<array<double>>,b:array<double>>>"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def softmax(values: Column) -> Column:
    """exp(x - max) over their sum; the maximum keeps it in range."""
    powers = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda s, x: s + x))


def softmax_column(rows: DataFrame, values: str, out: str) -> DataFrame:
    """rows with the softmax of an array column; each step is a column, so nothing is computed once per element."""
    top = rows.withColumn("__m", F.array_max(values))
    powers = top.withColumn("__p", F.transform(F.col(values), lambda x: F.exp(x - F.col("__m"))))
    total = powers.withColumn("__s", F.aggregate("__p", F.lit(0.0), lambda s, x: s + x))
    return total.withColumn(out, F.transform("__p", lambda p: p / F.col("__s"))).drop("__m", "__p", "__s")


def top_k(gates: Column, k: int = 2) -> Column:
    """The k largest gates as (gate, expert), largest first, the lower expert first of equals."""
    pairs = F.transform(gates, lambda g, i: F.struct((-g).alias("down"), i.alias("expert")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct((-p["down"]).alias("gate"), p["expert"].alias("expert")))


def mixture(tokens: DataFrame, key: str, x: str, gates: str, experts: Callable[[Column, Column], Column], k: int = 2) -> DataFrame:
    """(key, y): the sum over each token's k experts of gate times expert(x, expert number), gates not scaled anew.

    Each token meets its own experts in its row, so tokens are not shuffled; an
    expert without tokens costs nothing.
    """
    picked = tokens.withColumn("__top", top_k(F.col(gates), k))
    parts = picked.withColumn("__parts", F.transform("__top", lambda t: F.transform(experts(F.col(x), t["expert"]), lambda v: v * t["gate"])))
    zero = F.transform(x, lambda v: F.lit(0.0))
    y = F.aggregate("__parts", zero, lambda total, part: F.zip_with(total, part, lambda a, b: a + b))
    return parts.select(key, y.alias("y"))


def dispatched(tokens: DataFrame, experts: DataFrame, key: str, x: str, gates: str, k: int = 2, part: int = PART_TOKENS) -> DataFrame:
    """(key, y): the sum over each token's k experts of gate times the expert's network of x, gates not scaled anew.

    experts has expert (from 0) and layers (LAYERS): of each, y = w x + b, with
    what is negative set to 0 between layers. Tokens go to their experts and come
    back with a key that tells rows apart. An expert's tokens are dealt out in
    parts, by their share of all tokens, so an expert that gets a third of them
    is no group of its own; only its weights go to each of its parts. An expert
    that a gate names and the table lacks is an error.
    """
    kind = tokens.schema[key].dataType.simpleString()
    picked = tokens.select(key, F.col(x).cast("array<double>").alias("__x"), F.explode(top_k(F.col(gates), k)).alias("__t"))
    sent = picked.select(key, "__x", F.col("__t.expert").alias("expert"), F.col("__t.gate").cast("double").alias("gate"))
    load = stored(sent.groupBy("expert").agg(F.ceil(F.count("*") / part).cast("long").alias("parts")))
    known = load.join(experts.select("expert", "layers"), "expert", "left")
    lost = F.raise_error(F.concat(F.lit("no weights of expert "), F.col("expert").cast("string"))).cast("long")
    known = known.withColumn("parts", F.when(F.col("layers").isNull(), lost).otherwise(F.col("parts")))
    # A row an expert: as small as the list of experts.
    placed = sent.join(known.select("expert", "parts"), "expert").withColumn("part", F.pmod(F.xxhash64(key, "__x"), F.col("parts"))).drop("parts")
    weights = known.select("expert", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "layers")

    def work(group: pa.Table, weights: pa.Table) -> pa.Table:
        out = np.zeros((0, 0))
        if group.num_rows:
            column = group.column("__x").combine_chunks()
            out = column.flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1).T
            layers = weights.column("layers")[0].as_py()
            for n, layer in enumerate(layers):
                out = np.array(layer["w"]) @ out + np.array(layer["b"])[:, None]
                out = np.maximum(out, 0) if n + 1 < len(layers) else out
            out = (out * group.column("gate").to_numpy()).T
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * (out.shape[1] if len(out) else 0), pa.int32()), pa.array(out.ravel()))
        return pa.table([group.column(key), group.column("expert"), lists], names=[key, "expert", "y"])

    ways = ["expert", "part"]
    back = placed.groupBy(*ways).cogroup(weights.groupBy(*ways)).applyInArrow(work, f"`{key}` {kind}, expert int, y array<double>")
    each = back.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("expert", "y"))).alias("ys"))
    first, rest = F.get("ys", F.lit(0))["y"], F.slice("ys", 2, k)
    return each.select(key, F.aggregate(rest, first, lambda total, e: F.zip_with(total, e["y"], lambda a, b: a + b)).alias("y"))
