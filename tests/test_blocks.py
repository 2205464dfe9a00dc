import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from strandloom.operators import blocks, regions, runs

SIZES = [1, 3, 1 << 16]


def series(n=400, keys=("a", "b", "c"), seed=1):
    r = random.Random(seed)
    rows = [(k, p, r.randint(0, 2), r.randint(-5, 9)) for k in keys for p in range(-20, n) if r.random() < 0.9 or 100 < p < 300]
    return [(k, p, 1 if 120 < p < 250 else c, v) for k, p, c, v in rows]


def table(spark, rows):
    return spark.createDataFrame(rows, "key string, pos long, class int, value long").repartition(5)


def adjacent(positions):
    out = []
    for p in sorted(positions):
        if out and out[-1][1] + 1 == p:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("size", SIZES)
def test_runs_and_their_starts(spark, size):
    rows = series()
    wanted = {(k, a, b, b - a + 1) for k, own in groupby(rows, lambda r: r[0]) for a, b in adjacent([r[1] for r in own if r[2]])}
    got = runs.runs(table(spark, rows), ["key"], F.col("class") != 0, size=size).collect()
    assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted
    inside = runs.genes(table(spark, rows), ["key"], size=size).collect()
    assert len(inside) == sum(r[2] != 0 for r in rows)
    assert all((r["key"], r["gene_start"]) in {w[:2] for w in wanted if w[1] <= r["pos"] <= w[2]} for r in inside)
    parts = {(k, a, x, y, y - x + 1) for k, a, b, _ in wanted for x, y in adjacent([r[1] for r in rows if r[0] == k and a <= r[1] <= b and r[2] == 1])}
    got = runs.within_genes(table(spark, rows), ["key"], [1], size=size).collect()
    assert len(got) == len(parts) and {tuple(r) for r in got} == parts


@pytest.mark.parametrize("size", SIZES)
def test_sums_and_neighbours(spark, size):
    rows = series(120)
    got = blocks.running_sum(table(spark, rows), ["key"], "value", "total", size=size)
    assert {(r["key"], r["pos"], r["total"]) for r in got.collect()} == {(k, p, sum(v for a, q, _, v in rows if a == k and q <= p)) for k, p, _, _ in rows}
    for back in (False, True):
        near = blocks.with_next(table(spark, rows), ["key"], {"then": "value", "there": "pos"}, size=size, back=back).collect()
        assert len(near) == len(rows)
        for r in near:
            beside = [(q, v) for a, q, _, v in rows if a == r["key"] and (q < r["pos"] if back else q > r["pos"])]
            assert (r["there"], r["then"]) == ((max if back else min)(beside) if beside else (None, None))


def test_regions_by_blocks_equal_regions_in_one(spark):
    r = random.Random(4)
    bins = [(k, b, r.choice([0.0, 0.05, 0.3, 0.9]), r.randint(0, 1)) for k in "ab" for b in range(90)]
    binned = spark.createDataFrame(bins, "key string, bin long, mean double, n_high long")
    lengths = spark.createDataFrame([("a", 4480), ("b", 4500)], "key string, length long")
    one = sorted(map(tuple, regions.candidate_regions(binned, lengths, ["key"]).collect()))
    for size in (1, 3, 16):
        assert sorted(map(tuple, regions.candidate_regions(binned, lengths, ["key"], size=size).collect())) == one and len(one) > 20


def test_a_long_key_is_spread_over_tasks(spark):
    n, size = 400_000, 1 << 12
    rows = spark.range(n).select(F.concat(F.lit("k"), F.col("id") % 1).alias("key"), F.col("id").alias("pos"), (F.col("id") % 7).alias("value"))
    summed = blocks.running_sum(rows, ["key"], "value", "total", size=size)
    assert summed.where("pos = 399999").first()["total"] == sum(k % 7 for k in range(n))
    # A window holds a block: of one key's positions, those of different blocks are dealt out apart.
    dealt = rows.withColumn("b", blocks.block_of("pos", size)).repartition(4, "key", "b").select(F.spark_partition_id().alias("p"), "b").distinct().groupBy("p").count().collect()
    assert len(dealt) == 4 and sum(r["count"] for r in dealt) == -(-n // size)
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan and "__block" in plan
    [one] = runs.runs(rows, ["key"], F.lit(True), size=size).collect()
    assert tuple(one) == ("k0", 0, n - 1, n)
