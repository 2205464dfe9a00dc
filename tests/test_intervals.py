import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import intervals


def spans(n, seed, most=1 << 22):
    r = random.Random(seed)
    out = []
    for k in range(n):
        a = r.choice([r.randrange(-3000, 3000), r.randrange(most), 1024 * r.randrange(50)])
        out.append((r.choice("ab"), k, a, a + r.choice([0, 1, 7, 1023, 1024, 1025, r.randrange(1, 30_000), r.randrange(1, most)])))
    return out


def test_cells_cover_an_interval_once_and_are_few(spark):
    rows = [(a, b) for _, _, a, b in spans(200, 1)] + [(0, 1 << 34), (3, 250_000_000), (-(1 << 33), 5), (5, 5), (7, 2)]
    got = spark.createDataFrame(rows, "start long, end long").select("start", "end", intervals.cells(F.col("start"), F.col("end")).alias("cells")).collect()
    for r in got:
        held = sorted((c["cell"] * intervals.SMALLEST * 16 ** c["level"], (c["cell"] + 1) * intervals.SMALLEST * 16 ** c["level"]) for c in r["cells"])
        assert all(a[1] == b[0] for a, b in zip(held, held[1:])) and len(held) <= 32 * intervals.LEVELS
        if r["end"] > r["start"]:
            assert held[0][0] <= r["start"] < held[0][0] + intervals.SMALLEST * 16 ** 6 and held[0][0] > r["start"] - intervals.SMALLEST and r["end"] <= held[-1][1] < r["end"] + intervals.SMALLEST
        else:
            assert not held
    assert len(next(r for r in got if r["end"] == 250_000_000)["cells"]) < 100


@pytest.mark.parametrize("seed", [2, 3])
def test_overlaps_match_brute_force(spark, seed):
    left, right = spans(120, seed), spans(150, seed + 10)
    wanted = sorted((i, j) for k, i, a, b in left for m, j, c, d in right if k == m and max(a, c) < min(b, d))
    one = spark.createDataFrame(left, "key string, i long, start long, end long").repartition(3)
    two = spark.createDataFrame(right, "key string, j long, low long, high long").repartition(2)
    assert sorted((r["i"], r["j"]) for r in intervals.overlapping(one, two, ["key"]).collect()) == wanted and len(wanted) > 1000
    points = one.select("key", "i", F.col("start").alias("at"))
    inside = sorted((i, j) for k, i, a, _ in left for m, j, c, d in right if k == m and c <= a < d)
    assert sorted((r["i"], r["j"]) for r in intervals.containing(points, two, ["key"], "at", "low", "high").collect()) == inside
    assert intervals.overlapping(one.limit(0), two, ["key"]).count() == 0


def test_pairs_of_any_length_meet_in_few_cells(spark):
    r = random.Random(4)
    wide = [("a", k, a, a + r.choice([1, 900, 20_000, 100_000_000, 1 << 40, 1 << 57])) for k, a in enumerate(r.choice([-1, 1]) * r.randrange(1 << r.choice([9, 30, 45, 57])) for _ in range(90))]
    one, two = (spark.createDataFrame(wide, f"key string, {i} long, {a} long, {b} long").repartition(3) for i, a, b in (("i", "start", "end"), ("j", "low", "high")))
    wanted = sorted((i, j) for _, i, a, b in wide for _, j, c, d in wide if max(a, c) < min(b, d))
    few = intervals.FEW
    try:
        for intervals.FEW in (0, 12, few):
            assert sorted((x["i"], x["j"]) for x in intervals.overlapping(one, two, ["key"]).collect()) == wanted and len(wanted) > 500
    finally:
        intervals.FEW = few
    each = intervals.placed(one.withColumn("own", intervals._level(F.col("end") - F.col("start"))), ("start", "end"), "own", [])
    assert max(x["count"] for x in each.groupBy("i").count().collect()) <= intervals.SPREAD + 1
