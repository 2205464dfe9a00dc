import math

import numpy as np
import pytest

from strandloom.functions import sequence as S
from strandloom.operators import experts, genes, labels, metrics, packing, regions, runs, tiling
from pyspark.sql import functions as F


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_reverse_complement(spark):
    assert value(spark, S.reverse_complement(F.lit("ACGTNRX"))) == "XRNACGT"
    assert value(spark, S.reverse_complement(S.reverse_complement(F.lit("acgTNx")))) == "acgTNx"


def test_one_hot(spark):
    assert value(spark, S.one_hot(F.lit("AGNX"))) == [[1, 0, 0, 0], [0, 0, 1, 0], [0.25] * 4, [0] * 4]


def test_safe_log(spark):
    assert value(spark, S.safe_log(F.lit(0.0))) == -math.inf
    assert math.isclose(value(spark, S.safe_log(F.lit(0.0), 1e-3)), math.log(1e-3))


def genome(spark, *seqs):
    return spark.createDataFrame([(f"c{k}", s) for k, s in enumerate(seqs)], "seq_id string, seq string")


def test_tiles(spark):
    rows = tiling.windows(genome(spark, "ACGTACGTAC", ""), 4, 2)
    assert [(r["start"], r["seq"]) for r in rows.orderBy("start").collect()] == [(0, "XXACGTAC"), (4, "GTACGTAC"), (8, "GTACXXXX")]
    binary = rows.unionByName(tiling.windows(genome(spark, "ACGTACGTAC").withColumn("seq", F.col("seq").cast("binary")), 4, 2))
    assert binary.distinct().count() == 3


def test_tiles_and_strands_put_the_contig_together_again(spark):
    seq = "acgtnACGGTTAAC" * 7 + "A"
    both = tiling.both_strands(tiling.windows(genome(spark, seq), 10, 3), 10)
    low, high = tiling.kept_range(10)
    extra = 10 * 10 - len(seq)
    for strand, whole in ((1, seq.upper()), (-1, value(spark, S.reverse_complement(F.lit(seq.upper()))))):
        parts = both.where(F.col("strand") == strand).select("win_idx", low.alias("a"), high.alias("b"), "seq").orderBy("win_idx").collect()
        assert parts[0]["a"] == 0 and parts[-1]["b"] == len(seq) - 1
        text = ""
        for r in parts:
            skip = 3 + (extra if strand == -1 and r["win_idx"] == 0 else 0)
            text += r["seq"][skip : skip + r["b"] - r["a"] + 1]
        assert text == whole


def regions_of(spark, length, means, high=()):
    """Bins of constant probability; `high` are positions above the maximum."""
    rows = [("c", k, m, sum(50 * k <= h < 50 * k + 50 for h in high)) for k, m in enumerate(means)]
    binned = spark.createDataFrame(rows, "seq_id string, bin long, mean double, n_high long")
    out = regions.candidate_regions(binned, spark.createDataFrame([("c", length)], "seq_id string, length long"), ["seq_id"])
    return sorted((r["region_start"], r["region_end"]) for r in out.collect())


def test_regions(spark):
    assert regions_of(spark, 200, [0.9, 0.9, 0.0, 0.0], [10]) == [(0, 150)]
    assert regions_of(spark, 120, [0.0, 0.2, 0.2]) == [(50, 120)]
    assert regions_of(spark, 200, [0.2, 0.2, 0.0, 0.0]) == []
    assert regions_of(spark, 200, [0.2, 0.2, 0.0, 0.0], [120]) == [(0, 150)]


def test_bins_of_chunks_equal_bins_of_positions(spark):
    p = [((k * 37) % 100) / 100 for k in range(275)]
    chunks = spark.createDataFrame([("c", 0, p[:100]), ("c", 100, p[100:250]), ("c", 250, p[250:]), ("c", 275, [])], "seq_id string, start long, genic array<double>")
    track = spark.createDataFrame([("c", k, x) for k, x in enumerate(p)], "seq_id string, pos long, genic double")
    a, b = (sorted((r["bin"], round(r["mean"], 9), r["n_high"]) for r in f.collect()) for f in (regions.bins_of_chunks(chunks, ["seq_id"]), regions.bins(track, ["seq_id"])))
    assert a == b and len(a) == 6


def test_class_runs(spark):
    series = spark.createDataFrame(list(enumerate([0, 1, 1, 2, 2, 1, 0, 0, 1])), "pos long, class int").withColumn("key", F.lit(1))
    assert sorted((r["start"], r["end"]) for r in runs.runs(series, ["key"], F.col("class") != 0).collect()) == [(1, 5), (8, 8)]
    cds = sorted((r["gene_start"], r["start"], r["end"]) for r in runs.within_genes(series, ["key"], [1]).collect())
    assert cds == [(1, 1, 2), (1, 5, 5), (8, 8, 8)]


def test_coordinates_and_phases(spark):
    start, end = genes.to_forward(F.lit(10), F.lit(19), F.lit(100), F.lit(-1))
    assert (value(spark, start), value(spark, end)) == (81, 90)
    cds = spark.createDataFrame([("g", 0, 3), ("g", 10, 14), ("g", 20, 22)], "gene string, start long, end long")
    assert [r["phase"] for r in genes.cds_phases(cds, ["gene"]).orderBy("start").collect()] == [0, 2, 0]
    assert [(r["start"], r["end"]) for r in genes.introns(cds, ["gene"]).orderBy("start").collect()] == [(4, 9), (15, 19)]


def test_gene_numbers_run_over_both_strands(spark):
    rows = spark.createDataFrame([("c", 1, 50), ("c", -1, 10), ("c", -1, 90), ("c", 1, 5)], "seq_id string, strand int, first_cds long")
    got = {(r["strand"], r["first_cds"]): r["gene_no"] for r in genes.numbered(rows).collect()}
    assert got == {(1, 5): 1, (1, 50): 2, (-1, 90): 3, (-1, 10): 4}


def test_packing(spark):
    items = spark.createDataFrame([(0, 9), (1, 7), (2, 5), (3, 5)], "seq_ord long, length long")
    assert [r["chunk_id"] for r in packing.longest_first(items, 2).orderBy("seq_ord").collect()] == [0, 1, 1, 0]
    assert {r["chunk_id"] for r in packing.longest_first(items, 9).collect()} == {0, 1, 2, 3}


def test_greedy_overlap(spark):
    rows = spark.createDataFrame([(1, 0, 5), (2, 3, 9), (3, 5, 7)], "gene_no long, start long, end long").withColumn("seq_id", F.lit("c"))
    assert [r["accepted"] for r in labels.accepted(rows, ["seq_id"]).orderBy("gene_no").collect()] == [True, False, True]


def test_transition_windows_are_mirrored_on_the_reverse_strand(spark):
    shape = "gene long, start long, end long, strand int"
    whole = spark.createDataFrame([(g, 100, 400, s) for g, s in ((1, 1), (2, -1))], shape)
    exons = spark.createDataFrame([(g, a, b, s) for g, s in ((1, 1), (2, -1)) for a, b in ((100, 180), (220, 300), (350, 400))], shape)
    cds = spark.createDataFrame([(g, a, b, s) for g, s in ((1, 1), (2, -1)) for a, b in ((130, 180), (220, 300), (350, 380))], shape)

    def run(**kwargs):
        rows = labels.transition_windows(whole, exons, cds, ["gene"], (16, 17, 18, 19, 20, 21), **kwargs).collect()
        assert all(r["write_seq"] == r["value"] - 16 for r in rows)
        return {g: sorted((r["value"], r["start"], r["end"]) for r in rows if r["gene"] == g) for g in (1, 2)}

    forward = [(16, 129, 133), (17, 377, 381), (18, 99, 101), (19, 399, 401), (20, 179, 182), (20, 299, 302), (21, 218, 221), (21, 348, 351)]
    mirrored = [(16, 377, 381), (17, 129, 133), (18, 399, 401), (19, 99, 101), (20, 218, 221), (20, 348, 351), (21, 179, 182), (21, 299, 302)]
    assert run() == {1: forward, 2: forward}
    assert run(strand="strand") == {1: forward, 2: mirrored}


def test_transitions_and_masks(spark):
    def run(values, function, **names):
        rows = spark.createDataFrame(list(enumerate(values)), f"pos long, {names['name']} int").withColumn("key", F.lit(1))
        return [r[-1] for r in function(rows, ["key"]).orderBy("pos").collect()]

    assert run([0, 1, 2, 3, 2, 1, 0], labels.state_transitions, name="class") == [1, 1, 1, 1, 1, 1, 0]
    assert run([0, 2, 0], labels.state_transitions, name="class") == [0, 0, 0]
    assert run([1, 1, 0, 1, 1], labels.transition_mask, name="weight") == [1, 0, 0, 1, 0]


def test_filled_phase(spark):
    assert [value(spark, labels.filled_phase(F.lit(k), F.lit(4), F.lit(2), F.lit(False))) for k in range(4)] == [2, 1, 0, 2]
    assert [value(spark, labels.filled_phase(F.lit(k), F.lit(4), F.lit(2), F.lit(True))) for k in range(4)] == [2, 0, 1, 2]


def test_last_writer_wins(spark):
    rows = spark.createDataFrame([("c", 0, 4, 1, 0), ("c", 2, 6, 2, 1), ("c", 3, 3, 9, 2)], "seq_id string, start long, end long, value int, write_seq int")
    assert [r["value"] for r in labels.last_written(rows, ["seq_id"]).orderBy("pos").collect()] == [1, 1, 2, 2, 2, 2]


def test_average_utr_falls_back(spark):
    rows = spark.createDataFrame([("g", 0, 5)], "gene string, utr_5 long, utr_3 long")
    assert tuple(labels.average_utr(labels.utr_lengths(rows, ["gene"])).first()) == (500, 500, 0)


def test_metrics_of_nothing_and_of_a_perfect_model(spark):
    none = spark.createDataFrame([], "label int, pred int")
    assert metrics.accuracy(metrics.confusion(none)).first()["accuracy"] is None
    same = spark.createDataFrame([(k % 3, k % 3) for k in range(9)], "label int, pred int")
    assert {r["f1"] for r in metrics.f1(metrics.confusion(same)).collect()} == {1.0}


def test_early_stop(spark):
    rows = spark.createDataFrame(list(enumerate([0.1, 0.5, 0.4, 0.5, 0.6, 0.2, 0.3, 0.3])), "epoch long, score double")
    got = metrics.early_stop(rows, 3).orderBy("epoch").collect()
    assert [r["streak"] for r in got] == [0, 0, 1, 2, 0, 1, 2, 3] and [r["stopped"] for r in got] == [False] * 7 + [True]


def test_mixture_of_experts(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], [0.5, 0.3, 0.2]), (2, [0.0, 1.0], [0.2, 0.2, 0.6])], "id long, x array<double>, g array<double>")
    got = {r["id"]: r["y"] for r in experts.mixture(rows, "id", "x", "g", lambda x, e: F.transform(x, lambda v: v * (e + 1))).collect()}
    assert all(math.isclose(a, b) for a, b in zip(got[1] + got[2], [1.1, 2.2, 0.0, 2.0], strict=True))
    soft = experts.softmax_column(rows, "g", "p").where("id = 1").first()["p"]
    assert math.isclose(sum(soft), 1) and soft == sorted(soft, reverse=True)


@pytest.mark.parametrize("part", [4, 4096])
def test_tokens_meet_their_experts_networks(spark, part):
    """Most tokens go to one expert; two layers each."""
    r = np.random.default_rng(8)
    tokens = [(i, r.standard_normal(5).tolist(), r.dirichlet([20, 1, 1, 1]).tolist()) for i in range(60)]
    layers = [[(r.standard_normal((7, 5)), r.standard_normal(7)), (r.standard_normal((3, 7)), r.standard_normal(3))] for _ in range(4)]
    rows = [(e, [(w.tolist(), b.tolist()) for w, b in own]) for e, own in enumerate(layers)]
    networks = spark.createDataFrame(rows, f"expert int, layers {experts.LAYERS}")
    table = spark.createDataFrame(tokens, "i long, x array<double>, g array<double>").repartition(3)
    got = {r["i"]: r["y"] for r in experts.dispatched(table, networks, "i", "x", "g", 3, part).collect()}
    for i, x, g in tokens:
        wanted = np.zeros(3)
        for e in sorted(range(4), key=lambda e: (-g[e], e))[:3]:
            (w1, b1), (w2, b2) = layers[e]
            wanted += g[e] * (w2 @ np.maximum(w1 @ np.array(x) + b1, 0) + b2)
        assert np.allclose(got[i], wanted)
    assert len(got) == 60 and experts.dispatched(table.limit(0), networks, "i", "x", "g").count() == 0
    with pytest.raises(Exception, match="no weights of expert 0"):
        experts.dispatched(table, networks.where("expert > 0"), "i", "x", "g").collect()
