import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import genes, hmm, hmm_utr
from strandloom.plans import annotate as plan
from strandloom.plans import samples
from strandloom.plans.scoring import CompositionScorer
from strandloom.sources import gff

LINES = [
    "##gff-version 3",
    "c1\tx\tgene\t11\t60\t.\t+\t.\tID=g1", "c1\tx\tmRNA\t11\t60\t.\t+\t.\tID=t1;Parent=g1", "c1\tx\tmRNA\t11\t30\t.\t+\t.\tID=t0;Parent=g1",
    "c1\tx\texon\t11\t60\t.\t+\t.\tParent=t1", "c1\tx\tCDS\t21\t32\t.\t+\t0\tParent=t1",
    "c1\tx\tgene\t40\t70\t.\t+\t.\tID=g2", "c1\tx\tmRNA\t40\t70\t.\t+\t.\tID=t2;Parent=g2", "c1\tx\tCDS\t41\t52\t.\t+\t0\tParent=t2",
    "c1\tx\tpseudogene\t80\t90\t.\t-\t.\tID=p1", "c1\tx\tgene\t91\t95\t.\t-\t.\tID=g3", "c1\tx\tregion\t1\t100\t.\t+\t.\tID=r",
]


@pytest.fixture(scope="module")
def inputs(spark):
    seq = list("C" * 100)
    seq[20:32] = "ATGCCCCCCTAA"
    genome = spark.createDataFrame([("c1", 0, 100, bytearray("".join(seq), "ascii")), ("c2", 1, 30, bytearray(b"ACGTACGTACGTACGTACGTACGTACGTAC"))], "seq_id string, seq_ord int, length long, seq binary")
    lines = spark.createDataFrame(list(enumerate(LINES)), "line_no long, value string")
    return genome, samples.feature_rows(gff.parse_links(lines))


def test_models_and_masks(inputs):
    models, parts, masks = samples.gene_models(inputs[1])
    assert [(r["gene_line"], r["start"], r["end"]) for r in models.collect()] == [(1, 10, 60)]
    assert sorted((r["type"], r["start"], r["end"]) for r in parts.collect()) == [("CDS", 20, 32), ("exon", 10, 60)]
    # The second gene begins before the first ends; the others have no parts, or a type to mask; the region is passed over.
    assert sorted((r["strand"], r["start"], r["end"]) for r in masks.collect()) == [(-1, 79, 90), (-1, 90, 95), (1, 39, 70)]


def test_samples_of_a_small_genome(spark, inputs, tmp_path):
    rows = samples.samples(*inputs, 40, 4, (2, 3, 4, 5, 6, 7), 10)
    got = {(r["strand"], r["win_idx"]): r for r in rows.collect()}
    # Windows without genes, and the contig that the annotation lacks, are left out.
    assert set(got) == {(1, 0), (1, 1)}
    one = got[1, 0]
    assert one["seq"].startswith("XXXXCCCC") and len(one["seq"]) == 48
    assert one["ann"] == [0] * 10 + [1] * 10 + [2] * 12 + [1] * 8
    assert one["phase"] == [3] * 20 + [0, 2, 1] * 4 + [3] * 8
    wanted = [1] * 40
    wanted[19:23], wanted[29:33], wanted[9:11] = [2] * 4, [3] * 4, [4] * 2
    wanted[39] = 0
    assert one["weight"] == wanted
    assert [k for k, x in enumerate(one["transition"]) if x] == [9, 19, 31]
    assert [k for k, x in enumerate(one["transition_mask"]) if not x] == [38, 39]
    assert got[1, 1]["ann"] == [1] * 20 + [0] * 20 and got[1, 1]["weight"][:30] == [0] * 30
    everything = {(r["seq_id"], r["strand"], r["win_idx"]): r for r in samples.samples(*inputs, 40, 4, need_genes=False, mask_length=10).collect()}
    assert set(everything) == {("c1", s, k) for s in (1, -1) for k in range(3)}
    back = everything["c1", -1, 2]
    assert back["ann"] == [0] * 40 and back["phase"] == [3] * 40
    # The window's last 20 places lie beyond the contig; turned around they come first.
    assert back["weight"] == [0] * 20 + [1] * 5 + [0] * 15
    samples.write_samples(rows, str(tmp_path), "one")
    samples.write_samples(rows.where("win_idx = 0"), str(tmp_path), "two")
    both = samples.read_samples(spark, str(tmp_path), ["one", "two"])
    assert sorted(r["species"] for r in both.collect()) == ["one", "one", "two"]
    with pytest.raises(FileNotFoundError):
        samples.read_samples(spark, str(tmp_path), ["one", "three"])


def test_seeded_split_and_shuffle(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("seq_id"), F.lit(1).alias("strand"), F.lit(0).alias("win_idx"))
    a, b = samples.split(rows, 0.3, 5)
    assert a.count() + b.count() == 2000 and 500 < a.count() < 700
    again = samples.split(rows.repartition(7), 0.3, 5)[0]
    assert a.exceptAll(again).isEmpty()
    order = [r["seq_id"] for r in samples.shuffled(rows, 1).collect()]
    assert order == [r["seq_id"] for r in samples.shuffled(rows.repartition(5), 1).collect()] and order != [r["seq_id"] for r in samples.shuffled(rows, 2).collect()]


def test_windows_are_scored_once_and_predictions_kept_by_chunk(spark, tmp_path):
    import pyarrow as pa

    genome = spark.createDataFrame([(f"c{k}", k, 900, bytearray(b"ACGGCGCCAT" * 90)) for k in range(4)], "seq_id string, seq_ord int, length long, seq binary")
    counter = spark.sparkContext.accumulator(0)

    class Counting(CompositionScorer):
        def score(self, windows):
            counter.add(len(windows))
            return super().score(windows)

    options = dict(min_cds_length=12, min_cds_score=0.3)
    direct = plan.annotate(genome, Counting(), 256, 64, **options).collect()
    assert counter.value == 4 * 4 * 2 and pa
    contigs = genome.drop("seq")
    plan.write_predictions(plan.predict(genome, CompositionScorer(), 256, 64), contigs, str(tmp_path / "p"), 3)
    assert len(list((tmp_path / "p").glob("chunk_id=*"))) == 3
    pieces = plan.read_predictions(spark, str(tmp_path / "p"))
    assert sorted(map(str, plan.decode(pieces, contigs, **options).collect())) == sorted(map(str, direct))
    if direct:
        with pytest.raises(Exception, match="no sequence in the genome"):
            plan.decode(pieces, contigs.where("seq_id <> 'c1'"), **options).collect()


def test_bins_sum_the_genic_classes_over_pieces(spark):
    rng, rows, whole = np.random.default_rng(1), [], {}
    for seq_id, cuts in (("a", [0, 30, 30, 170, 260]), ("b", [0, 50, 99])):
        p = rng.random((cuts[-1], 5)).astype(np.float32)
        whole[seq_id] = p
        rows += [(seq_id, 1, a, p[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:])]
    pieces = spark.createDataFrame(rows, "seq_id string, strand byte, start long, probs array<array<float>>").repartition(2)
    got = {(r["seq_id"], r["bin"]): r for r in plan._bins(pieces, 2.0).collect()}
    for seq_id, p in whole.items():
        genic = p[:, 1:].sum(1, dtype=float)
        for k in range(0, len(p), 50):
            r = got.pop((seq_id, k // 50))
            assert r["mean"] == pytest.approx(genic[k : k + 50].mean()) and r["n_high"] == (genic[k : k + 50] > 2.0).sum()
    assert not got


def test_states_fall_into_three_or_four_classes(spark):
    for machine, untranslated in ((hmm.machine(2), False), (hmm_utr.machine(2, True), True)):
        rows = spark.createDataFrame([(n,) for n in machine.names], "state string")
        got = {r["state"]: r["c"] for r in rows.select("state", genes.state_class(F.col("state"), untranslated).alias("c")).collect()}
        assert [got[n] for n in machine.names] == machine.kind.tolist()
