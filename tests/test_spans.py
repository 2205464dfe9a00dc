import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import hmm, spans

from . import test_hmm_utr as older
from .test_hmm import dense_viterbi, gene, random_case

SCHEMA = "seq_id string, strand tinyint, region_start long, start long, seq string, probs array<array<double>>"


def carried(seq, p, cut, m):
    with np.errstate(divide="ignore"):
        weights = [float(hmm.start_weight(np.log(p[k, m.emits[m.number["start2"]]]))) for k in range(1, cut) if seq[k] == "G"]
    return weights[-1] if weights else -np.inf


@pytest.mark.parametrize("seed", range(6))
def test_two_pieces_give_the_path_of_the_dense_recurrence_at_every_cut(seed):
    intron = 1 + seed % 3
    seq, p = random_case(60, seed, "ACGTN")
    m = hmm.machine(intron)
    wanted = hmm.decode([p], [seq], intron)[0]
    if "N" not in seq or seed < 3:
        assert list(wanted) == list(dense_viterbi(seq, p, intron)[0])
    for cut in range(1, len(seq)):
        g = carried(seq, p, cut, m)
        scores = hmm.transfer(p[:cut], seq[:cut], intron, first=True)[0]
        behind = hmm.transfer(p[cut:], seq[cut:], intron, carried=g)
        end = int((scores + behind[:, 0]).argmax())
        left = hmm.decode([p[:cut]], [seq[:cut]], intron, ends=[end])[0]
        right = hmm.decode([p[cut:]], [seq[cut:]], intron, entries=[scores], ends=[0], carried=[g])[0]
        assert list(left) + list(right) == list(wanted)


def test_tables_multiply_in_any_grouping():
    seq, p = random_case(90, 3)
    a, b, c = (hmm.transfer(p[k : k + 30], seq[k : k + 30], first=k == 0, carried=carried(seq, p, k, hmm.machine())) for k in (0, 30, 60))
    whole = hmm.transfer(p, seq, first=True)
    for got in (spans.times(spans.times(a, b), c), spans.times(a, spans.times(b, c))):
        assert np.allclose(got[0], whole[0])


def regions(seed=5):
    """Regions of genes with introns between random stretches, (seq_id, strand, region_start, seq, probs)."""
    out = []
    for r in range(4):
        seq, p = "", np.zeros((0, 5))
        for k in range(6):
            s, q = random_case(37 + 11 * k, 100 * seed + 10 * r + k)
            q[:, 0] += 2
            g, own, _ = gene(70 + 20 * k, 100 if k % 2 else None, seed=r * 10 + k)
            seq, p = seq + s + g, np.concatenate([p, q / q.sum(1, keepdims=True), own])
        out.append(("c" if r < 3 else None, 1 if r % 2 else -1, 1000 * r, seq, p.tolist()))
    return out


@pytest.mark.parametrize("size, fan", [(64, 2), (10_000, 64), (1, 8)])
def test_genes_of_regions_in_pieces_equal_those_of_whole_regions(spark, size, fan):
    whole = [r for r in regions() if r[0]] if size > 1 else [(a, b, c, s[:600], p[:600]) for a, b, c, s, p in regions()[:1]]
    wanted = hmm.annotate_regions(spark.createDataFrame(whole, "seq_id string, strand tinyint, region_start long, seq string, probs array<array<double>>")).collect()
    cut = [(i, s, at, at + k, seq[k : k + size], p[k : k + size]) for i, s, at, seq, p in whole for k in range(0, len(seq), size)]
    got = spans.annotate_pieces(spark.createDataFrame(cut, SCHEMA).repartition(5), spans.CodonModel(), fan=fan).collect()

    def plain(rows):
        return sorted((*r[:5], round(r["score"], 9), round(r["cds_score"], 9)) for r in rows)

    assert plain(got) == plain(wanted) and (len(wanted) > 20 or size == 1)


@pytest.mark.parametrize("cut_codons", [False, True])
def test_two_pieces_of_the_older_model_give_the_same_path_at_every_cut(cut_codons):
    for seed, letters in enumerate(("ACGT", "AGT", "ACGTNa")):
        seq, classes, changes, phases = older.random_case(50, seed, letters)
        wanted = older.hmm.decode([classes], [changes], [phases], [seq], 2, cut_codons)[0]
        for cut in range(1, len(seq)):
            beside = older.hmm.Beside(seq[max(0, cut - 2) : cut], "", tuple(changes[cut - 1]))
            scores = older.hmm.transfer(classes[:cut], changes[:cut], phases[:cut], seq[:cut], 2, cut_codons, older.hmm.Beside(right=seq[cut]), first=True)[0]
            behind = older.hmm.transfer(classes[cut:], changes[cut:], phases[cut:], seq[cut:], 2, cut_codons, beside)
            end = int((scores + behind[:, 0]).argmax())
            left = older.hmm.decode([classes[:cut]], [changes[:cut]], [phases[:cut]], [seq[:cut]], 2, cut_codons, ends=[end], beside=[older.hmm.Beside(right=seq[cut])])[0]
            right = older.hmm.decode([classes[cut:]], [changes[cut:]], [phases[cut:]], [seq[cut:]], 2, cut_codons, [scores], [0], [beside])[0]
            assert list(left) + list(right) == list(wanted)


@pytest.mark.parametrize("size", [1, 7, 4000])
def test_genes_of_the_older_model_in_pieces_equal_those_of_whole_regions(spark, size):
    whole = []
    for r in range(1 if size == 1 else 3):
        parts = [older.gene(s, at)[:4] for s, at in ((("GT", "AG"), 15 + r), (("AT", "AC"), 17), (("GC", "AG"), 16))][: 1 if size == 1 else 3]
        seq = "".join(p[0] for p in parts)
        whole.append((f"c{r}", -1 if r else 1, 50 * r, seq if r else seq[:30].lower() + seq[30:], *(np.concatenate([p[k] for p in parts]).tolist() for k in (1, 2, 3))))
    tracks = "seq string, classes array<array<double>>, changes array<array<double>>, phases array<array<double>>"
    wanted = older.hmm.annotate_regions(spark.createDataFrame(whole, f"seq_id string, strand tinyint, region_start long, {tracks}"), 30, 0.2).collect()
    cut = [(i, s, at, at + k, seq[k : k + size], *(x[k : k + size] for x in xs)) for i, s, at, seq, *xs in whole for k in range(0, len(seq), size)]
    pieces = spark.createDataFrame(cut, f"seq_id string, strand tinyint, region_start long, start long, {tracks}").repartition(5)
    got = spans.annotate_pieces(pieces, spans.UntranslatedModel(30, 0.2), fan=5).collect()

    def plain(rows):
        return sorted((*r[:6], round(r["score"] or 0, 9), round(r["cds_score"], 9)) for r in rows)

    assert plain(got) == plain(wanted) and len(wanted) >= 5


@pytest.mark.parametrize("size", [1, 7, 100])
def test_regions_of_some_pieces_need_no_tables(spark, monkeypatch, size):
    """Tables cost some 15 times a path; a region of up to `fan` pieces is decoded piece after piece, either model, and its scores are those of the whole."""
    monkeypatch.setattr(spans, "path_ends", lambda frame, fan, ends=spans.path_ends: ends(frame.where(F.raise_error(F.lit("a table")).isNull()), fan))
    whole = [r for r in regions() if r[0]] if size > 1 else [(a, b, c, s[:300], p[:300]) for a, b, c, s, p in regions()[:2]]
    wanted = hmm.annotate_regions(spark.createDataFrame(whole, "seq_id string, strand tinyint, region_start long, seq string, probs array<array<double>>"), 12, 0.1, min_span=12).collect()
    cut = [(i, s, at, at + k, seq[k : k + size], p[k : k + size]) for i, s, at, seq, p in whole for k in range(0, len(seq), size)]
    got = spans.annotate_pieces(spark.createDataFrame(cut, SCHEMA).repartition(5), spans.CodonModel(12, 0.1, min_span=12), fan=1000).collect()

    def plain(rows, n):
        return sorted((*r[:n], round(r["score"] or 0, 9), round(r["cds_score"], 9)) for r in rows)

    assert plain(got, 5) == plain(wanted, 5) and wanted
    parts = [older.gene(s, at)[:4] for s, at in ((("GT", "AG"), 15), (("AT", "AC"), 17), (("GC", "AG"), 16))]
    seq, classes, changes, phases = "".join(p[0] for p in parts), *(np.concatenate([p[k] for p in parts]).tolist() for k in (1, 2, 3))
    tracks = "seq string, classes array<array<double>>, changes array<array<double>>, phases array<array<double>>"
    wanted = older.hmm.annotate_regions(spark.createDataFrame([("c", -1, 50, seq, classes, changes, phases)], f"seq_id string, strand tinyint, region_start long, {tracks}"), 30, 0.2).collect()
    cut = [("c", -1, 50, 50 + k, *(x[k : k + size] for x in (seq, classes, changes, phases))) for k in range(0, len(seq), size)]
    pieces = spark.createDataFrame(cut, f"seq_id string, strand tinyint, region_start long, start long, {tracks}").repartition(3)
    assert plain(spans.annotate_pieces(pieces, spans.UntranslatedModel(30, 0.2), fan=1000).collect(), 6) == plain(wanted, 6) and wanted


def test_scores_behind_pieces_are_those_of_the_whole_to_the_bit():
    seq, p = random_case(90, 11, "ACGTN")
    whole, scores, m = hmm.exits(hmm.Columns([p], [seq]))[0], None, hmm.machine()
    for k in range(0, 90, 13):
        within = {"entries": [scores], "carried": [carried(seq, p, k, m)]} if k else {}
        scores = hmm.exits(hmm.Columns([p[k : k + 13]], [seq[k : k + 13]], **within))[0]
    assert np.array_equal(scores, whole)


def test_no_pieces_give_no_genes(spark):
    assert spans.annotate_pieces(spark.createDataFrame([], SCHEMA), spans.CodonModel()).collect() == []
