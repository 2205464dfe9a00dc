import numpy as np
import pytest

from strandloom.operators import tracks
from strandloom.plans import annotate as plan
from strandloom.plans.scoring import CompositionScorer, CompositionTracks


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_cells_give_back_what_they_were_given(kind):
    rng = np.random.default_rng(3)
    for n in (0, 1, 700):
        given = [rng.random((n, width)).astype(kind) for width in (4, 2, 3)]
        if n:
            given[0][0, 0], given[1][-1, 1] = np.nan, -np.inf
        got = tracks.unpack(tracks.pack(given))
        assert [g.dtype for g in got] == [kind] * 3 and all(np.array_equal(a, b, equal_nan=True) for a, b in zip(got, given, strict=True))


def test_parts_of_regions_that_reach_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(plan, "CELL", 40)
    rng, whole = np.random.default_rng(5), {}
    for seq_id, strand, n in (("a", 1, 500), ("a", -1, 500), ("b", 1, 39)):
        whole[seq_id, strand] = ("".join(rng.choice(list("ACGT"), n)), rng.random((n, 5)).astype(np.float32))
    rows = [(*key, len(seq), k, seq[k : k + 64], p[k : k + 64].tolist()) for key, (seq, p) in whole.items() for k in range(0, len(seq), 64)]
    arrays = spark.createDataFrame(rows, "seq_id string, strand byte, length long, start long, seq string, probs array<array<float>>").repartition(3)
    wanted = {("a", 1, 0, 500), ("a", -1, 10, 11), ("a", -1, 64, 128), ("a", -1, 130, 490), ("b", 1, 0, 39)}
    found = spark.createDataFrame(sorted(wanted), "seq_id string, strand byte, region_start long, region_end long")
    parts: dict = {}
    for r in plan.packed_parts(found, tracks.packed(arrays, ("probs",))).collect():
        own = tracks.unpack(r["packed"])[0][r["at"] : r["at"] + len(r["seq"])]
        parts.setdefault((r["seq_id"], r["strand"], r["region_start"]), []).append((r["start"], r["seq"], own))
    for seq_id, strand, low, high in wanted:
        own = sorted(parts.pop((seq_id, strand, low)), key=lambda part: part[0])
        seq, p = whole[seq_id, strand]
        assert own[0][0] == low and "".join(s for _, s, _ in own) == seq[low:high] and np.array_equal(np.concatenate([q for _, _, q in own]), p[low:high])
    assert not parts


def test_annotation_stores_and_moves_cells(spark, monkeypatch):
    """Arrays by base were stored once and shuffled three times."""
    genome = spark.createDataFrame([(k, k, 900, bytearray(b"ATGGCGGCGGCGGCGGCGTAA" * 40 + b"AT" * 30)) for k in range(3)], "seq_id int, seq_ord int, length long, seq binary")
    kinds, shuffles, keep, cut = [], [], plan.stored, plan.packed_parts

    def stored(frame, wide=False):
        kinds.extend(k for _, k in frame.dtypes)
        return keep(frame, wide)

    def parts(found, pieces):
        out = cut(found, pieces)
        shuffles.append(out._jdf.queryExecution().optimizedPlan().toString().count("Repartition"))
        return out

    monkeypatch.setattr(plan, "stored", stored)
    monkeypatch.setattr(plan, "packed_parts", parts)
    plan.annotate(genome, CompositionScorer(), 256, 64, min_cds_score=0.1, min_cds_length=3)
    plan.annotate_tracks(genome, CompositionTracks(), "Fungi", 256, 64, min_cds_score=0.1, min_cds_length=3)
    assert kinds.count("binary") == 2 and not [k for k in kinds if k.startswith("array<array")]
    assert shuffles == [1, 1]
