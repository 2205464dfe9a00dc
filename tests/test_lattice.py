"""The decoders' steps over listed edges, and what an annotation reads and makes once."""

import numpy as np

from strandloom.operators import hmm, hmm_utr, spans, tiling
from strandloom.operators.lattice import Lattice
from strandloom.plans import annotate as plan
from strandloom.plans.scoring import CompositionScorer


def test_best_edges_and_where_they_come_from():
    random = np.random.default_rng(3)
    for before, changed in ((hmm.machine(2).before, None), (hmm_utr.machine(2, True).before, hmm_utr.machine(2, True).changed)):
        steps, n, states = Lattice(before, changed), 40, before.shape[1]
        # Few values, so that many edges score the same.
        scores = np.round(random.normal(size=(states, n)))
        scores[random.random(scores.shape) < 0.2] = -np.inf
        weights = np.round(random.normal(size=(2, n)))
        context = random.integers(0, before.shape[0], n)
        own = before[context]
        step = 0 if changed is None else np.where(changed[context], weights[1][:, None, None], weights[0][:, None, None])
        value = np.where(own >= 0, scores.T[np.arange(n)[:, None, None], np.maximum(own, 0)] + step, -np.inf)
        held = scores[steps.state]
        best = steps.best(held if changed is None else np.concatenate([held + weights[0], held + weights[1]]), context)
        assert np.array_equal(best[steps.row], value.max(2).T)
        for state in range(states):
            came, score = steps.came(held, context, np.full(n, state), None if changed is None else weights)
            assert np.array_equal(score, value[:, state].max(1))
            assert np.array_equal(came, np.take_along_axis(own[:, state], value[:, state].argmax(1)[:, None], 1)[:, 0])


def test_fewer_numbers_a_base_than_states_times_their_most_edges():
    for m in (hmm.machine(), hmm_utr.machine()):
        assert len(m.lattice.source) < 0.55 * m.before.shape[1] * m.before.shape[2]


def test_both_strands_read_their_tiles_once(spark):
    genome = spark.createDataFrame([(1, "ACGTACGTTA")], "seq_id int, seq string")
    tiles = tiling.windows(genome, 4, 1)
    plans = tiling.both_strands(tiles, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plans
    rows = {(r["strand"], r["win_idx"]): r["seq"] for r in tiling.both_strands(tiles, 4).collect()}
    assert rows[1, 0] == "XACGTA" and rows[-1, 2] == "TACGTX" and rows[-1, 0] == "XXXTAA" and len(rows) == 6


def test_a_region_of_one_piece_needs_no_table(spark, monkeypatch):
    genome = spark.createDataFrame([(k, k, 90, bytearray(b"ATGGCGGCGGCGGCGGCGTAA" * 4 + b"ATATAT")) for k in range(3)], "seq_id int, seq_ord int, length long, seq binary")
    made = []
    tables = spans.path_ends
    monkeypatch.setattr(spans, "path_ends", lambda frame, fan: (made.append(frame.count()), tables(frame, fan))[1])
    limits = {"min_cds_score": 0.1, "min_cds_length": 3}
    rows = [sorted(map(tuple, plan.annotate(genome, CompositionScorer(5), 512, 16, whole=whole, **limits).collect()), key=str) for whole in (0, 1 << 18)]
    assert made == [0] and rows[0] == rows[1]
