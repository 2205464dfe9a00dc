import random
from itertools import product

import numpy as np
import pytest

from strandloom.operators import hmm


def emission(m, probabilities):
    with np.errstate(divide="ignore"):
        return np.log(probabilities)[:, m.emits]


def edge_weights(m, base, emit, g_before):
    """Dense weights of one step, written from the rules rather than from the decoder's tables."""
    w = np.full((len(m.names), len(m.names)), -np.inf)
    letter = base if base in "ACGT" else "G"
    for a, b in m.edges[letter]:
        w[a, b] = 0.0
    n = m.number

    def paid(state):
        return 10 * emit[n[state]] if emit[n[state]] < np.log(0.1) else 0.0

    if base == "A":
        w[n["intergenic"], n["start0"]] = paid("start0")
    if base == "T":
        w[n["start0"], n["start1"]] = paid("start1")
    if letter == "G":
        w[n["start1"], n["start2"]] = paid("start2") if base == "G" else g_before
    if base == "C":
        for g in hmm.CODING:
            w[n[f"{g}.D0"], n[f"{g}.D1"]] = 1000 * emit[n[f"{g}.D1"]]
    return w


def dense_viterbi(seq, probabilities, min_intron):
    m = hmm.machine(min_intron)
    emit = emission(m, probabilities)
    score = np.full(len(m.names), -np.inf)
    score[0], g, back = 0, -np.inf, []
    for t in range(1, len(seq)):
        w = edge_weights(m, seq[t].upper(), emit[t], g)
        if seq[t].upper() == "G":
            g = w[m.number["start1"], m.number["start2"]]
        with np.errstate(invalid="ignore"):
            total = score[:, None] + w + emit[t][None, :]
        total[np.isnan(total)] = -np.inf
        back.append(total.argmax(0))
        score = total.max(0)
    path = [0]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], score[0]


def path_score(seq, probabilities, path, min_intron):
    m = hmm.machine(min_intron)
    emit, g, total = emission(m, probabilities), -np.inf, 0.0
    for t in range(1, len(seq)):
        w = edge_weights(m, seq[t].upper(), emit[t], g)
        if seq[t].upper() == "G":
            g = w[m.number["start1"], m.number["start2"]]
        total += w[path[t - 1], path[t]] + emit[t][path[t]]
    return total


def random_case(n, seed, letters="ACGT"):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([1, 1, 1, 1, 0.7], n)
    return "".join(rng.choice(list(letters), n)), p


def gene(n_codons, intron_at=None, seed=0):
    """A start codon, codons without stops, a stop codon, between padding; maybe an intron GT..AG inside."""
    rng = random.Random(seed)
    codons = [c for c in map("".join, product("ACGT", repeat=3)) if c not in hmm.STOP_CODONS]
    body = "ATG" + "".join(rng.choice(codons) for _ in range(n_codons)) + "TAA"
    classes = [1, 2, 3][:0] + [(1, 3, 2)[k % 3] for k in range(len(body))]
    if intron_at:
        body = body[:intron_at] + "GTCCCCCCCCAG" + body[intron_at:]
        classes = classes[:intron_at] + [4] * 12 + classes[intron_at:]
    seq, classes = "CC" + body + "CC", [0, 0, *classes, 0, 0]
    p = np.full((len(seq), 5), 0.02)
    p[np.arange(len(seq)), classes] = 0.92
    return seq, p, classes


def test_machine_has_fifty_states_and_forbids_stops_in_frame():
    m = hmm.machine(1)
    assert len(m.names) == 50 and m.names[0] == "intergenic"
    for codon in map("".join, product("ACGT", repeat=3)):
        state = "CDS2"
        for base in codon:
            state = state and hmm.grown(state, base)
        assert (state is None) == (codon in hmm.STOP_CODONS)


@pytest.mark.parametrize("min_intron", [1, 3])
def test_decoding_equals_the_dense_recurrence(min_intron):
    cases = [random_case(n, seed, letters) for seed, (n, letters) in enumerate([(1, "ACGT"), (2, "ACGT"), (9, "ACGT"), (60, "ACGT"), (61, "ACGTN"), (200, "ATG"), (90, "acgtRX")])]
    cases += [gene(12, seed=k)[:2] for k in range(3)] + [gene(20, 30 + k, seed=k)[:2] for k in range(3)]
    got = hmm.decode([p for _, p in cases], [s for s, _ in cases], min_intron)
    for (seq, p), path in zip(cases, got, strict=True):
        wanted, best = dense_viterbi(seq, p, min_intron)
        assert path.tolist() == wanted
        if len(seq) > 1 and np.isfinite(best):
            assert np.isclose(path_score(seq, p, path, min_intron), best)


def test_best_path_of_enumeration():
    """All state paths of a short region, by brute force."""
    seq, p, _ = gene(1)
    seq, p = seq[1:-1], p[1:-1]
    m = hmm.machine(1)
    emit, frontier, g = emission(m, p), {(0,): 0.0}, -np.inf
    for t in range(1, len(seq)):
        w = edge_weights(m, seq[t], emit[t], g)
        g = w[m.number["start1"], m.number["start2"]] if seq[t] == "G" else g
        frontier = {(*path, j): s + w[path[-1], j] + emit[t][j] for path, s in frontier.items() for j in np.flatnonzero(np.isfinite(w[path[-1]]))}
    best = max(s for path, s in frontier.items() if path[-1] == 0)
    assert np.isclose(path_score(seq, p, hmm.decode([p], [seq])[0], 1), best)


@pytest.mark.parametrize("at", [None, 10, 11, 12])
def test_planted_genes_are_found(at):
    seq, p, classes = gene(30, at)
    path = hmm.decode([p], [seq])[0]
    kind = hmm.machine(1).kind[path]
    assert kind.tolist() == [0 if c == 0 else 2 if c == 4 else 1 for c in classes]
    found = hmm.structures(path, p, 60, 0.5, 1, 90)
    assert len(found) == 1 and len(found[0]["cds"]) == (2 if at else 1)
    assert np.isclose(found[0]["cds_score"], 0.92)
    assert sum(b - a + 1 for a, b, _ in found[0]["cds"]) % 3 == 0
    assert not hmm.structures(path, p, 60, 0.5, 1, 5000) and not hmm.structures(path, p, 600, 0.5, 1, 0) and not hmm.structures(path, p, 60, 0.95, 1, 0)


def test_decoded_genes_obey_the_code():
    for seed in range(8):
        seq, p = random_case(600, seed)
        path = hmm.decode([p], [seq])[0]
        for g in hmm.structures(path, p, 0, 0.0, 1, 0):
            spliced = "".join(seq[a : b + 1] for a, b, _ in g["cds"])
            codons = [spliced[k : k + 3] for k in range(0, len(spliced), 3)]
            assert codons[0] == "ATG" and codons[-1] in hmm.STOP_CODONS and not set(codons[:-1]) & set(hmm.STOP_CODONS)
            for a, b in g["introns"]:
                assert seq[a : a + 2] in ("GT", "GC") and seq[b - 1 : b + 1] == "AG"
