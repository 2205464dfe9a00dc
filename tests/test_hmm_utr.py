import numpy as np
import pytest

from strandloom.operators import hmm_utr as hmm

EPS = 1e-64


def dense(seq, classes, changes, phases, min_intron, cut):
    """The recurrence with a whole matrix a step, its letters read from the sequence itself."""
    m = hmm.machine(min_intron, cut)
    emit, text = hmm.emissions(m, classes, phases), seq.upper()
    score = np.full(len(m.names), -np.inf)
    score[0], back = 0, []
    for t in range(1, len(seq)):
        w = np.full((len(m.names), len(m.names)), np.log(EPS))
        stay, change = np.log(np.maximum(changes[t - 1], EPS))
        donor, end = text[t : t + 2], text[t - 2 : t] if t > 1 else ""
        for a, b, changed in m.edges(text[t], donor if donor in ("GT", "GC", "AT") else "", end):
            w[m.number[a], m.number[b]] = change if changed else stay
        total = score[:, None] + w + emit[t][None, :]
        back.append(total.argmax(0))
        score = total.max(0)
    path = [0]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def random_case(n, seed, letters="ACGT"):
    rng = np.random.default_rng(seed)
    return "".join(rng.choice(list(letters), n)), rng.dirichlet([1, 1, 1, 1], n), rng.dirichlet([5, 1], n), rng.dirichlet([1, 1, 1, 1], n)


def gene(splice=("GT", "AG"), at=15, lower=False):
    """Untranslated bases, a gene with an intron after `at` coding bases, untranslated bases; nothing of it by chance."""
    body = "ATG" + "GCA" * 12 + "TAA"
    intron = splice[0] + "C" * 12 + splice[1]
    labels = [0] * 4 + [1] * 6 + [2] * at + [3] * len(intron) + [2] * (len(body) - at) + [1] * 6 + [0] * 4
    seq = "CCCC" + "CCCCCC" + body[:at] + intron + body[at:] + "CCCCCC" + "CCCC"
    classes = np.full((len(seq), 4), 0.02)
    classes[np.arange(len(seq)), labels] = 0.94
    changes = np.tile([0.95, 0.05], (len(seq), 1))
    edge = np.flatnonzero(np.diff(labels))
    changes[edge] = [0.05, 0.95]
    phases = np.full((len(seq), 4), 0.02)
    coding = np.flatnonzero(np.array(labels) == 2)
    phases[coding, [(0, 2, 1)[k % 3] for k in range(len(coding))]] = 0.94
    return seq.lower() if lower else seq, classes, changes, phases, labels


@pytest.mark.parametrize(("min_intron", "cut"), [(1, False), (4, False), (2, True)])
def test_decoding_equals_the_dense_recurrence(min_intron, cut):
    cases = [random_case(n, k, letters) for k, (n, letters) in enumerate([(1, "ACGT"), (2, "ACGT"), (3, "AGT"), (50, "ACGT"), (51, "ACGTN"), (90, "AGT"), (70, "acgtRX")])]
    cases += [gene(s, at)[:4] for s in (("GT", "AG"), ("GC", "AG"), ("AT", "AC")) for at in (15, 16, 17)]
    got = hmm.decode(*([c[k] for c in cases] for k in (1, 2, 3, 0)), min_intron, cut)
    for case, path in zip(cases, got, strict=True):
        assert path.tolist() == dense(*case, min_intron, cut)


@pytest.mark.parametrize("splice", [("GT", "AG"), ("GC", "AG"), ("AT", "AC")])
@pytest.mark.parametrize("at", [15, 16, 17])
def test_planted_genes_are_found(splice, at):
    seq, classes, changes, phases, labels = gene(splice, at)
    (path,) = hmm.decode([classes], [changes], [phases], [seq], 3)
    assert hmm.machine(3).kind[path].tolist() == labels
    coding = hmm.coding_probabilities(classes, phases)
    (found,) = hmm.structures(path, coding, seq, 30, 0.5, 3)
    assert [len(found[k]) for k in ("exon", "CDS", "intron")] == [2, 2, 1]
    assert found["exon"][0][0] == 4 and found["CDS"][0][0] == 10 and sum(b - a + 1 for a, b, _ in found["CDS"]) == 42
    assert np.isclose(found["cds_score"], 0.94)
    assert not hmm.structures(path, coding, seq, 43, 0.5, 3) and not hmm.structures(path, coding, seq, 30, 0.95, 3)
    assert hmm.structures(path, coding, seq.lower(), 30, 0.0, 3)[0]["cds_score"] == 0 and not hmm.structures(path, coding, seq.lower(), 30, 0.1, 3)


def test_introns_within_codons_only_where_they_may_be():
    seq, classes, changes, phases, labels = gene(at=2)
    for cut in (False, True):
        (path,) = hmm.decode([classes], [changes], [phases], [seq], 1, cut)
        m = hmm.machine(1, cut)
        names = [m.names[k] for k in path]
        pairs = list(zip(names, names[1:], strict=False))
        assert any(a == "start1" and b.startswith("start1.GT") for a, b in pairs) == cut
    assert len(hmm.machine(1, True).names) > len(hmm.machine(1).names)


def test_regions_as_rows(spark):
    kind = "seq_id string, strand byte, region_start long, seq string, classes array<array<double>>, changes array<array<double>>, phases array<array<double>>"
    cases = [gene(), gene(("AT", "AC"), 17), gene()]
    rows = [(f"c{k}", 1 - 2 * (k % 2), 100 * k, seq, *(x.tolist() for x in (a, b, c))) for k, (seq, a, b, c, _) in enumerate(cases)]
    rows += [("c0", 1, 0, *rows[0][3:]), ("none", 1, 0, "", [], [], []), ("one", 1, 0, "A", *(x[:1].tolist() for x in cases[0][1:4]))]
    frame = spark.createDataFrame(rows, kind)
    got = sorted(tuple(r)[:6] for r in hmm.annotate_regions(frame, 30, 0.5).collect())
    wanted = []
    for seq_id, strand, start, at in (("c0", 1, 0, 15), ("c0", 1, 0, 15), ("c1", -1, 100, 17), ("c2", 1, 200, 15)):
        cut, end = 10 + at, 10 + 42 + 16
        spans = {"exon": [(4, cut - 1), (cut + 16, end + 5)], "CDS": [(10, cut - 1), (cut + 16, end - 1)], "intron": [(cut, cut + 15)]}
        wanted += [(seq_id, strand, start + 10, kind, start + a, start + b) for kind, own in spans.items() for a, b in own]
    assert got == sorted(wanted)
    assert hmm.annotate_regions(frame.limit(0)).count() == 0
