"""Gene structure by a constrained hidden Markov model, decoded in numpy batches.

The states are a codon machine. Inside a coding run a state knows the place in
the codon and, as far as a stop codon may follow, its bases so far; a run that
an intron has cut keeps going in "ext" states until the codon is whole, and only
states outside those may be left for another intron. Edges are derived from that
rule base by base; decoding runs many regions side by side, a position at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandloom.operators.lattice import Lattice

#: N stands for any other letter.
BASES = "AGCTN"
STOP_CODONS = ("TAA", "TAG", "TGA")
#: Coding states by what the codon holds so far: N is any base that cannot begin or continue a stop codon.
CODING = ("CDS0", "CDS0_T", "CDS1", "CDS1_TA", "CDS1_TG", "CDS2")
#: States in order of their numbers; ties go to the lower one.
PLAIN = ("intergenic", "start0", "start1", "start2", *CODING, "end0", "end1_TA", "end1_TG", "end2", *(f"{s}_ext" for s in CODING))
START_FLOOR = log(0.1)


def grown(state: str, base: str) -> str | None:
    """The coding state after one more base; None where a stop codon would be whole."""
    if state in ("CDS2", "start2"):
        return "CDS0_T" if base == "T" else "CDS0"
    if state.startswith("CDS0"):
        return f"CDS1_T{base}" if state == "CDS0_T" and base in "AG" else "CDS1"
    return None if state.removeprefix("CDS1_") + base in STOP_CODONS else "CDS2"


class Machine:
    """States, emissions and edges for a least intron length."""

    def __init__(self, min_intron: int = 1) -> None:
        if min_intron < 1:
            raise ValueError("an intron has a state at least")
        introns = [f"{g}.{part}" for g in CODING for part in ("D0", "D1", "A0", "A1", *(f"I{k}" for k in range(min_intron)))]
        self.names = [*PLAIN, *introns]
        self.number = {name: k for k, name in enumerate(self.names)}
        #: Which class probability a state emits.
        self.emits = np.array([self._class(name) for name in self.names])
        #: 0 intergenic, 1 coding, 2 intron.
        self.kind = np.array([0 if c == 0 else 2 if c == 4 else 1 for c in self.emits])
        self.edges: dict[str, list[tuple[int, int]]] = {base: sorted({(self.number[a], self.number[b]) for a, b in self._edges(base, min_intron)}) for base in BASES}
        width = max(sum(b == s for _, b in pairs) for pairs in self.edges.values() for s in range(len(self.names)))
        #: By base and state, the states before it, lowest first; -1 fills up.
        self.before = np.full((len(BASES), len(self.names), width), -1)
        for k, base in enumerate(BASES):
            for s in range(len(self.names)):
                own = [a for a, b in self.edges[base] if b == s]
                self.before[k, s, : len(own)] = own
        self.lattice = Lattice(self.before)
        #: By base, the edges in order of the state they lead to: where from, where each state's edges begin, and those states.
        self.steps = []
        for base in BASES:
            pairs = sorted(self.edges[base], key=lambda ab: (ab[1], ab[0]))
            to, begin = np.unique([b for _, b in pairs], return_index=True)
            self.steps.append((np.array([a for a, _ in pairs]), begin, to))
        place = [{state: begin for begin, state in zip(begins.tolist(), to.tolist(), strict=True)} for _, begins, to in self.steps]
        #: Edges that pay more, as places in those of their base, with the state they lead to: into a start codon's bases, and a GC donor's second.
        self.start_edges = {k: (place[k][self.number[s]], self.number[s]) for k, s in ((0, "start0"), (3, "start1"), (1, "start2"))}
        self.donor_edges = [place[2][self.number[f"{g}.D1"]] for g in CODING]

    @staticmethod
    def _class(name: str) -> int:
        if name == "intergenic":
            return 0
        if "." in name:
            return 4
        return {"0": 1, "1": 3, "2": 2}[next(c for c in name if c.isdigit())]

    @staticmethod
    def _edges(base: str, min_intron: int) -> Iterator[tuple[str, str]]:
        yield "intergenic", "intergenic"
        yield "end2", "intergenic"
        for here, after, on in (("intergenic", "start0", "A"), ("start0", "start1", "T"), ("start1", "start2", "G"), ("CDS2", "end0", "T"), ("end0", "end1_TA", "A"), ("end0", "end1_TG", "G"), ("end1_TA", "end2", "AG"), ("end1_TG", "end2", "A")):
            if base in on:
                yield here, after
        if grown("start2", base):
            yield "start2", grown("start2", base)
        for state in CODING:
            after = grown(state, base)
            if after:
                yield state, after
                yield f"{state}_ext", after if state == "CDS2" else f"{after}_ext"
                yield f"{state}.A1", f"{after}_ext"
            last = f"{state}.I{min_intron - 1}"
            yield f"{state}.D1", f"{state}.I0"
            yield last, last
            for k in range(min_intron - 1):
                yield f"{state}.I{k}", f"{state}.I{k + 1}"
            if base == "G":
                yield state, f"{state}.D0"
                yield f"{state}.A0", f"{state}.A1"
            if base in "TC":
                yield f"{state}.D0", f"{state}.D1"
            if base == "A":
                yield last, f"{state}.A0"


@lru_cache(maxsize=4)
def machine(min_intron: int = 1) -> Machine:
    return Machine(min_intron)


def _letters(sequence: str) -> np.ndarray:
    """Numbers in BASES; -1 for letters other than A, C, G and T."""
    code = np.full(256, -1, np.int8)
    for k, b in enumerate(BASES[:4]):
        code[[ord(b), ord(b.lower())]] = k
    return code[np.frombuffer(sequence.encode("latin-1", "replace"), np.uint8)]


def start_weight(emitted: np.ndarray) -> np.ndarray:
    """What a base of a start codon pays beside its emission."""
    return np.where(emitted < START_FLOOR, 10 * emitted, 0.0)


def transfer(probabilities: np.ndarray, sequence: str, min_intron: int = 1, floor: float = 0.0, n_as_g: bool = True, carried: float = -np.inf, first: bool = False) -> np.ndarray:
    """The best scores from each state before a sequence (rows) to each state at its end (columns).

    A step of the decoder is linear in (max, +), so a region's best scores are
    its pieces' tables multiplied in that algebra, in any grouping. carried is
    the start weight of the last G before the sequence, as decode takes it; a
    region's first piece stays at its first base, where the region begins.
    """
    m = machine(min_intron)
    with np.errstate(divide="ignore"):
        emit = np.log(np.maximum(probabilities.astype(float), floor))
    letter = _letters(sequence)
    base = np.where(letter >= 0, letter, 1 if n_as_g else 4)
    paid = np.zeros(len(base))
    for b, (_, state) in m.start_edges.items():
        paid[base == b] = start_weight(emit[base == b, m.emits[state]])
    seen = np.maximum.accumulate(np.where((letter == 1) & (np.arange(len(base)) >= first), np.arange(len(base)), -1))
    last = np.where(seen >= 0, paid[np.maximum(seen, 0)], carried)
    paid = np.where(base == 1, last, paid)
    score, out = np.full((len(m.names), len(m.names)), -np.inf), np.empty((len(m.names), len(m.names)))
    np.fill_diagonal(score, 0.0)
    for t in range(1 if first else 0, len(base)):
        b = int(base[t])
        source, begin, to = m.steps[b]
        value = score[source]
        if b in m.start_edges:
            value[m.start_edges[b][0]] += paid[t]
        elif b == 2:
            value[m.donor_edges] += 1000 * emit[t, 4]
        out.fill(-np.inf)
        out[to] = np.maximum.reduceat(value, begin, axis=0) + emit[t, m.emits[to]][:, None]
        score, out = out, score
    return score.T.copy()


class Columns:
    """Regions, or pieces of them, side by side: a column each, the longest first, and the steps over their bases."""

    def __init__(
        self, probabilities: list[np.ndarray], sequences: list[str], min_intron: int = 1, floor: float = 0.0, n_as_g: bool = True,
        entries: list[np.ndarray] | None = None, carried: list[float] | None = None,
    ) -> None:
        self.machine = m = machine(min_intron)
        self.order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        self.lengths = np.array([len(sequences[i]) for i in self.order], np.int64)
        self.size = int(self.lengths[0]) if len(self.order) else 0
        #: The first base that takes a step: a region begins at its first base.
        self.begin = 1 if entries is None else 0
        n, size = len(self.order), self.size
        starts = [m.number[f"start{k}"] for k in range(3)]
        self.emit = np.full((size, 5, n), -np.inf)
        self.base = np.full((size, n), 1, np.int8)
        # What the steps into a start codon's bases and into a GC donor's second cost beside the emission.
        self.more = np.zeros((size, 4, n))
        with np.errstate(divide="ignore", invalid="ignore"):
            for column, i in enumerate(self.order if size else []):
                here = slice(0, self.lengths[column])
                own, letter = np.log(np.maximum(probabilities[i].astype(float), floor)), _letters(sequences[i])
                on = np.where(letter >= 0, letter, 1 if n_as_g else 4)
                self.emit[here, :, column], self.base[here, column] = own, on
                paid = [start_weight(own[:, m.emits[state]]) for state in starts]
                seen = np.maximum.accumulate(np.where((letter == 1) & (np.arange(len(letter)) >= self.begin), np.arange(len(letter)), -1))
                paid[2] = np.where(seen >= 0, paid[2][np.maximum(seen, 0)], -np.inf if carried is None else carried[i])
                for k, b in enumerate((0, 3, 1)):
                    self.more[here, k, column] = np.where(on == b, paid[k], 0.0)
                self.more[here, 3, column] = np.where(on == 2, 1000 * own[:, 4], 0.0)
        rows = m.lattice.row
        self.start_rows, self.donor_rows, self.emits = rows[starts], rows[[m.number[f"{g}.D1"] for g in CODING]], m.emits[m.lattice.state]
        #: The scores before the first step, a row a state.
        self.scores = np.full((len(m.names), n), -np.inf)
        if entries is None:
            self.scores[rows[0]] = 0
        elif n:
            self.scores[:] = np.array([entries[i] for i in self.order], float).T[m.lattice.state]

    def live(self, t: int) -> int:
        """How many columns have a base t."""
        return int(np.searchsorted(-self.lengths, -t, "left"))

    def step(self, t: int, before: np.ndarray) -> np.ndarray:
        """The scores behind the base t of those before it, of the columns that have it."""
        live = before.shape[1]
        value = self.machine.lattice.best(before, self.base[t, :live])
        value[self.start_rows] += self.more[t, :3, :live]
        value[self.donor_rows] += self.more[t, 3, :live]
        value += np.take(self.emit[t, :, :live], self.emits, axis=0)
        return value

    def came(self, t: int, before: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The states before the base t on the best paths to those behind it."""
        return np.maximum(self.machine.lattice.came(before, self.base[t, : before.shape[1]], state)[0], 0)


def exits(columns: Columns) -> list[np.ndarray]:
    """The scores of the states behind each piece, in the order that the pieces were given in; one row of scores is held at a time."""
    scores = columns.scores
    for t in range(columns.begin, columns.size):
        live = columns.live(t)
        scores[:, :live] = columns.step(t, scores[:, :live])
    out: list[np.ndarray] = [np.zeros(0)] * len(columns.order)
    for column, i in enumerate(columns.order):
        out[i] = scores[columns.machine.lattice.row, column]
    return out


def traced(columns: Columns, ends: list[int] | None = None) -> tuple[list[np.ndarray], list[int]]:
    """The best path through each column, and the state before it that it comes from; for regions, which begin there, 0."""
    n, size, begin = len(columns.order), columns.size, columns.begin
    if not size:
        return [np.zeros(0, np.int64) for _ in range(n)], [0] * n
    scores = np.full((size + 1 - begin, *columns.scores.shape), -np.inf)
    scores[0] = columns.scores
    # scores[t + 1 - begin] are those behind the base t.
    for t in range(begin, size):
        live = columns.live(t)
        scores[t + 1 - begin, :, :live] = columns.step(t, scores[t - begin, :, :live])
    path = np.zeros((size, n), np.int64)
    path[columns.lengths - 1, np.arange(n)] = 0 if ends is None else [ends[i] for i in columns.order]
    for t in range(size - 1, 0, -1):
        live = columns.live(t)
        path[t - 1, :live] = columns.came(t, scores[t - begin, :, :live], path[t, :live])
    before = np.zeros(n, np.int64) if begin else columns.came(0, scores[0], path[0])
    paths: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    came = [0] * n
    for column, i in enumerate(columns.order):
        paths[i], came[i] = path[: columns.lengths[column], column].copy(), int(before[column])
    return paths, came


def decode(
    probabilities: list[np.ndarray], sequences: list[str], min_intron: int = 1, floor: float = 0.0, n_as_g: bool = True,
    entries: list[np.ndarray] | None = None, ends: list[int] | None = None, carried: list[float] | None = None,
) -> list[np.ndarray]:
    """The most likely states of each region; probabilities are (length, 5).

    A region begins and ends intergenic. A start codon's bases pay ten times
    their emission where it is under 0.1, a GC donor a thousand times. Letters
    other than A, C, G and T read as G, with the start weight of the G before
    (n_as_g), or as a base that no special edge takes. Of a piece within a
    region, entries are the states' scores before it and carried is the start
    weight of the last G there; ends is the state that a piece ends in.
    """
    return traced(Columns(probabilities, sequences, min_intron, floor, n_as_g, entries, carried), ends)[0]


Run = tuple[int, int, int, float]  # kind, first and last position, sum of the emitted probabilities


def runs_of(states: np.ndarray, probabilities: np.ndarray, min_intron: int) -> list[Run]:
    """The runs of equal kinds of a decoded sequence."""
    m = machine(min_intron)
    kind = m.kind[states]
    p = probabilities[np.arange(len(states)), m.emits[states]].astype(float)
    edge = np.flatnonzero(np.diff(np.concatenate([[-1], kind, [-1]])))
    return [(int(kind[a]), int(a), int(b) - 1, float(p[a:b].sum())) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def gene_of(runs: list[Run], min_length: int, min_score: float, min_span: int) -> dict | None:
    """The gene that neighbouring runs of coding bases and introns make; None where it does not pass the filters."""
    cds = [(a, b, total) for kind, a, b, total in runs if kind == 1]
    length = sum(b - a + 1 for a, b, _ in cds)
    if not cds or length < min_length or cds[-1][1] - cds[0][0] + 1 < min_span:
        return None
    score = sum(total for _, _, total in cds) / length
    if score < min_score:
        return None
    return {"cds": [(a, b, total / (b - a + 1)) for a, b, total in cds], "introns": [(a, b) for kind, a, b, _ in runs if kind == 2], "cds_score": float(score)}


def structures(states: np.ndarray, probabilities: np.ndarray, min_length: int, min_score: float, min_intron: int, min_span: int = 200) -> list[dict]:
    """The genes of a decoded region that pass the filters: coding runs with scores, introns, and the gene's score."""
    genes, now = [], []
    for run in [*runs_of(states, probabilities, min_intron), (0, 0, 0, 0.0)]:
        if run[0]:
            now.append(run)
            continue
        gene = gene_of(now, min_length, min_score, min_span)
        genes += [gene] if gene else []
        now = []
    return genes


GENE_KINDS = (pa.string(), pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())


def gene_rows(seq_id: str, strand: int, shift: int, gene: dict) -> list[tuple]:
    """A gene's coding runs as rows of GENES."""
    return [(seq_id, strand, shift + gene["cds"][0][0], shift + a, shift + b, score, gene["cds_score"]) for a, b, score in gene["cds"]]


GENES = "seq_id string, strand tinyint, gene_start long, start long, end long, score double, cds_score double"


def annotate_regions(regions: DataFrame, min_length: int = 60, min_score: float = 0.5, min_intron: int = 1, min_span: int = 200, budget: int = 32 << 20) -> DataFrame:
    """A row per coding run of the genes in `regions` (seq_id, strand, region_start, seq, probs: an array of five-number arrays).

    Positions are 0-based, strand-local, ends inclusive. Regions of a batch are
    decoded side by side while their scores fit the budget; a failing
    region fails the job.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = len(machine(min_intron).names)
        for batch in batches:
            lists, rows = batch.column(4), []
            flat, inner, at = lists.values.values.to_numpy(zero_copy_only=False), lists.values.offsets.to_numpy(), lists.offsets.to_numpy()
            for i, row in enumerate(batch.select(["seq_id", "strand", "region_start", "seq"]).to_pylist()):
                rows.append(row | {"probs": flat[inner[at[i]] : inner[at[i + 1]]].reshape(-1, 5)})
            rows.sort(key=lambda r: -len(r["seq"]))
            while rows:
                # The scores of all states and ten numbers a base.
                many = max(1, budget // (8 * (states + 10) * max(1, len(rows[0]["seq"]))))
                now, rows = rows[:many], rows[many:]
                p = [r["probs"].astype(float) for r in now]
                out = {k: [] for k in ("seq_id", "strand", "gene_start", "start", "end", "score", "cds_score")}
                for r, own, path in zip(now, p, decode(p, [r["seq"] for r in now], min_intron), strict=True):
                    for gene in structures(path, own, min_length, min_score, min_intron, min_span):
                        for row in gene_rows(r["seq_id"], r["strand"], r["region_start"], gene):
                            for key, value in zip(out, row, strict=True):
                                out[key].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), GENE_KINDS, strict=True)], names=list(out))

    return regions.select("seq_id", "strand", "region_start", "seq", "probs").mapInArrow(work, GENES)
