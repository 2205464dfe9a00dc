"""Gene structure with untranslated regions and learned chances of a change, decoded in numpy batches.

The older gene model. A base has probabilities of four classes (intergenic,
untranslated, coding, intron), of a change of class behind it, and of the three
places in a codon. Introns are of three kinds, each a chain of states that a
donor opens and an acceptor closes; behind an intron a codon is finished before
the next may come. What no rule allows is not forbidden but costs FLOOR, so a
region always has a path. Many regions are decoded side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandloom.operators.hmm import traced
from strandloom.operators.lattice import Lattice

FLOOR = 1e-64
#: Donor and acceptor of the kinds of introns.
SPLICE = {"GT": "AG", "GC": "AG", "AT": "AC"}
#: States of an intron at least, but for GT introns between coding bases, and how much dearer an intron of another kind is.
SHORT, RARE = 2, 10.0
CODING = ("coding0", "coding1", "coding2")
#: What a codon that an intron has cut goes on with, before other introns may follow.
RESUMED = ("resumed0", "resumed1", "resumed2")
START, STOP = ("start0", "start1", "start2"), ("stop0", "stop1", "stop2", "stop3")
#: States in order of their numbers; ties go to the lower one. A stop codon is stop0, stop1 (TG) or stop2 (TA), stop3.
PLAIN = ("intergenic", "before", *START, *RESUMED, *CODING, *STOP, "behind")
#: Steps on one base, (from, to, letters): within a start or stop codon, and into it.
ON = (
    ("start0", "start1", "T"), ("start1", "start2", "G"),
    ("stop0", "stop1", "G"), ("stop0", "stop2", "A"), ("stop1", "stop3", "A"), ("stop2", "stop3", "AG"),
)
#: The probability that a state emits: coding states by their place in the codon, after which come untranslated bases, introns and what is intergenic.
_PLACE = {"start0": 0, "start1": 2, "start2": 1, "stop0": 0, "stop1": 2, "stop2": 2, "stop3": 1, "intergenic": 3, "before": 4, "behind": 4}
_PLACE |= {f"{name}{k}": place for name in ("coding", "resumed") for k, place in enumerate((0, 2, 1))}
INTRON = 5


class Machine:
    """States, emissions and edges for a least length of GT introns between coding bases.

    With cut_codons, introns may also lie within start and stop codons.
    """

    def __init__(self, min_intron: int = 1, cut_codons: bool = False) -> None:
        if min_intron < 1:
            raise ValueError("an intron has a state at least")
        #: Where an intron may lie: the state before it gives it its name.
        self.places = ("before", *CODING, "behind", *((*START[:2], *STOP[:3]) if cut_codons else ()))
        self.length = {(p, kind): min_intron if p in CODING and kind == "GT" else SHORT for p in self.places for kind in SPLICE}
        chains = [f"{p}.{kind}{k}" for (p, kind), n in self.length.items() for k in range(n)]
        self.names = [*PLAIN, *chains]
        self.number = {name: k for k, name in enumerate(self.names)}
        self.emits = np.array([_PLACE.get(name, INTRON) for name in self.names])
        self.times = np.array([RARE if "." in name and name.split(".")[1][:2] != "GT" else 1.0 for name in self.names])
        #: 0 intergenic, 1 untranslated, 2 coding, 3 intron.
        self.kind = np.array([2 if c < 3 else c - 3 if c < INTRON else 3 for c in self.emits])
        #: By context, the states before a state, lowest first, and whether the class changes; -1 fills up.
        self.contexts = [(base, donor, end) for base in "ACGT" for donor in ("", *SPLICE) for end in ("", "AG", "AC")]
        tables = [self._before(*c) for c in self.contexts]
        #: By context, the edges in order of the state they lead to: where from, whether the class changes, where each state's edges begin, and those states.
        self.steps = []
        for table in tables:
            edges = [(s, a, change) for s, own in enumerate(table) for a, change in sorted(own.items())]
            to, begin = np.unique([s for s, _, _ in edges], return_index=True)
            self.steps.append((np.array([a for _, a, _ in edges]), np.array([int(c) for _, _, c in edges]), begin, to))
        width = max(len(v) for t in tables for v in t)
        self.before = np.full((len(tables), len(self.names), width), -1)
        self.changed = np.zeros(self.before.shape, bool)
        for c, table in enumerate(tables):
            for s, own in enumerate(table):
                for k, (a, change) in enumerate(sorted(own.items())):
                    self.before[c, s, k], self.changed[c, s, k] = a, change
        self.lattice = Lattice(self.before, self.changed)

    def _before(self, base: str, donor: str, end: str) -> list[dict[int, bool]]:
        out: list[dict[int, bool]] = [{} for _ in self.names]
        for a, b, change in self.edges(base, donor, end):
            out[self.number[b]][self.number[a]] = change
        return out

    def edges(self, base: str, donor: str, end: str) -> Iterator[tuple[str, str, bool]]:
        """(from, to, whether the class changes) onto a base, with the donor that begins there and the acceptor that ends before it."""
        for state in ("intergenic", "before", "behind"):
            yield state, state, False
        yield "intergenic", "before", True
        yield "behind", "intergenic", True
        yield "stop3", "behind", True
        yield "start2", "coding0", False
        for chain in (RESUMED, CODING):
            yield from ((a, b, False) for a, b in zip(chain[:-1], chain[1:], strict=True))
            yield chain[-1], "coding0", False
        steps = [(a, b) for a, b, letters in ON if base in letters]
        yield from ((a, b, False) for a, b in steps)
        if base == "A":
            yield "before", "start0", True
        if base == "T":
            yield "coding2", "stop0", False
        for (place, kind), n in self.length.items():
            yield from ((f"{place}.{kind}{k}", f"{place}.{kind}{k + 1}", False) for k in range(n - 1))
            last = f"{place}.{kind}{n - 1}"
            yield last, last, False
            if kind == donor:
                yield place, f"{place}.{kind}0", True
                # Codons that are whole lead to introns of what they lie beside.
                for whole, beside in (("start2", "coding2"), ("stop3", "behind")):
                    if place == beside:
                        yield whole, f"{place}.{kind}0", True
            if SPLICE[kind] == end:
                yield from ((last, after, True) for after in self._after(place, base, steps))

    @staticmethod
    def _after(place: str, base: str, steps: list[tuple[str, str]]) -> Iterator[str]:
        """Where an intron leads when it ends before this base."""
        if place in ("before", "behind"):
            yield place
        if place in CODING:
            yield RESUMED[(CODING.index(place) + 1) % 3]
        if place == "before" and base == "A":
            yield "start0"
        if place == "coding2" and base == "T":
            yield "stop0"
        yield from (b for a, b in steps if a == place)


@lru_cache(maxsize=4)
def machine(min_intron: int = 1, cut_codons: bool = False) -> Machine:
    return Machine(min_intron, cut_codons)


def contexts(sequence: str, left: str = "", right: str = "") -> np.ndarray:
    """The number of each base's context in a machine's table, with what is beside a piece; letters other than A, C, G and T open no codon, as C does not."""
    if left or right:
        return contexts(left + sequence + right)[len(left) : len(left) + len(sequence)]
    text = sequence.upper()
    data = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    base = np.full(256, 1)
    base[[ord(b) for b in "AGT"]] = (0, 2, 3)
    donor, end = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    two = data[:-1].astype(np.int64) * 256 + data[1:] if len(data) > 1 else np.zeros(0, np.int64)
    for k, kind in enumerate(SPLICE, 1):
        donor[:-1][two == ord(kind[0]) * 256 + ord(kind[1])] = k
    for k, kind in enumerate(("AG", "AC"), 1):
        end[2:][two[:-1] == ord(kind[0]) * 256 + ord(kind[1])] = k
    return (base[data] * 4 + donor) * 3 + end


def coding_probabilities(classes: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """By base and phase: half the probability of the phase, half that of a coding base."""
    return (np.maximum(phases[:, :3], FLOOR) + np.maximum(classes[:, 2:3], FLOOR)) / 2


def _by_class(classes: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """Logarithms by base of the six probabilities that states emit."""
    floored = np.maximum(classes.astype(float), FLOOR)
    return np.log(np.concatenate([coding_probabilities(classes.astype(float), phases.astype(float)), floored[:, [0, 1, 3]]], 1))


def emissions(m: Machine, classes: np.ndarray, phases: np.ndarray) -> np.ndarray:
    return _by_class(classes, phases)[:, m.emits] * m.times


class Beside(NamedTuple):
    """What a piece of a region has beside it: the last two bases and the chances of the last base before it, and the first base after it."""

    left: str = ""
    right: str = ""
    changes: tuple[float, float] = (1.0, 1.0)


def transfer(classes: np.ndarray, changes: np.ndarray, phases: np.ndarray, sequence: str, min_intron: int = 1, cut_codons: bool = False, beside: Beside | None = None, first: bool = False) -> np.ndarray:
    """The best scores from each state before a sequence (rows) to each state at its end (columns); a region's first piece stays at its first base."""
    m = machine(min_intron, cut_codons)
    beside = beside or Beside()
    emit, context, closed = _by_class(classes, phases), contexts(sequence, beside.left, beside.right), float(np.log(FLOOR))
    step = np.log(np.maximum(np.concatenate([[beside.changes], changes[:-1, :2]]).astype(float), FLOOR))
    score, out = np.full((len(m.names), len(m.names)), -np.inf), np.empty((len(m.names), len(m.names)))
    np.fill_diagonal(score, 0.0)
    for t in range(1 if first else 0, len(sequence)):
        source, change, begin, to = m.steps[context[t]]
        value = score[source] + step[t, change][:, None]
        out[:] = score.max(0) + closed
        out[to] = np.maximum(out[to], np.maximum.reduceat(value, begin, axis=0))
        out += (emit[t, m.emits] * m.times)[:, None]
        score, out = out, score
    return score.T.copy()


class Columns:
    """Regions, or pieces of them, side by side, as operators.hmm.Columns has them."""

    def __init__(
        self, classes: list[np.ndarray], changes: list[np.ndarray], phases: list[np.ndarray], sequences: list[str], min_intron: int = 1, cut_codons: bool = False,
        entries: list[np.ndarray] | None = None, beside: list[Beside] | None = None,
    ) -> None:
        self.machine = m = machine(min_intron, cut_codons)
        self.order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        self.lengths = np.array([len(sequences[i]) for i in self.order], np.int64)
        self.size = int(self.lengths[0]) if len(self.order) else 0
        self.begin = 1 if entries is None else 0
        n, size, self.closed = len(self.order), self.size, float(np.log(FLOOR))
        # Seven numbers a base, whatever the number of states, and the chances of the step onto a base.
        self.emit, self.chances, self.context = np.zeros((size, 7, n)), np.zeros((size, 2, n)), np.zeros((size, n), np.int64)
        for column, i in enumerate(self.order if size else []):
            own, here = beside[i] if beside else Beside(), slice(0, self.lengths[column])
            self.emit[here, :6, column] = _by_class(classes[i], phases[i])
            self.chances[here, :, column] = np.log(np.maximum(np.concatenate([[own.changes], changes[i][:-1, :2]]).astype(float), FLOOR))
            self.context[here, column] = contexts(sequences[i], own.left, own.right)
        self.emit[:, 6] = self.emit[:, INTRON] * RARE
        self.emits = np.where(m.times == RARE, 6, m.emits)[m.lattice.state]
        self.scores = np.full((len(m.names), n), -np.inf)
        if entries is None:
            self.scores[m.lattice.row[0]] = 0
        elif n:
            self.scores[:] = np.array([entries[i] for i in self.order], float).T[m.lattice.state]
        self.both = np.empty((2 * len(m.names), n))

    def live(self, t: int) -> int:
        """How many columns have a base t."""
        return int(np.searchsorted(-self.lengths, -t, "left"))

    def step(self, t: int, before: np.ndarray) -> np.ndarray:
        """The scores behind the base t of those before it, of the columns that have it."""
        states, live = before.shape
        np.add(before, self.chances[t, 0, :live], out=self.both[:states, :live])
        np.add(before, self.chances[t, 1, :live], out=self.both[states:, :live])
        value = self.machine.lattice.best(self.both[:, :live], self.context[t, :live])
        np.maximum(value, before.max(0) + self.closed, out=value)
        value += np.take(self.emit[t, :, :live], self.emits, axis=0)
        return value

    def came(self, t: int, before: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The states before the base t on the best paths to those behind it."""
        live = before.shape[1]
        came, allowed = self.machine.lattice.came(before, self.context[t, :live], state, self.chances[t, :, :live])
        forced = before.max(0) + self.closed
        some = np.flatnonzero(forced >= allowed)
        if len(some):
            # Of equals, the lower number.
            first = before[self.machine.lattice.row][:, some].argmax(0)
            came[some] = np.where((forced[some] > allowed[some]) | (first < came[some]), first, came[some])
        return came


def decode(
    classes: list[np.ndarray], changes: list[np.ndarray], phases: list[np.ndarray], sequences: list[str], min_intron: int = 1, cut_codons: bool = False,
    entries: list[np.ndarray] | None = None, ends: list[int] | None = None, beside: list[Beside] | None = None,
) -> list[np.ndarray]:
    """The most likely states of each region; classes (length, 4), changes (length, 2: stay, change) and phases (length, 3 or more).

    A region begins and ends intergenic. The chances of a change at a base are
    those of the step that leaves it. Of a piece within a region, entries are
    the states' scores before it, ends the state that it ends in, and beside
    what its first and last bases need.
    """
    return traced(Columns(classes, changes, phases, sequences, min_intron, cut_codons, entries, beside), ends)[0]


def runs_of(states: np.ndarray, coding: np.ndarray, sequence: str, min_intron: int = 1, cut_codons: bool = False) -> list[tuple[int, int, int, float]]:
    """The runs of equal kinds of a decoded sequence: kind, first and last position, and the sum of a coding run's probabilities.

    coding holds coding_probabilities. A lower-case coding base adds nothing to a sum.
    """
    m = machine(min_intron, cut_codons)
    kind = m.kind[states]
    upper = np.array([not c.islower() for c in sequence], bool)
    p = np.where((kind == 2) & upper, coding[np.arange(len(states)), np.minimum(m.emits[states], 2)], 0.0)
    edge = np.flatnonzero(np.diff(np.concatenate([[-1], kind, [-1]])))
    return [(int(kind[a]), int(a), int(b) - 1, float(p[a:b].sum())) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def gene_of(runs: list[tuple[int, int, int, float]], min_length: int, min_score: float) -> dict | None:
    """The gene that neighbouring runs make: exons, coding runs with scores, introns, and the gene's score; None where it does not pass the filters.

    An exon is what untranslated and coding runs make that touch.
    """
    cds = [(a, b, total) for kind, a, b, total in runs if kind == 2]
    length = sum(b - a + 1 for a, b, _ in cds)
    if not cds or length < min_length:
        return None
    score = float(sum(total for _, _, total in cds) / length)
    if score < min_score:
        return None
    exons: list[tuple[int, int]] = []
    for kind, a, b, _ in runs:
        if kind != 3:
            touches = exons and exons[-1][1] + 1 == a
            exons[-1 if touches else len(exons) :] = [(exons[-1][0] if touches else a, b)]
    introns = [(a, b, None) for kind, a, b, _ in runs if kind == 3]
    return {"exon": [(a, b, None) for a, b in exons], "CDS": [(a, b, total / (b - a + 1)) for a, b, total in cds], "intron": introns, "cds_score": score}


def structures(states: np.ndarray, coding: np.ndarray, sequence: str, min_length: int, min_score: float, min_intron: int = 1, cut_codons: bool = False) -> list[dict]:
    """The genes of a decoded region that pass the filters."""
    genes, now = [], []
    for run in [*runs_of(states, coding, sequence, min_intron, cut_codons), (0, 0, 0, 0.0)]:
        if run[0]:
            now.append(run)
            continue
        gene = gene_of(now, min_length, min_score)
        genes += [gene] if gene else []
        now = []
    return genes


def part_rows(seq_id: str, strand: int, shift: int, gene: dict) -> list[tuple]:
    """A gene's exons, coding runs and introns as rows of PARTS."""
    return [(seq_id, strand, shift + gene["CDS"][0][0], kind, shift + a, shift + b, score, gene["cds_score"]) for kind in ("exon", "CDS", "intron") for a, b, score in gene[kind]]


PART_KINDS = (pa.string(), pa.int8(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
PARTS = "seq_id string, strand tinyint, gene_start long, type string, start long, end long, score double, cds_score double"


def annotate_regions(regions: DataFrame, min_length: int = 60, min_score: float = 0.5, min_intron: int = 1, cut_codons: bool = False, budget: int = 32 << 20) -> DataFrame:
    """A row per exon, coding run and intron of the genes in `regions` (seq_id, strand, region_start, seq, classes, changes, phases: arrays of arrays by base).

    Positions are 0-based, strand-local, ends inclusive; gene_start is the first
    coding base. A score stands with coding runs alone. Regions of a batch are
    decoded side by side while their tables fit the budget. No regions, or none
    with bases, give no rows.
    """

    def arrays(column: pa.Array) -> list[np.ndarray]:
        """The rows' arrays by base; those of a row have one length."""
        at, inner = column.offsets.to_numpy(), column.values.offsets.to_numpy()
        flat = column.values.values.to_numpy(zero_copy_only=False)
        return [flat[inner[a] : inner[b]].reshape(b - a, -1) if b > a else np.zeros((0, 4)) for a, b in zip(at[:-1], at[1:], strict=True)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("seq_id", "strand", "gene_start", "type", "start", "end", "score", "cds_score")
        states = len(machine(min_intron, cut_codons).names)
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in range(4)), *(arrays(batch.column(c)) for c in range(4, 7)), strict=True))
            rows.sort(key=lambda r: -len(r[3]))
            while rows:
                # The scores of all states and twelve numbers a base.
                many = max(1, budget // (8 * (states + 12) * max(1, len(rows[0][3]))))
                now, rows = rows[:many], rows[many:]
                paths = decode(*([r[k] for r in now] for k in (4, 5, 6, 3)), min_intron, cut_codons)
                out = []
                for (seq_id, strand, start, seq, classes, _, phases), path in zip(now, paths, strict=True):
                    for gene in structures(path, coding_probabilities(classes.astype(float), phases.astype(float)), seq, min_length, min_score, min_intron, cut_codons):
                        out += part_rows(seq_id, strand, start, gene)
                yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*out, strict=True) if out else [()] * len(PART_KINDS), PART_KINDS, strict=True)], names=list(names))

    return regions.select("seq_id", "strand", "region_start", "seq", "classes", "changes", "phases").mapInArrow(work, PARTS)
