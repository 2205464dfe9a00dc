"""Decoding of regions in pieces: bounded memory, and one region over many tasks.

A region of a few pieces is decoded by one task, piece after piece: forward, the
scores at every piece's edge are kept and nothing else; backward, each piece is
decoded from those with the state that the piece behind it comes from. Many
regions go side by side, and paths are those of the whole recurrence bit by bit.

Longer regions are dealt over tasks. A decoder's step is linear in (max, +). So each piece of a region has a table of
the best scores from every state before it to every state at its end, whoever
computes it; tables of FAN neighbours multiply into one, level by level, until a
region is one. On the way down every table learns the scores that its part
starts from and the state that it ends in, at last each piece. Those are the
scores kept at every piece's edge: with them a piece is decoded on its own,
backward pointers and all, and no task ever holds more than a few pieces or FAN
tables.

A region of one piece is decoded as it is. A piece's path is the whole region's path there, but for ties: where two paths
score the same up to rounding, the pieces may take the other one.

Genes that end within a piece are whole. Those that reach an edge are fragments,
at most two a piece; fragments that touch are chained and make one gene.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandloom.operators import hmm, hmm_utr
from strandloom.operators.tracks import PACKED, arrays, packed, unpack
from strandloom.session import stored

FAN = 64
#: Bases of a region that one task decodes piece after piece, in up to FAN pieces.
ALONE = 1 << 18
#: Rows of what pieces learn from their region that are sent to all tasks; more are joined by key. One has a number for each state.
BROADCAST_ROWS = 20_000

KEYS = ["seq_id", "strand", "region_start"]
#: Bases of regions that a task decodes, and how many of them it holds at a time, in cells.
TASK_BASES, HELD_BASES = 1 << 22, 1 << 21
_RUNS = "array<struct<kind:int,start:bigint,end:bigint,total:double>>"


Run = tuple[int, int, int, float]  # kind, first and last position, sum of probabilities


class Model(Protocol):
    """A decoder, as far as pieces need it. A row is a piece: seq, its tracks as arrays by base, what beside() gave it, and `first`."""

    tracks: tuple[str, ...]
    schema: str
    kinds: tuple[pa.DataType, ...]

    def own(self) -> dict[str, Column]:
        """Narrow columns of a piece that its neighbours ask for."""

    def beside(self, order: WindowSpec) -> dict[str, Column]:
        """What a piece needs of the pieces before and behind it, of their own() columns."""

    #: beside() for a region's first piece, and for the piece behind an opened one; `right`, the first base behind a piece, is given apart.
    outset: dict

    def after(self, row: dict) -> dict: ...

    def bytes_per_base(self) -> int: ...

    def table(self, row: dict) -> np.ndarray: ...

    def columns(self, rows: list[dict], entries: list[np.ndarray] | None) -> hmm.Columns | hmm_utr.Columns:
        """Pieces side by side; entries are the states' scores before them, none for those that begin their regions."""

    def runs(self, row: dict, path: np.ndarray) -> list[Run]: ...

    def gene(self, seq_id: str, strand: int, runs: list[Run]) -> list[tuple]:
        """The rows of schema that a gene's runs make; none where it does not pass the filters."""


class CodonModel:
    """The decoder of operators.hmm over five class probabilities a base (probs)."""

    tracks, schema, kinds = ("probs",), hmm.GENES, hmm.GENE_KINDS
    outset = {"carried": None}

    def __init__(self, min_length: int = 60, min_score: float = 0.5, min_intron: int = 1, min_span: int = 200) -> None:
        self.filters, self.min_intron = (min_length, min_score, min_span), min_intron

    def own(self) -> dict[str, Column]:
        """The probability of a start codon's G at the piece's last G."""
        m = hmm.machine()
        # The base at which a region begins takes no step.
        skip = F.when(F.col("start") == F.col("region_start"), 1).otherwise(0)
        letters = F.upper(F.col("seq"))
        at = F.length("seq") - F.instr(F.reverse(letters), "G") + 1
        place = F.element_at(F.get("probs", (at - 1).cast("int")), int(m.emits[m.number["start2"]]) + 1)
        return {"g": F.when(F.contains(letters, F.lit("G")) & (at > skip), place).cast("double")}

    def beside(self, order: WindowSpec) -> dict[str, Column]:
        return {"carried": F.last("g", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))}

    def after(self, row: dict) -> dict:
        # The base at which a region begins takes no step.
        at = row["seq"].upper().rfind("G")
        m = hmm.machine()
        return {"carried": float(row["probs"][at, m.emits[m.number["start2"]]]) if at >= row["first"] else row["carried"]}

    def bytes_per_base(self) -> int:
        return 8 * (len(hmm.machine(self.min_intron).names) + 10)

    def _weight(self, row: dict) -> float:
        with np.errstate(divide="ignore"):
            return -np.inf if row["carried"] is None else float(hmm.start_weight(np.log(row["carried"])))

    def table(self, row: dict) -> np.ndarray:
        return hmm.transfer(row["probs"], row["seq"], self.min_intron, carried=self._weight(row), first=row["first"])

    def columns(self, rows: list[dict], entries: list[np.ndarray] | None) -> hmm.Columns:
        within = {} if entries is None else {"entries": entries, "carried": [self._weight(r) for r in rows]}
        return hmm.Columns([r["probs"] for r in rows], [r["seq"] for r in rows], self.min_intron, **within)

    def runs(self, row: dict, path: np.ndarray) -> list[Run]:
        return hmm.runs_of(path, row["probs"], self.min_intron)

    def gene(self, seq_id: str, strand: int, runs: list[Run]) -> list[tuple]:
        gene = hmm.gene_of(runs, *self.filters)
        return hmm.gene_rows(seq_id, strand, 0, gene) if gene else []


class UntranslatedModel:
    """The decoder of operators.hmm_utr over probabilities of classes, of changes and of places in the codon."""

    tracks, schema, kinds = ("classes", "changes", "phases"), hmm_utr.PARTS, hmm_utr.PART_KINDS
    outset = {"left": "", "before": None}

    def __init__(self, min_length: int = 60, min_score: float = 0.5, min_intron: int = 1, cut_codons: bool = False) -> None:
        self.filters, self.machine = (min_length, min_score), (min_intron, cut_codons)

    def own(self) -> dict[str, Column]:
        return {"tail": F.right("seq", F.lit(2)), "head": F.left("seq", F.lit(1)), "leaving": F.slice(F.element_at("changes", -1), 1, 2).cast("array<double>")}

    def beside(self, order: WindowSpec) -> dict[str, Column]:
        none = F.lit("")
        left = F.right(F.concat(F.coalesce(F.lag("tail", 2).over(order), none), F.coalesce(F.lag("tail").over(order), none)), F.lit(2))
        return {"left": left, "right": F.coalesce(F.lead("head").over(order), none), "before": F.lag("leaving").over(order)}

    def after(self, row: dict) -> dict:
        return {"left": (row["left"] + row["seq"])[-2:], "before": row["changes"][-1, :2].tolist()}

    def bytes_per_base(self) -> int:
        return 8 * (len(hmm_utr.machine(*self.machine).names) + 12)

    def _beside(self, row: dict) -> hmm_utr.Beside:
        return hmm_utr.Beside(row["left"], row["right"], tuple(row["before"] or (1.0, 1.0)))

    def table(self, row: dict) -> np.ndarray:
        return hmm_utr.transfer(row["classes"], row["changes"], row["phases"], row["seq"], *self.machine, beside=self._beside(row), first=row["first"])

    def columns(self, rows: list[dict], entries: list[np.ndarray] | None) -> hmm_utr.Columns:
        tracks = ([r[k] for r in rows] for k in (*self.tracks, "seq"))
        return hmm_utr.Columns(*tracks, *self.machine, entries=entries, beside=[self._beside(r) for r in rows])

    def runs(self, row: dict, path: np.ndarray) -> list[Run]:
        return hmm_utr.runs_of(path, hmm_utr.coding_probabilities(row["classes"], row["phases"]), row["seq"], *self.machine)

    def gene(self, seq_id: str, strand: int, runs: list[Run]) -> list[tuple]:
        gene = hmm_utr.gene_of(runs, *self.filters)
        return hmm_utr.part_rows(seq_id, strand, 0, gene) if gene else []


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product of two tables."""
    out = np.empty((a.shape[0], b.shape[1]))
    for k in range(a.shape[0]):
        out[k] = (a[k][:, None] + b).max(0)
    return out


def _square(data: bytes) -> np.ndarray:
    flat = np.frombuffer(data, float)
    return flat.reshape(int(len(flat) ** 0.5), -1)


def _product(group: pa.Table) -> pa.Table:
    group = group.sort_by("piece")
    whole = None
    for data in group.column("table").to_pylist():
        whole = _square(data) if whole is None else times(whole, _square(data))
    first = group.slice(0, 1)
    return pa.table([*(first.column(k) for k in KEYS), first.column("above"), pa.array([whole.tobytes()])], names=[*KEYS, "piece", "table"])


def _shared_out(group: pa.Table) -> pa.Table:
    """Where each of a group's tables starts from and ends, given the group's own."""
    group = group.sort_by("piece")
    tables = [_square(data) for data in group.column("table").to_pylist()]
    scores, leave = [np.frombuffer(group.column("entry")[0].as_py(), float)], group.column("leave")[0].as_py()
    for table in tables[:-1]:
        scores.append((scores[-1][:, None] + table).max(0))
    ends = []
    for before, table in zip(reversed(scores), reversed(tables), strict=True):
        ends.append(leave)
        leave = int((before + table[:, leave]).argmax())
    return pa.table([*(group.column(k) for k in KEYS), group.column("piece"), pa.array([s.tobytes() for s in scores]), pa.array(ends[::-1], pa.int32())], names=[*KEYS, "piece", "entry", "leave"])


def path_ends(tables: DataFrame, fan: int = FAN) -> DataFrame:
    """(KEYS, piece, entry, leave) of tables (KEYS, piece, table): for each piece the scores before it and the state that the best path leaves it in.

    Pieces of a region count from 0. Regions begin and end in state 0.
    """
    kinds = {f.name: f.dataType.simpleString() for f in tables.schema}
    keys = ", ".join(f"{k} {kinds[k]}" for k in KEYS)
    levels, above = [tables], F.expr(f"piece div {fan}").alias("above")
    while (levels[-1].agg(F.max("piece")).first()[0] or 0) >= fan:
        now = levels[-1].select(*KEYS, "piece", "table", above)
        levels.append(stored(now.groupBy(*KEYS, "above").applyInArrow(_product, f"{keys}, piece bigint, table binary")))

    # A root's start depends on its number of states alone: state 0 scores nothing, the others are out of reach.
    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = []
            for data in batch.column(batch.num_columns - 1).to_pylist():
                entry = np.full(len(_square(data)), -np.inf)
                entry[0] = 0
                entries.append(entry.tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEYS), pa.array([0] * n, pa.int64()), pa.array(entries, pa.binary()), pa.array([0] * n, pa.int32())], names=[*KEYS, "above", "entry", "leave"])

    known = levels[-1].where("piece = 0").select(*KEYS, "table").mapInArrow(root, f"{keys}, above bigint, entry binary, leave int")
    for level in reversed(levels):
        now = level.select(*KEYS, "piece", "table", above).join(known, [*KEYS, "above"])
        known = now.groupBy(*KEYS, "above").applyInArrow(_shared_out, f"{keys}, piece bigint, entry binary, leave int").withColumnRenamed("piece", "above")
    return known.withColumnRenamed("above", "piece")


def _given(pieces: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """pieces with the columns of a narrow table of a row a piece at most."""
    return pieces.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on)


def joined(runs: list[dict]) -> list[Run]:
    """A gene's runs in order, those of one kind that touch as one."""
    out: list[Run] = []
    for r in runs:
        if out and out[-1][0] == r["kind"] and out[-1][2] + 1 == r["start"]:
            kind, a, _, total = out[-1]
            out[-1] = (kind, a, r["end"], total + r["total"])
        else:
            out.append((r["kind"], r["start"], r["end"], r["total"]))
    return out


def chained(genes: DataFrame) -> DataFrame:
    """(KEYS, runs) of genes and fragments (KEYS, left, right, runs): fragments that touch at an edge of pieces are one row, their runs in order.

    left and right say that a gene reaches its piece's edge there. A window sees
    fragments alone, at most two a piece.
    """
    whole = genes.where("not left and not right").select(*KEYS, "runs")
    parts = genes.where("left or right").withColumns({"begin": F.element_at("runs", 1)["start"], "until": F.element_at("runs", -1)["end"]})
    order = W.partitionBy(*KEYS).orderBy("begin")
    new = F.when(F.lag("until").over(order) + 1 == F.col("begin"), 0).otherwise(1)
    parts = parts.withColumn("new", new).withColumn("chain", F.sum("new").over(order))
    parts = parts.groupBy(*KEYS, "chain").agg(F.sort_array(F.collect_list(F.struct("begin", "runs"))).alias("parts"))
    return whole.unionByName(parts.select(*KEYS, F.flatten(F.transform("parts", lambda p: p["runs"])).alias("runs")))


def in_order(parts: DataFrame, bases: int) -> DataFrame:
    """Parts of regions of so many bases in all, a region's parts behind each other in one of many small tasks."""
    tasks = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-bases // TASK_BASES))
    return parts.repartition(tasks, *KEYS).sortWithinPartitions(*KEYS, "start")


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The parts of each region, of rows that are in order."""
    own: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if own and any(row[k] != own[0][k] for k in KEYS):
                yield own
                own = []
            own.append(row)
    if own:
        yield own


def _held(regions: Iterator[list[dict]], bases: int = HELD_BASES) -> Iterator[list[list[dict]]]:
    """Regions in groups of about so many bases, one at least."""
    now, size = [], 0
    for region in regions:
        own = sum(len(part["seq"]) for part in region)
        if now and size + own > bases:
            yield now
            now, size = [], 0
        now.append(region)
        size += own
    if now:
        yield now


def _opened(part: dict, model: Model) -> dict:
    """A part with its own stretch of the tracks in its cell."""
    low, high = part["at"], part["at"] + len(part["seq"])
    return {k: v for k, v in part.items() if k != PACKED} | {k: t[low:high].astype(float) for k, t in zip(model.tracks, unpack(part[PACKED]), strict=True)}


def _as_one(region: list[dict], model: Model) -> dict:
    """A region's parts as one piece."""
    parts = [_opened(part, model) for part in region]
    row = {k: parts[0][k] for k in (*KEYS, "start")} | {"seq": "".join(p["seq"] for p in parts), "first": True, "piece": 0, "last": True}
    return row | model.outset | {"right": ""} | {k: np.concatenate([p[k] for p in parts]) for k in model.tracks}


def _side_by_side(rows: list, length: Callable[[Any], int], model: Model, budget: int) -> Iterator[list]:
    """rows, longest first, in groups whose scores fit the budget."""
    rows = sorted(rows, key=length, reverse=True)
    while rows:
        many = max(1, budget // (model.bytes_per_base() * max(1, length(rows[0]))))
        yield rows[:many]
        rows = rows[many:]


def _placed(row: dict, path: np.ndarray, model: Model) -> list[dict]:
    """The runs of a decoded piece at their places in the contig."""
    return [{"kind": kind, "start": row["start"] + a, "end": row["start"] + b, "total": total} for kind, a, b, total in model.runs(row, path)]


def _between(runs: list[dict]) -> Iterator[list[dict]]:
    """What stands between intergenic runs."""
    now: list[dict] = []
    for run in runs:
        if run["kind"]:
            now.append(run)
        elif now:
            yield now
            now = []
    if now:
        yield now


def _batch(rows: list[tuple], model: Model) -> pa.RecordBatch:
    names = [field.split()[0] for field in model.schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(columns, model.kinds, strict=True)], names=names)


def annotate_whole(parts: DataFrame, model: Model, bases: int, budget: int = 32 << 20) -> DataFrame:
    """The rows of a model's genes over regions of `bases` in all, of which a task can decode each at once.

    parts has KEYS, start, seq, and of a packed piece the cell and the place in it where the part begins.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _held(_regions(batches)):
            out = []
            for own in _side_by_side(group, lambda region: sum(len(p["seq"]) for p in region), model, budget):
                rows = [_as_one(region, model) for region in own]
                for row, path in zip(rows, hmm.traced(model.columns(rows, None))[0], strict=True):
                    for runs in _between(_placed(row, path, model)):
                        out += model.gene(row["seq_id"], row["strand"], joined(runs))
            yield _batch(out, model)

    return in_order(parts, bases).mapInArrow(work, model.schema)


def annotate_chains(parts: DataFrame, model: Model, bases: int, budget: int = 32 << 20) -> DataFrame:
    """annotate_whole, with the scores of a single piece of each region at a time: region by region its pieces are decoded one after the other."""

    def pieces(regions: list[list[dict]], k: int) -> Iterator[tuple[list[list[dict]], list[dict], hmm.Columns | hmm_utr.Columns]]:
        for own in _side_by_side(regions, lambda region: len(region[k]["seq"]), model, budget):
            rows = [_opened(region[k], model) | {"first": k == 0} for region in own]
            yield own, rows, model.columns(rows, [r["entry"] for r in rows] if k else None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _held(_regions(batches)):
            for region in group:
                region[0] |= model.outset
                region[-1] |= {"leave": 0, "right": ""}
                for part, behind in zip(region[:-1], region[1:], strict=True):
                    part["right"] = behind["seq"][:1]
            most = max(map(len, group))
            for k in range(most - 1):
                for own, rows, columns in pieces([r for r in group if len(r) > k + 1], k):
                    for region, row, scores in zip(own, rows, hmm.exits(columns), strict=True):
                        region[k + 1] |= {"entry": scores} | model.after(row)
            for k in reversed(range(most)):
                for own, rows, columns in pieces([r for r in group if len(r) > k], k):
                    for region, row, path, came in zip(own, rows, *hmm.traced(columns, [r["leave"] for r in rows]), strict=True):
                        region[k] = {"runs": _placed(row, path, model)} | {name: row[name] for name in KEYS}
                        if k:
                            region[k - 1]["leave"] = came
            out = []
            for region in group:
                for runs in _between([run for part in region for run in part["runs"]]):
                    out += model.gene(region[0]["seq_id"], region[0]["strand"], joined(runs))
            yield _batch(out, model)

    return in_order(parts, bases).mapInArrow(work, model.schema)


def _unpacked(parts: DataFrame, tracks: tuple[str, ...]) -> DataFrame:
    """Parts with their own stretch of the tracks as arrays by base."""
    kept = [*KEYS, "start", "seq"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in tracks]
            for cell, at, seq in zip(*(batch.column(c).to_pylist() for c in (PACKED, "at", "seq")), strict=True):
                for column, track in zip(columns, unpack(cell), strict=True):
                    column.append(track[at : at + len(seq)].tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, pa.list_(pa.list_(pa.float64()))) for c in columns)], names=[*kept, *tracks])

    rows = parts.select(*kept, "at", PACKED)
    return rows.mapInArrow(work, ", ".join([*(f"{n} {t}" for n, t in rows.select(*kept).dtypes), *(f"{t} array<array<double>>" for t in tracks)]))


_PARTS = pa.schema([
    ("seq_id", pa.string()), ("strand", pa.int8()), ("region_start", pa.int64()), ("left", pa.bool_()), ("right", pa.bool_()),
    ("runs", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("total", pa.float64())]))),
])


def annotate_pieces(pieces: DataFrame, model: Model, budget: int = 32 << 20, fan: int = FAN, alone: int = ALONE) -> DataFrame:
    """The rows of a model's genes over regions in pieces (seq_id string, strand, region_start, start, seq, the model's tracks), which follow each other without a gap.

    Positions are 0-based, strand-local, ends inclusive. pieces is read three
    times; packed parts, as annotate_whole takes them, do as well. Regions of at
    most `fan` pieces and `alone` bases are decoded by a task each.
    """
    if PACKED not in pieces.columns:
        pieces = packed(pieces, model.tracks).withColumn("at", F.lit(0))
    far = (F.col("n") > fan) | (F.col("bases") > alone)
    sizes = stored(pieces.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("bases")))
    near, long = sizes.where(~far).agg(F.coalesce(F.sum("bases"), F.lit(0))).first()[0], sizes.where(far).select(*KEYS)
    many = long.count()
    long = F.broadcast(long) if many <= BROADCAST_ROWS else long
    short = annotate_chains(pieces.join(long, KEYS, "left_anti") if many else pieces, model, near, budget)
    return short.unionByName(_by_tables(stored(_unpacked(pieces.join(long, KEYS, "left_semi"), model.tracks), wide=True), model, budget, fan))


def _by_tables(pieces: DataFrame, model: Model, budget: int, fan: int) -> DataFrame:
    """annotate_pieces by tables of scores, for regions of any number of pieces; their tracks are arrays. pieces is read three times."""
    keys, narrow = "seq_id string, strand tinyint, region_start bigint", [*KEYS, "start"]
    order = W.partitionBy(*KEYS).orderBy("start")
    known = pieces.select(*narrow, *(c.alias(k) for k, c in model.own().items()))
    beside = model.beside(order)
    numbered = stored(known.select(*narrow, (F.row_number().over(order) - 1).cast("long").alias("piece"), F.lead("start").over(order).isNull().alias("last"), *(c.alias(k) for k, c in beside.items())))
    small = [*narrow, "piece", "last", *beside]
    wide = _given(pieces, numbered, narrow).select(*small, "seq", *model.tracks)

    def rows_of(batch: pa.RecordBatch, more: tuple[str, ...] = ()) -> list[dict]:
        rows = batch.select([*small, *more, "seq"]).to_pylist()
        tracks = {k: [x.astype(float) for x in arrays(batch.column(k))] for k in model.tracks}
        return [r | {"first": r["piece"] == 0} | {k: tracks[k][i] for k in tracks} for i, r in enumerate(rows)]

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(row.column(k) for k in (*KEYS, "piece")), pa.array([model.table(rows_of(row)[0]).tobytes()])], names=[*KEYS, "piece", "table"])

    # A region of one piece begins and ends as regions do: it needs no table.
    alone = numbered.where("piece = 0 and last").select(*KEYS, "piece", F.lit(None).cast("binary").alias("entry"), F.lit(0).alias("leave"))
    tables = wide.where("piece > 0 or not last").mapInArrow(tabled, f"{keys}, piece bigint, table binary")
    ends = stored(path_ends(stored(tables), fan).select(*KEYS, "piece", "entry", "leave").unionByName(alone))

    def found(row: dict, path: np.ndarray) -> Iterator[dict]:
        for now in _between(_placed(row, path, model)):
            left, right = row["piece"] > 0 and now[0]["start"] == row["start"], not row["last"] and now[-1]["end"] == row["start"] + len(path) - 1
            yield {k: row[k] for k in KEYS} | {"left": left, "right": right, "runs": now}

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            longest = max(map(len, whole.column("seq").to_pylist()), default=0)
            many = max(1, budget // (model.bytes_per_base() * max(1, longest)))
            for begin in range(0, whole.num_rows, many):
                rows, out = rows_of(whole.slice(begin, many), ("entry", "leave")), []
                for own in ([r for r in rows if r["first"]], [r for r in rows if not r["first"]]):
                    entries = None if own and own[0]["first"] else [np.frombuffer(r["entry"], float) for r in own]
                    for row, path in zip(own, hmm.traced(model.columns(own, entries), [r["leave"] for r in own])[0], strict=True):
                        out += found(row, path)
                yield pa.RecordBatch.from_pylist(out, _PARTS)

    parts = stored(_given(wide, ends, [*KEYS, "piece"]).mapInArrow(decoded, f"{keys}, left boolean, right boolean, runs {_RUNS}"))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([row for r in batch.to_pylist() for row in model.gene(r["seq_id"], r["strand"], joined(r["runs"]))], model)

    return chained(parts).mapInArrow(finished, model.schema)
