"""Near duplicates: fast similarity sketches, banding, and exact verification.

A document is the set of its distinct five-word shingles. Its sketch places the
elements in bins round by round: in round i every element hashes to one bin and
offers the value (i, hash); a bin keeps the smallest offer. Once all bins are
full no later round can change one, so a large set needs one or two rounds. As
many rounds as bins are random; after those, round t + j offers every element
to bin j, so that every coordinate of every non-empty set is full. As with
independent minimum hashes, two sets agree in a coordinate with the probability
of their Jaccard similarity, and the share of agreeing coordinates concentrates.

Bands of coordinates give candidates; a link needs 100 * intersection >= 75 *
union on the full sets. Equal sets are one class from the start, so a group of
copies is one candidate. A bucket's members are first compared with its
smallest member. Where members of several components remain, those outside the
bucket's largest component are compared with all members, in cells of bounded
size: no pair of a bucket goes untested unless it is linked already, and no
pair is a row before it is found similar.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Words, checkpointed, components, mix, slices

SHINGLE = 5
THRESHOLD = 75  # percent
#: Coordinates a band and bands: two sets at the threshold share no band with probability 3e-7.
ROWS, BANDS = 4, 40
COORDINATES = ROWS * BANDS
#: Elements of all sets on one side of a cell, about, and what a member counts beside its own: a cell is bounded
#: in bytes however large its members are, and has at most some 2,300 of the smallest on a side.
CELL_ELEMENTS, MEMBER = 150_000, 64
#: Numbers in a table of members by shared elements.
_TABLE = 1 << 22

_ODD = np.random.default_rng(7).integers(1, 2**62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROUND = mix(np.arange(2 * COORDINATES, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))
_BAND = np.random.default_rng(8).integers(1, 2**62, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EMPTY = np.uint64(2**64 - 1)
_LOW = np.uint64(2**40 - 1)


def shingles(words: Words) -> list[np.ndarray]:
    """Each text's set of shingle hashes, sorted; a text of under five words is one shingle."""
    h = words.hash
    runs = mix(sum((h[k : len(h) - SHINGLE + 1 + k] * _ODD[k] for k in range(SHINGLE)), start=np.uint64(0))) if len(h) >= SHINGLE else np.zeros(0, np.uint64)
    out = []
    for i in range(len(words)):
        low, high = words.first[i], words.first[i + 1]
        if high - low >= SHINGLE:
            out.append(np.unique(runs[low : high - SHINGLE + 1]))
        elif high > low:
            out.append(mix(np.array([(h[low:high] * _ODD[: high - low]).sum() + np.uint64(high - low)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(elements: np.ndarray, bins: int = COORDINATES) -> np.ndarray:
    """The `bins` coordinates of a non-empty set of 64-bit elements."""
    out = np.full(bins, _EMPTY)
    done, block = 0, max(1, min(bins, ceil(1.2 * bins * log(bins + 1) / len(elements))))
    while done < bins:
        many = min(block, bins - done)
        rounds = np.arange(done, done + many, dtype=np.uint64)
        h = mix(elements[None, :] ^ _ROUND[done : done + many, None])
        offers = (rounds[:, None] << np.uint64(40)) | (h & _LOW)
        np.minimum.at(out, ((h >> np.uint64(40)) % np.uint64(bins)).astype(np.int64).ravel(), offers.ravel())
        done += many
        if out.max() != _EMPTY:
            return out
    for j in np.flatnonzero(out == _EMPTY):
        h = mix(elements ^ _ROUND[bins + j])
        out[j] = (np.uint64(bins + j) << np.uint64(40)) | (h & _LOW).min()
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    keys = (coordinates.reshape(BANDS, ROWS) * _BAND).sum(1, dtype=np.uint64)
    return mix(keys + mix(np.arange(BANDS, dtype=np.uint64)))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = shingles(Words(batch.column(1)))
            keys = [bands(sketch(s)).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))),
                ],
                names=["id", "n", "digest", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = shingles(Words(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "elements"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = np.zeros(batch.num_rows, bool)
        for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            good[i] = 100 * common >= THRESHOLD * (len(x) + len(y) - common)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))


def _common(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[rows] with sets[columns]."""
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, element, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(seen > 1) - 1
    keep = seen[element] > 1
    member, element = member[keep], shared[element[keep]]
    order = np.argsort(element, kind="stable")
    member, element = member[order], element[order]
    kind = np.float32 if max(map(len, sets)) < 1 << 24 else np.float64  # exact for such counts
    out, many = np.zeros((len(rows), len(columns)), kind), int(element[-1]) + 1 if len(element) else 0
    width = max(64, min(many, _TABLE // len(sets)))
    for low in range(0, many, width):
        a, b = np.searchsorted(element, [low, low + width])
        has = np.zeros((len(sets), width), np.float32)
        has[member[a:b], element[a:b] - low] = 1
        out += has[rows] @ has[columns].T
    return out


def _cell(table: pa.Table) -> pa.Table:
    """Of a cell's (query, member) pairs that are similar on their full sets, as many as join the components that they link, and no more.

    Every pair is tested. The members of a component are linked already, and
    what one query links is one component from then on, so a cell gives fewer
    links than it has members, however many of its pairs are similar.
    """
    ids, component, query = (table.column(c).to_numpy() for c in ("id", "component", "query"))
    sets = [np.frombuffer(e.as_buffer(), np.uint64) for e in table.column("elements")]
    n = np.array([len(s) for s in sets])
    rows, columns = np.flatnonzero(query), np.flatnonzero(~query)
    x, y = [], []
    if len(rows) and len(columns):
        common = _common(sets, rows, columns)
        group = np.unique(component, return_inverse=True)[1]
        for i, shared in zip(rows, common, strict=True):
            shared = shared.astype(np.int64)
            similar = columns[100 * shared >= THRESHOLD * (n[i] + n[columns] - shared)]
            others, first = np.unique(group[similar], return_index=True)
            apart = others != group[i]
            if apart.any():
                x += [i] * int(apart.sum())
                y += similar[first[apart]].tolist()
                group[np.isin(group, others)] = group[i]
    return pa.table({"a": pa.array(ids[np.array(x, np.int64)], pa.int64()), "b": pa.array(ids[np.array(y, np.int64)], pa.int64())})


def _open_links(rows: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b), tested on the full sets, among a bucket's members of different components."""
    now = rows.join(links.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = now.groupBy("band", "component").agg(F.count("*").alias("c"), F.sum(F.col("n") + MEMBER).alias("size"))
    still = parts.groupBy("band").agg(F.sum("c").alias("all"), F.sum("size").alias("sizes"), F.max(F.struct("c", "component", "size")).alias("main"), F.count("*").alias("kinds"))
    across, down = F.ceil(F.col("sizes") / CELL_ELEMENTS).alias("across"), F.ceil((F.col("sizes") - F.col("main.size")) / CELL_ELEMENTS).alias("down")
    still = still.where("all > 2 and kinds > 1").select("band", F.col("main.component").alias("main"), across, down)
    left = now.join(still, "band").withColumn("h", F.xxhash64("id", "band"))
    asks = left.where("component <> main").select("band", "id", "component", F.lit(True).alias("query"), F.expr("pmod(h, down)").alias("i"), F.explode(F.expr("sequence(0L, across - 1)")).alias("j"))
    held = left.select("band", "id", "component", F.lit(False).alias("query"), F.explode(F.expr("sequence(0L, down - 1)")).alias("i"), F.expr("pmod(h, across)").alias("j"))
    return asks.union(held).join(sets, "id").groupBy("band", "i", "j").applyInArrow(_cell, "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept.

    component_id is the smallest identifier that the document reaches by links,
    its own included; kept marks the rows that carry it. Texts without words,
    null texts and rows without an identifier are linked with nothing (a null
    identifier has a null component and stays). Rows that repeat an identifier
    are returned each, and share a component as they share the identifier,
    also where their texts differ. Identifiers are whole numbers.
    A table without rows gives none. Other columns are not read.
    """
    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    seen = checkpointed(raw.mapInArrow(_sketches, "id long, n long, digest binary, bands array<long>"))
    able = seen.where("n > 0 and id is not null")
    first = able.groupBy("digest").agg(F.min(F.struct("id", "n", "bands")).alias("r")).select("r.*")
    each = first.select("id", "n", F.explode("bands").alias("band"))
    hubs = each.groupBy("band").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("many")).where("many > 1")
    rows = checkpointed(each.join(hubs.select("band", "hub"), "band"))

    need = rows.select("id").distinct()
    sets = checkpointed(raw.join(need, "id", "left_semi").mapInArrow(_sets, "id long, elements binary"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, na, nb), those that are similar on their full sets."""
        fit = pairs.where(f"a <> b and 100 * least(na, nb) >= {THRESHOLD} * greatest(na, nb)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        left = sets.select(F.col("id").alias("a"), F.col("elements").alias("x"))
        right = sets.select(F.col("id").alias("b"), F.col("elements").alias("y"))
        return fit.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long")

    # An identifier with several texts joins their classes.
    named = able.groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("many"))
    several = able.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("id")
    tied = able.join(several, "id").join(named, "digest").select(F.col("id").alias("a"), F.col("node").alias("b"))
    edges = linked(rows.select(F.col("hub.id").alias("a"), F.col("id").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb")))
    links = components(edges.union(tied))
    more = checkpointed(_open_links(rows.drop("hub"), links, sets))
    if not more.isEmpty():
        links = components(links.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    classes = named.join(links, "node", "left")
    classes = classes.where("many > 1 or component is not null").select("digest", F.coalesce("component", "node").alias("component"))
    apart = seen.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    placed = able.drop("bands").join(classes, "digest", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    return placed.union(apart).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document, the smallest identifier, of each group; all columns as they were.

    Rows whose identifier is null stay.
    """
    gone = groups(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
