"""Personal data: patterned identifiers, and terms that give them away.

Emails, addresses, card and phone numbers are found by their patterns; these are
the protected entities. Over the corpus, the terms of whole texts are counted
with each entity and with each kind of entity, a text and its exact copies once.
A term discloses an entity, or that there is one of its kind, if nearly all texts
with the term have it and knowing the term raises its probability by LEAST_BITS
bits. Shares are drawn to the entity's share of all texts by SMOOTHING texts, so
a single text proves nothing. So many pairs of terms and entities are looked at
that some look like that by chance: the chance of a pair's counts if term and
entity had nothing to do with each other, times the number of pairs, is at most
MOST_FALSE. Such terms are spans too, wherever they stand; they
are generalised to the kind of entity that they disclose, or removed above
REMOVE_BITS. Of several entities the one that a term tells most about counts, of
equals the later kind.

A filter of fixed size tells tasks which words may be candidates, and which texts
may be copies; counts and joins behind it are exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Words, checkpointed, slices

KINDS = ("email", "ip", "card", "phone", "term")
LEAST_SHARE, LEAST_BITS, REMOVE_BITS = 0.9, 4.0, 16.0
#: Texts that the share of an entity in all texts counts as, beside those with a term.
SMOOTHING = 0.2
#: Terms that would pass for disclosing by chance in the whole corpus, at the most. The chance of n of a term's d texts
#: having an entity is bounded by exp(-d * divergence of n/d from the entity's share) (Chernoff), the pairs by terms times entities of each text.
MOST_FALSE = 0.5
FILTER_BITS = 1 << 21
#: Text that a worker looks at in one go; its arrays are some thirty times as large.
_BYTES = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits without three dotted ones behind it has no part that does better, so only its start is tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_NO_DIGIT = str.maketrans("", "", " ().-+")
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(128) if not chr(b).isalnum()]] = True


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, by their at signs, so that long runs of letters are read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def entities(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    if not _ANY.search(text):
        return []
    found = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].translate(_NO_DIGIT)
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(m[0].translate(_NO_DIGIT)) <= 15:
            found.append((3, *m.span()))
    return found


def _terms(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the words without ASCII punctuation at their ends, and their hashes; words of under three bytes, and numbers, hash to 0."""
    start, end = words.start.copy(), words.end.copy()
    for _ in range(4):
        start += (end > start + 1) & _PUNCTUATION[words.data[start]] if len(start) else 0
        end -= (end > start + 1) & _PUNCTUATION[words.data[end - 1]] if len(end) else 0
    value = words.hashes(start, end)
    digit = np.concatenate([[0], np.cumsum((words.data >= 48) & (words.data < 58))])
    value[(end - start < 3) | (digit[end] > digit[start])] = 0
    return start, end, value


def _value(kind: int, text: str) -> int:
    """A hash of an entity whose last two bits are its kind."""
    plain = text.lower() if kind < 2 else "".join(c for c in text if c.isdigit())
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little", signed=True) & -4 | kind


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: its entities, their values, and the distinct terms of a text that has entities, those inside an entity left out."""
    for whole in batches:
        for batch in slices(whole, "text", _BYTES):
            texts = batch.column(3).to_pylist()
            spans = [entities(t) for t in texts]
            some = [i for i, s in enumerate(spans) if s]
            terms: list[np.ndarray | list] = [[] for _ in texts]
            known: list[list[int]] = [[] for _ in texts]
            if some:
                words = Words(pa.array([texts[i] for i in some], pa.string()))
                start, end, value = _terms(words)
                for k, i in enumerate(some):
                    low, high = words.first[k], words.first[k + 1]
                    free = value[low:high].copy()
                    for _, x, y in spans[i]:
                        a, b = (len(texts[i][:c].encode()) + words.at[k] for c in (x, y))
                        free[np.searchsorted(end[low:high], a, "right") : np.searchsorted(start[low:high], b)] = 0
                    terms[i] = np.unique(free[free != 0]).view(np.int64)
                    known[i] = sorted({_value(kind, texts[i][x:y]) for kind, x, y in spans[i]})
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in range(3)),
                    pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in spans], pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array(known, pa.list_(pa.int64())),
                    pa.array(terms, pa.list_(pa.int64())),
                ],
                names=["id", "key", "digest", "spans", "known", "terms"],
            )


_SPANS = "array<struct<kind:int,start:int,end:int>>"


def _filter(terms: DataFrame, column: str = "term") -> np.ndarray:
    """A filter of the terms; FILTER_BITS bits come to the driver, never more."""
    at = F.pmod(column, F.lit(FILTER_BITS))
    words = terms.select(at.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def _maybe(bits: np.ndarray, value: np.ndarray) -> np.ndarray:
    at = value % np.uint64(FILTER_BITS)
    return ((bits.view(np.uint64)[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool) & (value != 0)


def disclosing(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(term, bits, of): the terms that disclose an entity or a kind, with the entity's kind, of rows (digest, text) and their findings; rows of one digest count once."""
    spark = rows.sparkSession
    total = found.agg(F.countDistinct("digest")).first()[0]
    have = found.where("size(known) > 0").groupBy("digest").agg(F.first(F.struct("spans", "known", "terms")).alias("r")).select("digest", "r.*")
    have = checkpointed(have)

    def rare(entities: DataFrame, *more) -> DataFrame:
        """How many texts have an entity, where that leaves LEAST_BITS bits to learn."""
        return entities.groupBy("entity").agg(F.count("*").alias("with"), *more).where(F.col("with") * 2**LEAST_BITS <= total)

    kinds_of = F.array_distinct(F.transform("spans", lambda s: s["kind"]))
    pairs = have.agg(F.sum(F.size("terms").cast("long") * (F.size("known") + F.size(kinds_of)))).first()[0] or 1
    # One text's share stays below LEAST_SHARE, so values and terms of one text need no count. Values that stand in the same
    # texts have the same counts with every term: the last of them, by kind, stands for all, so a list of contacts is one value.
    values = have.select("digest", F.explode("known").alias("entity"))
    place = F.sum(F.xxhash64(F.lit(1), "digest").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(2), "digest"))
    shared = rare(values, *(c.alias(f"p{k}") for k, c in enumerate(place))).where("with > 1").groupBy("with", "p0", "p1").agg(F.max_by("entity", F.struct(F.col("entity").bitwiseAND(F.lit(3)), "entity")).alias("entity"))
    values = values.join(shared.select("entity", "with"), "entity").join(have.select("digest", "terms"), "digest").select(F.explode("terms").alias("term"), "entity", "with")
    kinds = have.select(F.explode(kinds_of).alias("entity"), "terms")
    kinds = kinds.join(F.broadcast(rare(kinds)), "entity").select(F.explode("terms").alias("term"), F.col("entity").cast("long"), "with")
    counts = checkpointed(values.groupBy("term", "entity", "with").agg(F.count("*").alias("n")).union(kinds.groupBy("term", "entity", "with").agg(F.count("*").alias("n"))).where("n > 1"))
    if counts.isEmpty():
        return spark.createDataFrame([], "term long, bits double, of int")
    bits = spark.sparkContext.broadcast(_filter(counts.select("term").distinct()))
    copies = spark.sparkContext.broadcast(_filter(found.groupBy("digest").count().where("count > 1"), "digest"))

    def dealt(again: bool):
        """Rows that may, or cannot, have copies."""

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.mod(batch.column(0).to_numpy(), FILTER_BITS)
                yield batch.filter(pa.array(((copies.value[at >> 6] >> (at & 63)) & 1).astype(bool) == again))

        return rows.mapInArrow(pick, "digest long, text string")

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _BYTES):
                words = Words(batch.column(0))
                value = _terms(words)[2]
                hit = np.flatnonzero(_maybe(bits.value, value))
                owner, term = np.searchsorted(words.first, hit, "right") - 1, value[hit]
                order = np.lexsort((owner, term))
                owner, term = owner[order], term[order]
                new = np.ones(len(term), bool)
                new[1:] = (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])
                term, n = np.unique(term[new].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(n, pa.int64())], names=["term", "docs"])

    alone, again = dealt(False).select("text"), dealt(True).groupBy("digest").agg(F.first("text").alias("text")).select("text")
    docs = alone.mapInArrow(frequency, "term long, docs long").union(again.mapInArrow(frequency, "term long, docs long")).groupBy("term").agg(F.sum("docs").alias("docs"))
    base = F.col("with") / F.lit(float(total))
    share = (F.col("n") + SMOOTHING * base) / (F.col("docs") + SMOOTHING)
    own = F.col("n") / F.col("docs")
    apart = own * F.log(own / base) + F.when(own < 1, (1 - own) * F.log((1 - own) / (1 - base))).otherwise(0.0)
    sure = F.lit(log(pairs)) - F.col("docs") * apart <= log(MOST_FALSE)
    joined = counts.join(docs, "term").where((share >= LEAST_SHARE) & sure)
    # The last two bits of an entity are its kind, and a kind is its own number.
    most = F.max(F.struct(F.log2(share / base).alias("bits"), F.col("entity").bitwiseAND(F.lit(3)).cast("int").alias("of")))
    return checkpointed(joined.groupBy("term").agg(most.alias("m")).select("term", "m.bits", "m.of").where(F.col("bits") >= LEAST_BITS))


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, key, spans (kind, start, end; code points, end exclusive), and in order the terms' bits and the kinds that they disclose (of).

    Kinds are positions in KINDS; spans are by kind and start. Matches of one
    kind do not overlap; those of different kinds may. A null or empty text has
    none. Rows that repeat are returned each, with the same spans; no rows give
    no rows; other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text).alias("key"), F.xxhash64(text).alias("digest"), text.alias("text"))
    found = checkpointed(rows.mapInArrow(_find, f"id {kind}, key long, digest long, spans {_SPANS}, known array<long>, terms array<long>"))
    terms = disclosing(rows.select("digest", "text"), found)
    base = found.select("id", "key", "spans")
    if terms.isEmpty():
        return base.select(F.col("id").alias(id_col), "key", "spans", F.expr("cast(array() as array<double>)").alias("bits"), F.expr("cast(array() as array<int>)").alias("of"))
    bits = spark.sparkContext.broadcast(_filter(terms.select("term")))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _BYTES):
                words = Words(batch.column(1))
                start, end, value = _terms(words)
                hit = np.flatnonzero(_maybe(bits.value, value))
                owner = np.searchsorted(words.first, hit, "right") - 1
                chars = np.concatenate([[0], np.cumsum(words.data & 0xC0 != 0x80)])
                zero = chars[words.at[owner]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), pa.array(value[hit].view(np.int64)), pa.array((chars[start[hit]] - zero).astype(np.int32)), pa.array((chars[end[hit]] - zero).astype(np.int32))],
                    names=["key", "term", "start", "end"],
                )

    # Rows that repeat give the same hits twice.
    seen = rows.select("key", "text").mapInArrow(hits, "key long, term long, start int, end int").distinct().join(terms, "term")
    each = F.struct(F.lit(KINDS.index("term")).alias("kind"), F.col("start"), F.col("end"), F.col("bits"), F.col("of"))
    more = seen.groupBy("key").agg(F.sort_array(F.collect_list(each)).alias("more"))
    joined = base.join(more, "key", "left")
    plain = F.transform("more", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    none = F.expr(f"cast(array() as {_SPANS})")
    bits, of = F.transform("more", lambda m: m["bits"]), F.transform("more", lambda m: m["of"])
    return joined.select(
        F.col("id").alias(id_col), "key", F.concat("spans", F.coalesce(plain, none)).alias("spans"),
        F.coalesce(bits, F.expr("cast(array() as array<double>)")).alias("bits"), F.coalesce(of, F.expr("cast(array() as array<int>)")).alias("of"),
    )


def summary(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per kind, base_sha256 of the patterned spans, and all spans as text."""
    names = F.array(*map(F.lit, KINDS))

    def text(spans) -> object:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    # A lambda of two arguments, a default counts, gets the position as the second one.
    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    base = F.filter("spans", lambda s: s["kind"] < 4)
    return rows.select(id_col, *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every entity replaced by its kind in brackets, and every term by the kind that it discloses.

    Terms above REMOVE_BITS are cut out. Where spans overlap, the one that
    begins first counts, of these the longest. A null text stays null; all
    columns as they were, whatever their names.
    """
    found = detected(docs, id_col, text_col).dropDuplicates(["key"]).select(F.col("key").alias("k"), F.struct("spans", "bits", "of").alias("found"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # The columns of docs travel in one struct, so that none can clash.
    rows = docs.select(F.xxhash64(id_col, text).alias("k"), F.struct(*docs.columns).alias("doc")).join(found, "k").select("doc", "found")
    names, at = docs.columns, docs.columns.index(text_col)

    def put(k: int, one: dict) -> str:
        term = k - (len(one["spans"]) - len(one["bits"]))
        if term >= 0 and one["bits"][term] >= REMOVE_BITS:
            return ""
        return f"[{KINDS[one['of'][term] if term >= 0 else one['spans'][k]['kind']].upper()}]"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, out = batch.column(0).flatten(), []
            for body, one in zip(own[at].to_pylist(), batch.column(1).to_pylist(), strict=True):
                if body is None:
                    out.append(None)
                    continue
                parts, done = [], 0
                for start, end, word in sorted((m["start"], -m["end"], put(k, one)) for k, m in enumerate(one["spans"])):
                    if start >= done:
                        parts += [body[done:start], word]
                    done = max(done, -end)
                out.append("".join([*parts, body[done:]]))
            columns = [pa.array(out, pa.string()) if k == at else own[k] for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(cut, docs.schema)
