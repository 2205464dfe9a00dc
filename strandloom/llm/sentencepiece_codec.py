"""SentencePiece encoding with source offsets, and decoding.

A text is normalised through the model's compiled character map: at every
position the longest prefix that the map's double-array trie holds is replaced
by its normal form, and each byte of the result records the source byte that
it came from. The normalised text is cut where no piece of the vocabulary can
reach across, and each part is merged pair by pair, the best score first and
the leftmost of equals, with single bytes for characters that the vocabulary
lacks. The pieces tile the normalised text, so their lengths and that record
project every piece to the original byte span. Ids are decoded through a table
of surfaces. The model file is read once a worker from a path that all can read.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from strandloom.llm.common import slices

MARK = "▁"
SPACE = MARK.encode()
#: Parts of a text whose pieces a worker remembers, and the longest part that it does.
MEMORY, LONGEST = 1 << 19, 48
_NEVER = float("inf")
_KINDS = sentencepiece_model_pb2.ModelProto.SentencePiece


class CharacterMap:
    """The compiled character map: a double-array trie of prefixes and their normal forms."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, np.uint32, size // 4, 4).tolist() if size else []
        self.forms = blob[4 + size :]
        self.leads = np.zeros(256, bool)
        if self.units:
            root = self._offset(self.units[0])
            for byte in range(256):
                at = root ^ byte
                self.leads[byte] = byte > 0 and at < len(self.units) and self._label(self.units[at]) == byte

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    @staticmethod
    def _label(unit: int) -> int:
        return unit & 0x800000FF

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and normal form of the longest prefix of raw[at:] in the map."""
        found, node = None, self._offset(self.units[0])
        for i in range(at, len(raw)):
            node ^= raw[i]
            if raw[i] == 0 or node >= len(self.units) or self._label(unit := self.units[node]) != raw[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                begin = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.forms[begin : self.forms.index(b"\0", begin)]
        return found


class Normaliser:
    """`fixed` are strings that stay as they are wherever they stand, the longest first."""

    def __init__(self, spec: sentencepiece_model_pb2.NormalizerSpec, suffix_space: bool = False, fixed: list[str] | None = None) -> None:
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.fixed = re.compile(b"|".join(re.escape(f.encode()) for f in fixed)) if fixed else None
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        if suffix_space:
            raise ValueError("models that mark white space at the end of words are not supported")

    def __call__(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them, and their end, the source offset."""
        data = np.frombuffer(raw, np.uint8)
        if not raw:
            return b"", np.zeros(1, np.int64)
        if self.squeeze or self.map.leads[data].any():
            data, origin = self._mapped(raw, data)
        else:
            origin = np.arange(len(data))
        end = len(raw)
        if self.squeeze:
            blank = data == 32
            first = np.flatnonzero(~blank)
            if not len(first):
                return b"", np.full(1, end)
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            keep[first[-1] + 1 :] = False
            end = int(origin[first[-1] + 1]) if first[-1] + 1 < len(origin) else end
            data, origin = data[keep], origin[keep]
        mark = SPACE if self.escape else b" "
        wide = np.where(data == 32, len(mark), 1)
        out = np.repeat(data, wide)
        if self.escape:
            at = np.repeat(np.cumsum(wide) - wide, wide)
            spaces = out == 32
            out[spaces] = np.frombuffer(mark, np.uint8)[(np.arange(len(out)) - at)[spaces]]
        origin = np.append(np.repeat(origin, wide), end)
        if self.squeeze:
            # Marks that the text itself holds at its end go with the blanks.
            last = len(out)
            while last and out[last - len(mark) : last].tobytes() == mark:
                last -= len(mark)
            out, origin = out[:last], origin[: last + 1]
        if self.dummy:
            return mark + out.tobytes(), np.concatenate([np.repeat(origin[:1], len(mark)), origin])
        return out.tobytes(), origin

    def _mapped(self, raw: bytes, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest prefixes replaced; only positions with a byte that begins a prefix are looked at."""
        parts, origins, done = [], [], 0
        kept = [m.span() for m in self.fixed.finditer(raw)][::-1] if self.fixed else []
        for at in np.flatnonzero(self.map.leads[data] & (data & 0xC0 != 0x80)).tolist():
            while kept and kept[-1][1] <= at:
                kept.pop()
            if kept and kept[-1][0] <= at:
                continue
            if at < done or (hit := self.map.longest(raw, at)) is None:
                continue
            parts += [raw[done:at], hit[1]]
            origins += [np.arange(done, at), np.full(len(hit[1]), at)]
            done = at + hit[0]
        parts.append(raw[done:])
        origins.append(np.arange(done, len(raw)))
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(origins)


class _Remembered(dict):
    """Pieces by part of a text; forgets all when it is full."""

    def __init__(self, merge: Callable[[str], list[int]]) -> None:
        self.merge = merge

    def __missing__(self, part: str) -> list[int]:
        ids = self.merge(part)
        if len(part) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[part] = ids
        return ids


class Codec:
    """One model: its normaliser, merge ranks, byte lengths and surfaces of the pieces."""

    def __init__(self, path: str) -> None:
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        if proto.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE:
            raise ValueError("only models that merge pairs are supported")
        pieces = list(enumerate(proto.pieces))
        usual = (_KINDS.NORMAL, _KINDS.USER_DEFINED, _KINDS.UNUSED)
        self.ids = {p.piece: i for i, p in pieces if p.type in usual}
        self.rank = {p.piece: -p.score for _, p in pieces if p.type in usual}
        self.unused = {p.piece for _, p in pieces if p.type == _KINDS.UNUSED}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in pieces if p.type == _KINDS.BYTE}
        self.unknown = next(i for i, p in pieces if p.type == _KINDS.UNKNOWN)
        self.end = next(i for i, p in pieces if p.type == _KINDS.CONTROL and p.piece == (proto.trainer_spec.eos_piece or "</s>"))
        fixed = sorted((p.piece for _, p in pieces if p.type == _KINDS.USER_DEFINED), key=lambda f: (-len(f), f))
        self.fixed = re.compile("(" + "|".join(map(re.escape, fixed)) + ")") if fixed else None
        spec = proto.normalizer_spec
        self.normalise = Normaliser(spec, proto.trainer_spec.treat_whitespace_as_suffix, fixed)
        # A mark behind another character can only begin a piece if none holds it further on.
        whole = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.part = re.compile(r"(?s).+" if whole else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known = _Remembered(self.merged)
        self.lengths = np.array([1 if p.type == _KINDS.BYTE else len(p.piece.encode()) if p.type in usual else 0 for _, p in pieces])
        self.surfaces = [p.piece.replace(MARK, " ").encode() if p.type in usual else b"" for _, p in pieces]
        for byte, i in self.bytes.items():
            self.surfaces[i] = bytes([byte])
        self.surfaces[self.unknown] = (proto.trainer_spec.unk_surface or " \u2047 ").encode()
        self.blanks = {i for p, i in self.ids.items() if p.startswith(MARK)}
        self.controls = {i for i, p in pieces if p.type == _KINDS.CONTROL}
        self.strip = (spec.add_dummy_prefix or spec.remove_extra_whitespaces, spec.remove_extra_whitespaces)

    def merged(self, part: str) -> list[int]:
        """The ids of one part; a character outside the vocabulary gives its bytes, or what is negative of its length for an unknown id."""
        if len(part) > LONGEST or self.fixed or self.unused:
            return self._merged_by_heap(part)
        pieces, rank = list(part), self.rank
        ranks = [rank.get(a + b, _NEVER) for a, b in pairwise(pieces)]
        while ranks and (best := min(ranks)) != _NEVER:
            i = ranks.index(best)
            pieces[i] += pieces.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(pieces[i] + pieces[i + 1], _NEVER)
            if i:
                ranks[i - 1] = rank.get(pieces[i - 1] + pieces[i], _NEVER)
        return [i for p in pieces for i in self._ids_of(p)]

    def _ids_of(self, piece: str) -> tuple[int, ...] | list[int]:
        if piece in self.ids:
            return (self.ids[piece],)
        raw = piece.encode()
        return [self.bytes[b] for b in raw] if self.bytes else (-len(raw),)

    def _merged_by_heap(self, part: str) -> list[int]:
        """The same for parts of any length, with fixed pieces and pieces that are taken apart again."""
        if self.fixed:
            pieces, frozen = [], []
            for k, run in enumerate(self.fixed.split(part)):
                own = [run] if k % 2 else list(run)
                pieces += own
                frozen += [k % 2 == 1] * len(own)
        else:
            pieces, frozen = list(part), [False] * len(part)
        n = len(pieces)
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        made: dict[str, tuple[str, str]] = {}

        def pair(i: int, j: int) -> tuple[float, int, int, str] | None:
            if i < 0 or j >= n or frozen[i] or frozen[j] or (rank := self.rank.get(piece := pieces[i] + pieces[j])) is None:
                return None
            if piece in self.unused:
                made[piece] = pieces[i], pieces[j]
            return rank, i, j, piece

        heap = [p for i in range(n - 1) if (p := pair(i, i + 1))]
        heapify(heap)
        while heap:
            _, i, j, piece = heappop(heap)
            if not pieces[i] or not pieces[j] or pieces[i] + pieces[j] != piece or behind[i] != j:
                continue
            pieces[i], pieces[j] = piece, ""
            behind[i] = behind[j]
            if behind[i] < n:
                before[behind[i]] = i
            for p in (pair(before[i], i), pair(i, behind[i])):
                if p:
                    heappush(heap, p)
        todo, out = [p for p in reversed(pieces) if p], []
        while todo:
            piece = todo.pop()
            if piece in self.unused and piece in made:
                todo += made[piece][::-1]
            else:
                out += self._ids_of(piece)
        return out

    def encode(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with an end id, and the source byte span of each; the end id's span is empty. Unknown characters in a row are one id."""
        normal, origin = self.normalise(raw)
        parts = self.part.findall(normal.decode("utf-8", "replace"))
        ids = np.fromiter(chain(chain.from_iterable(map(self.known.__getitem__, parts)), (self.end,)), np.int32)
        odd = ids < 0
        lengths = np.where(odd, -ids, self.lengths[ids])
        ends = np.cumsum(lengths)
        begins = ends - lengths
        if odd.any():
            ids[odd] = self.unknown
            first = ~(odd & np.concatenate([[False], odd[:-1]]))
            last = np.append(first[1:], True)
            ids, begins, ends = ids[first], begins[first], ends[last]
        return ids, origin[begins], origin[ends]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 give a replacement character each."""
        shown = [i for i in ids.tolist() if i not in self.controls]
        parts = [self.surfaces[i] for i in shown]
        once, more = self.strip
        for k in range(len(parts) if more else min(1, len(parts)) if once else 0):
            if shown[k] in self.blanks:
                parts[k] = parts[k][1:]
            if parts[k]:
                break
        whole = b"".join(parts)
        try:
            return whole.decode()
        except UnicodeDecodeError:
            return whole.decode("utf-8", "replace_bytes")


def _replace_bytes(error: UnicodeError) -> tuple[str, int]:
    return "\ufffd", error.start + 1


codecs.register_error("replace_bytes", _replace_bytes)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encoder(path: str, spans: bool) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                rows = [model.encode(raw) for raw in batch.column(1).cast(pa.binary()).to_pylist()]
                decoded = pa.array([model.decode(r[0]) for r in rows], pa.string())
                offsets = pa.array(np.cumsum([0, *(len(r[0]) for r in rows)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[k] for r in rows]).astype(np.int32))) for k in range(3 if spans else 1)]
                covered = pa.array([int((r[2] - r[1]).sum()) for r in rows], pa.int64())
                digest = pa.array([hashlib.sha256(np.column_stack(r[1:]).astype("<i4").tobytes()).hexdigest() for r in rows])
                names = ["id", "ids", *["begins", "ends"][: len(lists) - 1], "decoded", "n_bytes", "spans_sha256"]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists, decoded, covered, digest], names=names)

    return encode


def encoded(docs: DataFrame, model_path: str, spans: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, ids, decoded, n_bytes, spans_sha256, and with `spans` begins and ends.

    ids end with the end id and have no beginning id; begins and ends give each
    piece's byte span in the text's UTF-8; decoded is the text that the ids stand
    for; n_bytes is how many source bytes the spans cover, and spans_sha256 is
    the digest of all spans (begin, end, as 32-bit numbers, low byte first). A
    null text counts as empty: an end id alone. No rows give no rows; rows that
    repeat are returned each; other columns are not read.
    """
    kind = docs.schema[id_col].dataType
    fields = [T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if spans:
        fields += [T.StructField(name, T.ArrayType(T.IntegerType())) for name in ("begins", "ends")]
    fields += [T.StructField("decoded", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans_sha256", T.StringType())]
    raw = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return raw.mapInArrow(_encoder(model_path, spans), T.StructType(fields)).withColumnRenamed("id", id_col)


def digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_tokens, ids_sha256 (of the decimal ids joined by a blank), decoded_sha256, n_bytes, spans_sha256."""
    return pieces.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        "n_bytes",
        "spans_sha256",
    )
