"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

A token is predicted in three factors: its class, its leaf within the class, and
the token within its leaf. The first two are softmaxes over sums of hashed
features of the tokens before (the last one, the last two, and skips over one
and two tokens); the third is the add-one share of the token among the leaf's
counts, an unknown token holding one count. A token's leaf follows from its
last two bytes, so unknown words have one too.

The hashed features live in tables of a fixed size. Beside them every token
that LEAST_SEEN places of the training texts follow is a feature of its own
for the class softmax, with its weights in the row of its count: they are as
many as the corpus has such tokens, and are never in one place.

Training goes over all training texts in every round. Each task sums the
gradient, what its tokens observe less what the model expects, for each feature
and class, and the log likelihood; Spark adds them. A weight moves by STEP times
its gradient over its expectation, which is a gradient step in units of the
curvature. Rounds end when a token's mean log likelihood gains less than
LEAST_GAIN, after ROUNDS at the latest. A last pass does one such step for the
features of single tokens. For scoring, texts are dealt into blocks of bounded
size, each block asks for the counts and weights of its distinct tokens by a
join, and is scored with them in numpy batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Words, checkpointed, mix, slices

CLASSES = 16
LEAVES = CLASSES * CLASSES
#: Rows of the weight tables: features of the class softmax, and features by class of the leaf softmax.
FEATURES, LEAF_FEATURES = 1 << 13, 1 << 9
#: Most gradient rounds over all training texts, and the least gain of one (log10 a token) that has another one follow.
#: Two more rounds would raise the likelihood of training texts by 0.03 a token, that of held-out ones by 0.002.
ROUNDS, LEAST_GAIN = 2, 0.002
#: Counts added to an expectation before a gradient is divided by it, the parts of that which a weight moves by, and the most it moves.
DAMPING, STEP, LEAF_STEP, MOST_STEP = 4.0, 0.5, 0.8, 2.0
#: Places in the training texts that a token must stand before to be a feature of its own.
LEAST_SEEN = 8
#: Its weights are kept as bytes, so many to one.
UNITS = 32
#: Most bits of the bitmap that tells tasks which tokens may be such features (16 MB); if it is too full, more are summed for nothing.
MOST_BITS = 1 << 27
#: Text that a block holds, about.
BLOCK_BYTES = 24 << 20
#: Tokens that a task collects before it sends its requests.
MOST_ASKED = 1 << 22

END, START = np.uint64(0xE0D0E0D0E0D0E0D1), np.uint64(0x57A2757A2757A271)
_BYTES = 2 << 20
_TOKENS, _SMALL = 1 << 16, 1 << 14
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(128) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += np.uint64(32)


def leaves(words: Words) -> np.ndarray:
    """Each word's leaf, 1 to LEAVES - 1, by its last two bytes before any punctuation; leaf 0 is the end's."""
    if not len(words.start):
        return np.zeros(0, np.int64)
    end = words.end.copy()
    for _ in range(4):
        end -= (end > words.start + 1) & _PUNCTUATION[words.data[end - 1]]
    last = _LOWER[words.data[end - 1]]
    before = np.where(end - 2 >= words.start, _LOWER[words.data[np.maximum(end - 2, 0)]], np.uint64(0))
    return (mix(last * np.uint64(256) + before) % np.uint64(LEAVES - 1)).astype(np.int64) + 1


class Tokens:
    """The tokens of a batch of texts, each text's end included, with leaves and features."""

    def __init__(self, texts: pa.Array) -> None:
        words = Words(texts)
        n, texts_n = len(words.hash), len(words)
        self.first = words.first + np.arange(texts_n + 1)
        owner = np.repeat(np.arange(texts_n), np.diff(words.first))
        self.hash = np.full(n + texts_n, END)
        self.leaf = np.zeros(n + texts_n, np.int64)
        self.hash[np.arange(n) + owner] = words.hash
        self.leaf[np.arange(n) + owner] = leaves(words)
        self.place = np.arange(n + texts_n) - np.repeat(self.first[:-1], np.diff(self.first))

    def before(self, k: int) -> np.ndarray:
        out = np.full(len(self.hash), START)
        out[k:] = self.hash[:-k] if k else self.hash
        out[self.place < k] = START
        return out

    def features(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Rows of the class table and (to be joined with the class) of the leaf table."""
        one, two, three = mix(self.before(1)), self.before(2), self.before(3)
        skip, both = mix(two ^ np.uint64(11)), mix(one * np.uint64(3) + two)
        wide = [x % np.uint64(FEATURES) for x in (one, both, skip, mix(three ^ np.uint64(13)))]
        return [x.astype(np.int64) for x in wide], [(x % np.uint64(LEAF_FEATURES)).astype(np.int64) for x in (one >> np.uint64(20), skip >> np.uint64(20))]


class Weights:
    """The two weight tables and the leaves' counts."""

    def __init__(self, tokens: np.ndarray, kinds: np.ndarray) -> None:
        self.mass = tokens + kinds + 1.0
        share = np.log(self.mass / self.mass.sum()).reshape(CLASSES, CLASSES)
        self.class_prior = np.logaddexp.reduce(share, 1).astype(np.float32)
        self.leaf_prior = (share - self.class_prior[:, None]).astype(np.float32)
        self.wide = np.zeros((FEATURES, CLASSES), np.float32)
        self.narrow = np.zeros((LEAF_FEATURES * CLASSES, CLASSES), np.float32)

    def move(self, row: np.ndarray, observed: np.ndarray, expected: np.ndarray) -> None:
        step = np.clip((observed - expected) / (expected + DAMPING), -MOST_STEP, MOST_STEP).astype(np.float32)
        low = row < FEATURES
        self.wide[row[low]] += STEP * step[low]
        self.narrow[row[~low] - FEATURES] += LEAF_STEP * step[~low]


def _softmax(prior: np.ndarray, table: np.ndarray, rows: list[np.ndarray], spare: np.ndarray, out: np.ndarray, more: np.ndarray | None = None) -> None:
    """Into out: the softmax of the prior, the table's rows and `more`, summed."""
    out[:] = prior
    for r in rows:
        np.take(table, r, axis=0, out=spare[: len(r)], mode="clip")
        out += spare[: len(r)]
    if more is not None:
        out += more
    np.exp(np.clip(out, -60, 60, out=out), out=out)
    out /= out @ np.ones((CLASSES, 1), np.float32)


def _predict(w: Weights, tokens: Tokens, own: Callable[[slice], np.ndarray] | None = None) -> Iterator[tuple[slice, list[np.ndarray], np.ndarray, list[np.ndarray], np.ndarray]]:
    """By batches of tokens: feature rows and class probabilities, feature rows and leaf probabilities within the true class.

    `own` gives the class weights of a batch's single-token features.
    """
    wide, narrow = tokens.features()
    spare = np.empty((_SMALL, CLASSES), np.float32)
    for low in range(0, len(tokens.hash), _TOKENS):
        at = slice(low, min(low + _TOKENS, len(tokens.hash)))
        kind = tokens.leaf[at] // CLASSES
        rows, leaf_rows = [f[at] for f in wide], [f[at] * CLASSES + kind for f in narrow]
        p, q = (np.empty((len(kind), CLASSES), np.float32) for _ in range(2))
        for begin in range(0, len(kind), _SMALL):
            part = slice(begin, min(begin + _SMALL, len(kind)))
            _softmax(w.class_prior, w.wide, [r[part] for r in rows], spare, p[part], own(slice(low + part.start, low + part.stop)) if own else None)
            _softmax(w.leaf_prior[kind[part]], w.narrow, [r[part] for r in leaf_rows], spare, q[part])
        yield at, rows, p, leaf_rows, q


def _add(rows: list[np.ndarray], p: np.ndarray, target: np.ndarray, observed: np.ndarray, expected: np.ndarray) -> None:
    """Add what the tokens observe and expect to tables of a row per class."""
    by_class = np.ascontiguousarray(p.T, dtype=np.float64)
    size = observed.shape[1]
    for r in rows:
        observed += np.bincount(target * size + r, minlength=observed.size).reshape(observed.shape)
        for c in range(CLASSES):
            expected[c] += np.bincount(r, by_class[c], size)


#: The row of the summed log likelihood of classes and leaves.
LIKELIHOOD = -1
_SUMS = [f"{kind}{c}" for kind in ("o", "e") for c in range(CLASSES)]


def _gradients(w) -> Callable:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros((CLASSES, n)) for n in (FEATURES, LEAF_FEATURES * CLASSES) for _ in range(2)]
        likelihood = 0.0
        for whole in batches:
            for batch in slices(whole, "text", _BYTES):
                tokens = Tokens(batch.column(0))
                for at, rows, p, leaf_rows, q in _predict(w.value, tokens):
                    kind, leaf = np.divmod(tokens.leaf[at], CLASSES)
                    _add(rows, p, kind, *tables[:2])
                    _add(leaf_rows, q, leaf, *tables[2:])
                    each = np.arange(len(kind))
                    likelihood += float(np.log10(np.maximum(p[each, kind].astype(float) * q[each, leaf], 1e-30)).sum())
        seen, wanted = np.concatenate([tables[0], tables[2]], 1).T, np.concatenate([tables[1], tables[3]], 1).T
        row = np.flatnonzero(seen.any(1) | (wanted > 0).any(1))
        columns = [np.append(t[row, c], likelihood if k + c == 0 else 0.0).astype(np.float32) for k, t in enumerate((seen, wanted)) for c in range(CLASSES)]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(row, LIKELIHOOD), pa.int32()), *map(pa.array, columns)], names=["row", *_SUMS])

    return sums


def _bitmap(tokens: DataFrame) -> np.ndarray:
    """Bits at the tokens' hashes, about sixteen for each and MOST_BITS at most, as 64-bit words."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(10, (16 * tokens.count()).bit_length()))
    at = F.pmod("token", F.lit(bits))
    words = tokens.select(at.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


_OWN = [f"d{c}" for c in range(CLASSES)]


def _own_gradients(w, bitmap) -> Callable:
    """Per task and token before, how often it stands there and the gradient of its class weights, in units."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bitmap.value
        for whole in batches:
            for batch in slices(whole, "text", _BYTES * 4):
                tokens = Tokens(batch.column(0))
                before, kind = tokens.before(1), tokens.leaf // CLASSES
                at = before % np.uint64(len(words) * 64)
                may = ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool) & (tokens.place > 0)
                order = np.flatnonzero(may)
                order = order[np.argsort(before[order], kind="stable")]
                wide, _ = tokens.features()
                spare, p = np.empty((_SMALL, CLASSES), np.float32), np.empty((_SMALL, CLASSES), np.float32)
                for low in range(0, len(order), _SMALL):
                    now = order[low : low + _SMALL]
                    out = p[: len(now)]
                    _softmax(w.value.class_prior, w.value.wide, [f[now] for f in wide], spare, out)
                    np.negative(out, out=out)
                    out[np.arange(len(now)), kind[now]] += 1
                    own = before[now]
                    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    step = np.rint(UNITS * np.add.reduceat(out, first, axis=0)).astype(np.int32)
                    n = np.diff(np.append(first, len(now)))
                    yield pa.RecordBatch.from_arrays([pa.array(own[first].view(np.int64)), pa.array(n, pa.int32()), *(pa.array(step[:, c]) for c in range(CLASSES))], names=["token", "n", *_OWN])

    return sums


def _own_weights(prior: np.ndarray) -> Callable:
    """Weights of single-token features as bytes: one gradient step over the expected counts."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy()[:, None]
            d = np.column_stack([batch.column(2 + c).to_numpy() for c in range(CLASSES)]) / UNITS
            step = STEP * np.clip(d / (n * np.exp(prior) + DAMPING), -MOST_STEP, MOST_STEP)
            raw = np.rint(step * UNITS).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in raw], pa.binary())], names=["token", "weights"])

    return weigh


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", _BYTES * 4):
            tokens = Tokens(batch.column(0))
            value, first, n = np.unique(tokens.hash, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(tokens.leaf[first].astype(np.int32)), pa.array(n)], names=["token", "leaf", "n"])


class Model:
    """Token counts and single-token weights as a DataFrame (token, n, weights), the hashed weights, and the rounds' log likelihoods a token."""

    def __init__(self, counts: DataFrame, tokens: int, kinds: int, weights: Weights, gains: list[float]) -> None:
        self.counts, self.tokens, self.kinds, self.weights, self.gains = counts, tokens, kinds, weights, gains


def fit(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, least_gain: float = LEAST_GAIN, least_seen: int = LEAST_SEEN) -> Model:
    """Count and train on all rows of docs; a null text is an end alone."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.mapInArrow(_counter, "token long, leaf int, n long")
    counts = checkpointed(found.groupBy("token").agg(F.first("leaf").alias("leaf"), F.sum("n").alias("n")))
    by_leaf = counts.groupBy("leaf").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toPandas()
    n, kinds = (np.zeros(LEAVES) for _ in range(2))
    n[by_leaf["leaf"]], kinds[by_leaf["leaf"]] = by_leaf["n"], by_leaf["kinds"]
    weights, gains = Weights(n, kinds), []
    for _ in range(rounds):
        sent = context.broadcast(weights)
        task_sums = rows.mapInArrow(_gradients(sent), "row int, " + ", ".join(f"{s} float" for s in _SUMS))
        table = task_sums.groupBy("row").agg(*(F.sum(s).alias(s) for s in _SUMS)).toPandas()
        sent.unpersist()
        gains.append(float(table.loc[table["row"] == LIKELIHOOD, _SUMS[0]].sum()) / max(1.0, n.sum()))
        if len(gains) > 1 and gains[-1] - gains[-2] < least_gain:
            break
        table = table[table["row"] != LIKELIHOOD]
        sums = table[_SUMS].to_numpy()
        weights.move(table["row"].to_numpy(), sums[:, :CLASSES], sums[:, CLASSES:])
    often = counts.where(F.col("n") >= least_seen).select("token")
    sent, bitmap = context.broadcast(weights), context.broadcast(_bitmap(often))
    own = rows.mapInArrow(_own_gradients(sent, bitmap), "token long, n int, " + ", ".join(f"{d} int" for d in _OWN))
    own = own.groupBy("token").agg(F.sum("n").alias("n"), *(F.sum(d).alias(d) for d in _OWN)).where(F.col("n") >= least_seen)
    own = own.mapInArrow(_own_weights(weights.class_prior), "token long, weights binary")
    counts = checkpointed(counts.select("token", "n").join(own, "token", "left"))
    return Model(counts, int(n.sum()), int(kinds.sum()), weights, gains)


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct tokens that each block's texts ask for, or some of them twice if a partition's blocks ask for very many."""
    asked: dict[int, np.ndarray] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for b, value in asked.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), b)), pa.array(value.view(np.int64))], names=["block", "token"])
        asked.clear()

    for whole in batches:
        for batch in slices(whole, "text", _BYTES * 4):
            block = batch.column(0).to_numpy()
            tokens = Tokens(batch.column(1))
            owner = np.repeat(block, np.diff(tokens.first))
            for b in np.unique(block).tolist():
                new = np.unique(tokens.hash if len(block) == 1 else tokens.hash[owner == b])
                asked[b] = np.union1d(asked[b], new) if b in asked else new
            if sum(map(len, asked.values())) > MOST_ASKED:
                yield from sent()
    yield from sent()


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities of the whole text with its end: base_score of
    the add-one unigram model, score of the maximum-entropy model. A null text
    counts as empty. Repeated rows are each scored, those that repeat identifier
    and text in one block; no rows give no rows; other
    columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    size = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    key = F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).alias("block")
    rows = docs.select(key, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(id_col).alias("id")).repartition("block")
    # All columns, so that the texts are dealt once for both uses.
    asked = rows.mapInArrow(_requests, "block long, token long")
    known = asked.join(model.counts, "token").select("block", "token", "n", "weights")
    total, kinds = model.tokens, model.kinds
    sent = docs.sparkSession.sparkContext.broadcast(model.weights)

    def score(texts: pa.Table, counts: pa.Table) -> pa.Table:
        w = sent.value
        token = counts.column("token").to_numpy().view(np.uint64)
        order = np.argsort(token)
        token, n = np.append(token[order], END), np.append(counts.column("n").to_numpy()[order], 0).astype(float)
        # The row behind the last is that of tokens without weights.
        own = np.zeros((len(token), CLASSES), np.float32)
        raw = counts.column("weights").take(pa.array(order))
        some = np.flatnonzero(raw.is_valid().to_numpy(zero_copy_only=False))
        own[some] = np.frombuffer(b"".join(raw.drop_null().to_pylist()), np.int8).reshape(-1, CLASSES).astype(np.float32) / UNITS
        out = []
        for chunk in texts.combine_chunks().to_batches():
            for batch in slices(chunk, "text", _BYTES):
                t = Tokens(batch.column(batch.schema.names.index("text")))
                at = np.searchsorted(token[:-1], t.hash)
                c = np.where(token[at] == t.hash, n[at], 0.0)
                base = np.log10((c + 1) / (total + kinds + 1))
                full = np.log10((c + 1) / w.mass[t.leaf])
                last = np.append(len(token) - 1, np.where(token[at] == t.hash, at, len(token) - 1)[:-1])
                last[t.place == 0] = len(token) - 1
                for where, _, p, _, q in _predict(w, t, lambda part, last=last: own[last[part]]):
                    k, leaf = np.divmod(t.leaf[where], CLASSES)
                    each = np.arange(len(k))
                    full[where] += np.log10(np.maximum(p[each, k].astype(float) * q[each, leaf], 1e-30))
                first = t.first[:-1]
                sums = [np.add.reduceat(v, first) if len(first) else v[:0] for v in (c > 0, base, full)]
                out.append(pa.table({"id": batch.column(batch.schema.names.index("id")), "n_tokens": np.diff(t.first), "n_known": sums[0].astype(np.int64), "base_score": sums[1], "score": sums[2]}))
        return pa.concat_tables(out) if out else pa.table({"id": texts.column("id"), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})

    out = rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
