"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon transducer reads words as insults, threats, targets, negations or
marks of reported speech, each arc with a weight. Five machines (negation,
reported speech, address, insults and threats) are composed into one that reads
the classes of a clause. An insult is read as plain or, where somebody has been
addressed, as aimed; an insult or a threat may also be read as the promise of a
target behind it, and such a path lives only if the target comes. A threat
without a target is no threat. An arc weighs the word's weight times the factor
of its outcome, and a clause is scored by its best path. A text's score is a
logistic function of the outcomes on its clauses' best paths.

Insults and stems are weighted by their log odds in labelled texts; the
logistic function is fitted to the same labelled rows. Both look at no more
than LABELLED_ROWS rows, picked by a hash of the identifier; scoring reads
every text whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Words, checkpointed, slices

#: Most labelled rows that the lexicon and the weights are learned from.
LABELLED_ROWS = 40_000
#: Texts that an entry must come up in, and the least log odds that it must have: this and LABELLED_ROWS bound the lexicon.
LEAST_TEXTS, LEAST_ODDS = 4, 2.5
#: Lengths of the stems (word beginnings) that may become entries.
STEMS = (3, 4, 5, 6)

PRIOR_INSULTS = "idiot moron loser scum worthless pathetic disgusting stupid".split()
THREATS = "kill hurt destroy murder stab strangle beat töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your yours u ur du dich dir ihr euch vous toi votre tú usted ustedes he she they him her them".split()
NEGATIONS = "not never no none n't isn't aren't wasn't don't nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTS = "said says say wrote writes called calls quoted claims claimed sagte schrieb nannte dit écrit appelle dijo escribió llamó".split()

OUTCOMES = ("plain", "aimed", "negated", "reported")
FEATURES = [f"{kind}_{what}" for what in ("most", "sum") for kind in OUTCOMES] + ["threat", "clauses"]

#: What an arc with an outcome multiplies a word's weight by.
FACTORS = {"plain": 1.0, "aimed": 2.0, "negated": 0.5, "reported": 0.5}
#: Words that a negation or an address carries over, and within which a promised target must come.
NEGATED_WORDS, AIMED_WORDS = 3, 4


def _fading(reach: int) -> dict[str, str]:
    return {f"on{k}": f"on{k - 1}" if k > 1 else "off" for k in range(1, reach + 1)}


def _promise(kind: str) -> dict:
    """A machine that, once a word of the kind is read as a promise, dies unless a target comes within AIMED_WORDS words."""
    waiting = {f"wait{k}": f"wait{k - 1}" if k > 1 else None for k in range(1, AIMED_WORDS + 1)}
    on = {"target": dict.fromkeys(waiting, "off"), f"{kind}>": {"off": f"wait{AIMED_WORDS}"}}
    return {"start": "off", "final": {"off"}, "fade": waiting, "on": on}


#: Machines: "on" gives the next state by class (and state), "fade" that of any other class; a state in neither stays, None is dead.
NEGATION = {"start": "off", "fade": _fading(NEGATED_WORDS), "on": {"negation": f"on{NEGATED_WORDS}"}}
REPORT = {"start": "off", "fade": {}, "on": {"report": "on", "quote": "on"}}
ADDRESS = {"start": "off", "fade": _fading(AIMED_WORDS), "on": {"target": f"on{AIMED_WORDS}"}}
INSULT, THREAT = _promise("insult"), _promise("threat")
#: How a word of a class may be read; ">" marks the promise of a target.
READINGS = {"insult": ("insult", "insult>"), "threat": ("other", "threat", "threat>")}

_TOKEN = re.compile(r"(?P<end>[.!?;:\n|]+)|(?P<quote>[\"“”«»„])|(?P<word>[^\W\d_]+(?:['’][^\W\d_]+)*)")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: The bytes that end a clause.
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?;:\n|"]] = True


def _next(machine: dict, state: str, kind: str) -> str | None:
    to = machine["on"].get(kind)
    if isinstance(to, dict):
        to = to.get(state)
    return to if to is not None else machine["fade"].get(state, state)


def _outcome(state: tuple, kind: str) -> tuple[bool, str | None]:
    """Whether the reading is allowed in a state, and the outcome of an insult or a threat there."""
    if kind.rstrip(">") not in READINGS:
        return True, None
    negated, reported, aimed = (s != "off" for s in state[:3])
    if kind == "threat" and not aimed:
        return False, None
    return True, "reported" if reported else "negated" if negated else "aimed" if aimed or kind.endswith(">") else "plain"


def compose(*machines: dict) -> tuple[tuple, dict]:
    """The start state and the arcs (state, class) -> (state, outcome) of the machines run side by side, for all states that can be reached."""
    kinds = {"other", "insult", "insult>", "threat", "threat>", "target", "negation", "report", "quote"}
    start = tuple(m["start"] for m in machines)
    arcs, todo = {}, [start]
    seen = {start}
    while todo:
        state = todo.pop()
        for kind in kinds:
            allowed, out = _outcome(state, kind)
            to = tuple(_next(m, s, kind) for m, s in zip(machines, state, strict=True))
            if allowed and None not in to:
                arcs[state, kind] = to, out
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
    return start, arcs


START, ARCS = compose(NEGATION, REPORT, ADDRESS, INSULT, THREAT)


def best_path(clause: list[tuple[str, float]]) -> list[tuple[str, str, float]]:
    """(kind, outcome, weight) of the insults and threats on the best path of (class, weight) through the composed machine."""
    paths: dict[tuple, tuple[float, tuple]] = {START: (0.0, ())}
    for kind, weight in clause:
        now: dict[tuple, tuple[float, tuple]] = {}
        for state, (total, path) in paths.items():
            for reading in READINGS.get(kind, (kind,)):
                arc = ARCS.get((state, reading))
                if arc is None:
                    continue
                to, out = arc
                sum_ = total + weight * FACTORS[out] if out else total
                if to not in now or sum_ > now[to][0]:
                    # Paths share their beginnings, so a long clause costs no more for each word.
                    now[to] = sum_, (path, (kind, out, weight)) if out else path
        paths = now
    final = [p for state, p in paths.items() if state[3] == state[4] == "off"]
    out, path = [], max(final, key=lambda p: p[0])[1] if final else ()
    while path:
        path, step = path
        out.append(step)
    return out[::-1]


class Lexicon:
    """Words and stems with weights; a word counts as its heaviest entry."""

    def __init__(self, entries: dict[str, float]) -> None:
        fixed = [(w, "threat", 3.0) for w in THREATS] + [(w, "target", 0.0) for w in TARGETS] + [(w, "negation", 0.0) for w in NEGATIONS] + [(w, "report", 0.0) for w in REPORTS]
        self.fixed = {w: (kind, weight) for w, kind, weight in fixed}
        self.entries = entries
        #: How the words begin that an entry may fit, and those that may be a hit.
        self.heads = {e.removeprefix("=")[: STEMS[0]] for e in entries}
        self.loud = self.heads | {w[: STEMS[0]] for w in THREATS}

    def hit(self, word: str) -> bool:
        """Whether a lower-case word is an insult or a threat."""
        return word[: STEMS[0]] in self.loud and self.read(word)[0] in ("insult", "threat")

    def read(self, word: str) -> tuple[str, float]:
        """A lower-case word's class and weight."""
        if word[: STEMS[0]] not in self.heads:
            return self.fixed.get(word, ("other", 0.0))
        weight = max([self.entries.get("=" + word, 0.0), *(self.entries.get(word[:k], 0.0) for k in STEMS if len(word) >= k)])
        return ("insult", weight) if weight > 0 else self.fixed.get(word, ("other", 0.0))


def units(words: set[str]) -> set[str]:
    """What a text's words may enter the lexicon as: themselves and their stems."""
    return {"=" + w for w in words}.union(*({w[:k] for w in words if len(w) >= k} for k in STEMS))


def clauses(text: str, lexicon: Lexicon) -> np.ndarray:
    """The outcomes of a text's clauses, as FEATURES."""
    most, total = dict.fromkeys(OUTCOMES, 0.0), dict.fromkeys(OUTCOMES, 0.0)
    threat, matched, parts = 0.0, 0, [[]]
    for token in _TOKEN.finditer(text.lower()):
        if token.lastgroup == "end":
            parts.append([])
        else:
            parts[-1].append(("quote", 0.0) if token.lastgroup == "quote" else lexicon.read(token[0]))
    for part in parts:
        path = best_path(part) if any(kind in READINGS for kind, _ in part) else []
        for kind, where, weight in path:
            if kind == "threat":
                threat = max(threat, weight if where == "aimed" else 0.0)
            else:
                most[where], total[where] = max(most[where], weight), total[where] + weight
        matched += bool(path)
    return np.array([*most.values(), *np.log1p([*total.values()]), threat, np.log1p(matched)])


def _features(batch: pa.RecordBatch, lexicon: Lexicon) -> np.ndarray:
    """FEATURES of the texts in column 1; a text without an insult or a threat is all zeros.

    Only distinct words of the batch are looked up, and only clauses with a hit
    are read: others leave no outcome, and every clause begins anew.
    """
    words = Words(batch.column(1))
    _, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
    raw = words.data.tobytes()
    loud = np.zeros(len(first), bool)
    for k, (a, b) in enumerate(zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)):
        word = raw[a:b].decode("utf-8", "replace").lower()
        # A word may hold several runs of letters; each is read on its own.
        loud[k] = lexicon.hit(word) if word.isalpha() else any(map(lexicon.hit, _LETTERS.findall(word)))
    out = np.zeros((len(words), len(FEATURES)))
    if not loud.any():
        return out
    hit = np.flatnonzero(loud[back])
    owner = np.searchsorted(words.first, hit, "right") - 1
    ends = np.concatenate([[-1], np.flatnonzero(_END[words.data]), [len(words.data)]])
    low = np.maximum(ends[np.searchsorted(ends, words.start[hit]) - 1] + 1, words.at[owner])
    high = np.minimum(ends[np.searchsorted(ends, words.end[hit])], words.at[owner + 1])
    parts: dict[int, list[list[int]]] = {}
    for i, a, b in zip(owner.tolist(), low.tolist(), high.tolist(), strict=True):
        own = parts.setdefault(i, [])
        if own and a < own[-1][1]:
            own[-1][1] = max(b, own[-1][1])
        else:
            own.append([a, b])
    for i, own in parts.items():
        out[i] = clauses("\n".join(raw[a:b].decode("utf-8", "replace") for a, b in own), lexicon)
    return out


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """The rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


class Model:
    """A lexicon and logistic weights over FEATURES; the last weight is the constant."""

    #: Without labels of both kinds: an insult of weight 3 is enough, negated or reported it is not.
    PRIOR = np.array([1.5, 2.0, 0.3, 0.3, 0.0, 0.0, 0.0, 0.0, 1.5, 0.0, -4.0])

    def __init__(self, entries: dict[str, float], weights: np.ndarray | None = None) -> None:
        self.entries, self.weights = entries, self.PRIOR if weights is None else weights

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton steps for a ridge logistic fit; the constant is not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = LABELLED_ROWS) -> Model:
    """Learn from the labelled rows that are not held out, at most `most` of them."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    picked = known.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The picked labels are at most `most` rows of two numbers; their texts are read from the documents once.
    rows = checkpointed(texts.join(F.broadcast(picked), "id").select("y", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update(units(set(_LETTERS.findall(text.lower()))))
        names = sorted(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in seen)], names=["unit", "n0", "n1"])

    total = {int(r["y"]): r["count"] for r in rows.groupBy("y").count().collect()}
    prior = {"=" + w: 3.0 for w in PRIOR_INSULTS}
    if not total.get(0) or not total.get(1):
        return Model(prior)
    n0, n1 = total[0] + 1, total[1] + 1
    odds = F.log((F.col("n1") + 0.5) / n1) - F.log((F.col("n0") + 0.5) / n0)
    found = rows.mapInArrow(count, "unit string, n0 long, n1 long").groupBy("unit").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).withColumn("odds", odds)
    strong, fixed = (F.col("n1") >= LEAST_TEXTS) & (F.col("odds") >= LEAST_ODDS), F.col("unit").isin(list(prior)) & (F.col("n0") + F.col("n1") >= 4)
    picked = found.where(strong | fixed).orderBy("unit").select("unit", "odds", strong.alias("strong"), fixed.alias("fixed")).collect()
    learned = [(r["unit"], float(r["odds"])) for r in picked if r["strong"]]
    against = {r["unit"] for r in picked if r["fixed"]}
    entries = {w: p for w, p in prior.items() if w not in against} | dict(learned)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries)
        for whole in batches:
            for batch in slices(whole, "text"):
                x = _features(batch, lexicon)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k]) for k in range(len(FEATURES)))], names=["y", *FEATURES])

    table = rows.mapInArrow(measure, "y int, " + ", ".join(f"{n} double" for n in FEATURES)).toPandas()
    return Model(entries, _logistic(table[FEATURES].to_numpy(), table["y"].to_numpy(float)))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' identifiers with held_out, score (0 to 1) and predicted (1 from a score of 0.5).

    A null or empty text gets the score of a text without matches. Rows are
    returned as often as docs has them; an empty table gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(kept.value.entries)
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept.value.score(_features(batch, lexicon)))], names=["id", "score"])

    raw = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = raw.mapInArrow(score, f"id {kind}, score double").withColumnRenamed("id", id_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model predicts as toxic; all columns as they were."""
    kept = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(kept.value.entries)
        for whole in batches:
            for batch in slices(whole, text_col):
                texts = batch.column(at).cast(pa.string()).fill_null("")
                two = pa.RecordBatch.from_arrays([texts, texts], names=["id", "text"])
                yield batch.filter(pa.array(kept.value.score(_features(two, lexicon)) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
