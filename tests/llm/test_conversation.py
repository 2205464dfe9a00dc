import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

from pyspark.sql import functions as F

from strandloom.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, gone string, copy string, fault int"
BLANKS = " \t\n\x0b\f\r"


def data():
    random.seed(12)
    out, roles, texts = [], ["user", "assistant", "system", "tool", "", None], ["Hello there.", "Cut of", "", None, " \n\t", "Why?", "So it is! \n", "é", "\xa0", "."]
    for conv in [*range(150), None]:
        for turn in range(random.randint(0, 6)):
            number = random.choice([turn, turn, turn, turn + 1, None, -turn])
            out.append((conv, number, random.choices(roles, [5, 5, 2, 1, 1, 1])[0], random.choice(texts), "x", None, "y", 7))
    out += [(None, k, "user", texts[k], None, None, None, None) for k in range(4)]
    return [*out, out[3], out[3], *[(777, k, ["user", "assistant"][k % 2], f"{k}. " + "Long. " * 5000, None, None, None, None) for k in range(40)]]


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out[conv]
        if fate:
            text = "" if fate == 1 else re.sub(r"[.!?]", "", text) if fate == 2 else text
            out[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return {k: sorted(v, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])) for k, v in out.items()}


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        bare = text.strip(BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns, found):
    """The least (cost, audit) over all edits, by trying each, with at most two insertions in a place; and the text."""
    best = None
    ways = []
    for (_, role, text), fault in zip(turns, found):
        more = 3 * (fault == "truncated")
        each = [(4, "D", [])]
        if fault not in ("blank", "duplicate"):
            each += [(more, "K", [(role[:1], f"{role}:{text}")]), (3 + more, "R", [("u", f"user:{text}")]), (3 + more, "R", [("a", f"assistant:{text}")])]
        ways.append(each)
    places = [(0, "", []), *[(3 * len(x), "I" * len(x), [(c, {"u": "user:", "a": "assistant:"}[c]) for c in x]) for x in ("u", "a", "ua", "au")]]
    for edits in product(*[w for pair in zip([places] * len(ways), ways) for w in pair], places):
        cost = sum(e[0] for e in edits)
        if best is not None and cost > best[0]:
            continue
        said = [x for e in edits for x in e[2]]
        if re.fullmatch(r"(s?(ua)+)?", "".join(x[0] or "-" for x in said)):
            one = (cost, "".join(e[1] for e in edits), "\n".join(x[1] for x in said))
            best = one if best is None or one[:2] < best[:2] else best
    return best


def test_repairs_match_brute_force(spark):
    rows = data()
    got = {r["conv"]: r for r in repair.repaired(repair.spoiled(spark.createDataFrame(rows, SCHEMA).repartition(5))).collect()}
    wanted = damaged(rows)
    assert set(got) == set(wanted) and None in got
    kinds = Counter()
    for conv, turns in wanted.items():
        row, found = got[conv], faults(turns)
        kinds.update(found)
        assert [row[k] for k in ("blank", "duplicate", "truncated")] == [found.count(k) for k in ("blank", "duplicate", "truncated")]
        numbers = [t[0] for t in turns if t[0] is not None]
        assert row["gaps"] == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        initials = [t[1][:1] for t in turns]
        assert row["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        if len(turns) <= 4:
            cost, audit, text = cheapest(turns, found)
            assert (row["cost"], row["audit"], row["text"]) == (cost, audit, text), (conv, turns)
    assert min(kinds[k] for k in ("blank", "duplicate", "truncated", "")) > 20
    assert any(not turns and got[conv]["audit"] == "" for conv, turns in wanted.items()) and len(got[777]["text"]) > 500_000


def test_damage_is_as_stated_and_an_empty_table_stays_empty(spark):
    rows = data()
    table = repair.spoiled(spark.createDataFrame(rows, SCHEMA))
    kept = defaultdict(list)
    for r in table.where(~F.col("gone")).collect():
        kept[r["conv"]].append((r["turn"], r["role"], r["text"]))
    assert {k: Counter(v) for k, v in kept.items()} == {k: Counter(v) for k, v in damaged(rows).items() if v}
    assert repair.repaired(repair.spoiled(spark.createDataFrame([], SCHEMA))).collect() == []


def test_all_rows_lost_gives_zeros_and_an_empty_text(spark):
    lost = next(k for k in range(10_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    [row] = repair.repaired(repair.spoiled(spark.createDataFrame([(lost, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string"))).collect()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", "") and hashlib.sha256(row["text"].encode()).hexdigest().startswith("e3b0c442")
