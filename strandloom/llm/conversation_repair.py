"""Repair of conversations whose turns were lost, emptied, cut, repeated or given to the wrong side.

A conversation's role initials have to read `(s?(ua)+)?`: an optional system
turn, then users and assistants by turns. That pattern has four states (nothing
yet, after the system turn, after a user, after an assistant), so one fold over
a conversation's sorted turns finds the cheapest edits: `aggregate` carries one
(cost, audit) struct a state, and `least` picks among the ways into a state.
Two audits that cost the same are never the beginning of each other, as they
treat the same turns and differ at most in insertions, which cost something; so
the least prefix stays the least whatever follows.

Flags come from windows over a conversation's equal turns, which spread over
tasks by role and text. The fold and the repaired text need a conversation as
one row, as the result itself is one text a conversation. Built-in functions
only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cost of an edit: another role, no turn, one more turn, a cut text that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

_SEEN = r"[^\x20\x09-\x0D]"
_OPEN = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"
_OUT_OF_REACH = 1 << 60
#: The fold's letters: as the audit's, but with the side of an inserted or changed turn. They sort as the audit's do.
_USER_IN, _ASSISTANT_IN, _USER, _ASSISTANT = "I", "J", "R", "S"


def spoiled(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone): the rows after repeatable damage, by crc32 of `conv:turn` modulo 20.

    0 loses a row (gone; it stays for its conversation's name), 1 empties its
    text, 2 takes its full stops, exclamation and question marks, 3 repeats it,
    4 makes it the user's. A null is one blank in that name, as a role and as a
    text; conv and turn stay null.
    """
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col(conv_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank))
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), blank).alias("role"), F.coalesce(F.col(text_col).cast("string"), blank).alias("text"), (F.crc32(name) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("fate") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def flagged(rows: DataFrame) -> DataFrame:
    """rows with `fault`, each row's first: 1 blank, 2 duplicate of an earlier role and text, 3 truncated, 0 none."""
    same = W.partitionBy("conv", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first())
    fault = F.when(~F.col("text").rlike(_SEEN), 1).when(F.row_number().over(same) > 1, 2).when(F.col("text").rlike(_OPEN), 3).otherwise(0)
    return rows.withColumn("fault", fault)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _way(cost: Column | int, path: Column | str) -> Column:
    lit = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(lit(cost, "long").alias("cost"), lit(path, "string").alias("path"))


def _then(way: Column, cost: Column | int, letter: str) -> Column:
    return _way(way["cost"] + cost, F.concat(way["path"], F.lit(letter)))


def _states(none: Column, system: Column, user: Column, assistant: Column) -> Column:
    return F.struct(none.alias("none"), system.alias("system"), user.alias("user"), assistant.alias("assistant"))


def _start() -> Column:
    away = _way(_OUT_OF_REACH, "")
    return _states(_way(0, ""), away, _way(INSERT, _USER_IN), _way(2 * INSERT, _USER_IN + _ASSISTANT_IN))


def _turn(now: Column, row: Column) -> Column:
    """The cheapest ways into each state after one more turn, and after insertions behind it."""
    goes, first = row["fault"].isin(1, 2), F.substring(row["role"], 1, 1)
    extra = F.when(row["fault"] == 3, TRUNCATED).otherwise(0)

    def into(state: str, before: Column, initial: str, other: str) -> Column:
        stays = F.when(first == initial, _then(before, extra, "K")).otherwise(_then(before, extra + REROLE, other))
        return F.when(goes, _then(now[state], DELETE, "D")).otherwise(F.least(_then(now[state], DELETE, "D"), stays))

    system = F.when(~goes & (first == "s"), F.least(_then(now["system"], DELETE, "D"), _then(now["none"], extra, "K"))).otherwise(_then(now["system"], DELETE, "D"))
    user = into("user", F.least(now["none"], now["system"], now["assistant"]), "u", _USER)
    moved = _states(_then(now["none"], DELETE, "D"), system, user, into("assistant", now["user"], "a", _ASSISTANT))

    def insert(s: Column) -> Column:
        user = F.least(s["user"], _then(F.least(s["none"], s["system"], s["assistant"]), INSERT, _USER_IN))
        return _let(user, lambda u: _states(s["none"], s["system"], u, F.least(s["assistant"], _then(u, INSERT, _ASSISTANT_IN))))

    return _let(moved, insert)


def _inserted(letters: Column) -> Column:
    return F.replace(F.replace(letters, F.lit(_USER_IN), F.lit("user:\n")), F.lit(_ASSISTANT_IN), F.lit("assistant:\n"))


def _text(turns: Column, path: Column) -> Column:
    """The repaired conversation, a line feed behind each turn but the last."""

    def piece(t: Column, part: Column) -> Column:
        edit = F.right(part, F.lit(1))
        role = F.when(edit == "K", t["role"]).when(edit == _USER, "user").otherwise("assistant")
        own = F.when(edit == "D", "").otherwise(F.concat(role, F.lit(":"), t["text"], F.lit("\n")))
        return F.concat(_inserted(F.substring(part, F.lit(1), F.length(part) - 1)), own)

    parts = F.regexp_extract_all(path, F.lit(f"[{_USER_IN}{_ASSISTANT_IN}]*[DKRS]"), F.lit(0))
    whole = F.concat(F.array_join(F.zip_with(turns, parts, piece), ""), _inserted(F.regexp_extract(path, f"[{_USER_IN}{_ASSISTANT_IN}]*$", 0)))
    return _let(whole, lambda w: F.substring(w, F.lit(1), F.greatest(F.length(w) - 1, F.lit(0))))


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv, turn, role, text, gone): its faults, the cheapest repair and its text.

    conv, gaps, blank, duplicate, truncated, illegal, cost, audit, text. Turns
    are taken by number, nulls first, equal numbers by role and text, and of
    rows alike in all three the first is no duplicate. A null conv is a
    conversation of its own. gaps counts the numbers missing between
    the least and the largest turn; illegal the neighbours whose initials are
    not su, ua or au. The audit has a letter for each edit (Delete, Insert,
    Keep, Rerole); of audits that cost the same, the least in ASCII counts. A
    conversation whose rows are all gone has zeros, an empty audit and an empty
    text; no rows give no rows.
    """
    turn = F.struct("turn", "role", "text", (F.col("fault") == 2).alias("again"), "fault")
    each = flagged(rows).groupBy("conv").agg(F.sort_array(F.collect_list(F.when(~F.col("gone"), turn))).alias("turns"))
    count = lambda fault: F.size(F.filter("turns", lambda t: t["fault"] == fault)).cast("long")
    numbers = F.filter(F.transform("turns", lambda t: t["turn"]), lambda n: n.isNotNull())
    gaps = _let(numbers, lambda n: F.when(F.size(n) == 0, F.lit(0)).otherwise(F.array_max(n) - F.array_min(n) + 1 - F.size(F.array_distinct(n))))
    initials = F.transform("turns", lambda t: F.substring(t["role"], 1, 1))
    behind = F.slice(F.col("initials"), F.lit(2), F.greatest(F.size("initials") - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(F.col("initials"), F.lit(1), F.size(behind)), behind, lambda a, b: F.concat(a, b))
    way = F.aggregate("turns", _start(), _turn, lambda s: F.least(s["none"], s["assistant"]))
    out = each.withColumns({"initials": initials, "way": way})
    illegal = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")
    audit = F.translate("way.path", _ASSISTANT_IN + _ASSISTANT, _USER_IN + _USER)
    return out.select(
        "conv", gaps.cast("long").alias("gaps"), count(1).alias("blank"), count(2).alias("duplicate"), count(3).alias("truncated"), illegal.alias("illegal"),
        F.col("way.cost").alias("cost"), audit.alias("audit"), _text(F.col("turns"), F.col("way.path")).alias("text"),
    )
