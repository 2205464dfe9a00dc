"""Quality rules as a ledger of bits.

Every rule is evaluated once per document; the ledger keeps the measurements and
one bit for each rule that failed. A policy is a versioned set of rules, that is
a mask: applying one, comparing two, or asking what a rule changes are bitwise
operations on the ledger and never look at a text again. Built-in functions
only; a row is one text, so no measurement needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import BLANKS, WORD

WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Rules by bit, as conditions on the measurements that fail a document.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars > 25 * n_words",
    "capitals": "100 * n_capitals > 60 * word_chars",
}
#: Policies by version: the rules that count.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols"),
    "v2": tuple(RULES),
}


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def _let(value: Column, body) -> Column:
    """body of value, with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(windows: Column) -> Column:
    """Words that windows (hashes by position) which occur twice or more cover."""

    def covered(at: Column) -> Column:
        gaps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)

    def positions(order: Column) -> Column:
        n = F.size(order) - 1
        twins = F.zip_with(F.slice(order, 1, n), F.slice(order, 2, n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda t: t.isNotNull()))))

    order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(order, lambda o: _let(positions(o), covered))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, the measurements, and failed, a bit per rule of RULES.

    A null text has no words: it is measured like an empty one. Texts may be of
    any length; no rows give no rows; repeated rows are each measured; other
    columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col),
        F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("lines"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
    )
    starts = F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))
    windows = F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    rows = rows.select(
        id_col,
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_capitals",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") > WINDOW, windows).alias("windows"),
    )
    several = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.when(several, _repeated(F.col("windows"))), F.lit(0)).cast("long")).drop("windows")
    failed = sum((F.when(F.expr(rule), F.lit(1 << bit)).otherwise(0) for bit, rule in enumerate(RULES.values())), start=F.lit(0))
    return rows.withColumn("failed", failed)


def verdicts(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with base_failed and kept, false where a rule of the policy failed."""
    base, whole = F.lit(mask("base")), F.lit(mask("base") | mask(policy))
    return rows.withColumn("base_failed", F.col("failed").bitwiseAND(base) != 0).withColumn("kept", F.col("failed").bitwiseAND(whole) == 0)


def ablations(rows: DataFrame) -> DataFrame:
    """For each policy and rule of it: documents kept, failed by the rule, by it alone, and kept without it.

    The ledger shrinks to one row per set of failed rules, at most 2**rules, before policies meet it.
    """
    names = list(RULES)
    counts = rows.groupBy("failed").agg(F.count("*").alias("n"))
    pairs = F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(p)).alias("mask"), F.lit(1 << names.index(r)).alias("bit")) for p, rules in POLICIES.items() for r in rules))
    each = counts.select("failed", "n", F.explode(pairs).alias("x")).select("failed", "n", "x.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))

    def documents(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return each.groupBy("policy", "rule").agg(
        documents(hit == 0).alias("kept"),
        documents(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        documents(hit == F.col("bit")).alias("failed_alone"),
        documents((hit == 0) | (hit == F.col("bit"))).alias("kept_without"),
    )
