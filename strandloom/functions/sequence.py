"""Column functions over nucleotide strings; all built-in expressions."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that stand for several bases; each counts as a quarter of every base.
AMBIGUOUS = "NMWRYKBSDHV"
PADDING = "X"
STOPS, STOPS_REVERSED = ("TAA", "TAG", "TGA"), ("TTA", "CTA", "TCA")
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def upper(seq: Column) -> Column:
    """a-z as A-Z; other characters stay, so no letter turns into two."""
    return F.translate(seq, LOWER, UPPER)


def reverse_complement(seq: Column) -> Column:
    """Case is kept; letters other than A, C, G and T stand for themselves."""
    return F.reverse(F.translate(seq, "ATGCatgc", "TACGtacg"))


def reverse_complement_strict(seq: Column) -> Column:
    """For upper-case sequence of A, C, G, T, ambiguity letters and padding; anything else is an error."""
    return F.when(seq.rlike(f"^[ACGT{AMBIGUOUS}{PADDING}]*$"), reverse_complement(seq)).otherwise(F.raise_error(F.concat(F.lit("not a nucleotide sequence: "), F.substring(seq, 1, 40))).cast("string"))


def one_hot(seq: Column) -> Column:
    """An array of [A, C, G, T] weights by letter: units, quarters for ambiguity, zeros for padding."""

    def weights(letter: Column) -> Column:
        rows = {base: F.array(*(F.lit(float(base == b)) for b in "ACGT")) for base in "ACGT"}
        quarter, zero = F.array(*[F.lit(0.25)] * 4), F.array(*[F.lit(0.0)] * 4)
        out = F.when(letter == "A", rows["A"])
        for base in "CGT":
            out = out.when(letter == base, rows[base])
        return out.when(letter.isin(*AMBIGUOUS), quarter).when(letter == PADDING, zero).otherwise(F.raise_error(F.concat(F.lit("not a nucleotide: "), letter)).cast("array<double>"))

    return F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), weights)


def base_weights(seq: Column) -> list[Column]:
    """Column sums of the one-hot matrix, without building it."""

    def count(letters: str) -> Column:
        return F.length(seq) - F.length(F.translate(seq, letters, ""))

    return [(count(base) + 0.25 * count(AMBIGUOUS)).alias(f"w_{base.lower()}") for base in "ACGT"]


def starts_codon(cds: Column, reverse: bool = False) -> Column:
    return F.right(cds, F.lit(3)) == "CAT" if reverse else F.left(cds, F.lit(3)) == "ATG"


def stops_codon(cds: Column, reverse: bool = False) -> Column:
    return F.left(cds, F.lit(3)).isin(*STOPS_REVERSED) if reverse else F.right(cds, F.lit(3)).isin(*STOPS)


def in_frame(cds: Column) -> Column:
    return F.length(cds) % 3 == 0


def safe_log(p: Column, floor: float = 0.0) -> Column:
    """ln, with minus infinity for zero and below (Spark's ln would be null); `floor` lifts small values first."""
    lifted = F.greatest(p, F.lit(floor))
    return F.when(lifted <= 0, F.lit(float("-inf"))).otherwise(F.ln(lifted))


def argmax(values: Column) -> Column:
    """The position, from 0, of the largest value; the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def positional_encoding(pos: Column, width: int, base: float = 10000.0) -> Column:
    """Sine and cosine by turns, frequencies falling from 1 to 1/base."""

    def value(k: Column) -> Column:
        angle = pos * F.exp((k % 2 - k) * F.lit(log(base) / width))
        return F.when(k % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))

    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), value)
