"""Gene models: scores, filters, order, numbers, phases, and coordinates on the forward strand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: States of untranslated bases before and behind the coding ones, by this library's names and by their usual ones.
UNTRANSLATED = ("before", "behind", "five_UTR", "three_UTR")
#: Least coding score by lineage where none is given.
LINEAGE_SCORES = {"Mammalia": 0.7}
LINEAGE_DEFAULT = 0.65


def phase_probability(phase: Column, p1: Column, p2: Column, p3: Column) -> Column:
    """The probability of the class that fits a base's codon position: first 1, second 3, third 2."""
    return F.when(phase == 0, p1).when(phase == 2, p3).when(phase == 1, p2)


def unmasked(base: Column, p: Column, coefficient: float = 0.0) -> Column:
    """p, times the coefficient for soft-masked (lower-case) bases."""
    return F.when(base.rlike("^[a-z]$"), p * coefficient).otherwise(p)


def coding_scores(bases: DataFrame, gene_keys: list[str], cds_key: str, p: str = "p") -> tuple[DataFrame, DataFrame]:
    """Mean probability per coding run and per gene, of a row per coding base; the gene's from the runs' partial sums."""
    each = bases.groupBy(*gene_keys, cds_key).agg(F.sum(p).alias("sum_p"), F.count("*").alias("n"))
    by_gene = each.groupBy(*gene_keys).agg((F.sum("sum_p") / F.sum("n")).alias("cds_score"))
    return each.select(*gene_keys, cds_key, (F.col("sum_p") / F.col("n")).alias("score"), "n"), by_gene


def gene_filter(cds: DataFrame, keys: list[str], min_length: int = 60, min_score: Column | float = 0.5, min_span: int = 200) -> DataFrame:
    """Genes, of rows (keys, start, end, score) with inclusive ends, that are long, sure and wide enough.

    Score is per coding base, so runs weigh by their length. Genes without
    coding runs have no rows here and so are dropped. min_span 0 turns that off.
    """
    length = F.col("end") - F.col("start") + 1
    rows = cds.groupBy(*keys).agg(F.sum(length).alias("cds_length"), (F.sum(F.col("score") * length) / F.sum(length)).alias("cds_score"), F.min("start").alias("first_cds"), F.max("end").alias("last_cds"))
    least = min_score if isinstance(min_score, Column) else F.lit(min_score)
    return rows.where((F.col("cds_length") >= min_length) & (F.col("cds_score") >= least) & (F.col("last_cds") - F.col("first_cds") + 1 >= min_span))


def lineage_score(given: Column, lineage: Column) -> Column:
    """The given threshold, or the lineage's where it is null or zero."""
    table = F.lit(LINEAGE_DEFAULT)
    for name, score in LINEAGE_SCORES.items():
        table = F.when(lineage == name, F.lit(score)).otherwise(table)
    return F.coalesce(F.nullif(given, F.lit(0.0)), table)


def least_score(given: float | None, lineage: str) -> float:
    """lineage_score for plans, where both are known beforehand."""
    return given if given else LINEAGE_SCORES.get(lineage, LINEAGE_DEFAULT)


def to_forward(start: Column, end: Column, length: Column, strand: Column) -> tuple[Column, Column]:
    """1-based inclusive coordinates on the forward strand, of 0-based inclusive strand-local ones."""
    back = strand == -1
    return F.when(back, length - end).otherwise(start + 1), F.when(back, length - start).otherwise(end + 1)


def numbered(genes: DataFrame, contig: str = "seq_id", first: str = "first_cds", ties: tuple[str, ...] = ()) -> DataFrame:
    """genes with gene_no within the contig: forward strand first, by position, then the reverse strand from its far end; genes that begin at one place by `ties`."""
    order = W.partitionBy(contig).orderBy(F.desc("strand"), F.when(F.col("strand") == -1, -F.col(first)).otherwise(F.col(first)), *ties)
    return genes.withColumn("gene_no", F.row_number().over(order))


def cds_phases(cds: DataFrame, keys: list[str], order: str = "start") -> DataFrame:
    """cds with part (number within the gene) and phase: bases to skip to the next codon, from the lengths of the runs before."""
    w = W.partitionBy(*keys).orderBy(order)
    before = F.coalesce(F.sum(F.col("end") - F.col("start") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cds.withColumn("part", F.row_number().over(w)).withColumn("phase", F.element_at(F.array(*map(F.lit, (0, 2, 1))), (before % 3 + 1).cast("int")))


def introns(cds: DataFrame, keys: list[str], order: str = "start") -> DataFrame:
    """(keys, start, end): the gaps between a gene's runs, ends inclusive."""
    w = W.partitionBy(*keys).orderBy(order)
    rows = cds.withColumn("after", F.lead("start").over(w)).where("after is not null and after > end + 1")
    return rows.select(*keys, (F.col("end") + 1).alias("start"), (F.col("after") - 1).alias("end"))


def with_all_contigs(contigs: DataFrame, genes: DataFrame, contig: str = "seq_id") -> DataFrame:
    """genes, and a row with null gene columns for every contig and strand without one."""
    strands = contigs.select(contig, "length", F.explode(F.array(F.lit(1).cast("byte"), F.lit(-1).cast("byte"))).alias("strand"))
    return strands.join(genes, [contig, "strand"], "left")


def gff_rows(cds: DataFrame, source: str = "strandloom", exons: DataFrame | None = None) -> DataFrame:
    """Feature rows of genes, transcripts, exons and coding runs, in file order.

    cds has seq_id, seq_ord, length, strand, gene_no, start, end (strand-local,
    0-based, inclusive), part, phase, score and cds_score. Coding runs alone
    have a score in their line, with two digits; every row carries the gene's
    cds_score for the comments around it. Without exons (the same columns but
    phase and score) coding runs are the exons; a gene reaches from its first to
    its last exon.
    """
    start, end = to_forward(F.col("start"), F.col("end"), F.col("length"), F.col("strand"))
    rows = cds.select("seq_id", "seq_ord", "gene_no", "strand", "part", "phase", "score", "cds_score", start.alias("start"), end.alias("end"))
    spans = rows if exons is None else exons.select("seq_id", "seq_ord", "gene_no", "strand", "part", "cds_score", start.alias("start"), end.alias("end"))
    gene = F.concat("seq_id", F.lit("-g"), F.col("gene_no").cast("string"))
    transcript = F.concat(gene, F.lit(".t1"))
    keys = ["seq_id", "seq_ord", "gene_no", "strand"]
    whole = spans.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("cds_score").alias("cds_score"))
    whole = whole.withColumn("part", F.lit(0))

    def line(frame: DataFrame, kind: str, rank: int, attributes: Column, score: Column | None = None, phase: Column | None = None) -> DataFrame:
        none = F.lit(".")
        return frame.select(
            "seq_id", "seq_ord", "gene_no", "part", F.lit(rank).alias("rank"), F.lit(source).alias("source"), F.lit(kind).alias("type"), "start", "end",
            (none if score is None else score).alias("score"), F.when(F.col("strand") == -1, "-").otherwise("+").alias("strand"),
            (none if phase is None else phase).alias("phase"), attributes.alias("attributes"), "cds_score",
        )

    def named(own: Column | None, above: Column | None) -> Column:
        pairs = [F.concat(F.lit(f"{key}="), value) for key, value in (("ID", own), ("Parent", above)) if value is not None]
        return F.concat_ws(";", *pairs)

    part, two_digits = F.col("part").cast("string"), F.coalesce(F.format_string("%.2f", F.bround("score", 2)), F.lit("."))
    return (
        line(whole, "gene", 0, named(gene, None))
        .unionByName(line(whole, "transcript", 1, named(transcript, gene)))
        .unionByName(line(spans, "exon", 2, named(F.concat(transcript, F.lit(".exon."), part), transcript)))
        .unionByName(line(rows, "CDS", 3, named(F.concat(transcript, F.lit(".CDS."), part), transcript), two_digits, F.col("phase").cast("string")))
    )


def state_class(state: Column, untranslated: bool = False) -> Column:
    """A decoding state's name as 0 intergenic, 1 coding, 2 intron; of the older model 0, 1 untranslated, 2 coding, 3 intron."""
    coding = F.lit(2 if untranslated else 1)
    out = F.when(state == "intergenic", 0).when(state.contains("."), 3 if untranslated else 2)
    return (out.when(state.isin(*UNTRANSLATED), 1) if untranslated else out).otherwise(coding)
