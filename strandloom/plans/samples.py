"""Genome and annotation to training samples: gene models, error masks, label tracks, windows.

Features are rows (line_no, seq_id, type, start, end, strand, phase, id, parent)
with 0-based half-open spans. Every track of a contig and strand is a set of
intervals that are written in file order; only windows are turned into arrays.
An interval that would begin before the contig is cut at its start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from strandloom.functions.sequence import reverse_complement_strict
from strandloom.operators import labels, tiling
from strandloom.session import stored, tasks_for
from strandloom.sources.fasta import chunks
from strandloom.sources.gff import with_each_parent

KEYS = ["seq_id", "strand", "gene_line"]
WINDOW, FLANK, MASK_LENGTH = 20480, 10240, 1000
#: Writes of one feature come before those of the next one; no feature has so many.
WRITES = 100


def feature_rows(links: DataFrame) -> DataFrame:
    """Features of sources.gff.parse_links rows, once for each of their parents; only those on a strand count."""
    strand = F.when(F.col("strand") == "+", 1).when(F.col("strand") == "-", -1)
    phase = F.col("phase").try_cast("int").alias("phase")
    return with_each_parent(links).select("line_no", F.col("seqid").alias("seq_id"), "type", (F.col("start") - 1).alias("start"), "end", strand.alias("strand"), phase, "id", "parent").where("strand is not null")


#: What a name is looked up by: a hash first, as rows sort slowly by few contigs and long names.
LINK = ["link", "seq_id", "parent"]


def _linked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("link", F.xxhash64("seq_id", "parent"))


def _candidates(rows: DataFrame) -> DataFrame:
    """Transcripts of an accepted type that have bases, with their gene's line and strand."""
    genes = rows.where("type = 'gene'").select("seq_id", F.col("id").alias("parent"), F.col("line_no").alias("gene_line"), F.col("strand").alias("gene_strand"))
    found = _linked(rows.where(F.col("type").isin(*labels.ACCEPTED) & (F.col("end") > F.col("start")))).join(_linked(genes), LINK)
    return found.select("seq_id", F.col("gene_strand").alias("strand"), "gene_line", "type", "start", "end", "id", "line_no")


def _longest(found: DataFrame) -> DataFrame:
    """Of each gene the longest of those transcripts, by LINK."""
    longest = labels.longest_transcripts(found, "gene_line", F.col("end") - F.col("start"), "line_no")
    return _linked(longest.select(*KEYS, "start", "end", F.col("id").alias("parent")))


def _parts_of(rows: DataFrame, longest: DataFrame, tasks: int | None = None) -> DataFrame:
    """Exons and coding parts of those transcripts; with `tasks` dealt over so many by LINK."""
    own, parts = longest.select(*LINK, "strand", "gene_line"), _linked(rows.where("type in ('exon', 'CDS') and parent is not null").drop("strand"))
    if tasks is not None:
        own, parts = own.repartition(tasks, *LINK), parts.repartition(tasks, *LINK)
    return parts.join(own, LINK).select(*LINK, "strand", "gene_line", "type", "start", "end", "phase", "line_no")


def gene_models(rows: DataFrame, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(models, parts, masks): accepted transcripts, their parts, and features of which the span is masked.

    A gene goes by its line, and its longest transcript counts. Masked are
    features of the MASKED types, and genes without parts, without an accepted
    type of transcript, without coding parts, or beginning before the last
    accepted one ends. Other features are passed over. `found` are the candidates
    of rows, where they are known. Which genes are taken is known before their
    parts are looked up, so no other gene's are.
    """
    longest = stored(_longest(_candidates(rows) if found is None else found))
    able = longest.join(_linked(rows.where("type = 'CDS'").select("seq_id", "parent")), LINK, "left_semi")
    taken = labels.accepted(able, ["seq_id", "strand"], order="gene_line").where("accepted").select("gene_line")
    taken = stored(taken)
    models = longest.join(taken, "gene_line")
    routed = rows.where(F.col("type").isin("gene", *labels.MASKED))
    masks = routed.join(taken.withColumnRenamed("gene_line", "line_no"), "line_no", "left_anti")
    parts = _parts_of(rows, models).select(*KEYS, "type", "start", "end", "phase", "line_no")
    return models.select(*KEYS, "start", "end"), parts, masks.select("seq_id", "strand", F.col("line_no").alias("gene_line"), "start", "end")


def _dealt(models: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables by gene over the same tasks, as many as the parts need."""
    n = tasks_for(parts)
    return models.repartition(n, "gene_line"), parts.repartition(n, "gene_line")


def utr_totals(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(total_5, total_3, n): untranslated bases before the first and behind the last coding base in reading order, of genes that have both.

    Of a gene counts the longest mRNA. No base there is a coding one, so they are
    what exons cover: by start, each exon adds what lies behind the ends of those
    before it. The window is by gene as parts are dealt for their join.
    """
    found = (_candidates(rows) if found is None else found).where("type = 'mRNA'")
    parts = _parts_of(rows, _longest(found), tasks_for(rows))
    keys = [*LINK, "strand", "gene_line"]
    by = W.partitionBy(*keys).orderBy("start")
    gene, coding = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), F.col("type") == "CDS"
    parts = parts.withColumns({"a": F.min(F.when(coding, F.col("start"))).over(gene), "b": F.max(F.when(coding, F.col("end"))).over(gene)})
    exons = parts.where("type = 'exon' and end > start and a is not null")
    spans = exons.withColumn("first", F.greatest("start", F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))))
    left, right = F.greatest(F.least("end", "a") - F.col("first"), F.lit(0)), F.greatest(F.col("end") - F.greatest("first", "b"), F.lit(0))
    back = F.col("strand") == -1
    return labels.utr_lengths(spans.select(*keys, F.when(back, right).otherwise(left).alias("utr_5"), F.when(back, left).otherwise(right).alias("utr_3")), keys)


def _coding_ends(parts: DataFrame) -> DataFrame:
    return parts.where("type = 'CDS'").groupBy(*KEYS).agg(F.min("start").alias("a"), F.max("end").alias("b"))


def _painted(models: DataFrame, parts: DataFrame) -> DataFrame:
    return labels.painted(models, parts.where("type = 'exon'"), parts.where("type = 'CDS'"), KEYS)


def coding_sequence(parts: DataFrame, genome: DataFrame, size: int = 1 << 16) -> DataFrame:
    """Coding parts with their sequence: an equi-join with pieces of contigs, not with whole ones. A coding base beyond its contig has no letter."""
    cds = parts.where("type = 'CDS' and end > start").select(*KEYS, "start", "end").distinct()
    held = chunks(genome, size).select("seq_id", F.col("start").alias("low"), "seq")
    # Pieces are a grid: a part is cut at its lines, and most lie between two of them.
    cut = cds.where("end > 0").withColumn("low", F.explode(F.expr(f"sequence(cast(greatest(start, 0) as bigint) div {size} * {size}, cast(end as bigint) - 1, {size}L)")))
    met = cut.join(held, ["seq_id", "low"])
    first = F.greatest("start", "low")
    letters = F.upper(F.substring(F.col("seq"), (first - F.col("low") + 1).cast("int"), (F.least(F.col("end"), F.col("low") + size) - first).cast("int")).cast("string"))
    # A part that begins behind its contig's end has no letters in the last piece.
    each, alone = met.select(*KEYS, "start", "end", "low", letters.alias("s")).where("s <> ''"), (F.col("start") >= F.col("low")) & (F.col("end") <= F.col("low") + size)
    several = each.where(~alone).groupBy(*KEYS, "start", "end").agg(F.sort_array(F.collect_list(F.struct(F.col("low").alias("p"), "s"))).alias("xs"))
    joined = several.select(*KEYS, "start", F.array_join(F.transform("xs", lambda x: x["s"]), "").alias("seq"))
    return each.where(alone).select(*KEYS, "start", F.col("s").alias("seq")).unionByName(joined)


def error_intervals(models: DataFrame, parts: DataFrame, genome: DataFrame, average_5: int, average_3: int, mask_length: int = MASK_LENGTH) -> DataFrame:
    """(KEYS, start, end, rank): what is masked because a model is wrong or incomplete, in the order of writing.

    By rank: 10, 11 missing untranslated region on the left and right; 12 introns
    of at most SHORT_INTRON; 13, 14 around coding bases beside a wrong start or
    stop codon; 15, 16 mask_length on either side of a coding part that is out of
    frame; 17, 18 overlapping coding parts and exons; 19 untranslated bases
    between coding ones. On the reverse strand left and right change roles.
    """
    models, parts = _dealt(models, parts)
    back = F.col("strand") == -1
    sequences = stored(coding_sequence(parts, genome))
    codons = labels.codon_errors(sequences.where("strand = 1"), KEYS).unionByName(labels.codon_errors(sequences.where("strand = -1"), KEYS, True))
    ends = _coding_ends(parts)
    rows = models.select(*KEYS, F.col("start").alias("s"), F.col("end").alias("e")).join(ends, KEYS).join(codons, KEYS)
    utr_left, utr_right = F.when(back, average_3).otherwise(average_5), F.when(back, average_5).otherwise(average_3)
    bad_left = F.when(back, F.col("bad_stop")).otherwise(F.col("bad_start"))
    bad_right = F.when(back, F.col("bad_start")).otherwise(F.col("bad_stop"))
    a, b, s, e = (F.col(c) for c in "abse")
    cases = [
        (10, a <= s, a - 2 * utr_left, a), (11, b >= e, b, b + 2 * utr_right), (13, bad_left, s, a), (14, bad_right, b, e),
        (15, F.col("bad_frame"), a - mask_length, a), (16, F.col("bad_frame"), b, b + mask_length),
    ]
    whole = rows.select(*KEYS, F.explode(F.array(*(F.when(when, F.struct(x.cast("long").alias("start"), y.cast("long").alias("end"), F.lit(r).alias("rank"))) for r, when, x, y in cases))).alias("x"))
    out = whole.where("x is not null").select(*KEYS, "x.*")
    for kind, rank in (("exon", 18), ("CDS", 17)):
        pairs = labels.boundary_errors(parts.where(F.col("type") == kind), KEYS)
        out = out.unionByName(pairs.where("overlap").select(*KEYS, "start", F.col("after_end").alias("end"), F.lit(rank).alias("rank")))
        if kind == "exon":
            out = out.unionByName(pairs.where("short_intron").select(*KEYS, F.col("end").alias("start"), F.col("after").alias("end"), F.lit(12).alias("rank")))
    inside = _painted(models, parts).where("class = 1").join(ends, KEYS)
    out = out.unionByName(inside.select(*KEYS, F.greatest("start", "a").alias("start"), F.least("end", "b").alias("end"), F.lit(19).alias("rank")))
    return out.withColumn("start", F.greatest("start", F.lit(0))).where("end > start")


def tracks(rows: DataFrame, genome: DataFrame, weights: tuple[int, ...] = (16,) * 6, mask_length: int = MASK_LENGTH) -> DataFrame:
    """(seq_id, strand, track, start, end, value, anchor, write_seq): intervals of the class (0), weight (1) and phase (2) tracks.

    A phase interval's value is the phase of its first base in reading order, which is the anchor.
    """
    found = stored(_candidates(rows))
    models, parts, masks = (stored(f) for f in gene_models(rows, found))
    mean = labels.average_utr(utr_totals(rows, found), mask_length).first()
    shifts = labels.transition_windows(models, parts.where("type = 'exon'"), parts.where("type = 'CDS'"), KEYS, weights, "strand")
    wrong = error_intervals(models, parts, genome, mean["average_5"], mean["average_3"], mask_length)

    def track(frame: DataFrame, number: int, value: Column, rank: Column, anchor: Column | None = None) -> DataFrame:
        order = (F.col("gene_line") * WRITES + rank).cast("long").alias("write_seq")
        return frame.select("seq_id", F.col("strand").cast("int").alias("strand"), F.lit(number).alias("track"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), value.cast("int").alias("value"), (F.lit(0) if anchor is None else anchor).cast("long").alias("anchor"), order)

    first = F.when(F.col("strand") == -1, F.col("end") - 1).otherwise(F.col("start"))
    # Coding parts of a gene may overlap: they are written in the order of their own lines.
    own_line = F.col("line_no") - F.col("gene_line") * WRITES
    return (
        track(_painted(models, parts), 0, F.col("class"), F.lit(0))
        .unionByName(track(shifts, 1, F.col("value"), F.col("write_seq")))
        .unionByName(track(wrong, 1, F.lit(0), F.col("rank")))
        .unionByName(track(masks, 1, F.lit(0), F.lit(0)))
        .unionByName(track(parts.where("type = 'CDS' and phase is not null"), 2, F.col("phase"), own_line, first))
    )


_TRACKS = ("ann", "weight", "transition", "transition_mask", "phase")
SAMPLE = T.StructType(
    [T.StructField("seq_id", T.StringType()), T.StructField("strand", T.IntegerType()), T.StructField("win_idx", T.IntegerType()), T.StructField("seq", T.StringType())]
    + [T.StructField(name, T.ArrayType(T.ShortType())) for name in _TRACKS]
)


def _arrays(spans: pa.Table, n: int, window: int) -> list[np.ndarray]:
    """A strand's class, weight and phase over one window, from spans relative to it; what lies beyond the contig is 0, 0 and 3."""
    out = [np.zeros(window, np.int16), np.ones(window, np.int16), np.full(window, 3, np.int16)]
    turn = np.array(labels.PHASES)
    for track, strand, low, high, value, anchor, _ in sorted(zip(*(spans.column(c).to_pylist() for c in ("track", "strand", "low", "high", "value", "anchor", "write_seq")), strict=True), key=lambda r: r[-1]):
        if track == 2:
            at = np.arange(low, high)
            out[2][low:high] = turn[((anchor - at if strand == -1 else at - anchor) + labels.PHASES.index(value)) % 3]
        else:
            out[track][low:high] = value
    for values, rest in zip(out, (0, 0, 3), strict=True):
        values[n:] = rest
    return out


def samples(genome: DataFrame, rows: DataFrame, window: int = WINDOW, flank: int = FLANK, weights: tuple[int, ...] = (16,) * 6, mask_length: int = MASK_LENGTH, need_genes: bool = True) -> DataFrame:
    """SAMPLE rows: each window of the annotated contigs on either strand, with its label arrays, where it is worth training on.

    Kept are windows with a weight other than 0 and, unless waived, a label other
    than intergenic. On the reverse strand sequence and arrays are turned around.
    Contigs without a feature give no rows.
    """
    named = rows.select("seq_id").distinct()
    tiles = tiling.windows(genome.join(named, "seq_id", "left_semi"), window, flank)
    tiles = tiles.select("seq_id", "length", "win_idx", "start", "seq", reverse_complement_strict(F.col("seq")).alias("turned"))
    spans = stored(tracks(rows, genome, weights, mask_length).where("end > start"))
    spans = spans.withColumn("win_idx", F.explode(F.expr(f"sequence(start div {window}, (end - 1) div {window})"))).withColumn("win_idx", F.col("win_idx").cast("int"))
    here = F.col("win_idx").cast("long") * window
    spans = spans.select("seq_id", "win_idx", "strand", "track", F.greatest(F.col("start") - here, F.lit(0)).alias("low"), F.least(F.col("end") - here, F.lit(window)).alias("high"), "value", (F.col("anchor") - here).alias("anchor"), "write_seq")
    if need_genes:
        # Most windows of a genome have no label on either strand: only the others are shuffled.
        genic = spans.where("track = 0").select("seq_id", "win_idx").distinct()
        tiles, spans = (frame.join(genic, ["seq_id", "win_idx"], "left_semi") for frame in (tiles, spans))

    def build(key: tuple, tile: pa.Table, spans: pa.Table) -> pa.Table:
        out = {f.name: [] for f in SAMPLE.fields}
        for row in tile.to_pylist():
            n = min(window, row["length"] - row["start"])
            for strand in (1, -1):
                ann, weight, phase = _arrays(spans.filter(pc.equal(spans["strand"], strand)), n, window)
                if not weight[:n].any() or need_genes and not ann[:n].any():
                    continue
                if strand == -1:
                    ann, weight, phase = ann[::-1], weight[::-1], phase[::-1]
                low, high = np.minimum(ann[:-1], ann[1:]), np.maximum(ann[:-1], ann[1:])
                step = np.append((low != high) & ~((low == 0) & (high > 1)), False)
                sure = np.append((weight[:-1] != 0) & (weight[1:] != 0), False)
                for name, value in zip(out, (row["seq_id"], strand, row["win_idx"], row["seq"] if strand == 1 else row["turned"], ann, weight, step, sure, phase), strict=True):
                    out[name].append(value.astype(np.int16) if isinstance(value, np.ndarray) else value)
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), *[pa.list_(pa.int16())] * 5]
        return pa.table({name: pa.array(v, k) for (name, v), k in zip(out.items(), kinds, strict=True)})

    both = [frame.withColumn("seq_id", F.col("seq_id").cast("string")).groupBy("seq_id", "win_idx") for frame in (tiles, spans)]
    return both[0].cogroup(both[1]).applyInArrow(build, SAMPLE)


def write_samples(rows: DataFrame, path: str, species: str) -> None:
    """Samples of one species as a folder of its own; a second run replaces the first."""
    rows.write.mode("overwrite").parquet(f"{path}/species={species}")


def read_samples(spark: SparkSession, path: str, species: list[str]) -> DataFrame:
    """The samples of the given species with their name; one that is missing is an error."""
    out = None
    for name in species:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/species={name}")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            raise FileNotFoundError(f"no samples of {name} in {path}")
        own = spark.read.parquet(f"{path}/species={name}").withColumn("species", F.lit(name))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no species named")
    return out


def split(rows: DataFrame, share: float, seed: int = 0, keys: tuple[str, ...] = ("seq_id", "strand", "win_idx")) -> tuple[DataFrame, DataFrame]:
    """Two parts of rows, about `share` of them in the first, by a seeded hash of their keys: the same on every run and cluster."""
    place = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30))
    return rows.where(place < int(share * (1 << 30))), rows.where(place >= int(share * (1 << 30)))


def shuffled(rows: DataFrame, seed: int = 0, keys: tuple[str, ...] = ("seq_id", "strand", "win_idx")) -> DataFrame:
    """rows in an order that follows from the seed and the keys, spread over partitions by range."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)
