"""Genome to gene models: tile, score, find regions, decode, number, write."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandloom.operators import genes, intervals, packing, regions, spans, tiling
from strandloom.operators.tracks import PACKED, packed, unpack
from strandloom.plans.scoring import Scorer, TrackScorer, scored
from strandloom.session import stored
from strandloom.sources.fasta_ranges import PIECE, windows_of_pieces
from strandloom.sources.gff import write_gff

WINDOW, FLANK = 30720, 5120
#: Bases of a region that one task decodes alone: 105 MB of scores.
WHOLE = 1 << 18
#: Least coding score where neither a score nor a lineage is given.
LEAST_SCORE = 0.5


def predict(genome: DataFrame, scorer: Scorer, window: int = WINDOW, flank: int = FLANK, piece: int = PIECE, cells: bool = False) -> DataFrame:
    """Scored pieces of both strands. Scoring is the dear step: store them before several steps read them.

    genome has whole contigs (seq_id, seq), or pieces of `piece` bases (seq_id, seq_ord, length, start, seq) of contigs of any length.
    With `cells`, a piece's probabilities are one cell of operators.tracks, as the steps behind it take them best.
    """
    cut = windows_of_pieces(genome, window, flank, piece) if "start" in genome.columns else tiling.windows(genome, window, flank)
    return scored(tiling.both_strands(cut, window), scorer, window, flank, cells=cells)


def contigs_of(genome: DataFrame) -> DataFrame:
    """(seq_id, seq_ord, length) of contigs or of pieces of them; a contig's first piece begins at 0."""
    rows = genome.where("start = 0") if "start" in genome.columns else genome
    return rows.select(F.col("seq_id").cast("string").alias("seq_id"), "seq_ord", "length")


def write_predictions(pieces: DataFrame, contigs: DataFrame, path: str, chunks: int = 1) -> None:
    """pieces as Parquet, a folder for each chunk of contigs; the contigs are dealt longest first. A second run replaces the first."""
    dealt = packing.longest_first(contigs.select("seq_ord", "length"), chunks).select("seq_ord", "chunk_id")
    of = contigs.select("seq_id", "seq_ord").join(dealt, "seq_ord").select("seq_id", "chunk_id")
    pieces.join(of, "seq_id").write.mode("overwrite").partitionBy("chunk_id").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """All chunks that write_predictions, or another program, put into a folder."""
    return spark.read.parquet(path).drop("chunk_id")


def checked(found: DataFrame, contigs: DataFrame) -> DataFrame:
    """found with the contigs' columns; a prediction for a contig that the genome lacks is an error."""
    known = contigs.select(F.col("seq_id").cast("string").alias("seq_id"), "seq_ord", "length", F.lit(True).alias("__known"))
    rows = found.join(known, "seq_id", "left")
    message = F.concat(F.lit("no sequence in the genome for predictions of "), F.coalesce("seq_id", F.lit("null")))
    return rows.withColumn("seq_ord", F.when(F.col("__known"), F.col("seq_ord")).otherwise(F.raise_error(message).cast("int"))).drop("__known")


def _bins(pieces: DataFrame, most: float, track: str = "probs") -> DataFrame:
    """Bin means of pieces that may begin anywhere: a part of a bin each, summed over pieces.

    The genic probability is the sum of all classes but 0, however many there
    are, which need not be one less that of class 0. Of packed pieces the first track counts.
    """
    track = PACKED if PACKED in pieces.columns else track

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            own = [unpack(cell)[0] for cell in lists.to_pylist()] if track == PACKED else []
            at = np.cumsum([0, *map(len, own)]) if track == PACKED else lists.offsets.to_numpy()
            if at[0] == at[-1]:
                continue
            if track == PACKED:
                flat = np.concatenate(own)
            else:
                inner = lists.values.offsets.to_numpy()
                flat = lists.values.values.to_numpy(zero_copy_only=False).reshape(-1, inner[1] - inner[0])
            genic = flat[:, 1:].sum(1, dtype=float)
            piece = np.repeat(np.arange(batch.num_rows), np.diff(at))
            place = batch.column(2).to_numpy()[piece] + np.arange(at[0], at[-1]) - at[piece]
            number = place // regions.BIN
            first = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (piece[1:] != piece[:-1])]))
            row = pa.array(piece[first])
            genic = genic[at[0] : at[-1]]
            sums = [pa.array(number[first]), pa.array(np.add.reduceat(genic, first)), pa.array(np.diff(np.append(first, len(place)))), pa.array(np.add.reduceat((genic > most).astype(np.int64), first))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *sums], names=["seq_id", "strand", "bin", "total", "n", "high"])

    rows = pieces.select("seq_id", "strand", "start", track).mapInArrow(parts, f"seq_id {dict(pieces.dtypes)['seq_id']}, strand tinyint, bin long, total double, n long, high long")
    return rows.groupBy("seq_id", "strand", "bin").agg((F.sum("total") / F.sum("n")).alias("mean"), F.sum("high").alias("n_high"))


def found_regions(pieces: DataFrame, average: float = 0.1, most: float = 0.5, track: str = "probs") -> DataFrame:
    """(seq_id, strand, region_start, region_end, is_open) of scored pieces."""
    lengths = pieces.where("start = 0").select("seq_id", "strand", "length")
    return regions.candidate_regions(stored(_bins(pieces, most, track)), lengths, ["seq_id", "strand"], average)


def parts_of(found: DataFrame, pieces: DataFrame, tracks: tuple[str, ...] = ("probs",)) -> DataFrame:
    """(seq_id, strand, region_start, region_end, start, seq, tracks): what scored pieces have of the regions that they overlap."""
    key = ["seq_id", "strand"]
    # A piece has as many letters as places in its tracks, which are dearer to read.
    spans = pieces.select(*key, "start", (F.col("start") + F.length("seq")).alias("piece_end"))
    pairs = intervals.overlapping(found.select(*key, "region_start", "region_end"), spans, key, ("region_start", "region_end"), ("start", "piece_end"))
    met = pairs.join(pieces.select(*key, "start", "seq", *tracks), [*key, "start"])
    low, high = F.greatest("start", "region_start"), F.least("piece_end", "region_end")
    at, n = (low - F.col("start") + 1).cast("int"), (high - low).cast("int")
    return met.select("seq_id", "strand", "region_start", "region_end", low.alias("start"), F.substring(F.col("seq"), at, n).alias("seq"), *(F.slice(t, at, n).alias(t) for t in tracks))


#: Bases of a contig that pieces and regions meet in, and of all contigs that a task holds.
CELL, TASK_BASES = 1 << 18, 1 << 24


def packed_parts(found: DataFrame, pieces: DataFrame) -> DataFrame:
    """parts_of packed pieces (KEYS of spans, start, seq, at, packed): cells go along whole, with the place in them where a part begins.

    Pieces move once. Only regions, which are narrow, are there once for each stretch of a contig that they reach into.
    """
    key, size = ["seq_id", "strand"], F.lit(CELL)

    def stretches(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / size), F.floor((F.col(high) - 1) / size))).alias("stretch")

    # A contig's first piece knows its length, so this reads no letters.
    bases = pieces.where("start = 0").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-bases // TASK_BASES))
    held = pieces.select(*key, "start", (F.col("start") + F.length("seq")).alias("piece_end"), "seq", PACKED).where("piece_end > start")
    held = held.select("*", stretches("start", "piece_end")).repartition(tasks, *key, "stretch")
    asks = found.select(*key, "region_start", "region_end").where("region_end > region_start").select("*", stretches("region_start", "region_end"))
    once = F.col("stretch") == F.floor(F.greatest("start", "region_start") / size)
    met = held.join(asks.hint("shuffle_hash"), [*key, "stretch"]).where(once & (F.col("start") < F.col("region_end")) & (F.col("region_start") < F.col("piece_end")))
    low, high = F.greatest("start", "region_start"), F.least("piece_end", "region_end")
    at = (low - F.col("start")).cast("int")
    return met.select(*spans.KEYS, low.alias("start"), F.substring(F.col("seq"), at + 1, (high - low).cast("int")).alias("seq"), at.alias("at"), PACKED)


def whole_regions(parts: DataFrame, tracks: tuple[str, ...] = ("probs",)) -> DataFrame:
    """Regions with their sequence and tracks, their parts put together."""
    part = F.struct("start", "seq", *tracks)
    whole = parts.groupBy("seq_id", "strand", "region_start", "region_end").agg(F.array_sort(F.collect_list(part), lambda a, b: F.when(a["start"] < b["start"], -1).otherwise(1)).alias("parts"))

    def each(name: str) -> Column:
        return F.transform("parts", lambda p: p[name])

    return whole.select("seq_id", "strand", "region_start", "region_end", F.array_join(each("seq"), "").alias("seq"), *(F.flatten(each(t)).alias(t) for t in tracks))


def candidates(pieces: DataFrame, average: float = 0.1, most: float = 0.5) -> DataFrame:
    """Regions with their sequence and probabilities. pieces is read more than once."""
    return whole_regions(parts_of(found_regions(pieces, average, most), pieces))


def decode(
    pieces: DataFrame, contigs: DataFrame, average: float = 0.1, most: float = 0.5, min_cds_length: int = 60, min_cds_score: float | None = None, min_intron: int = 1,
    lineage: str | None = None, whole: int = WHOLE,
) -> DataFrame:
    """Feature rows of all genes; contigs has seq_id, seq_ord and length.

    Regions of at most `whole` bases are decoded at once, longer ones in the
    pieces that they overlap. The least coding score, where none or 0 is
    given, is the lineage's, and without a lineage LEAST_SCORE.
    """
    score = genes.least_score(min_cds_score, lineage) if lineage else LEAST_SCORE if min_cds_score is None else min_cds_score
    found = found_regions(pieces, average, most)
    cds = _decoded(found, pieces, spans.CodonModel(min_cds_length, score, min_intron), whole)
    return genes.gff_rows(checked(_placed(genes.cds_phases(cds, GENE), _numbers(cds)), contigs))


GENE = ["seq_id", "strand", "gene_start"]


def _decoded(found: DataFrame, pieces: DataFrame, model: spans.Model, whole: int) -> DataFrame:
    """The model's rows of the regions found: of short ones at once, of longer ones in pieces. Stored, as decoding is dear and read more than once."""
    found = stored(found.withColumn("seq_id", F.col("seq_id").cast("string")))
    held = packed(pieces, model.tracks).withColumn("seq_id", F.col("seq_id").cast("string"))
    size = F.col("region_end") - F.col("region_start")
    short, long = found.where(size <= whole), found.where(size > whole)
    bases = short.agg(F.sum(size)).first()[0]
    rows = [spans.annotate_whole(packed_parts(short, held), model, bases)] if bases else []
    rows += [] if long.isEmpty() else [spans.annotate_pieces(stored(packed_parts(long, held), wide=True), model)]
    # Both have the model's columns; without regions there is nothing of either.
    return stored(reduce(DataFrame.unionByName, rows)) if rows else found.sparkSession.createDataFrame([], model.schema)


def _numbers(rows: DataFrame) -> DataFrame:
    """(GENE, gene_no): genes by their first coding base within their contig."""
    return genes.numbered(rows.select(*GENE).distinct().withColumnRenamed("gene_start", "first_cds")).withColumnRenamed("first_cds", "gene_start")


def _placed(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    return rows.join(numbers, GENE)


#: The older model's tracks.
TRACKS = spans.UntranslatedModel.tracks


def predict_tracks(genome: DataFrame, scorer: TrackScorer, window: int = WINDOW, flank: int = FLANK, piece: int = PIECE, cells: bool = False) -> DataFrame:
    """predict, for a scorer of the older model's tracks."""
    cut = windows_of_pieces(genome, window, flank, piece) if "start" in genome.columns else tiling.windows(genome, window, flank)
    return scored(tiling.both_strands(cut, window), scorer, window, flank, tracks=TRACKS, cells=cells)


def decode_tracks(
    pieces: DataFrame, contigs: DataFrame, lineage: str, average: float = 0.1, most: float = 0.5, min_cds_length: int = 60, min_cds_score: float | None = None, min_intron: int = 1,
    cut_codons: bool = False, whole: int = WHOLE,
) -> DataFrame:
    """decode, by the older model: genes reach over their untranslated regions, exons have lines of their own. Write them with intron_score."""
    score = genes.least_score(min_cds_score, lineage)
    found = found_regions(pieces, average, most, TRACKS[0])
    parts = _decoded(found, pieces, spans.UntranslatedModel(min_cds_length, score, min_intron, cut_codons), whole)
    return untranslated_rows(parts, contigs)


def untranslated_rows(parts: DataFrame, contigs: DataFrame) -> DataFrame:
    """Feature rows of genes given as exons and coding runs (hmm_utr.PARTS)."""
    numbers = _numbers(parts)
    cds = genes.cds_phases(parts.where("type = 'CDS'"), GENE)
    exons = parts.where("type = 'exon'").withColumn("part", F.row_number().over(W.partitionBy(*GENE).orderBy("start")))
    return genes.gff_rows(checked(_placed(cds, numbers), contigs), exons=checked(_placed(exons, numbers), contigs))


def annotate_tracks(genome: DataFrame, scorer: TrackScorer, lineage: str, window: int = WINDOW, flank: int = FLANK, piece: int = PIECE, **thresholds: float | None) -> DataFrame:
    """annotate, by the older model."""
    return decode_tracks(stored(predict_tracks(genome, scorer, window, flank, piece, cells=True), wide=window > 4096), contigs_of(genome), lineage, **thresholds)


def annotate(genome: DataFrame, scorer: Scorer, window: int = WINDOW, flank: int = FLANK, piece: int = PIECE, **thresholds: float | str | None) -> DataFrame:
    """genome (seq_id, seq_ord, length, seq), or pieces of one, to feature rows; every window is scored once."""
    return decode(stored(predict(genome, scorer, window, flank, piece, cells=True), wide=window > 4096), contigs_of(genome), **thresholds)


def annotate_to(genome: DataFrame, scorer: Scorer, path: str, **options: float | str | None) -> None:
    """annotate, written as GFF3 text."""
    write_gff(annotate(genome, scorer, **options), contigs_of(genome), path)
