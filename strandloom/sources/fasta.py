"""FASTA in: a row per contig, sequence as binary, case kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandloom.session import new_folder

EXTENSIONS = (".fasta", ".fna", ".fa")


def check_extension(path: str) -> str:
    if not path.lower().endswith(EXTENSIONS):
        raise ValueError(f"{path}: a FASTA file ends in {', '.join(EXTENSIONS)}")
    return path


def read_fasta(spark: SparkSession, path: str, unique: bool = True) -> DataFrame:
    """(seq_id, seq_ord, length, seq): a record begins at a line that begins with '>'.

    The identifier is the header up to the first white space; seq_ord is the
    record's place in the input. A repeated identifier is an error unless
    `unique` is off. Read by Spark's text source, so any store and many files do.
    """
    records = spark.read.option("lineSep", "\n>").text(path).select(F.monotonically_increasing_id().alias("place"), F.col("_metadata.file_path").alias("file"), "value")
    record = F.regexp_replace(F.col("value"), "^>", "")
    head = F.regexp_extract(record, r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace(record, r"^[^\n]*(\n|$)", ""), r"[\s]+", "")
    rows = records.select("file", "place", F.regexp_extract(head, r"^(\S*)", 1).alias("seq_id"), body.cast("binary").alias("seq")).where("seq_id <> ''")
    names = rows.select("file", "place", "seq_id")
    order = names.withColumn("seq_ord", (F.row_number().over(W.orderBy("file", "place")) - 1).cast("int"))
    if unique:
        same = F.count("*").over(W.partitionBy("seq_id"))
        order = order.withColumn("seq_ord", F.when(same == 1, F.col("seq_ord")).otherwise(F.raise_error(F.concat(F.lit("repeated sequence identifier "), F.col("seq_id"))).cast("int")))
    return rows.join(order.drop("seq_id"), ["file", "place"]).select("seq_id", "seq_ord", F.octet_length("seq").cast("long").alias("length"), "seq")


def write_fasta(genome: DataFrame, path: str | None = None, width: int = 60) -> str:
    """genome (seq_id, seq) as FASTA text with lines of `width` bases, many files in a folder; gives the folder, a new one where none is named."""
    path = path or new_folder(genome.sparkSession, "fasta")
    lines = F.regexp_replace(F.col("seq").cast("string"), f"(.{{{width}}})(?!$)", "$1\n")
    genome.select(F.concat(F.lit(">"), F.col("seq_id").cast("string"), F.lit("\n"), lines)).write.text(path)
    return path


def chunks(genome: DataFrame, size: int = 1 << 20) -> DataFrame:
    """(seq_id, seq_ord, length, start, seq): contigs cut into binary pieces, for storage and for work on long ones."""
    starts = genome.where("length > 0").select("seq_id", "seq_ord", "length", "seq", F.explode(F.expr(f"sequence(0L, length - 1, {size}L)")).alias("start"))
    return starts.select("seq_id", "seq_ord", "length", "start", F.substring("seq", (F.col("start") + 1).cast("int"), F.lit(size)).alias("seq"))


def read_species(spark: SparkSession, path: str) -> DataFrame:
    """(species): one per line, white space around them cut, empty lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("species")).where("species <> ''")
