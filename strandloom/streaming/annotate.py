"""Annotation of contigs as they arrive: each micro-batch is a genome of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.plans.annotate import annotate
from strandloom.plans.scoring import Scorer


def contig_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(seq_id, length, seq) of FASTA records in files that appear in the folder."""
    records = spark.readStream.option("lineSep", "\n>").text(folder)
    record = F.regexp_replace(F.col("value"), "^>", "")
    body = F.regexp_replace(F.regexp_replace(record, r"^[^\n]*(\n|$)", ""), r"[\s]+", "")
    rows = records.select(F.regexp_extract(record, r"^(\S*)", 1).alias("seq_id"), body.cast("binary").alias("seq")).where("seq_id <> ''")
    return rows.select("seq_id", F.octet_length("seq").cast("long").alias("length"), "seq")


def annotate_stream(contigs: DataFrame, scorer: Scorer, out: str, checkpoint: str, **options: float) -> StreamingQuery:
    """Feature rows of each batch, as Parquet under out/batch=N; a batch that is done again overwrites its own folder."""

    def batch(rows: DataFrame, number: int) -> None:
        genome = rows.withColumn("seq_ord", F.xxhash64("seq_id"))
        annotate(genome, scorer, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return contigs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
