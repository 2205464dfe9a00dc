"""Stand-in inputs over the provided tables: the same SQL text in Spark and in the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandloom.session import spread, stored

SERIES_SQL = """
    SELECT user_id AS key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos, value,
           CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN 2 ELSE 1 END AS class,
           CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 3 ELSE 2 END AS class4,
           CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 + event_id % 3 END AS weight
    FROM {events}
"""

#: Children of a gene, numbered; starts rise with the number, ends are inclusive, neighbours may be near or overlap.
FEATURES_SQL = """
    SELECT l_orderkey AS gene_id, child_no, o_custkey % 40 AS seq_id, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END AS strand,
           (l_orderkey % 300) * 1500 + child_no * 90 + l_partkey % 40 AS start_pos,
           (l_orderkey % 300) * 1500 + child_no * 90 + l_partkey % 40 + CAST(l_quantity AS BIGINT) * 2 + l_suppkey % 9 AS end_pos,
           l_discount * 10 AS score, l_returnflag AS kind
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS child_no FROM {lineitem}) l
    JOIN {orders} o ON o_orderkey = l_orderkey
"""

#: Genes, transcripts, exons and coding parts out of those children: some genes of a masked type, some transcripts of another type, some second transcripts.
MODEL_SQL = """
    SELECT gene_id * 100 AS line_no, seq_id, CASE WHEN gene_id % 11 = 0 THEN 'pseudogene' ELSE 'gene' END AS type, min(start_pos) AS start_at, max(end_pos) + 1 AS end_at, strand,
           CAST(NULL AS INT) AS phase, concat('g', gene_id) AS id, CAST(NULL AS STRING) AS parent FROM {features} GROUP BY gene_id, seq_id, strand
    UNION ALL SELECT gene_id * 100 + 1, seq_id, CASE WHEN gene_id % 13 = 0 THEN 'lnc_RNA' ELSE 'mRNA' END, min(start_pos), max(end_pos) + 1, strand, NULL, concat('t', gene_id), concat('g', gene_id) FROM {features} GROUP BY gene_id, seq_id, strand
    UNION ALL SELECT gene_id * 100 + 2, seq_id, 'mRNA', min(start_pos), min(start_pos) + 50, strand, NULL, concat('u', gene_id), concat('g', gene_id) FROM {features} WHERE gene_id % 5 = 0 GROUP BY gene_id, seq_id, strand
    UNION ALL SELECT gene_id * 100 + 10 + 2 * child_no, seq_id, 'exon', start_pos, end_pos + 1, strand, NULL, NULL, concat('t', gene_id) FROM {features}
    UNION ALL SELECT gene_id * 100 + 11 + 2 * child_no, seq_id, 'CDS', start_pos + gene_id % 3, end_pos + 1, strand, CAST(child_no % 3 AS INT), NULL, concat('t', gene_id) FROM {features} WHERE kind <> 'N'
"""
#: Forty contigs, each the same stretch of letters over and over, begun at another letter.
CONTIG_LENGTH = 449_700
CONTIGS_SQL = f"""
    SELECT seq_id, substring(repeat('ATGGCATTAACGCATCTAGGTCATTGACCATGTTACG', 12200), CAST(seq_id AS INT) % 37 + 1, {CONTIG_LENGTH}) AS seq FROM {{features}} GROUP BY seq_id
"""

DNA_SQL = """
    SELECT doc_id AS seq_id, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', ''{flag}) AS seq FROM {documents}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in tables})


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SERIES_SQL, "events")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene_id, child_no, seq_id, strand, start, end, score, kind."""
    return _parts(spark, sf_dir).withColumnRenamed("start_pos", "start").withColumnRenamed("end_pos", "end")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEATURES_SQL with the parts of a gene in one of many small tasks, whatever the size of the tables."""
    return spark.sql(FEATURES_SQL, lineitem=spread(table(spark, sf_dir, "lineitem"), "l_orderkey"), orders=table(spark, sf_dir, "orders"))


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """features, numbered and joined once for a query that reads them several times, dealt by gene."""
    return spread(stored(features(spark, sf_dir)), "gene_id")


def _model_rows(parts: DataFrame) -> DataFrame:
    """What MODEL_SQL gives, in one pass over parts that are dealt by gene: the first part of a gene brings the gene's own rows along."""
    gene, kinds = W.partitionBy("gene_id", "seq_id", "strand").orderBy("child_no"), "line_no long, type string, start long, end long, phase int, id string, parent string"
    whole = gene.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = parts.withColumns({"first": F.row_number().over(gene) == 1, "low": F.min("start_pos").over(whole), "high": F.max("end_pos").over(whole)})
    n, line = F.col("gene_id"), F.col("gene_id") * 100
    named = {k: F.concat(F.lit(k), n) for k in "gtu"}
    none = F.lit(None)
    second, child = F.col("first") & (n % 5 == 0), F.col("child_no")
    each = [
        (F.col("first"), (line, F.when(n % 11 == 0, "pseudogene").otherwise("gene"), F.col("low"), F.col("high") + 1, none, named["g"], none)),
        (F.col("first"), (line + 1, F.when(n % 13 == 0, "lnc_RNA").otherwise("mRNA"), F.col("low"), F.col("high") + 1, none, named["t"], named["g"])),
        (second, (line + 2, F.lit("mRNA"), F.col("low"), F.col("low") + 50, none, named["u"], named["g"])),
        (F.lit(True), (line + 10 + 2 * child, F.lit("exon"), F.col("start_pos"), F.col("end_pos") + 1, none, none, named["t"])),
        (F.col("kind") != "N", (line + 11 + 2 * child, F.lit("CDS"), F.col("start_pos") + n % 3, F.col("end_pos") + 1, child % 3, none, named["t"])),
    ]
    fields = [k.split() for k in kinds.split(", ")]
    made = F.array(*(F.when(when, F.struct(*(v.cast(kind).alias(name) for v, (name, kind) in zip(values, fields, strict=True)))) for when, values in each))
    out = rows.select("seq_id", "strand", F.explode(made).alias("x")).where("x is not null")
    return out.select("x.line_no", "seq_id", "x.type", "x.start", "x.end", "strand", "x.phase", "x.id", "x.parent")


def model_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(genome, features) for the label workflow."""
    rows = stored(_model_rows(_parts(spark, sf_dir)))
    contigs = spark.sql(CONTIGS_SQL, features=rows)
    # Read many times over; as a view each window would build its whole contig again.
    return stored(contigs.select("seq_id", F.col("seq_id").alias("seq_ord"), F.lit(CONTIG_LENGTH).cast("long").alias("length"), F.col("seq").cast("binary").alias("seq"))), rows


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, seq): the letters A, C, G and T of the documents; those without any are left out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # A table of one or two small files would be cleaned by one or two tasks.
    if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        docs = docs.repartition(spark.sparkContext.defaultParallelism)
    # What DNA_SQL gives: runs of other letters go at once, and only what is left is translated.
    letters = F.translate(F.regexp_replace("text", "[^ACGTacgt]+", ""), "acgt", "ACGT")
    return docs.where(F.col("text").rlike("[ACGTacgt]")).select(F.col("doc_id").alias("seq_id"), letters.alias("seq"))


def probability_chunks(genome: DataFrame, chunk: int = 3000) -> DataFrame:
    """(seq_id, length, start, genic): a deterministic genic probability by position, in chunks of a multiple of the bin."""
    rows = genome.select("seq_id", F.length("seq").cast("long").alias("length"))
    rows = rows.select("seq_id", "length", F.explode(F.expr(f"sequence(0L, length - 1, {chunk}L)")).alias("start"))
    positions = F.sequence(F.col("start"), F.least(F.col("start") + chunk, F.col("length")) - 1)

    def genic(p):
        hot = ((F.floor(p / 150) * 7 + F.col("seq_id") * 3) % 5) < 2
        inside, outside = F.when(hot, 60 + p % 30).otherwise(p % 4), F.when(hot, 1).otherwise(96)
        return inside * F.lit(1.0) / (outside + inside)

    return rows.select("seq_id", "length", "start", F.transform(positions, genic).alias("genic"))
