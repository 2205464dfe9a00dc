"""GFF3 in and out: lines as rows, attributes as maps, features as trees by parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.session import stored


_FIELDS = ("seqid", "source", "type", "start", "end", "score", "strand", "phase")


def _pairs(text: Column) -> Column:
    """The key=value pieces in order: the value is what stands between the first and the second '='."""
    pieces = F.transform(F.filter(F.split(text, ";"), lambda p: p.contains("=")), lambda p: F.split(F.trim(p), "="))
    return F.transform(pieces, lambda p: F.struct(p[0].alias("key"), p[1].alias("value")))


def attribute(text: Column, key: str) -> Column:
    """The value of one key; of equal keys the last counts."""
    own = F.filter(F.split(text, ";"), lambda p: p.contains("=") & (F.trim(F.substring_index(p, "=", 1)) == key))
    return F.get(F.split(F.trim(F.try_element_at(own, F.lit(-1))), "="), F.lit(1))


def _cut(lines: DataFrame, value: str) -> DataFrame:
    rows = lines.where(~F.col(value).startswith("#")).select("line_no", F.split(F.trim(value), "\t").alias("c")).where("size(c) >= 9")
    fields = [F.get("c", F.lit(k)).try_cast("long" if n in ("start", "end") else "string").alias(n) for k, n in enumerate(_FIELDS)]
    return rows.select("line_no", *fields, F.get("c", F.lit(8)).alias("text"))


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """GFF rows of lines (line_no, value) with a map of attributes; comments, blank lines and lines of under nine columns are left out."""
    rows = _cut(lines, value).withColumn("pairs", _pairs(F.col("text")))
    # Of equal keys the last counts: its place is the last one in the array of keys.
    keys = rows.withColumn("keys", F.transform("pairs", lambda p: p["key"]))
    last = F.filter("pairs", lambda p, i: F.size("pairs") - F.array_position(F.reverse("keys"), p["key"]) == i)
    return keys.select("line_no", *_FIELDS, F.map_from_entries(last).alias("attributes"))


def parse_links(lines: DataFrame, value: str = "value") -> DataFrame:
    """GFF rows of lines with id and parent alone, which is all that joins need."""
    return _cut(lines, value).select("line_no", *_FIELDS, attribute(F.col("text"), "ID").alias("id"), attribute(F.col("text"), "Parent").alias("parent"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value); numbers rise in file order but are not dense."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def filter_gff(spark: SparkSession, path: str, out: str) -> None:
    """without_repeated_genes from file to file; part files keep the order of lines."""
    kept = without_repeated_genes(read_lines(spark, path))
    kept.repartitionByRange("line_no").sortWithinPartitions("line_no").select("value").write.text(out)


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(read_lines(spark, path))


def with_each_parent(rows: DataFrame) -> DataFrame:
    """rows with one row for each name in `parent`, a list with commas; features without one keep a null.

    Names stay percent-coded as the file has them, so a comma within a name (%2C) parts nothing.
    """
    names = F.filter(F.split(F.col("parent"), ","), lambda p: p != "")
    return rows.withColumn("parent", F.explode_outer(F.when(F.size(names) > 0, F.array_distinct(names))))


def children(features: DataFrame, parents: DataFrame) -> DataFrame:
    """Features of which one of the Parent attribute's names is the ID of one of `parents`, with its line number and identifier; a row for each such parent."""
    own = with_each_parent(features.withColumn("parent", F.try_element_at("attributes", F.lit("Parent"))))
    above = parents.select(F.try_element_at("attributes", F.lit("ID")).alias("parent"), F.col("line_no").alias("parent_line"))
    return own.join(above, "parent")


def _closure(links: DataFrame, most_rounds: int) -> DataFrame:
    """(node, up, depth) of links (node, up): all that a node reaches and the fewest steps to it.

    A round knows all pairs of up to k steps and adds those of up to 2 * k: a
    shortest path of more than k steps is one of exactly k and one of at most k
    behind it, so only pairs of exactly k steps are joined. A node that reaches
    itself is an error.
    """
    reach = stored(links.distinct().withColumn("depth", F.lit(1).cast("long")))
    for n in range(most_rounds + 1):
        loop = reach.where("node = up").first()
        if loop is not None:
            raise ValueError(f"{loop['node']} is its own ancestor")
        ends = reach.where(F.col("depth") == 2**n)
        if ends.isEmpty():
            return reach
        further = reach.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"))
        longer = ends.join(further, "up").select("node", F.col("far").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        if n == most_rounds:
            if longer.isEmpty():
                return reach
            break
        reach = stored(reach.unionByName(longer).groupBy("node", "up").agg(F.min("depth").alias("depth")))
    raise ValueError(f"features nest deeper than {2**most_rounds} levels")


def ancestors(rows: DataFrame, most_rounds: int = 12) -> DataFrame:
    """(line_no, ancestor, depth) of rows (line_no, id, parent): every feature with all identifiers above it, and the fewest steps to each.

    Features may have several parents, and an identifier several lines. Parents
    that no feature is named by count as ancestors. A feature above itself is an
    error; features without parents have no rows.
    """
    each = stored(with_each_parent(rows.select("line_no", "id", "parent")).where("parent is not null"))
    reach = _closure(each.where("id is not null").select(F.col("id").alias("node"), F.col("parent").alias("up")), most_rounds)
    # A line that alone has its identifier has that one's ancestors; others have those of their own parents.
    alone = each.where("id is not null").groupBy(F.col("id").alias("node")).agg(F.min("line_no").alias("line_no"), F.max("line_no").alias("last")).where("line_no = last").drop("last")
    rest = each.join(alone, "line_no", "left_anti")
    direct = rest.select("line_no", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("depth"))
    above = rest.join(reach.withColumnRenamed("node", "parent"), "parent").select("line_no", F.col("up").alias("ancestor"), (F.col("depth") + 1).alias("depth"))
    shared = direct.unionByName(above).groupBy("line_no", "ancestor").agg(F.min("depth").alias("depth"))
    return reach.join(alone, "node").select("line_no", F.col("up").alias("ancestor"), "depth").unionByName(shared)


def trees(rows: DataFrame, most_rounds: int = 12) -> DataFrame:
    """(line_no, root_line, depth): every feature with the lines of the parentless features above it; such a feature is its own root at depth 0."""
    roots = rows.where(F.coalesce("parent", F.lit("")) == "")
    named = roots.where("id is not null").select(F.col("id").alias("ancestor"), F.col("line_no").alias("root_line"))
    below = ancestors(rows, most_rounds).join(named, "ancestor").groupBy("line_no", "root_line").agg(F.min("depth").alias("depth"))
    return below.unionByName(roots.select("line_no", F.col("line_no").alias("root_line"), F.lit(0).cast("long").alias("depth")))


def repeated_genes(rows: DataFrame) -> DataFrame:
    """(line_no) of genes whose ID another gene has too, of their mRNAs, and of those' exons and coding parts; rows has line_no, type, id and parent."""
    genes = rows.where("type = 'gene' and id is not null")
    twice = genes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    transcripts = rows.where("type = 'mRNA'").join(twice.withColumnRenamed("id", "parent"), "parent", "left_semi")
    parts = rows.where("type in ('exon', 'CDS')").join(transcripts.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi")
    return genes.join(twice, "id", "left_semi").select("line_no").union(transcripts.select("line_no")).union(parts.select("line_no"))


def without_repeated_genes(lines: DataFrame) -> DataFrame:
    """lines (line_no, value) without those of repeated genes and without blank ones; comments stay."""
    bad = repeated_genes(stored(parse_links(lines).select("line_no", "type", "id", "parent")))
    kept = lines.where(F.trim("value") != "")
    good = F.size(F.split(F.trim("value"), "\t")) >= 9
    return kept.where(F.col("value").startswith("#") | good).join(bad, "line_no", "left_anti")


def to_lines(rows: DataFrame) -> DataFrame:
    """Nine tab-separated columns of GFF rows with attributes as text."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in ("seq_id", "source", "type", "start", "end", "score", "strand", "phase", "attributes")]
    return rows.withColumn("value", F.concat_ws("\t", *fields))


ORDER = ("seq_ord", "side", "kind", "gene_no", "rank", "part", "step")


def file_lines(rows: DataFrame, contigs: DataFrame, intron_score: bool = False) -> DataFrame:
    """(ORDER, value): rows of operators.genes.gff_rows as the lines of a file, with the comments around genes, strands and contigs.

    Each contig and strand has a heading, and a note where it has no gene. The
    older model's files note an intron score for each gene, which it leaves at 0.
    """
    side = F.when(F.col("strand") == "-", 1).otherwise(0).alias("side")

    body = to_lines(rows).select("seq_ord", side, "gene_no", F.lit(1).alias("kind"), "rank", "part", F.lit(0).alias("step"), "value")
    each = rows.where("rank = 0").select("seq_ord", side, F.col("gene_no"), F.concat(F.lit("g"), F.col("gene_no").cast("string")).alias("g"), F.col("cds_score").cast("string").alias("score"))
    notes = [(-1, 0, F.concat(F.lit("# Start gene "), "g")), (-1, 1, F.concat(F.lit("# The CDS score is "), "score")), (9, 0, F.concat(F.lit("# End gene "), "g")), (9, 1, F.lit("###"))]
    notes += [(-1, 2, F.lit("# The intron score is 0"))] if intron_score else []
    # All of a gene's notes out of one row: a union of them would make the genes again for each.
    lines = F.array(*(F.struct(F.lit(rank).alias("rank"), F.lit(0).alias("part"), F.lit(step).alias("step"), text.alias("value")) for rank, step, text in notes))
    body = body.unionByName(each.select("seq_ord", "side", "gene_no", F.lit(1).alias("kind"), F.inline(lines)))

    number = (F.col("seq_ord") + 1).cast("string")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.lit("forward").alias("name")), F.struct(F.lit(1).alias("side"), F.lit("reverse").alias("name")))).alias("s")
    heads = contigs.select("seq_id", "seq_ord", "length", sides).select("seq_id", "seq_ord", "length", "s.side", "s.name")
    heads = heads.join(each.select("seq_ord", "side", F.lit(True).alias("some")).distinct(), ["seq_ord", "side"], "left")
    title = F.concat(F.lit("# ----- prediction on sequence number "), number, F.lit(" (length = "), F.col("length").cast("string"), F.lit(", name = "), F.col("seq_id").cast("string"), F.lit(") -----"))
    lines = F.concat(
        F.when(F.col("side") == 0, F.array(F.lit("#"), title)).otherwise(F.array().cast("array<string>")),
        F.array(F.lit("#"), F.concat(F.lit("# Predicted genes for sequence number "), number, F.lit(" on "), "name", F.lit(" strands"))),
        F.when(F.col("some").isNull(), F.array(F.lit("# None"), F.lit("###"))).otherwise(F.array().cast("array<string>")),
    )
    heads = heads.select("seq_ord", "side", F.lit(0).alias("gene_no"), F.lit(0).alias("kind"), F.lit(0).alias("rank"), F.lit(0).alias("part"), F.posexplode(lines).alias("step", "value"))
    return heads.unionByName(body).select(*ORDER, "value")


def write_gff(rows: DataFrame, contigs: DataFrame, path: str, intron_score: bool = False) -> None:
    """file_lines as text under a version line; range partitioning on the sort key keeps the order over many part files."""
    first = contigs.sparkSession.range(1).select(*(F.lit(-1).alias(c) for c in ORDER), F.lit("##gff-version 3").alias("value"))
    first.unionByName(file_lines(rows, contigs, intron_score)).orderBy(*ORDER).select("value").write.text(path)
