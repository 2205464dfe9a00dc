import random

import pytest
from pyspark.sql import functions as F

from strandloom.plans import samples, views

SCHEMA = "line_no long, seq_id string, type string, start long, end long, strand int, phase int, id string, parent string"


def annotation(n, seed):
    """Genes of which exons and coding parts overlap at will, some without either; a few have a shorter mRNA or another longer transcript."""
    r, rows = random.Random(seed), []
    for g in range(n):
        seq_id, strand, at, line = r.choice("ab"), r.choice([1, -1]), 40 * g, 100 * g
        rows.append((line, seq_id, "gene", at, at + 60, strand, None, f"g{g}", None))
        rows.append((line + 1, seq_id, "mRNA", at, at + 60, strand, None, f"t{g}", f"g{g}"))
        if r.random() < 0.3:
            rows.append((line + 2, seq_id, r.choice(["mRNA", "V_gene_segment"]), at, at + r.choice([30, 90]), strand, None, f"u{g}", f"g{g}"))
        for k in range(r.randrange(8)):
            a = at + r.randrange(60)
            rows.append((line + 3 + k, seq_id, r.choice(["exon", "exon", "CDS"]), a, a + r.randrange(-1, 25), strand, 0, None, r.choice([f"t{g}", f"u{g}"])))
    return rows


def totals(rows):
    """Base by base: what exons of the longest mRNAs hold before and behind the coding bases."""
    out = [0, 0, 0]
    for g in (r for r in rows if r[2] == "gene"):
        own = [r for r in rows if r[2] == "mRNA" and r[8] == g[7] and r[1] == g[1] and r[4] > r[3]]
        if not own:
            continue
        name = max(own, key=lambda r: (r[4] - r[3], -r[0]))[7]
        parts = [r for r in rows if r[8] == name and r[1] == g[1]]
        coding = [r for r in parts if r[2] == "CDS"]
        if not coding:
            continue
        a, b = min(r[3] for r in coding), max(r[4] for r in coding)
        exon = {p for r in parts if r[2] == "exon" for p in range(r[3], r[4])}
        sides = [sum(p < a for p in exon), sum(p >= b for p in exon)][:: g[5]]
        if min(sides) > 0:
            out = [out[0] + sides[0], out[1] + sides[1], out[2] + 1]
    return tuple(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_untranslated_totals_match_a_count_of_bases(spark, seed):
    rows = annotation(300, seed)
    wanted = totals(rows)
    assert tuple(samples.utr_totals(spark.createDataFrame(rows, SCHEMA).repartition(3)).first()) == wanted and wanted[2] > 5


def test_an_annotation_is_read_few_times_over(spark):
    rows = spark.createDataFrame(annotation(40, 3), SCHEMA)
    genome = spark.createDataFrame([(s, k, 2000, bytearray(b"ACGGCGCCAT" * 200)) for k, s in enumerate("ab")], "seq_id string, seq_ord int, length long, seq binary")
    counter = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    samples.tracks(rows.mapInArrow(count, rows.schema), genome, mask_length=10).write.format("noop").mode("overwrite").save()
    assert counter.value <= 8 * rows.count()


def test_model_rows_are_those_of_the_sql(spark, tmp_path):
    lines = [(o, k % 3, 7 * o % 50, k + o % 9, float((10 * o + k) % 49 + 1), 100.0 * k, "2020-01-01", 0.05 * (k % 3), "NRA"[(o + k) % 3]) for o in range(150) for k in range(1 + o % 7)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate string, l_discount double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(o, 11 * o % 97) for o in range(150)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    genome, rows = views.model_rows(spark, str(tmp_path))
    wanted = spark.sql(views.MODEL_SQL, features=views._parts(spark, str(tmp_path))).withColumnRenamed("start_at", "start").withColumnRenamed("end_at", "end")
    assert dict(rows.dtypes) == dict(wanted.dtypes) and rows.columns == wanted.columns
    assert sorted(map(str, rows.collect())) == sorted(map(str, wanted.collect())) and rows.where("type = 'CDS'").count() > 100
    assert genome.count() == rows.select("seq_id").distinct().count() and genome.where(F.length("seq") != views.CONTIG_LENGTH).isEmpty()
