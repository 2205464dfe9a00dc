"""Sequences of coding parts by a grid of pieces."""

from strandloom.plans import samples


def test_parts_across_pieces_and_beyond_the_contig(spark):
    seq = "ACGTTGCAAC"
    genome = spark.createDataFrame([("c", 0, 10, bytearray(seq.encode()))], "seq_id string, seq_ord int, length long, seq binary")
    spans = [(0, 3), (2, 5), (3, 4), (1, 10), (8, 30), (10, 12), (25, 30), (-2, 2), (4, 8)]
    rows = [("c", 1, k, "CDS", a, b, 0, k) for k, (a, b) in enumerate(spans)]
    parts = spark.createDataFrame(rows, "seq_id string, strand int, gene_line long, type string, start long, end long, phase int, line_no long")
    out = samples.coding_sequence(parts, genome, 4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Cells of many levels are not needed where pieces are a grid.
    assert "level" not in plan
    assert {r["gene_line"]: r["seq"] for r in out.collect()} == {k: seq[max(a, 0) : b] for k, (a, b) in enumerate(spans) if seq[max(a, 0) : b]}
