import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.plans import annotate as plan
from strandloom.plans.scoring import CompositionScorer, DenseScorer
from strandloom.sources import fasta, fasta_ranges, gff
from strandloom.streaming.annotate import annotate_stream, contig_stream

from .test_hmm import gene
from .test_hmm_utr import gene as older_gene


def test_fasta(spark, tmp_path):
    path = tmp_path / "g.fna"
    path.write_text(">one first contig\nACGT\nacgn\n>two\n\n>three x>y\r\nAC\r\nGT\r\n")
    rows = fasta.read_fasta(spark, fasta.check_extension(str(path))).orderBy("seq_ord").collect()
    assert [(r["seq_id"], r["seq_ord"], r["length"], bytes(r["seq"])) for r in rows] == [("one", 0, 8, b"ACGTacgn"), ("two", 1, 0, b""), ("three", 2, 4, b"ACGT")]
    cut = fasta.chunks(fasta.read_fasta(spark, str(path)), 3).where("seq_id = 'one'").orderBy("start").collect()
    assert [bytes(r["seq"]) for r in cut] == [b"ACG", b"Tac", b"gn"]
    path.write_text(">a\nAC\n>a\nGT\n")
    with pytest.raises(Exception, match="repeated sequence identifier a"):
        fasta.read_fasta(spark, str(path)).collect()
    with pytest.raises(ValueError):
        fasta.check_extension("g.txt")
    (tmp_path / "s.txt").write_text(" a \n\nb\n")
    assert [r["species"] for r in fasta.read_species(spark, str(tmp_path / "s.txt")).collect()] == ["a", "b"]


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "line_no long, value string")


def test_gff_lines(spark):
    row = gff.parse_lines(lines(spark, "# c", "", "short\tline", "c1\ts\tgene\t5\t9\t.\t+\t.\tID=g1;note=a=b;flag;ID=g2")).collect()
    assert len(row) == 1 and (row[0]["start"], row[0]["end"]) == (5, 9) and row[0]["attributes"] == {"ID": "g2", "note": "a"}


def test_repeated_genes_go_with_their_parts(spark):
    def line(kind, attributes):
        return f"c\ts\t{kind}\t1\t9\t.\t+\t.\t{attributes}"

    text = ["# head", line("gene", "ID=g1"), line("mRNA", "ID=t1;Parent=g1"), line("exon", "Parent=t1"), line("UTR", "Parent=t1"), line("gene", "ID=g1"), line("gene", "ID=g2"), line("mRNA", "ID=t2;Parent=g2"), line("CDS", "Parent=t2"), ""]
    kept = {r["line_no"] for r in gff.without_repeated_genes(lines(spark, *text)).collect()}
    assert kept == {0, 4, 6, 7, 8}


def test_trees_of_any_depth_with_several_parents(spark):
    def line(name, parents):
        attributes = [f"ID={name}"] * bool(name) + [f"Parent={parents}"] * bool(parents)
        return "\t".join(["c", "s", "x", "1", "9", ".", "+", ".", ";".join(attributes)])

    text = [line("g", ""), line("h", ""), line("t", "g,h"), line("u", "t"), line("", "u,g"), line("", "nobody"), line("v%2Cw", "u"), line("", "v%2Cw,v"), line("u", "h"), line("", "")]
    rows = gff.parse_links(lines(spark, *text))
    got = {(r["line_no"], r["ancestor"]): r["depth"] for r in gff.ancestors(rows).collect()}
    assert got == {
        (2, "g"): 1, (2, "h"): 1, (3, "t"): 1, (3, "g"): 2, (3, "h"): 2, (4, "u"): 1, (4, "g"): 1, (4, "t"): 2, (4, "h"): 2, (5, "nobody"): 1,
        (6, "u"): 1, (6, "t"): 2, (6, "h"): 2, (6, "g"): 3, (7, "v%2Cw"): 1, (7, "v"): 1, (7, "u"): 2, (7, "t"): 3, (7, "h"): 3, (7, "g"): 4, (8, "h"): 1,
    }
    roots = {(r["line_no"], r["root_line"], r["depth"]) for r in gff.trees(rows).collect()}
    assert {(0, 0, 0), (1, 1, 0), (9, 9, 0), (4, 0, 1), (4, 1, 2), (7, 0, 4), (7, 1, 3)} <= roots and not any(a == 5 for a, _, _ in roots)
    both = gff.children(gff.parse_lines(lines(spark, *text)), gff.parse_lines(lines(spark, *text)))
    assert {(r["line_no"], r["parent_line"]) for r in both.collect()} >= {(2, 0), (2, 1), (4, 0), (4, 3), (4, 8)}
    deep = [line(f"d{k}", f"d{k - 1}" if k else "") for k in range(40)]
    assert gff.ancestors(gff.parse_links(lines(spark, *deep))).count() == 40 * 39 // 2
    with pytest.raises(ValueError, match="own ancestor"):
        gff.ancestors(gff.parse_links(lines(spark, line("a", "b"), line("b", "c"), line("c", "a"))))


class Planted:
    """Scores by the sequence's own truth: upper-case letters map to the classes of a known gene, either strand."""

    def __init__(self, seq, p):
        self.seq, self.p = seq, p

    def score(self, windows):
        out = np.tile([0.96, 0.01, 0.01, 0.01, 0.01], (len(windows), len(windows[0]), 1))
        for k, w in enumerate(windows):
            for at in range(len(w)):
                n = min(24, len(w) - at)
                if w[at : at + n] and (j := self.seq.find(w[at : at + n])) >= 0 and n == 24:
                    m = min(len(w) - at, len(self.seq) - j)
                    out[k, at : at + m] = self.p[j : j + m]
                    break
        return out


@pytest.fixture(scope="module")
def planted():
    seq, p, _ = gene(90, 100, seed=4)
    pad = "TC" * 130
    turned = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    return seq, p, pad + seq + pad, pad + turned + pad


def test_annotation_finds_a_planted_gene_on_either_strand(spark, planted, tmp_path):
    seq, p, forward, backward = planted
    rows = [("fwd", 0, len(forward), forward.encode()), ("rev", 1, len(backward), backward.encode()), ("none", 2, 300, b"TC" * 150)]
    genome = spark.createDataFrame(rows, "seq_id string, seq_ord int, length long, seq binary")
    for window in (4096, 700):
        got = plan.annotate(genome, Planted(seq, p), window, 400).collect()
        genes = {r["seq_id"]: r for r in got if r["type"] == "gene"}
        assert set(genes) == {"fwd", "rev"} and genes["fwd"]["strand"] == "+" and genes["rev"]["strand"] == "-"
        n = len(seq) - 4
        assert (genes["fwd"]["start"], genes["fwd"]["end"]) == (263, 262 + n) == (genes["rev"]["start"], genes["rev"]["end"])
        assert sum(r["type"] == "CDS" for r in got) == 4 and {r["phase"] for r in got if r["type"] == "CDS"} == {"0", "2"}
    plan.annotate_to(genome, Planted(seq, p), str(tmp_path / "out"), window=4096, flank=400)
    text = [r["value"] for part in sorted((tmp_path / "out").glob("part-*")) for r in spark.read.text(str(part)).collect()]
    assert text[:5] == ["##gff-version 3", "#", f"# ----- prediction on sequence number 1 (length = {len(forward)}, name = fwd) -----", "#", "# Predicted genes for sequence number 1 on forward strands"]
    assert text[5] == "# Start gene g1" and text[6].startswith("# The CDS score is ") and text.count("# None") == 4 and text.count("# End gene g1") == 2
    back = gff.parse_lines(lines(spark, *text))
    assert back.count() == len(got)
    order = [v.split("\t")[2] for v in text if v.startswith("fwd\t")]
    assert order == ["gene", "transcript", "exon", "exon", "CDS", "CDS"]


def test_two_steps_equal_one(spark, planted, tmp_path):
    seq, p, forward, _ = planted
    genome = spark.createDataFrame([("fwd", 0, len(forward), forward.encode())], "seq_id string, seq_ord int, length long, seq binary")
    plan.predict(genome, Planted(seq, p), 700, 400).write.parquet(str(tmp_path / "tracks"))
    two = plan.decode(spark.read.parquet(str(tmp_path / "tracks")), genome)
    assert sorted(map(str, two.collect())) == sorted(map(str, plan.annotate(genome, Planted(seq, p), 700, 400).collect()))


def test_long_regions_and_pieces_of_contigs_give_the_same_genes(spark, planted, tmp_path):
    seq, p, forward, backward = planted
    (tmp_path / "g.fa").write_text("".join(f">{name}\n" + "\n".join(s[k : k + 60] for k in range(0, len(s), 60)) + "\n" for name, s in (("fwd", forward), ("none", "TC" * 150), ("rev", backward))))
    whole = plan.annotate(fasta.read_fasta(spark, str(tmp_path / "g.fa")), Planted(seq, p), 100, 400).collect()
    assert sum(r["type"] == "gene" for r in whole) == 2
    pieces = fasta_ranges.read_pieces(spark, str(tmp_path / "g.fa"), 400, 128)
    for genome, rest in ((pieces, {}), (pieces, {"whole": 50}), (fasta.read_fasta(spark, str(tmp_path / "g.fa")), {"whole": 50})):
        assert sorted(map(str, plan.annotate(genome, Planted(seq, p), 100, 400, piece=400, **rest).collect())) == sorted(map(str, whole))
    assert plan.annotate(pieces, Planted(seq, p), 100, 400, piece=400, lineage="Mammalia", min_cds_score=0.95).collect() == []
    assert len(plan.annotate(pieces, Planted(seq, p), 100, 400, piece=400, lineage="Mammalia", min_cds_score=0.0).collect()) == len(whole)


class PlantedTracks:
    """The tracks of a known gene of the older model where its sequence is, on either strand."""

    def __init__(self, seq, *tracks):
        self.seq, self.tracks = seq, tracks

    def score(self, windows):
        away = ([0.94, 0.02, 0.02, 0.02], [0.95, 0.05], [0.02, 0.02, 0.02, 0.94])
        out = tuple(np.tile(a, (len(windows), len(windows[0]), 1)) for a in away)
        for k, w in enumerate(windows):
            if (j := w.find(self.seq)) >= 0:
                for own, track in zip(out, self.tracks):
                    own[k, j : j + len(self.seq)] = track
        return out


def test_the_older_plan_writes_genes_with_untranslated_exons(spark, tmp_path):
    seq, classes, changes, phases, _ = older_gene()
    turned = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    pad, n = "TC" * 60, len(seq) - 8
    rows = [("fwd", 0, len(seq) + 240, (pad + seq + pad).encode()), ("rev", 1, len(seq) + 240, (pad + turned + pad).encode())]
    genome = spark.createDataFrame(rows, "seq_id string, seq_ord int, length long, seq binary")
    scorer = PlantedTracks(seq, classes, changes, phases)
    got = plan.annotate_tracks(genome, scorer, "Fungi", 4096, 400, min_cds_length=30).collect()
    for rest in ({"whole": 20}, {"window": 100, "whole": 20}):
        again = plan.annotate_tracks(genome, scorer, "Fungi", **{"window": 4096, "flank": 400, "min_cds_length": 30, **rest}).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))
    assert plan.annotate_tracks(genome, scorer, "Mammalia", 4096, 400, min_cds_length=30, min_cds_score=0.99).collect() == []
    for name, strand in (("fwd", "+"), ("rev", "-")):
        own = {k: sorted((r["start"], r["end"]) for r in got if r["seq_id"] == name and r["type"] == k and r["strand"] == strand) for k in ("gene", "exon", "CDS")}
        assert own["gene"] == [(125, 124 + n)] and [len(own[k]) for k in ("exon", "CDS")] == [2, 2]
        assert own["exon"][0][0] == 125 and own["exon"][1][1] == 124 + n and own["CDS"][0][0] == 131 and own["CDS"][1][1] == 118 + n
    gff.write_gff(plan.annotate_tracks(genome, scorer, "Fungi", 4096, 400, min_cds_length=30), plan.contigs_of(genome), str(tmp_path / "out"), intron_score=True)
    text = [r["value"] for part in sorted((tmp_path / "out").glob("part-*")) for r in spark.read.text(str(part)).collect()]
    assert text.count("# The intron score is 0") == 2 and text[text.index("# The intron score is 0") - 1].startswith("# The CDS score is 0.9")


def test_streaming_annotation(spark, planted, tmp_path):
    seq, p, forward, _ = planted
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(f">fwd x\n{forward}\n")
    stream = annotate_stream(contig_stream(spark, str(tmp_path / "in")), Planted(seq, p), str(tmp_path / "out"), str(tmp_path / "state"), window=4096, flank=400)
    stream.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("type = 'gene'").count() == 1 and got.where("type = 'CDS'").count() == 2


def test_scorers_give_distributions():
    windows = ["ACGT" * 60, "X" * 20 + "GC" * 110]
    rng = np.random.default_rng(0)
    dense = DenseScorer(rng.normal(size=(9 * 4, 6)), np.zeros(6), rng.normal(size=(6, 5)), np.zeros(5))
    for scorer in (CompositionScorer(), dense):
        p = scorer.score(windows)
        assert p.shape == (2, 240, 5) and np.allclose(p.sum(2), 1)


def test_notes_of_a_gene_come_from_one_row(spark):
    """The genes' rows are made twice, for lines and for notes, not once more for each note."""
    schema = "seq_id string, seq_ord int, gene_no int, part int, rank int, source string, type string, start long, end long, score string, strand string, phase string, attributes string, cds_score double"
    rows = spark.createDataFrame([("c", 0, g, 0, k, "s", t, 1, 9, ".", "+", ".", "ID=x", 0.5) for g in (1, 2) for k, t in enumerate(("gene", "transcript", "exon"))], schema)
    counter = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    contigs = spark.createDataFrame([("c", 0, 10)], "seq_id string, seq_ord int, length long")
    lines = gff.file_lines(rows.mapInArrow(count, schema), contigs, intron_score=True).where("kind = 1").collect()
    assert len(lines) == 2 * (3 + 5) and counter.value <= 2 * rows.count()
    assert [r["value"] for r in sorted(lines, key=lambda r: r[: len(gff.ORDER)]) if r["gene_no"] == 2 and r["value"].startswith("#")] == ["# Start gene g2", "# The CDS score is 0.5", "# The intron score is 0", "# End gene g2", "###"]
