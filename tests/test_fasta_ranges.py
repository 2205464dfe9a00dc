import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandloom.operators import tiling
from strandloom.sources import fasta, fasta_ranges

TEXT = ">a first one\nACGTacgtNN\nACG\n\n>b\r\nTTTT\r\nGG\r\n>empty\n>c x>y\nAC>GT\n> no name\nGGGG\n>d\n" + "ACGTTGCA\n" * 40 + ">last"


def records(text):
    """(identifier, bases), read line by line."""
    out = []
    for line in text.split("\n"):
        if line.startswith(">"):
            out.append([(line[1:].split() or [""])[0] if line[1:2].strip() else "", ""])
        elif out:
            out[-1][1] += "".join(line.split())
    return out


def test_segments_meet_at_any_cut():
    data = TEXT.encode()

    def read(at, n):
        return data[at : at + n]

    for size in (1, 2, 3, 7, 16, 50, len(data)):
        got = []
        for start in range(0, len(data), size):
            for k, (name, bases) in enumerate(fasta_ranges.segments(read, len(data), start, min(start + size, len(data)))):
                if k:
                    got.append([name, bases.decode()])
                elif got:
                    got[-1][1] += bases.decode()
                else:
                    assert bases == b""
        assert got == records(TEXT), size


def test_a_header_without_an_end_is_an_error():
    data = b"ACGT\n>" + b"x" * (2 * fasta_ranges.HEADER)
    with pytest.raises(ValueError, match="header"):
        list(fasta_ranges.segments(lambda at, n: data[at : at + n], len(data), 0, len(data)))
    one_line = b">a\n" + b"ACGT" * fasta_ranges.HEADER
    assert [len(b) for _, b in fasta_ranges.segments(lambda at, n: one_line[at : at + n], len(one_line), 3 * fasta_ranges.HEADER, len(one_line))] == [fasta_ranges.HEADER + 3]


@pytest.mark.parametrize("byte_range, size", [(5, 8), (1 << 20, 8), (33, 1000)])
def test_pieces_equal_whole_contigs_cut(spark, tmp_path, byte_range, size):
    (tmp_path / "1.fa").write_text(TEXT)
    (tmp_path / "2.fna").write_text("ACGT\n>e\n" + "GATTACA" * 9)
    (tmp_path / "no.csv").write_text(">z\nA")
    got = fasta_ranges.read_pieces(spark, str(tmp_path), size, byte_range)
    wanted = fasta.chunks(fasta.read_fasta(spark, str(tmp_path) + "/*.f*"), size)
    columns = ["seq_id", "length", "start", "seq"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, wanted.select(columns).collect()))
    order = [r["seq_id"] for r in got.select("seq_id", "seq_ord").distinct().orderBy("seq_ord").collect()]
    assert order == ["a", "b", "c", "d", "e"]


def test_written_sequences_come_back(spark, tmp_path):
    rows = [("a", "ACGT" * 45), ("b", "A" * 60), ("c", "C" * 61), ("d", "G")]
    folder = fasta.write_fasta(spark.createDataFrame(rows, "seq_id string, seq string").repartition(3))
    got = fasta_ranges.read_pieces(spark, folder, 1000, 50)
    assert {(r["seq_id"], bytes(r["seq"]).decode()) for r in got.collect()} == set(rows)


def test_repeated_identifiers_and_missing_files_are_errors(spark, tmp_path):
    (tmp_path / "1.fa").write_text(">a\nAC\n>b\nG\n>a\nT")
    with pytest.raises(PySparkException, match="repeated sequence identifier a"):
        fasta_ranges.read_pieces(spark, str(tmp_path)).collect()
    for path in (tmp_path / "none.fa", tmp_path / "empty"):
        with pytest.raises(Exception, match="none.fa|no file"):
            (tmp_path / "empty").mkdir(exist_ok=True)
            fasta_ranges.read_pieces(spark, str(path)).collect()


@pytest.mark.parametrize("window, flank, size", [(4, 3, 8), (8, 8, 8), (4, 7, 4096)])
def test_windows_of_pieces_equal_windows_of_contigs(spark, tmp_path, window, flank, size):
    r = random.Random(2)
    text = "".join(f">c{k}\n" + "".join(r.choices("ACGTnacg", k=n)) + "\n" for k, n in enumerate((1, 7, 8, 9, 64, 65, 200)))
    (tmp_path / "1.fa").write_text(text)
    if flank > size:
        with pytest.raises(ValueError):
            fasta_ranges.windows_of_pieces(fasta_ranges.read_pieces(spark, str(tmp_path), size), window, flank, size)
        return
    got = fasta_ranges.windows_of_pieces(fasta_ranges.read_pieces(spark, str(tmp_path), size, 50), window, flank, size)
    wanted = tiling.windows(fasta.read_fasta(spark, str(tmp_path)), window, flank)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_a_long_contig_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "1.fa").write_text(">long\n" + "ACGTTGCAAC" * 400_000 + "\n>tail\nAC\n")
    spark.dataSource.register(fasta_ranges.FastaRanges)
    rows = spark.read.format("fasta_ranges").option("range", 500_000).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 9 and rows.groupBy(F.spark_partition_id()).count().count() == 9
    pieces = fasta_ranges.read_pieces(spark, str(tmp_path), 1 << 20, 500_000).orderBy("seq_ord", "start").collect()
    assert b"".join(r["seq"] for r in pieces if r["seq_id"] == "long") == b"ACGTTGCAAC" * 400_000
