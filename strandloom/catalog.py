"""Queries over the provided tables, one per operator, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import blocks, experts, genes, intervals, labels, metrics, packing, regions, runs, tiling
from strandloom.plans import annotate as plan
from strandloom.plans import samples, training
from strandloom.plans.scoring import CompositionScorer, CompositionTracks
from strandloom.plans.views import CONTIG_LENGTH, CONTIGS_SQL, DNA_SQL, FEATURES_SQL, MODEL_SQL, SERIES_SQL, dna, features, probability_chunks, series, stored_features, table
from strandloom.plans.views import model_rows as samples_view
from strandloom.session import new_folder, stored
from strandloom.sources import fasta, fasta_ranges, gff

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


_DNA = "dna AS (SELECT * FROM (" + DNA_SQL.replace("{flag}", ", 'g'").replace("{documents}", "documents") + ") WHERE length(seq) > 0)"
_SERIES = "series AS (" + SERIES_SQL.replace("{events}", "events") + ")"
_FEATURES = "features AS (" + FEATURES_SQL.replace("{lineitem}", "lineitem").replace("{orders}", "orders") + ")"

WINDOW, FLANK = 240, 40

# Sequence functions


@query(f"WITH {_DNA} SELECT seq_id, length(seq) AS n, md5(reverse(translate(seq, 'ATGCatgc', 'TACGtacg'))) AS rc_md5 FROM dna")
def q_revcomp(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("seq_id", F.length("seq").cast("long").alias("n"), F.md5(S.reverse_complement(F.col("seq"))).alias("rc_md5"))


@query("""
    WITH letters AS (SELECT doc_id AS seq_id, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGTNMWRYKBSDHV]', '', 'g') AS s FROM documents WHERE text IS NOT NULL),
    parts AS (SELECT *, length(regexp_replace(s, '[^NMWRYKBSDHV]', '', 'g')) / 4.0::DOUBLE AS q FROM letters)
    SELECT seq_id, """ + ", ".join(f"length(regexp_replace(s, '[^{b}]', '', 'g')) + q AS w_{b.lower()}" for b in "ACGT") + " FROM parts")
def q_onehot_counts(spark: SparkSession, d: str) -> DataFrame:
    letters = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("seq_id"), F.regexp_replace(S.upper(F.col("text")), f"[^ACGT{S.AMBIGUOUS}]", "").alias("s"))
    return letters.select("seq_id", *S.base_weights(F.col("s")))


@query(f"""
    WITH {_DNA} SELECT seq_id, left(seq, 3) = 'ATG' AS start_ok, right(seq, 3) IN ('TAA', 'TAG', 'TGA') AS stop_ok, length(seq) % 3 = 0 AS frame_ok,
    right(seq, 3) = 'CAT' AS start_ok_reverse, left(seq, 3) IN ('TTA', 'CTA', 'TCA') AS stop_ok_reverse FROM dna""")
def q_codon_checks(spark: SparkSession, d: str) -> DataFrame:
    seq = F.col("seq")
    return dna(spark, d).select("seq_id", S.starts_codon(seq).alias("start_ok"), S.stops_codon(seq).alias("stop_ok"), S.in_frame(seq).alias("frame_ok"), S.starts_codon(seq, True).alias("start_ok_reverse"), S.stops_codon(seq, True).alias("stop_ok_reverse"))


@query("SELECT vec_id, i::INT AS i, CASE WHEN i % 2 = 0 THEN sin(vec_id * exp(-i * ln(10000.0::DOUBLE) / 8)) ELSE cos(vec_id * exp(-(i - 1) * ln(10000.0::DOUBLE) / 8)) END AS value FROM embeddings, range(8) t(i)")
def q_positional_encoding(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(S.positional_encoding(F.col("vec_id"), 8)).alias("i", "value"))
    return rows


# Tiling

_TILES = f"""
    {_DNA},
    spans AS (SELECT seq_id, seq, length(seq) AS n, unnest(range(0, length(seq), {WINDOW})) AS start FROM dna),
    tiles AS (SELECT seq_id, n, start, (start // {WINDOW})::INT AS win_idx, ceil(n / {WINDOW}.0)::INT AS n_win,
        repeat('X', greatest(0, {FLANK} - start)) || substring(seq, greatest(start - {FLANK}, 0) + 1, least(start + {WINDOW + FLANK}, n) - greatest(start - {FLANK}, 0))
        || repeat('X', greatest(0, start + {WINDOW + FLANK} - n)) AS tile FROM spans)"""


@query(f"WITH {_TILES} SELECT seq_id, win_idx, start, md5(tile) AS tile_md5 FROM tiles")
def q_tile_windows(spark: SparkSession, d: str) -> DataFrame:
    return tiling.windows(dna(spark, d), WINDOW, FLANK).select("seq_id", "win_idx", "start", F.md5("seq").alias("tile_md5"))


@query(f"WITH {_TILES} SELECT seq_id, n_win - 1 - win_idx AS win_idx, md5(reverse(translate(tile, 'ATGC', 'TACG'))) AS tile_md5 FROM tiles")
def q_tile_reverse(spark: SparkSession, d: str) -> DataFrame:
    both = tiling.both_strands(tiling.windows(dna(spark, d), WINDOW, FLANK), WINDOW)
    return both.where("strand = -1").select("seq_id", "win_idx", F.md5("seq").alias("tile_md5"))


@query(f"""
    WITH {_TILES}, sides AS (SELECT seq_id, n, win_idx, n_win, unnest([1, -1]) AS strand FROM tiles),
    raw AS (SELECT *, win_idx * {WINDOW} - CASE WHEN strand = -1 THEN n_win * {WINDOW} - n ELSE 0 END AS low FROM sides)
    SELECT seq_id, strand::INT AS strand, win_idx, greatest(low, 0)::BIGINT AS first_pos, (least(low + {WINDOW}, n) - 1)::BIGINT AS last_pos FROM raw""")
def q_unpad(spark: SparkSession, d: str) -> DataFrame:
    both = tiling.both_strands(tiling.windows(dna(spark, d), WINDOW, FLANK), WINDOW)
    low, high = tiling.kept_range(WINDOW)
    return both.select("seq_id", F.col("strand").cast("int").alias("strand"), "win_idx", low.alias("first_pos"), high.alias("last_pos"))


# Regions

_BINS = f"""
    {_DNA},
    pos AS (SELECT seq_id, length(seq) AS n, unnest(range(0, length(seq))) AS pos FROM dna),
    prob AS (SELECT seq_id, n, pos, CASE WHEN hot THEN 60 + pos % 30 ELSE pos % 4 END * 1.0::DOUBLE / (CASE WHEN hot THEN 1 ELSE 96 END + CASE WHEN hot THEN 60 + pos % 30 ELSE pos % 4 END) AS genic
             FROM (SELECT *, ((pos // 150) * 7 + seq_id * 3) % 5 < 2 AS hot FROM pos)),
    bins AS (SELECT seq_id, any_value(n) AS n, pos // 50 AS bin, avg(genic) AS mean, count(*) FILTER (genic > 0.5) AS n_high FROM prob GROUP BY seq_id, pos // 50)"""
_ISLANDS = f"""
    {_BINS},
    edges AS (SELECT *, coalesce(lead(n_high) OVER w, 0) AS next_high, max(bin) OVER (PARTITION BY seq_id) AS last_bin FROM bins WINDOW w AS (PARTITION BY seq_id ORDER BY bin)),
    good AS (SELECT *, bin - row_number() OVER (PARTITION BY seq_id ORDER BY bin) AS island FROM edges WHERE mean >= 0.1),
    islands AS (SELECT seq_id, any_value(n) AS n, min(bin) AS a, max(bin) AS b, sum(n_high) AS high, arg_max(next_high, bin) AS closing, any_value(last_bin) AS last_bin FROM good GROUP BY seq_id, island)"""


def _binned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    bins = stored(regions.bins_of_chunks(probability_chunks(dna(spark, d)), ["seq_id", "length"]))
    return bins.drop("length"), bins.groupBy("seq_id").agg(F.first("length").alias("length"))


@query(f"WITH {_BINS} SELECT seq_id, bin, round(mean, 9) AS mean, n_high FROM bins")
def q_bin_mean(spark: SparkSession, d: str) -> DataFrame:
    return _binned(spark, d)[0].select("seq_id", "bin", F.round("mean", 9).alias("mean"), "n_high")


@query(f"""
    WITH {_ISLANDS} SELECT seq_id, a * 50 AS region_start, (CASE WHEN b = last_bin THEN n ELSE least((b + 2) * 50, n) END)::BIGINT AS region_end, b = last_bin AS is_open
    FROM islands WHERE b = last_bin OR high + closing >= 1""")
def q_regions(spark: SparkSession, d: str) -> DataFrame:
    return regions.candidate_regions(*_binned(spark, d), ["seq_id"])


@query(f"""
    WITH {_SERIES}, bins AS (SELECT key, pos // 50 AS bin, avg(value / 100.0::DOUBLE) AS mean, count(*) FILTER (value / 100.0::DOUBLE > 0.9) AS n_high FROM series GROUP BY ALL)
    SELECT key, bin, round(mean, 9) AS mean, n_high FROM bins WHERE mean >= 0.2 AND n_high >= 1""")
def q_region_filter(spark: SparkSession, d: str) -> DataFrame:
    track = series(spark, d).select("key", "pos", (F.col("value") / 100.0).alias("genic"))
    return regions.bins(track, ["key"], most=0.9).where("mean >= 0.2 and n_high >= 1").select("key", "bin", F.round("mean", 9).alias("mean"), "n_high")


@query(f"WITH {_SERIES} SELECT key, pos, round(sum(value) OVER (PARTITION BY key ORDER BY pos ROWS UNBOUNDED PRECEDING), 4) AS total FROM series")
def q_prefix_sum(spark: SparkSession, d: str) -> DataFrame:
    return blocks.running_sum(series(spark, d), ["key"], "value", "total").select("key", "pos", F.round("total", 4).alias("total"))


@query(f"WITH {_SERIES} SELECT key, pos // 50 AS bin, round(sum(value), 4) AS total, count(*) AS n FROM series GROUP BY ALL")
def q_range_sum(spark: SparkSession, d: str) -> DataFrame:
    return series(spark, d).groupBy("key", F.expr("pos div 50").alias("bin")).agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


# Runs

_GENES = f"""
    {_SERIES},
    genic AS (SELECT *, pos - row_number() OVER (PARTITION BY key ORDER BY pos) AS island FROM series WHERE {{kind}} <> 0),
    owned AS (SELECT *, min(pos) OVER (PARTITION BY key, island) AS gene_start FROM genic)"""


def _inner(kind: str, kinds: str) -> str:
    return f"""
    WITH {_GENES.replace("{kind}", kind)},
    inner_runs AS (SELECT *, pos - row_number() OVER (PARTITION BY key, gene_start ORDER BY pos) AS part FROM owned WHERE {kind} IN ({kinds}))
    SELECT key, gene_start, min(pos) AS start, max(pos) AS "end", count(*) AS n FROM inner_runs GROUP BY key, gene_start, part"""


@query("WITH " + _GENES.replace("{kind}", "class") + """ SELECT key, min(pos) AS start, max(pos) AS "end", count(*) AS n FROM owned GROUP BY key, island""")
def q_gene_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.runs(series(spark, d), ["key"], F.col("class") != 0)


@query(_inner("class", "1"))
def q_cds_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.within_genes(series(spark, d), ["key"], [1])


@query(_inner("class", "2"))
def q_intron_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.within_genes(series(spark, d), ["key"], [2])


@query(_inner("class4", "1, 2"))
def q_exon_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.within_genes(series(spark, d), ["key"], [1, 2], kind="class4")


# Genes


def _bases(spark: SparkSession, d: str) -> DataFrame:
    rows = features(spark, d).select("gene_id", "child_no", "score", F.explode(F.sequence("start", "end")).alias("pos"))
    phase = F.col("pos") % 3
    # Multiples of 1/128, so that sums are the same in any order.
    p = [((F.col("pos") * k + F.col("gene_id")) % 128) / 128.0 for k in (3, 5, 7)]
    return rows.withColumn("p", genes.phase_probability(phase, *p)).withColumn("base", F.when(F.col("pos") % 4 == 0, "a").otherwise("G"))


_BASES = f"""
    {_FEATURES},
    bases AS (SELECT gene_id, child_no, unnest(range(start_pos, end_pos + 1)) AS pos FROM features),
    scored AS (SELECT *, CASE pos % 3 WHEN 0 THEN ((pos * 3 + gene_id) % 128) / 128.0::DOUBLE WHEN 2 THEN ((pos * 7 + gene_id) % 128) / 128.0::DOUBLE ELSE ((pos * 5 + gene_id) % 128) / 128.0::DOUBLE END AS p FROM bases)"""


@query(f"""
    WITH {_BASES} SELECT gene_id, child_no, avg(p) AS score, any_value(cds_score) AS cds_score, count(*) AS n
    FROM scored JOIN (SELECT gene_id, avg(p) AS cds_score FROM scored GROUP BY gene_id) USING (gene_id) GROUP BY gene_id, child_no""")
def q_cds_score(spark: SparkSession, d: str) -> DataFrame:
    each, whole = genes.coding_scores(_bases(spark, d), ["gene_id"], "child_no")
    return each.join(whole, "gene_id").select("gene_id", "child_no", "score", "cds_score", "n")


@query(f"WITH {_BASES} SELECT gene_id, avg(CASE WHEN pos % 4 = 0 THEN 0 ELSE p END) AS cds_score FROM scored GROUP BY gene_id")
def q_cds_softmask(spark: SparkSession, d: str) -> DataFrame:
    rows = _bases(spark, d).withColumn("p", genes.unmasked(F.col("base"), F.col("p")))
    return genes.coding_scores(rows, ["gene_id"], "child_no")[1].select("gene_id", "cds_score")


@query(f"""
    WITH {_FEATURES}, totals AS (SELECT gene_id, sum(end_pos - start_pos + 1)::BIGINT AS cds_length, sum(score * (end_pos - start_pos + 1)) / sum(end_pos - start_pos + 1) AS s, min(start_pos) AS first_cds, max(end_pos) AS last_cds FROM features GROUP BY gene_id)
    SELECT gene_id, cds_length, round(s, 9) AS cds_score, first_cds, last_cds FROM totals WHERE cds_length >= 60 AND s >= 0.5 AND last_cds - first_cds + 1 >= 200""")
def q_gene_filters(spark: SparkSession, d: str) -> DataFrame:
    return genes.gene_filter(features(spark, d), ["gene_id"]).withColumn("cds_score", F.round("cds_score", 9))


@query("""
    SELECT c_custkey, CASE WHEN c_acctbal > 0 AND given <> 0 THEN given WHEN c_mktsegment = 'BUILDING' THEN 0.7 ELSE 0.65 END::DOUBLE AS least
    FROM (SELECT *, CASE WHEN c_acctbal > 0 THEN c_custkey % 3 / 10.0 END AS given FROM customer)""")
def q_lineage_threshold(spark: SparkSession, d: str) -> DataFrame:
    given = F.when(F.col("c_acctbal") > 0, F.col("c_custkey") % 3 / 10.0)
    lineage = F.when(F.col("c_mktsegment") == "BUILDING", "Mammalia").otherwise("Embryophyta")
    return table(spark, d, "customer").select("c_custkey", genes.lineage_score(given, lineage).alias("least"))


_GENE_ROWS = f"{_FEATURES}, gene_rows AS (SELECT gene_id, seq_id, strand, min(start_pos) AS first_cds, max(end_pos) AS last_cds FROM features GROUP BY ALL)"
_NUMBERED = f"{_GENE_ROWS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY strand DESC, CASE WHEN strand = -1 THEN -place ELSE place END) AS gene_no FROM (SELECT *, first_cds * 100000 + gene_id AS place FROM gene_rows))"


def _gene_rows(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).groupBy("gene_id", "seq_id", "strand").agg(F.min("start").alias("first_cds"), F.max("end").alias("last_cds"))


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    # Genes may begin at one place here; the identifier tells them apart. From identifiers of 100,000 on places may be equal
    # all the same: the SQL leaves their order open, here the identifier decides, so that reruns agree.
    rows = _gene_rows(spark, d).withColumn("place", F.col("first_cds") * 100000 + F.col("gene_id"))
    return genes.numbered(rows, first="place", ties=("gene_id",)).drop("place")


@query(f"WITH {_NUMBERED} SELECT seq_id, gene_id, gene_no FROM numbered")
def q_gene_number(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(spark, d).select("seq_id", "gene_id", F.col("gene_no").cast("long").alias("gene_no"))


_PHASES = """phases AS (SELECT *, row_number() OVER w AS part, CASE coalesce(sum(end_pos - start_pos + 1) OVER (PARTITION BY gene_id ORDER BY child_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS phase
    FROM features WINDOW w AS (PARTITION BY gene_id ORDER BY child_no))"""


@query(f"WITH {_FEATURES}, {_PHASES} SELECT gene_id, child_no, part, phase FROM phases")
def q_cds_phase(spark: SparkSession, d: str) -> DataFrame:
    return genes.cds_phases(features(spark, d), ["gene_id"], "child_no").select("gene_id", "child_no", F.col("part").cast("long").alias("part"), "phase")


@query(f"""
    WITH {_FEATURES} SELECT gene_id, child_no, CASE WHEN strand = -1 THEN 1000000 - end_pos ELSE start_pos + 1 END AS gff_start,
    CASE WHEN strand = -1 THEN 1000000 - start_pos ELSE end_pos + 1 END AS gff_end FROM features""")
def q_coord_flip(spark: SparkSession, d: str) -> DataFrame:
    start, end = genes.to_forward(F.col("start"), F.col("end"), F.lit(1_000_000), F.col("strand"))
    return features(spark, d).select("gene_id", "child_no", start.alias("gff_start"), end.alias("gff_end"))


_GFF_ROWS = f"""{_NUMBERED}, {_PHASES},
    parts AS (SELECT p.*, n.gene_no, CASE WHEN p.strand = -1 THEN 1000000 - end_pos ELSE start_pos + 1 END AS a, CASE WHEN p.strand = -1 THEN 1000000 - start_pos ELSE end_pos + 1 END AS b,
              p.seq_id || '-g' || gene_no AS gid FROM phases p JOIN numbered n USING (gene_id)),
    wholes AS (SELECT any_value(seq_id) AS seq_id, gid, any_value(gene_no) AS gene_no, any_value(strand) AS strand, min(a) AS a, max(b) AS b, count(*) AS n FROM parts GROUP BY gid),
    lines AS (
        SELECT seq_id, gene_no, 0 AS rank, 0 AS part, 'gene' AS type, a, b, strand, '.' AS score, '.' AS phase, 'ID=' || gid AS attributes FROM wholes
        UNION ALL SELECT seq_id, gene_no, 1, 0, 'transcript', a, b, strand, '.', '.', 'ID=' || gid || '.t1;Parent=' || gid FROM wholes
        UNION ALL SELECT seq_id, gene_no, 2, part, 'exon', a, b, strand, '.', '.', 'ID=' || gid || '.t1.exon.' || part || ';Parent=' || gid || '.t1' FROM parts
        UNION ALL SELECT seq_id, gene_no, 3, part, 'CDS', a, b, strand, printf('%.2f', score), phase::VARCHAR, 'ID=' || gid || '.t1.CDS.' || part || ';Parent=' || gid || '.t1' FROM parts),
    texts AS (SELECT *, concat_ws(chr(9), seq_id::VARCHAR, 'strandloom', type, a::VARCHAR, b::VARCHAR, score, CASE WHEN strand = -1 THEN '-' ELSE '+' END, phase, attributes) AS value FROM lines)"""


def _stand_in_rows(spark: SparkSession, d: str) -> DataFrame:
    cds = genes.cds_phases(features(spark, d), ["gene_id"], "child_no").join(_numbered(spark, d).select("gene_id", "gene_no"), "gene_id")
    whole = features(spark, d).groupBy("gene_id").agg((F.count("*") * 0.125).alias("cds_score"))
    cds = cds.join(whole, "gene_id").select(F.col("seq_id").cast("string").alias("seq_id"), F.col("seq_id").alias("seq_ord"), F.lit(1_000_000).alias("length"), "strand", "gene_no", "start", "end", "part", "phase", "score", "cds_score")
    return genes.gff_rows(cds)


@query(f"WITH {_GFF_ROWS} SELECT value FROM texts")
def q_gff_rows(spark: SparkSession, d: str) -> DataFrame:
    return gff.to_lines(_stand_in_rows(spark, d)).select("value")


@query(f"""
    WITH {_GFF_ROWS},
    body AS (
        SELECT seq_id, strand, 1 AS kind, gene_no, rank, part, 0 AS step, value FROM texts
        UNION ALL SELECT seq_id, strand, 1, gene_no, -1, 0, unnest([0, 1]), unnest(['# Start gene g' || gene_no, '# The CDS score is ' || (n * 0.125::DOUBLE)::VARCHAR]) FROM wholes
        UNION ALL SELECT seq_id, strand, 1, gene_no, 9, 0, unnest([0, 1]), unnest(['# End gene g' || gene_no, '###']) FROM wholes),
    sides AS (SELECT seq_id, strand, any_value(name) AS name FROM (SELECT c.seq_id, unnest([1, -1]) AS strand, unnest(['forward', 'reverse']) AS name FROM (SELECT DISTINCT o_custkey % 50 AS seq_id FROM orders) c) GROUP BY ALL),
    texts_of AS (
        SELECT seq_id, strand, list_concat(list_concat(CASE WHEN strand = 1 THEN ['#', '# ----- prediction on sequence number ' || (seq_id + 1) || ' (length = 1000000, name = ' || seq_id || ') -----'] ELSE [] END,
            ['#', '# Predicted genes for sequence number ' || (seq_id + 1) || ' on ' || name || ' strands']), CASE WHEN (seq_id, strand) IN (SELECT (seq_id, strand) FROM wholes) THEN [] ELSE ['# None', '###'] END) AS values FROM sides),
    heads AS (SELECT seq_id, strand, 0 AS kind, 0 AS gene_no, 0 AS rank, 0 AS part, unnest(range(0, len(values))) AS step, unnest(values) AS value FROM texts_of)
    SELECT seq_id AS seq_ord, CASE WHEN strand = -1 THEN 1 ELSE 0 END AS side, kind, gene_no, rank, part, step, value FROM body
    UNION ALL SELECT seq_id, CASE WHEN strand = -1 THEN 1 ELSE 0 END, kind, gene_no, rank, part, step, value FROM heads""")
def q_write_gff(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a file with its comments; some contigs have no gene."""
    contigs = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("seq_ord")).distinct().select("seq_ord", F.col("seq_ord").cast("string").alias("seq_id"), F.lit(1_000_000).alias("length"))
    lines = gff.file_lines(_stand_in_rows(spark, d), contigs)
    return lines.select(*(F.col(c).cast("long").alias(c) for c in gff.ORDER), "value")


@query("""
    SELECT n_nationkey AS seq_id, strand::INT AS strand, count(s_suppkey) AS n FROM (SELECT n_nationkey, unnest([1, -1]) AS strand FROM nation)
    LEFT JOIN supplier ON s_nationkey = n_nationkey AND strand = CASE WHEN s_acctbal > 4000 THEN 1 ELSE -1 END GROUP BY ALL""")
def q_contig_outer(spark: SparkSession, d: str) -> DataFrame:
    contigs = table(spark, d, "nation").select(F.col("n_nationkey").alias("seq_id"), F.lit(1).alias("length"))
    found = table(spark, d, "supplier").select(F.col("s_nationkey").alias("seq_id"), F.when(F.col("s_acctbal") > 4000, 1).otherwise(-1).cast("byte").alias("strand"), "s_suppkey")
    rows = genes.with_all_contigs(contigs, found)
    return rows.groupBy("seq_id", F.col("strand").cast("int").alias("strand")).agg(F.count("s_suppkey").alias("n"))


_UTR_PARTS = f"""{_FEATURES},
    moved AS (SELECT gene_id, seq_id, strand, start_pos + gene_id * 1000000 AS s, end_pos + gene_id * 1000000 AS e, score, kind FROM features),
    coding AS (SELECT *, s + gene_id % 3 AS c FROM moved WHERE kind <> 'N'),
    firsts AS (SELECT gene_id, seq_id, strand, min(c) AS first_cds, count(*) * 0.125::DOUBLE AS cds_score FROM coding GROUP BY ALL),
    numbers AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY strand DESC, CASE WHEN strand = -1 THEN -first_cds ELSE first_cds END) AS gene_no, seq_id || '-g' || row_number() OVER (PARTITION BY seq_id ORDER BY strand DESC, CASE WHEN strand = -1 THEN -first_cds ELSE first_cds END) AS gid FROM firsts),
    spans AS (
        SELECT gene_id, 2 AS rank, 'exon' AS type, row_number() OVER (PARTITION BY gene_id ORDER BY s) AS part, s, e, '.' AS score, '.' AS phase FROM moved
        UNION ALL SELECT gene_id, 3, 'CDS', row_number() OVER w, c, e, printf('%.2f', score), CASE coalesce(sum(e - c + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 3 WHEN 0 THEN '0' WHEN 1 THEN '2' ELSE '1' END
        FROM coding WINDOW w AS (PARTITION BY gene_id ORDER BY c)),
    placed AS (SELECT n.*, rank, type, part, score, phase, CASE WHEN strand = -1 THEN 10000000000000 - e ELSE s + 1 END AS a, CASE WHEN strand = -1 THEN 10000000000000 - s ELSE e + 1 END AS b FROM spans JOIN numbers n USING (gene_id)),
    lines AS (
        SELECT seq_id, gene_no, strand, rank, part, type, a, b, score, phase, 'ID=' || gid || '.t1.' || type || '.' || part || ';Parent=' || gid || '.t1' AS attributes FROM placed
        UNION ALL SELECT seq_id, gene_no, strand, unnest([0, 1]), 0, unnest(['gene', 'transcript']), min(a), max(b), '.', '.', unnest(['ID=' || gid, 'ID=' || gid || '.t1;Parent=' || gid]) FROM placed WHERE rank = 2 GROUP BY seq_id, gene_no, strand, gid)"""


@query(f"""
    WITH {_UTR_PARTS}
    SELECT seq_id AS seq_ord, gene_no, rank, part, concat_ws(chr(9), seq_id::VARCHAR, 'strandloom', type, a::VARCHAR, b::VARCHAR, score, CASE WHEN strand = -1 THEN '-' ELSE '+' END, phase, attributes) AS value FROM lines
    UNION ALL SELECT seq_id, gene_no, -1, unnest([0, 1, 2]), unnest(['# Start gene g' || gene_no, '# The CDS score is ' || cds_score::VARCHAR, '# The intron score is 0']) FROM numbers
    UNION ALL SELECT seq_id, gene_no, 9, unnest([0, 1]), unnest(['# End gene g' || gene_no, '###']) FROM numbers""")
def q_annotate_utr_rows(spark: SparkSession, d: str) -> DataFrame:
    """The lines of genes with untranslated exons, and their comments, from exons and coding runs as the older decoder gives them."""
    far = F.col("gene_id") * 1_000_000
    moved = features(spark, d).withColumns({"start": F.col("start") + far, "end": F.col("end") + far})
    coding = moved.where("kind <> 'N'").withColumn("start", F.col("start") + F.col("gene_id") % 3)
    firsts = coding.groupBy("gene_id").agg(F.min("start").alias("gene_start"), (F.count("*") * 0.125).alias("cds_score"))
    both = moved.withColumns({"type": F.lit("exon"), "score": F.lit(None).cast("double")}).unionByName(coding.withColumn("type", F.lit("CDS")))
    parts = both.join(firsts, "gene_id").select(F.col("seq_id").cast("string").alias("seq_id"), F.col("strand").cast("byte").alias("strand"), "gene_start", "type", "start", "end", "score", "cds_score")
    contigs = moved.select(F.col("seq_id").cast("string").alias("seq_id"), F.col("seq_id").cast("int").alias("seq_ord"), F.lit(10_000_000_000_000).alias("length")).distinct()
    lines = gff.file_lines(plan.untranslated_rows(stored(parts), contigs), contigs, intron_score=True).where("kind = 1")
    number = F.when(F.col("rank").isin(-1, 9), F.col("step")).otherwise(F.col("part"))
    return lines.select(*(F.col(c).cast("long").alias(c) for c in ("seq_ord", "gene_no", "rank")), number.cast("long").alias("part"), "value")


# GFF

_GFF_LINES = """
    lines AS (
        SELECT o_orderkey * 10 AS line_no, concat_ws(chr(9), 'c' || (o_custkey % 40), 'src', 'gene', o_orderkey::VARCHAR, (o_orderkey + 500)::VARCHAR, '.', '+', '.', 'ID=g' || (o_orderkey % {genes}) || ';note=a=b;ID=g' || (o_orderkey % {genes})) AS value FROM orders
        UNION ALL SELECT o_orderkey * 10 + 1, concat_ws(chr(9), 'c' || (o_custkey % 40), 'src', 'mRNA', o_orderkey::VARCHAR, (o_orderkey + 500)::VARCHAR, '.', '+', '.', 'ID=t' || o_orderkey || ';Parent=g' || (o_orderkey % {genes})) FROM orders
        UNION ALL SELECT o_orderkey * 10 + 2, concat_ws(chr(9), 'c' || (o_custkey % 40), 'src', CASE WHEN o_orderkey % 3 = 0 THEN 'exon' WHEN o_orderkey % 3 = 1 THEN 'CDS' ELSE 'UTR' END, o_orderkey::VARCHAR, (o_orderkey + 90)::VARCHAR, '.', '+', '0', 'flag;Parent=t' || o_orderkey) FROM orders
        UNION ALL SELECT o_orderkey * 10 + 3, CASE WHEN o_orderkey % 2 = 0 THEN '# ' || o_orderkey ELSE 'too' || chr(9) || 'short' END FROM orders)""".replace("{genes}", "700")


def _gff_lines(spark: SparkSession, d: str) -> DataFrame:
    o, tab = table(spark, d, "orders"), F.lit("\t")
    key, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    contig = F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string"))
    gene = F.concat(F.lit("g"), (key % 700).cast("string"))

    def line(kind, length: int, phase: str, attributes):
        return F.concat_ws("\t", contig, F.lit("src"), kind, text, (key + length).cast("string"), F.lit("."), F.lit("+"), F.lit(phase), attributes)

    part = F.when(key % 3 == 0, "exon").when(key % 3 == 1, "CDS").otherwise("UTR")
    values = F.array(
        line(F.lit("gene"), 500, ".", F.concat(F.lit("ID="), gene, F.lit(";note=a=b;ID="), gene)),
        line(F.lit("mRNA"), 500, ".", F.concat(F.lit("ID=t"), text, F.lit(";Parent="), gene)),
        line(part, 90, "0", F.concat(F.lit("flag;Parent=t"), text)),
        F.when(key % 2 == 0, F.concat(F.lit("# "), text)).otherwise(F.concat(F.lit("too"), tab, F.lit("short"))),
    )
    return o.select(key, F.posexplode(values).alias("k", "value")).select((F.col("o_orderkey") * 10 + F.col("k")).alias("line_no"), "value")


@query(f"""
    WITH {_GFF_LINES} SELECT line_no, split_part(value, chr(9), 1) AS seqid, split_part(value, chr(9), 3) AS type, split_part(value, chr(9), 4)::BIGINT AS start, split_part(value, chr(9), 5)::BIGINT AS "end",
    nullif(regexp_extract(split_part(value, chr(9), 9), '(^|;)ID=([^;]*)', 2), '') AS id, nullif(regexp_extract(value, 'note=([^;=]*)', 1), '') AS note, nullif(regexp_extract(value, 'Parent=([^;]*)', 1), '') AS parent
    FROM lines WHERE value NOT LIKE '#%' AND len(string_split(value, chr(9))) >= 9""")
def q_gff_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = gff.parse_lines(_gff_lines(spark, d))
    return rows.select("line_no", "seqid", "type", "start", "end", *(F.try_element_at("attributes", F.lit(k)).alias(n) for k, n in (("ID", "id"), ("note", "note"), ("Parent", "parent"))))


@query(f"""
    WITH {_GFF_LINES},
    rows AS (SELECT *, split_part(value, chr(9), 3) AS type, regexp_extract(value, 'ID=([^;]*)', 1) AS id, regexp_extract(value, 'Parent=([^;]*)', 1) AS parent FROM lines WHERE value NOT LIKE '#%' AND len(string_split(value, chr(9))) >= 9),
    twice AS (SELECT id FROM rows WHERE type = 'gene' GROUP BY id HAVING count(*) > 1),
    bad AS (SELECT line_no FROM rows WHERE type = 'gene' AND id IN (SELECT id FROM twice)
            UNION ALL SELECT line_no FROM rows WHERE type = 'mRNA' AND parent IN (SELECT id FROM twice)
            UNION ALL SELECT line_no FROM rows WHERE type IN ('exon', 'CDS') AND parent IN (SELECT id FROM rows WHERE type = 'mRNA' AND parent IN (SELECT id FROM twice)))
    SELECT line_no, value FROM lines WHERE (value LIKE '#%' OR len(string_split(value, chr(9))) >= 9) AND line_no NOT IN (SELECT line_no FROM bad)""")
def q_dup_gene_filter(spark: SparkSession, d: str) -> DataFrame:
    return gff.without_repeated_genes(_gff_lines(spark, d))


@query(f"""
    WITH {_GFF_LINES}, rows AS (SELECT *, split_part(value, chr(9), 3) AS type, regexp_extract(value, 'ID=([^;]*)', 1) AS id, regexp_extract(value, 'Parent=([^;]*)', 1) AS parent FROM lines WHERE len(string_split(value, chr(9))) >= 9)
    SELECT c.line_no, p.line_no AS parent_line FROM rows c JOIN rows p ON c.parent = p.id WHERE p.type = 'mRNA'""")
def q_gff_children(spark: SparkSession, d: str) -> DataFrame:
    rows = gff.parse_lines(_gff_lines(spark, d))
    return gff.children(rows, rows.where("type = 'mRNA'")).select("line_no", "parent_line")


_TREE_SQL = """
    WITH RECURSIVE features AS (SELECT c_custkey AS n, [x for x in list_distinct([c_custkey // 3, c_custkey // 5]) if x > 0] AS parents FROM customer WHERE c_custkey > 0),
    links AS (SELECT n, unnest(parents) AS up FROM features),
    reach AS (SELECT n, up, 1 AS depth FROM links UNION SELECT r.n, l.up, r.depth + 1 FROM reach r JOIN links l ON l.n = r.up),
    nearest AS (SELECT n, up, min(depth) AS depth FROM reach GROUP BY ALL),
    roots AS (SELECT n FROM features WHERE len(parents) = 0)"""


def _tree_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of features with up to two parents each, some with a percent-coded comma in their names."""
    n = F.col("c_custkey")
    name = lambda x: F.concat(F.lit("f"), x.cast("string"), F.when(x % 10 == 0, "%2C").otherwise(""))
    parents = F.filter(F.array_distinct(F.array(F.expr("c_custkey div 3"), F.expr("c_custkey div 5"))), lambda x: x > 0)
    above = F.when(F.size(parents) > 0, F.concat(F.lit(";Parent="), F.array_join(F.transform(parents, name), ","))).otherwise("")
    fields = [F.lit("c"), F.lit("src"), F.lit("part"), n.cast("string"), (n + 9).cast("string"), F.lit("."), F.lit("+"), F.lit(".")]
    return table(spark, d, "customer").where("c_custkey > 0").select(n.alias("line_no"), F.concat_ws("\t", *fields, F.concat(F.lit("ID="), name(n), above)).alias("value"))


@query(f"{_TREE_SQL} SELECT n AS line_no, 'f' || up || CASE WHEN up % 10 = 0 THEN '%2C' ELSE '' END AS ancestor, depth::BIGINT AS depth FROM nearest")
def q_gff_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return gff.ancestors(gff.parse_links(_tree_lines(spark, d))).select("line_no", "ancestor", "depth")


@query(f"{_TREE_SQL} SELECT f.n AS line_no, coalesce(r.up, f.n) AS root_line, coalesce(r.depth, 0)::BIGINT AS depth FROM features f LEFT JOIN (SELECT * FROM nearest WHERE up IN (FROM roots)) r ON r.n = f.n")
def q_gff_trees(spark: SparkSession, d: str) -> DataFrame:
    return gff.trees(gff.parse_links(_tree_lines(spark, d))).select("line_no", "root_line", "depth")


@query(f"""
    WITH {_FEATURES}, moved AS (SELECT gene_id, child_no, seq_id, start_pos + gene_id * 1000000 AS a, end_pos + gene_id * 1000000 AS b FROM features),
    spans AS (SELECT gene_id AS span, seq_id, min(a) AS low, max(b) AS high FROM moved GROUP BY ALL UNION ALL SELECT -1 - gene_id // 100, seq_id, min(a), max(b) FROM moved GROUP BY ALL UNION ALL SELECT NULL, seq_id, 0, max(b) FROM moved GROUP BY ALL)
    SELECT gene_id, child_no, span, least(b, high) - greatest(a, low) AS shared FROM moved m JOIN spans s ON s.seq_id = m.seq_id AND a < high AND low < b""")
def q_interval_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Features against the spans of genes, of a hundred genes, and of whole contigs."""
    far = F.col("gene_id") * 1_000_000
    parts = stored(features(spark, d).select("gene_id", "child_no", "seq_id", (F.col("start") + far).alias("start"), (F.col("end") + far).alias("end")))
    none, ends = F.lit(None).cast("long"), (F.min("low").alias("low"), F.max("high").alias("high"))
    of_genes = stored(parts.groupBy(F.col("gene_id").alias("span"), "seq_id").agg(F.min("start").alias("low"), F.max("end").alias("high")))
    wider = of_genes.groupBy(F.expr("-1 - span div 100").alias("span"), "seq_id").agg(*ends)
    whole = of_genes.groupBy("seq_id").agg(F.lit(0).cast("long").alias("low"), F.max("high").alias("high")).withColumn("span", none)
    spans = of_genes.unionByName(stored(wider.unionByName(whole)))
    pairs = intervals.overlapping(parts, spans, ["seq_id"])
    return pairs.select("gene_id", "child_no", "span", (F.least("end", "high") - F.greatest("start", "low")).alias("shared"))


# Labels


@query(f"WITH {_FEATURES} SELECT gene_id, child_no, end_pos - start_pos + 1 AS length FROM features QUALIFY row_number() OVER (PARTITION BY gene_id ORDER BY end_pos - start_pos DESC, child_no) = 1")
def q_longest_transcript(spark: SparkSession, d: str) -> DataFrame:
    length = F.col("end") - F.col("start") + 1
    return labels.longest_transcripts(features(spark, d), "gene_id", length, "child_no").select("gene_id", "child_no", length.alias("length"))


@query(f"""
    WITH RECURSIVE {_GENE_ROWS},
    ordered AS (SELECT *, row_number() OVER (PARTITION BY seq_id, strand ORDER BY gene_id) AS r FROM gene_rows),
    fold AS (
        SELECT seq_id, strand, gene_id, r, true AS accepted, last_cds AS until FROM ordered WHERE r = 1
        UNION ALL SELECT o.seq_id, o.strand, o.gene_id, o.r, o.first_cds >= f.until, CASE WHEN o.first_cds >= f.until THEN o.last_cds ELSE f.until END
        FROM fold f JOIN ordered o ON o.seq_id = f.seq_id AND o.strand = f.strand AND o.r = f.r + 1)
    SELECT seq_id, strand::INT AS strand, gene_id, accepted FROM fold""")
def q_overlap_accept(spark: SparkSession, d: str) -> DataFrame:
    rows = labels.accepted(_gene_rows(spark, d), ["seq_id", "strand"], "first_cds", "last_cds", "gene_id")
    return rows.select("seq_id", F.col("strand").cast("int").alias("strand"), "gene_id", "accepted")


@query(f"""
    WITH {_FEATURES},
    marks AS (SELECT gene_id, unnest(range(min(start_pos), max(end_pos))) AS pos, 3 AS class, 0 AS r FROM features GROUP BY gene_id
              UNION ALL SELECT gene_id, unnest(range(start_pos, end_pos)), 1, 1 FROM features
              UNION ALL SELECT gene_id, unnest(range(start_pos, end_pos)), 2, 2 FROM features WHERE kind <> 'N'),
    painted AS (SELECT gene_id, pos, arg_max(class, r) AS class FROM marks GROUP BY gene_id, pos)
    SELECT gene_id, class, count(*) AS n, sum(pos)::BIGINT AS checksum FROM painted GROUP BY ALL""")
def q_paint(spark: SparkSession, d: str) -> DataFrame:
    parts = stored_features(spark, d)
    whole = parts.groupBy("gene_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    rows = labels.painted(whole, parts, parts.where("kind <> 'N'"), ["gene_id"])
    n = F.col("end") - F.col("start")
    return rows.groupBy("gene_id", "class").agg(F.sum(n).alias("n"), F.sum(F.expr("(start + end - 1) * (end - start) div 2")).alias("checksum"))


@query(f"""
    WITH {_FEATURES},
    exons AS (SELECT *, lead(start_pos) OVER (PARTITION BY gene_id ORDER BY start_pos, child_no) AS after FROM features),
    whole AS (SELECT gene_id, min(start_pos) AS a, max(end_pos) AS b, any_value(strand) AS strand FROM features GROUP BY gene_id),
    coding AS (SELECT gene_id, min(start_pos) AS a, max(end_pos) AS b, any_value(strand) AS strand FROM features WHERE kind <> 'N' GROUP BY gene_id),
    windows AS (
        SELECT gene_id, a - 1 AS x, a + 3 AS y, CASE WHEN strand = 1 THEN 16 ELSE 17 END AS value, CASE WHEN strand = 1 THEN 0 ELSE 1 END AS r FROM coding
        UNION ALL SELECT gene_id, b - 3, b + 1, CASE WHEN strand = 1 THEN 17 ELSE 16 END, CASE WHEN strand = 1 THEN 1 ELSE 0 END FROM coding
        UNION ALL SELECT gene_id, a - 1, a + 1, CASE WHEN strand = 1 THEN 18 ELSE 19 END, CASE WHEN strand = 1 THEN 2 ELSE 3 END FROM whole
        UNION ALL SELECT gene_id, b - 1, b + 1, CASE WHEN strand = 1 THEN 19 ELSE 18 END, CASE WHEN strand = 1 THEN 3 ELSE 2 END FROM whole
        UNION ALL SELECT gene_id, end_pos - 1, end_pos + 2, CASE WHEN strand = 1 THEN 20 ELSE 21 END, CASE WHEN strand = 1 THEN 4 ELSE 5 END FROM exons WHERE after IS NOT NULL
        UNION ALL SELECT gene_id, after - 2, after + 1, CASE WHEN strand = 1 THEN 21 ELSE 20 END, CASE WHEN strand = 1 THEN 5 ELSE 4 END FROM exons WHERE after IS NOT NULL),
    marks AS (SELECT gene_id, unnest(range(greatest(x, 0), y)) AS pos, value, r FROM windows)
    SELECT gene_id, pos, arg_max(value, r) AS value FROM marks GROUP BY gene_id, pos""")
def q_weights_last_writer(spark: SparkSession, d: str) -> DataFrame:
    """Windows around boundaries on both strands: those of reverse genes are mirrored."""
    parts = stored_features(spark, d)
    whole = parts.groupBy("gene_id", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    windows = labels.transition_windows(whole, parts, parts.where("kind <> 'N'"), ["gene_id"], (16, 17, 18, 19, 20, 21), "strand")
    return labels.last_written(windows, ["gene_id"]).select("gene_id", "pos", "value")


_MODELS = f"""{_FEATURES},
    mrows AS ({MODEL_SQL.replace("{features}", "features")}),
    contigs AS ({CONTIGS_SQL.replace("{features}", "features")}),
    tx AS (SELECT m.*, g.line_no AS gene_line FROM mrows m JOIN mrows g ON m.parent = g.id AND g.type = 'gene' WHERE m.type = 'mRNA'
           QUALIFY row_number() OVER (PARTITION BY g.line_no ORDER BY m.end_at - m.start_at DESC, m.line_no) = 1),
    every_part AS (SELECT p.*, t.gene_line FROM mrows p JOIN tx t ON p.parent = t.id WHERE p.type IN ('exon', 'CDS')),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY seq_id, strand ORDER BY gene_line) AS r FROM tx WHERE gene_line IN (SELECT gene_line FROM every_part WHERE type = 'CDS')),
    fold AS (
        SELECT seq_id, strand, gene_line, r, true AS accepted, end_at AS until FROM ordered WHERE r = 1
        UNION ALL SELECT o.seq_id, o.strand, o.gene_line, o.r, o.start_at >= f.until, CASE WHEN o.start_at >= f.until THEN o.end_at ELSE f.until END
        FROM fold f JOIN ordered o ON o.seq_id = f.seq_id AND o.strand = f.strand AND o.r = f.r + 1),
    taken AS (SELECT gene_line FROM fold WHERE accepted),
    models AS (SELECT seq_id, strand, gene_line, start_at AS s, end_at AS e FROM ordered WHERE gene_line IN (SELECT gene_line FROM taken)),
    parts AS (SELECT * FROM every_part WHERE gene_line IN (SELECT gene_line FROM taken)),
    masks AS (SELECT seq_id, strand, line_no AS gene_line, start_at, end_at FROM mrows WHERE type IN ('gene', 'pseudogene') AND line_no NOT IN (SELECT gene_line FROM taken)),
    every_end AS (SELECT gene_line, min(start_at) AS a, max(end_at) AS b FROM every_part WHERE type = 'CDS' GROUP BY gene_line),
    marks AS (SELECT gene_line, unnest(range(start_at, end_at)) AS pos, 3 AS class, 0 AS r FROM tx
              UNION ALL SELECT gene_line, unnest(range(start_at, end_at)), CASE type WHEN 'exon' THEN 1 ELSE 2 END, CASE type WHEN 'exon' THEN 1 ELSE 2 END FROM every_part),
    painted AS (SELECT gene_line, pos, arg_max(class, r) AS class FROM marks GROUP BY gene_line, pos),
    sides AS (SELECT gene_line, count(*) FILTER (pos < a) AS l, count(*) FILTER (pos >= b) AS r, any_value(strand) AS strand
              FROM painted JOIN every_end USING (gene_line) JOIN tx USING (gene_line) WHERE class = 1 GROUP BY gene_line),
    utr AS (SELECT coalesce(sum(CASE WHEN strand = 1 THEN l ELSE r END), 0)::BIGINT AS total_5, coalesce(sum(CASE WHEN strand = 1 THEN r ELSE l END), 0)::BIGINT AS total_3, count(*) AS n FROM sides WHERE l > 0 AND r > 0)"""

_ERRORS = f"""{_MODELS},
    means AS (SELECT CASE WHEN n = 0 THEN 50 ELSE total_5 // n END AS m5, CASE WHEN n = 0 THEN 50 ELSE total_3 // n END AS m3 FROM utr),
    codons AS (
        SELECT gene_line, left(c, 3) AS head, right(c, 3) AS tail, length(c) AS n
        FROM (SELECT gene_line, string_agg(substring(seq, start_at + 1, end_at - start_at), '' ORDER BY start_at) AS c FROM parts JOIN contigs USING (seq_id) WHERE type = 'CDS' GROUP BY gene_line)),
    whole AS (
        SELECT m.*, a, b, n % 3 <> 0 AS bad_frame, CASE WHEN strand = 1 THEN m5 ELSE m3 END AS ml, CASE WHEN strand = 1 THEN m3 ELSE m5 END AS mr,
               CASE WHEN strand = 1 THEN head <> 'ATG' ELSE head NOT IN ('TTA', 'CTA', 'TCA') END AS bad_left, CASE WHEN strand = 1 THEN tail NOT IN ('TAA', 'TAG', 'TGA') ELSE tail <> 'CAT' END AS bad_right
        FROM models m JOIN every_end USING (gene_line) JOIN codons USING (gene_line), means),
    next_part AS (SELECT *, lead(start_at) OVER w AS after, lead(end_at) OVER w AS after_end FROM parts WINDOW w AS (PARTITION BY gene_line, type ORDER BY start_at)),
    raw AS (
        SELECT gene_line, a - 2 * ml AS x, a AS y, 10 AS rank FROM whole WHERE a <= s
        UNION ALL SELECT gene_line, b, b + 2 * mr, 11 FROM whole WHERE b >= e
        UNION ALL SELECT gene_line, s, a, 13 FROM whole WHERE bad_left UNION ALL SELECT gene_line, b, e, 14 FROM whole WHERE bad_right
        UNION ALL SELECT gene_line, a - 100, a, 15 FROM whole WHERE bad_frame UNION ALL SELECT gene_line, b, b + 100, 16 FROM whole WHERE bad_frame
        UNION ALL SELECT gene_line, end_at, after, 12 FROM next_part WHERE type = 'exon' AND after - end_at BETWEEN 0 AND 30
        UNION ALL SELECT gene_line, start_at, after_end, CASE type WHEN 'CDS' THEN 17 ELSE 18 END FROM next_part WHERE after < end_at),
    errors AS (SELECT gene_line, greatest(x, 0) AS x, y, rank FROM raw WHERE y > greatest(x, 0))"""


@query(f"WITH RECURSIVE {_MODELS} SELECT gene_line, start_at AS start, end_at AS \"end\" FROM masks")
def q_feature_masks(spark: SparkSession, d: str) -> DataFrame:
    return samples.gene_models(samples_view(spark, d)[1])[2].select("gene_line", "start", "end")


@query(f"WITH RECURSIVE {_MODELS} SELECT total_5, total_3, n FROM utr")
def q_utr_lengths(spark: SparkSession, d: str) -> DataFrame:
    return samples.utr_totals(samples_view(spark, d)[1])


@query(f"""
    WITH RECURSIVE {_ERRORS},
    bases AS (SELECT gene_line, x, y, rank FROM errors UNION ALL SELECT gene_line, pos, pos + 1, 19 FROM painted JOIN whole USING (gene_line) WHERE class = 1 AND pos >= a AND pos < b)
    SELECT gene_line, rank, sum(y - x)::BIGINT AS bases, min(x) AS first, max(y) AS last FROM bases GROUP BY gene_line, rank""")
def q_error_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Per gene and kind of error, how many bases its intervals mask and from where to where."""
    genome, rows = samples_view(spark, d)
    models, parts, _ = samples.gene_models(rows)
    mean = labels.average_utr(samples.utr_totals(rows), 100).first()
    wrong = samples.error_intervals(stored(models), stored(parts), genome, mean["average_5"], mean["average_3"], 100)
    return wrong.groupBy("gene_line", "rank").agg(F.sum(F.col("end") - F.col("start")).alias("bases"), F.min("start").alias("first"), F.max("end").alias("last"))


@query(f"""
    WITH RECURSIVE {_ERRORS},
    shifts AS (
        SELECT gene_line, a - 1 AS x, a + 3 AS y, CASE WHEN strand = 1 THEN 16 ELSE 17 END AS value, CASE WHEN strand = 1 THEN 0 ELSE 1 END AS r FROM whole
        UNION ALL SELECT gene_line, b - 3, b + 1, CASE WHEN strand = 1 THEN 17 ELSE 16 END, CASE WHEN strand = 1 THEN 1 ELSE 0 END FROM whole
        UNION ALL SELECT gene_line, s - 1, s + 1, CASE WHEN strand = 1 THEN 18 ELSE 19 END, CASE WHEN strand = 1 THEN 2 ELSE 3 END FROM whole
        UNION ALL SELECT gene_line, e - 1, e + 1, CASE WHEN strand = 1 THEN 19 ELSE 18 END, CASE WHEN strand = 1 THEN 3 ELSE 2 END FROM whole
        UNION ALL SELECT gene_line, end_at - 1, end_at + 2, CASE WHEN strand = 1 THEN 20 ELSE 21 END, CASE WHEN strand = 1 THEN 4 ELSE 5 END FROM next_part WHERE type = 'exon' AND after IS NOT NULL
        UNION ALL SELECT gene_line, after - 2, after + 1, CASE WHEN strand = 1 THEN 21 ELSE 20 END, CASE WHEN strand = 1 THEN 5 ELSE 4 END FROM next_part WHERE type = 'exon' AND after IS NOT NULL),
    writes AS (
        SELECT gene_line, greatest(x, 0) AS x, y, value, gene_line * 100 + r AS w FROM shifts UNION ALL SELECT gene_line, x, y, 0, gene_line * 100 + rank FROM errors
        UNION ALL SELECT gene_line, pos, pos + 1, 0, gene_line * 100 + 19 FROM painted JOIN whole USING (gene_line) WHERE class = 1 AND pos >= a AND pos < b
        UNION ALL SELECT gene_line, start_at, end_at, 0, gene_line * 100 FROM masks),
    place AS (SELECT line_no AS gene_line, seq_id, strand FROM mrows WHERE type IN ('gene', 'pseudogene')),
    weights AS (SELECT seq_id, strand, pos, arg_max(value, w) AS weight FROM (SELECT gene_line, unnest(range(x, y)) AS pos, value, w FROM writes) JOIN place USING (gene_line) GROUP BY ALL),
    classes AS (SELECT seq_id, strand, pos, arg_max(class, gene_line) AS class FROM painted JOIN models USING (gene_line) GROUP BY ALL),
    phases AS (
        SELECT seq_id, strand, pos, arg_max(p, line_no) AS phase FROM (
            SELECT seq_id, strand, line_no, pos, ([0, 2, 1])[(CASE WHEN strand = 1 THEN pos - start_at ELSE end_at - 1 - pos END + CASE phase WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END) % 3 + 1] AS p
            FROM (SELECT *, unnest(range(start_at, end_at)) AS pos FROM parts WHERE type = 'CDS')) GROUP BY ALL),
    wins AS (SELECT DISTINCT seq_id, strand, pos // 1000 AS win FROM classes),
    bases AS (
        SELECT w.seq_id, w.strand, win, i, CASE WHEN pos < {CONTIG_LENGTH} THEN coalesce(weight, 1) ELSE 0 END AS weight, coalesce(class, 0) AS class, coalesce(phase, 3) AS phase
        FROM (SELECT *, CASE WHEN strand = 1 THEN k ELSE 999 - k END AS i, win * 1000 + k AS pos FROM wins, range(0, 1000) t(k)) w
        LEFT JOIN weights USING (seq_id, strand, pos) LEFT JOIN classes USING (seq_id, strand, pos) LEFT JOIN phases USING (seq_id, strand, pos)),
    steps AS (SELECT *, lead(class) OVER o AS next_class, lead(weight) OVER o AS next_weight FROM bases WINDOW o AS (PARTITION BY seq_id, strand, win ORDER BY i)),
    sums AS (
        SELECT seq_id, strand, win, sum((i + 1) * class)::BIGINT AS ann, sum((i + 1) * weight)::BIGINT AS weight, sum((i + 1) * phase)::BIGINT AS phase,
               sum((i + 1) * CASE WHEN (class, next_class) IN ((0, 1), (1, 0), (1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)) THEN 1 ELSE 0 END)::BIGINT AS transition,
               sum((i + 1) * CASE WHEN weight <> 0 AND next_weight <> 0 THEN 1 ELSE 0 END)::BIGINT AS transition_mask
        FROM steps GROUP BY ALL HAVING max(abs(weight)) > 0),
    tiles AS (SELECT seq_id, win, repeat('X', greatest(0, 50 - win * 1000)) || substring(seq, greatest(win * 1000 - 50, 0) + 1, least(win * 1000 + 1050, {CONTIG_LENGTH}) - greatest(win * 1000 - 50, 0)) || repeat('X', greatest(0, win * 1000 + 1050 - {CONTIG_LENGTH})) AS tile
              FROM (SELECT DISTINCT seq_id, win FROM wins) JOIN contigs USING (seq_id))
    SELECT seq_id::VARCHAR AS seq_id, strand::INT AS strand, win::INT AS win_idx, md5(CASE WHEN strand = 1 THEN tile ELSE reverse(translate(tile, 'ATGC', 'TACG')) END) AS seq_md5, ann, weight, transition, transition_mask, phase
    FROM sums JOIN tiles USING (seq_id, win)""")
def q_label_samples(spark: SparkSession, d: str) -> DataFrame:
    """Training windows with all their tracks; each array as the sum of its values times their places."""
    rows = samples.samples(*samples_view(spark, d), 1000, 50, (16, 17, 18, 19, 20, 21), 100)
    place = {n: F.aggregate(F.transform(n, lambda x, i: (i + 1).cast("long") * x), F.lit(0).cast("long"), lambda a, x: a + x).alias(n) for n in ("ann", "weight", "transition", "transition_mask", "phase")}
    return rows.select("seq_id", "strand", "win_idx", F.md5("seq").alias("seq_md5"), *place.values())


@query(f"""
    WITH {_FEATURES}, gaps AS (SELECT *, lead(start_pos) OVER (PARTITION BY gene_id ORDER BY start_pos, child_no) - end_pos AS gap FROM features)
    SELECT gene_id, child_no, coalesce(gap BETWEEN 0 AND 30, false) AS short_intron, coalesce(gap < 0, false) AS overlap FROM gaps""")
def q_error_masks(spark: SparkSession, d: str) -> DataFrame:
    return labels.boundary_errors(features(spark, d), ["gene_id"]).select("gene_id", "child_no", "short_intron", "overlap")


@query(f"""
    WITH {_DNA}, parts AS (SELECT seq_id, i, substring(seq, i::BIGINT + 1, 10) AS s FROM (SELECT seq_id, seq, unnest(range(0, length(seq), 30)) AS i FROM dna)),
    spliced AS (SELECT seq_id, string_agg(s, '' ORDER BY i) AS s FROM parts GROUP BY seq_id)
    SELECT seq_id, left(s, 3) <> 'ATG' AS bad_start, right(s, 3) NOT IN ('TAA', 'TAG', 'TGA') AS bad_stop, length(s) % 3 <> 0 AS bad_frame, length(s) AS cds_length FROM spliced""")
def q_spliced_codons(spark: SparkSession, d: str) -> DataFrame:
    """A coding part of up to ten letters every thirty, over whole sequences."""
    parts = dna(spark, d).select("seq_id", "seq", F.explode(F.expr("sequence(0, length(seq) - 1, 30)")).alias("start")).select("seq_id", "start", F.substring("seq", F.col("start") + 1, F.lit(10)).alias("seq"))
    return labels.codon_errors(parts, ["seq_id"]).withColumn("cds_length", F.col("cds_length").cast("long"))


@query(f"""
    WITH {_FEATURES}, gaps AS (SELECT gene_id, end_pos + 1 AS start, lead(start_pos) OVER (PARTITION BY gene_id ORDER BY start_pos, child_no) - 1 AS "end" FROM features)
    SELECT gene_id, start, "end" FROM gaps WHERE "end" >= start""")
def q_intron_gap(spark: SparkSession, d: str) -> DataFrame:
    return genes.introns(features(spark, d), ["gene_id"])


@query(f"""
    WITH {_SERIES}, steps AS (SELECT key, pos, class4 AS a, lead(class4) OVER (PARTITION BY key ORDER BY pos) AS b FROM series)
    SELECT key, pos, CASE WHEN (a, b) IN ((0, 1), (1, 0), (1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)) THEN 1 ELSE 0 END AS transition FROM steps""")
def q_state_transition(spark: SparkSession, d: str) -> DataFrame:
    return labels.state_transitions(series(spark, d), ["key"], label="class4").select("key", "pos", "transition")


@query(f"WITH {_SERIES}, steps AS (SELECT key, pos, weight AS a, lead(weight) OVER (PARTITION BY key ORDER BY pos) AS b FROM series) SELECT key, pos, CASE WHEN a <> 0 AND b <> 0 THEN 1 ELSE 0 END AS transition_mask FROM steps")
def q_transition_mask(spark: SparkSession, d: str) -> DataFrame:
    return labels.transition_mask(series(spark, d), ["key"]).select("key", "pos", "transition_mask")


@query(f"""
    WITH {_FEATURES}, bases AS (SELECT gene_id, child_no, strand, unnest(range(0, end_pos - start_pos + 1)) AS i, end_pos - start_pos + 1 AS n, child_no % 3 AS phase FROM features),
    filled AS (SELECT *, ([0, 2, 1])[((CASE WHEN strand = -1 THEN n - 1 - i ELSE i END + CASE phase WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END) % 3) + 1] AS p FROM bases)
    SELECT gene_id, child_no, string_agg(p::VARCHAR, '' ORDER BY i) AS phases FROM filled GROUP BY ALL""")
def q_phase_fill(spark: SparkSession, d: str) -> DataFrame:
    length = F.col("end") - F.col("start") + 1
    filled = labels.filled_phases(length, F.col("child_no") % 3, F.col("strand") == -1)
    return features(spark, d).select("gene_id", "child_no", filled.alias("phases"))


@query(f"""
    WITH {_FEATURES}, sides AS (SELECT gene_id, sum(CASE WHEN kind = 'N' THEN end_pos - start_pos ELSE 0 END) AS u5, sum(CASE WHEN kind = 'R' THEN end_pos - start_pos ELSE 0 END) AS u3 FROM features GROUP BY gene_id),
    totals AS (SELECT coalesce(sum(u5), 0) AS t5, coalesce(sum(u3), 0) AS t3, count(*) AS n FROM sides WHERE u5 > 0 AND u3 > 0)
    SELECT CASE WHEN n = 0 THEN 500 ELSE trunc(t5 / n) END::BIGINT AS average_5, CASE WHEN n = 0 THEN 500 ELSE trunc(t3 / n) END::BIGINT AS average_3, n FROM totals""")
def q_utr_average(spark: SparkSession, d: str) -> DataFrame:
    length = F.col("end") - F.col("start")
    rows = features(spark, d).select("gene_id", F.when(F.col("kind") == "N", length).otherwise(0).alias("utr_5"), F.when(F.col("kind") == "R", length).otherwise(0).alias("utr_3"))
    return labels.average_utr(labels.utr_lengths(rows, ["gene_id"]))


@query(f"WITH {_SERIES} SELECT key, pos // 4 AS win_idx, bool_or(class <> 0) AS genic, bool_or(weight <> 0) AS weighed, count(*) AS n FROM series GROUP BY ALL HAVING bool_or(class <> 0) AND bool_or(weight <> 0)")
def q_window_discard(spark: SparkSession, d: str) -> DataFrame:
    return labels.kept_windows(series(spark, d), ["key"], 4)


# Metrics

_TRUTH = "truth AS (SELECT doc_id, quality + toxic AS label, (n_chars % 3)::INT AS pred, doc_id % 5 AS weight FROM labels JOIN documents USING (doc_id))"


def _truth(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 3).cast("int").alias("pred"))
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", (F.col("quality") + F.col("toxic")).alias("label"), "pred", (F.col("doc_id") % 5).alias("weight"))


@query(f"WITH {_TRUTH} SELECT label, pred, count(*) AS n FROM truth WHERE weight <> 0 GROUP BY ALL")
def q_confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_truth(spark, d), weight="weight")


@query(f"WITH {_TRUTH} SELECT avg((label = pred)::INT::DOUBLE) AS accuracy, count(*) AS n FROM truth WHERE weight <> 0")
def q_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.accuracy(metrics.confusion(_truth(spark, d), weight="weight"))


_F1 = f"""{_TRUTH}, kept AS (SELECT * FROM truth WHERE weight <> 0), classes AS (SELECT label AS class FROM kept UNION SELECT pred FROM kept),
    counts AS (SELECT class, (SELECT count(*) FROM kept WHERE label = class AND pred = class) AS tp, (SELECT count(*) FROM kept WHERE label <> class AND pred = class) AS fp, (SELECT count(*) FROM kept WHERE label = class AND pred <> class) AS fn FROM classes)"""


@query(f"WITH {_F1} SELECT class, tp, fp, fn, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1 FROM counts")
def q_f1(spark: SparkSession, d: str) -> DataFrame:
    return metrics.f1(metrics.confusion(_truth(spark, d), weight="weight"))


@query(f"WITH {_F1} SELECT avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)) AS macro_f1 FROM counts")
def q_macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return metrics.f1(metrics.confusion(_truth(spark, d), weight="weight")).agg(F.avg("f1").alias("macro_f1"))


@query(f"""
    WITH {_TRUTH}, tasks AS (SELECT label, pred, weight, 0 AS task FROM truth UNION ALL SELECT (label > 0)::INT, (pred > 0)::INT, weight, 1 FROM truth UNION ALL SELECT label % 2, pred % 2, weight, 2 FROM truth),
    kept AS (SELECT * FROM tasks WHERE weight <> 0), classes AS (SELECT DISTINCT task, c FROM (SELECT task, label AS c FROM kept UNION ALL SELECT task, pred FROM kept)),
    f1 AS (SELECT c.task, 2.0::DOUBLE * count(*) FILTER (label = c AND pred = c) / (count(*) FILTER (label = c) + count(*) FILTER (pred = c)) AS f1 FROM classes c JOIN kept k ON k.task = c.task GROUP BY c.task, c.c)
    SELECT round(avg(m), 9) AS macro_f1 FROM (SELECT avg(f1) AS m FROM f1 GROUP BY task)""")
def q_checkpoint_metric(spark: SparkSession, d: str) -> DataFrame:
    rows = _truth(spark, d)
    tasks = [rows, *(rows.withColumn("label", f(F.col("label")).cast("int")).withColumn("pred", f(F.col("pred")).cast("int")) for f in (lambda c: c > 0, lambda c: c % 2))]
    return metrics.checkpoint_metric([metrics.confusion(t, weight="weight") for t in tasks]).select(F.round("macro_f1", 9).alias("macro_f1"))


@query(f"""
    WITH {_TRUTH}, p AS (SELECT *, (1 + doc_id % 97) / 100.0::DOUBLE AS p FROM truth), batches AS (SELECT doc_id // 32 AS batch, avg(-ln(p) * weight * (1 + label)) AS loss FROM p GROUP BY ALL)
    SELECT round(avg(loss), 9) AS base, round(avg(loss) + 10 * avg(loss) + 10 * avg(loss), 9) AS total FROM batches""")
def q_weighted_ce(spark: SparkSession, d: str) -> DataFrame:
    rows = _truth(spark, d).withColumn("p", (1 + F.col("doc_id") % 97) / 100.0)
    loss = metrics.weighted_cross_entropy(F.col("p"), F.col("weight"), 1 + F.col("label"))
    mean = rows.groupBy(F.expr("doc_id div 32")).agg(loss.alias("loss")).agg(F.avg("loss").alias("loss"))
    return mean.select(F.round("loss", 9).alias("base"), F.round(metrics.total_loss(F.col("loss"), F.col("loss"), F.col("loss")), 9).alias("total"))


@query("""
    WITH RECURSIVE epochs AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS score FROM events),
    fold AS (
        SELECT key, epoch, score, score AS best, 0 AS streak, false AS stopped FROM epochs WHERE epoch = 1
        UNION ALL SELECT e.key, e.epoch, e.score, CASE WHEN e.score > f.best + 0.5 THEN e.score ELSE f.best END, CASE WHEN e.score > f.best + 0.5 THEN 0 ELSE f.streak + 1 END,
            f.stopped OR (e.score <= f.best + 0.5 AND f.streak + 1 >= 5)
        FROM fold f JOIN epochs e ON e.key = f.key AND e.epoch = f.epoch + 1)
    SELECT key, epoch, best, streak, stopped FROM fold""")
def q_early_stop(spark: SparkSession, d: str) -> DataFrame:
    scores = series(spark, d).select("key", (F.col("pos") + 1).alias("epoch"), F.col("value").alias("score"))
    return metrics.early_stop(scores, 5, 0.5, ["key"]).select("key", "epoch", "best", "streak", "stopped")


# Experts and packing

_GATES = """
    logits AS (SELECT vec_id, list_transform(range(0, 8), lambda b: list_sum(list_transform(embedding[b * 8 + 1:b * 8 + 8], lambda x: x::DOUBLE))) AS g, embedding FROM embeddings),
    powers AS (SELECT *, list_transform(g, lambda x: exp(x - list_max(g))) AS p FROM logits),
    gates AS (SELECT vec_id, embedding, list_transform(p, lambda x: x / list_sum(p)) AS gate FROM powers),
    each AS (SELECT vec_id, i - 1 AS expert, gate[i] AS gate, row_number() OVER (PARTITION BY vec_id ORDER BY gate[i] DESC, i) AS r FROM gates, range(1, 9) t(i))"""


def _gates(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    logits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.aggregate(F.slice(x, b * 8 + 1, 8), F.lit(0.0), lambda s, v: s + v))
    return experts.softmax_column(table(spark, d, "embeddings").select("vec_id", x.alias("x"), logits.alias("g")), "g", "gate")


@query(f"WITH {_GATES} SELECT vec_id, expert::INT AS expert, round(gate, 9) AS gate FROM each")
def q_softmax(spark: SparkSession, d: str) -> DataFrame:
    return _gates(spark, d).select("vec_id", F.posexplode("gate").alias("expert", "gate")).withColumn("gate", F.round("gate", 9))


@query(f"WITH {_GATES} SELECT vec_id, (r - 1)::INT AS place, expert::INT AS expert, round(gate, 9) AS gate FROM each WHERE r <= 2")
def q_topk_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = _gates(spark, d).select("vec_id", F.posexplode(experts.top_k(F.col("gate"))).alias("place", "t"))
    return rows.select("vec_id", "place", F.col("t.expert").alias("expert"), F.round("t.gate", 9).alias("gate"))


@query(f"""
    WITH {_GATES}, picked AS (SELECT e.vec_id, e.gate, e.expert, embedding FROM each e JOIN gates g USING (vec_id) WHERE r <= 2),
    parts AS (SELECT vec_id, k - 1 AS i, gate * (embedding[k]::DOUBLE * (expert + 1) + expert) AS y FROM picked, range(1, 65) t(k))
    SELECT vec_id, i::INT AS i, round(sum(y), 7) AS y FROM parts GROUP BY ALL""")
def q_moe_combine(spark: SparkSession, d: str) -> DataFrame:
    out = experts.mixture(_gates(spark, d), "vec_id", "x", "gate", lambda x, e: F.transform(x, lambda v: v * (e + 1) + e))
    return out.select("vec_id", F.posexplode("y").alias("i", "y")).withColumn("y", F.round("y", 7))


@query(f"""
    WITH {_GATES}, weights AS (SELECT e AS expert, k, list_transform(range(64), lambda j: ((e + 1) * (3 * k + 5 * j) % 11 - 5) / 16.0::DOUBLE) AS w, (e - k) / 8.0::DOUBLE AS b FROM range(8) x(e), range(8) y(k)),
    picked AS (SELECT e.vec_id, e.gate, e.expert, embedding::DOUBLE[] AS x FROM each e JOIN gates g USING (vec_id) WHERE r <= 2),
    parts AS (SELECT vec_id, k, gate * (list_inner_product(w, x) + b) AS y FROM picked JOIN weights USING (expert))
    SELECT vec_id, k::INT AS i, round(sum(y), 7) AS y FROM parts GROUP BY ALL""")
def q_moe_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Tokens sent to experts with weight matrices of their own."""
    e, k = F.col("expert"), F.sequence(F.lit(0), F.lit(7))
    w = F.transform(k, lambda k: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: ((e + 1) * (3 * k + 5 * j) % 11 - 5) / 16.0))
    layer = F.struct(w.alias("w"), F.transform(k, lambda k: (e - k) / 8.0).alias("b"))
    networks = spark.range(8).select(F.col("id").cast("int").alias("expert")).select("expert", F.array(layer).alias("layers"))
    out = experts.dispatched(_gates(spark, d), networks, "vec_id", "x", "gate")
    return out.select("vec_id", F.posexplode("y").alias("i", "y")).withColumn("y", F.round("y", 7))


@query(f"WITH {_GATES} SELECT vec_id, expert::INT AS best FROM each WHERE r = 1")
def q_argmax(spark: SparkSession, d: str) -> DataFrame:
    return _gates(spark, d).select("vec_id", S.argmax(F.col("gate")).alias("best"))


_LPT_STEP = ", ".join(f"CASE WHEN list_position(f.loads, list_min(f.loads)) = {k} THEN f.loads[{k}] + o.size ELSE f.loads[{k}] END" for k in range(1, 6))


_LPT_FOLD = f"""
    items AS (SELECT s_nationkey AS key, s_suppkey AS seq_ord, (s_suppkey * 7919 % 1000 + 1)::BIGINT AS size FROM supplier),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY size DESC, seq_ord) AS r, count(*) OVER (PARTITION BY key) AS n FROM items),
    big AS (SELECT 9223372036854775807::BIGINT AS top),
    fold AS (
        SELECT key, seq_ord, size, r, 0 AS chunk_id, [size, CASE WHEN n >= 2 THEN 0 ELSE top END, CASE WHEN n >= 3 THEN 0 ELSE top END, CASE WHEN n >= 4 THEN 0 ELSE top END, CASE WHEN n >= 5 THEN 0 ELSE top END] AS loads FROM ordered, big WHERE r = 1
        UNION ALL SELECT o.key, o.seq_ord, o.size, o.r, list_position(f.loads, list_min(f.loads)) - 1, [{_LPT_STEP}]
        FROM fold f JOIN ordered o ON o.key = f.key AND o.r = f.r + 1)"""


@query(f"WITH RECURSIVE {_LPT_FOLD} SELECT key, seq_ord, size, chunk_id::INT AS chunk_id FROM fold")
def q_lpt_chunks(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("seq_ord"), (F.col("s_suppkey") * 7919 % 1000 + 1).alias("size"))
    return packing.longest_first(items, 5, "size", "seq_ord", ["key"])


@query("SELECT c_custkey AS item, list_sort(list_distinct(list_filter([c_custkey % 3, c_custkey % 5, c_custkey % 7], lambda x: x NOT IN (0, 1))))::VARCHAR AS rest FROM customer")
def q_set_difference(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rest = F.sort_array(F.array_except(F.array(k % 3, k % 5, k % 7), F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    return table(spark, d, "customer").select(k.alias("item"), F.concat(F.lit("["), F.array_join(rest.cast("array<string>"), ", "), F.lit("]")).alias("rest"))


# Decoding and the whole plan: not for SQL; tests hold them against path enumeration and against each other


def _genome(spark: SparkSession, d: str) -> DataFrame:
    rows = dna(spark, d)
    return rows.select("seq_id", F.col("seq_id").alias("seq_ord"), F.length("seq").cast("long").alias("length"), F.col("seq").cast("binary").alias("seq"))


@query()
def q_viterbi(spark: SparkSession, d: str) -> DataFrame:
    from strandloom.operators import hmm

    pieces = stored(plan.predict(_genome(spark, d), CompositionScorer(), 512, 128))
    return hmm.annotate_regions(plan.candidates(pieces).withColumn("seq_id", F.col("seq_id").cast("string")), 12, 0.3, min_span=12)


@query()
def q_viterbi_utr(spark: SparkSession, d: str) -> DataFrame:
    from strandloom.operators import hmm_utr

    pieces = stored(plan.predict(_genome(spark, d), CompositionScorer(), 512, 128))
    # Four classes, the chance of a change and the places in a codon, made of five classes.
    found = plan.candidates(pieces).select(
        F.col("seq_id").cast("string").alias("seq_id"), "strand", "region_start", "seq",
        F.transform("probs", lambda p: F.array(p[0] * 0.75, p[0] * 0.25, p[1] + p[2] + p[3], p[4])).alias("classes"),
        F.transform("probs", lambda p: F.array(F.lit(1.0) - p[4] * 0.5, p[4] * 0.5 + p[0] * 0.02)).alias("changes"),
        F.transform("probs", lambda p: F.slice(p, 2, 3)).alias("phases"),
    )
    return hmm_utr.annotate_regions(found, 12, 0.3)


@query()
def q_annotate(spark: SparkSession, d: str) -> DataFrame:
    # Most of these contigs have some hundred bases: larger windows would be mostly padding.
    return plan.annotate(_genome(spark, d), CompositionScorer(), 512, 128, min_cds_score=0.3, min_cds_length=30)


@query()
def q_annotate_pieces(spark: SparkSession, d: str) -> DataFrame:
    """q_annotate with every region decoded in the pieces that it overlaps."""
    return plan.annotate(_genome(spark, d), CompositionScorer(), 512, 128, min_cds_score=0.3, min_cds_length=30, whole=0)


@query()
def q_annotate_utr(spark: SparkSession, d: str) -> DataFrame:
    return plan.annotate_tracks(_genome(spark, d), CompositionTracks(), "Fungi", 512, 128, min_cds_score=0.2, min_cds_length=12)


FASTA_PIECE = 256


@query(f"""
    WITH {_DNA} SELECT seq_id::VARCHAR AS seq_id, length(seq) AS length, unnest(range(0, length(seq), {FASTA_PIECE})) AS start, md5(substring(seq, unnest(range(0, length(seq), {FASTA_PIECE})) + 1, {FASTA_PIECE})) AS piece_md5 FROM dna""")
def q_fasta_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The sequences written as FASTA and read back by ranges of bytes, in pieces."""
    folder = fasta.write_fasta(dna(spark, d).select(F.col("seq_id").cast("string").alias("seq_id"), "seq"))
    pieces = fasta_ranges.read_pieces(spark, folder, FASTA_PIECE, 1 << 20)
    return pieces.select("seq_id", "length", "start", F.md5("seq").alias("piece_md5"))


@query()
def q_train_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds on windows of the documents' letters, whose labels follow from each base and the next."""
    tiles = tiling.windows(dna(spark, d), WINDOW, FLANK)
    # Digits of whole windows, by strings: a step for each base would take most of the time.
    letters = F.substring("seq", FLANK + 1, WINDOW + 1)
    digits = F.substring(F.translate(F.regexp_replace(letters, "[CG](?=[CG])", "2"), "TACGX", "10000"), 1, WINDOW)
    steps = F.translate(F.regexp_replace(F.translate(digits, "012", "abc"), r"(.)(?=\1|$)", "0"), "abc", "111")
    shorts = lambda text: F.split(text, "").cast("array<short>")
    rows = tiles.select("seq_id", "win_idx", "seq", shorts(digits).alias("ann"), shorts(steps).alias("step"), shorts(F.translate(F.substring("seq", FLANK + 1, WINDOW), "ACGTX", "11110")).alias("weight"))
    step, phase = F.col("step"), F.transform("ann", lambda a, i: F.when(a == 2, i % 3).otherwise(3).cast("short"))
    rows = stored(rows.select("seq_id", F.lit(1).alias("strand"), "win_idx", "seq", "ann", "weight", step.alias("transition"), F.col("weight").alias("transition_mask"), phase.alias("phase")))
    held, used = samples.split(rows, 0.2, 1)
    done = training.train(used, held, new_folder(spark, "training"), FLANK, 4, 3, 0.02)
    return done.select("round", F.round("loss", 6).alias("loss"), F.round("macro_f1", 6).alias("macro_f1"), "improved", "stopped")


# Storage


@query(f"WITH RECURSIVE {_LPT_FOLD} SELECT key, chunk_id::INT AS chunk_id, count(*) AS n, sum(size)::BIGINT AS total FROM fold GROUP BY ALL")
def q_chunk_totals(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("seq_ord"), (F.col("s_suppkey") * 7919 % 1000 + 1).alias("size"))
    return packing.chunk_totals(packing.longest_first(items, 5, "size", "seq_ord", ["key"]), "size", ["key"])


@query(f"WITH {_DNA} SELECT seq_id, md5(reverse(translate(seq, 'ATGC', 'TACG'))) AS rc_md5 FROM dna")
def q_revcomp_strict(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("seq_id", F.md5(S.reverse_complement_strict(F.col("seq"))).alias("rc_md5"))
