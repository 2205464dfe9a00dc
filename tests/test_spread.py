"""Tables dealt over tasks of a bounded size, and label tracks without joins."""

from strandloom import session
from strandloom.operators import labels
from strandloom.plans import views


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_grow_with_the_table(spark):
    rows = spark.range(1000).withColumnRenamed("id", "gene_id")
    assert session.spread(rows, "gene_id", rows=100).rdd.getNumPartitions() == 10
    assert session.spread(rows, "gene_id").rdd.getNumPartitions() == 4


def test_parts_of_a_gene_are_dealt_by_table_size(spark, tmp_path, monkeypatch):
    spark.sql("SELECT id div 3 AS l_orderkey, id % 3 AS l_linenumber, 1L AS l_partkey, 1L AS l_suppkey, 1.0D AS l_extendedprice, timestamp'2020-01-01' AS l_shipdate, 5.0D AS l_quantity, 0.1D AS l_discount, 'N' AS l_returnflag FROM range(90)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT id AS o_orderkey, id AS o_custkey FROM range(30)").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(session.spread, "__kwdefaults__", {"rows": 10})
    assert views.stored_features(spark, str(tmp_path)).rdd.getNumPartitions() == 9
    assert views.stored_features(spark, str(tmp_path)).count() == 90


def test_last_writers_need_no_join(spark):
    rows = spark.createDataFrame([(1, 0, 4, 7, 1), (1, 2, 6, 8, 2), (1, 3, 4, 9, 0), (1, 5, 5, 1, 3), (2, 10, 12, None, 1)], "k int, start long, end long, value int, write_seq int")
    out = labels.last_written(rows, ["k"])
    assert "Join" not in _plan(out)
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 0, 7), (1, 1, 7), (1, 2, 8), (1, 3, 8), (1, 4, 8), (1, 5, 8), (2, 10, None), (2, 11, None)]


def test_painting_is_one_window(spark):
    whole, exons, cds = (spark.createDataFrame(rows, "k int, start long, end long") for rows in ([(1, 0, 20)], [(1, 0, 5), (1, 5, 8), (1, 12, 20), (1, 12, 12)], [(1, 3, 8), (1, 6, 7), (1, 12, 14)]))
    out = labels.painted(whole, exons, cds, ["k"])
    assert "Aggregate" not in _plan(out)
    found = {}
    for k, start, end, kind in out.collect():
        for pos in range(start, end):
            assert pos not in found
            found[pos] = kind
    want = {p: 3 for p in range(20)} | {p: 1 for p in (*range(8), *range(12, 20))} | {p: 2 for p in (*range(3, 8), 12, 13)}
    assert found == want
