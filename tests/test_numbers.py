import pytest
from pyspark.sql import functions as F

from strandloom import catalog


@pytest.fixture
def scattered(spark):
    """Several partitions even for few rows, so that rows do not meet in the order of their identifiers."""
    with_ = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in with_}
    for k, v in with_.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_genes_at_one_place_go_by_their_identifier(scattered, tmp_path):
    """Gene 300,000 begins 3 bases before gene 0, so first_cds * 100000 + gene_id is the same for both, on either strand."""
    pairs = [(i, i + 300_000) for i in range(300)]
    for turn in (0, 1):
        folder = tmp_path / str(turn)
        parts, orders = [], []
        for low, high in pairs:
            for gene, part in ((low, 3), (high, 0))[:: 1 - 2 * turn]:
                parts.append((gene, part, 0, 1, 10.0, 1.0, 0.1, "N", "2020-01-01"))
                orders.append((gene, low % 2))
        schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate string"
        scattered.createDataFrame(parts, schema).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
        scattered.createDataFrame(orders, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{folder}/orders.parquet")
        number = {r["gene_id"]: r["gene_no"] for r in catalog.QUERIES["q_gene_number"](scattered, str(folder)).select("gene_id", F.col("gene_no")).collect()}
        assert len(number) == 600 and all(number[low] + 1 == number[high] for low, high in pairs)
