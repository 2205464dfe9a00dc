from pyspark.sql import functions as F

from strandloom.operators import labels


def test_phases_of_a_part_as_one_string(spark):
    """Base by base as filled_phase gives them, without a function called for each base."""
    rows = spark.range(1, 12).select(F.col("id").alias("n")).crossJoin(spark.range(3).select(F.col("id").alias("p"))).crossJoin(spark.createDataFrame([(True,), (False,)], "r boolean"))
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: labels.filled_phase(i, F.col("n"), F.col("p"), F.col("r")).cast("string"))
    got = rows.select(labels.filled_phases(F.col("n"), F.col("p"), F.col("r")).alias("got"), F.array_join(each, "").alias("want"))
    assert got.count() == 66 and got.where("got is distinct from want").isEmpty()
    plan = rows.select(labels.filled_phases(F.col("n"), F.col("p"), F.col("r")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan
