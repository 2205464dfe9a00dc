"""One place for the session settings that tests, bench and examples share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "strandloom", **conf: str) -> SparkSession:
    """A local session; on a cluster the deployment's own settings apply instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder of spark.checkpoint.dir.

    On a cluster that setting must name a folder all executors share. Only a
    local session without it gets a temporary folder of its own.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strandloom-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


#: Writer options for rows of some hundred kilobytes: readers take a row group's rows at once, so groups stay small.
WIDE = {"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 4}


def stored(df: DataFrame, wide: bool = False) -> DataFrame:
    """The rows of df as a Parquet table in the folder of spark.checkpoint.dir: computed once, and read by column; `wide` for long rows."""
    spark = df.sparkSession
    path = new_folder(spark, "stored")
    df.write.options(**(WIDE if wide else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task holds, about, of a table dealt by `spread`.
TASK_ROWS = 1 << 18


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """As many tasks as hold about `rows` rows of df each, those of the session at least. df is counted, so it is a table or cheap."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def spread(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """df dealt by keys over tasks_for it: a task's memory does not grow with the table."""
    return df.repartition(tasks_for(df, rows), *keys)
