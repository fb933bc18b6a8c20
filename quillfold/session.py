"""Session set-up and the few physical-plan helpers every operator shares."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Setting: partitions that inputs are dealt out over in any case.
SPLITS = "spark.quillfold.input.splits"
# Rows that a task takes in any case, however few tasks that makes.
FEW_ROWS = 1000
# A join key with more rows than this on one side is split over several salts.
HOT_ROWS = 200_000


def get_spark(app: str = "quillfold", cores: str | None = None) -> SparkSession:
    """The session of a submitted application as it is configured; without a master, a local one of ``cores``."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if SparkConf().contains("spark.master") or "SPARK_REMOTE" in os.environ:
        return builder.getOrCreate()
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    split = cores if cores.isdigit() else "8"
    return (
        builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", split)
        .config(SPLITS, split)  # the test tables are single small files
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a scan out anew where one of its tasks would hold up the others; otherwise leave it as it is.

    Text work is CPU-bound, but scans are cut by bytes and row groups: a small table of one row group is one task, however
    many cores there are. Rows are counted per partition first, which reads file footers only. The setting ``SPLITS`` deals out
    over so many partitions without counting.
    """
    spark = df.sparkSession
    splits = spark.conf.get(SPLITS, None)
    if not splits:
        cores = spark.sparkContext.defaultParallelism
        held = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
        if (held[0] or 0) <= 2 * max(FEW_ROWS, (held[1] or 0) / cores):
            return df
        splits = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * cores)
    return df.repartition(int(splits), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only a local master without that setting gets a folder of its own; anywhere else the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="quillfold-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for a table written by a job, next to the checkpoints."""
    return f"{shared_folder(spark)}/{name}-{os.urandom(8).hex()}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    Any executor may be lost afterwards without recomputing what led here, and later steps read
    only the columns they use. Iterations restart their plan from it.
    """
    path = scratch_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside(df: DataFrame, single: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row aggregate next to every row."""
    key = F.lit(1)
    return df.withColumn("_one", key).join(F.broadcast(single.withColumn("_one", key)), "_one").drop("_one")


def salted_join(
    big: DataFrame, other: DataFrame, on: str, spread_by: Column, hot_rows: int | None = None
) -> DataFrame:
    """Inner equi-join that splits the hot keys of ``big`` over several tasks.

    ``other`` should hold few rows per key. Keys of ``big`` with more than ``hot_rows`` rows get
    one salt per ``hot_rows`` rows, and only their rows of ``other`` are replicated. ``big`` is
    read twice, so pass something materialised.
    """
    limit = hot_rows or HOT_ROWS
    hot = (
        big.groupBy(on)
        .count()
        .filter(F.col("count") > limit)
        .select(on, F.ceil(F.col("count") / F.lit(limit)).cast("int").alias("_salts"))
    )
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = big.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), salts).cast("int")).drop("_salts")
    right = (
        other.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return left.join(right, [on, "_salt"]).drop("_salt")
