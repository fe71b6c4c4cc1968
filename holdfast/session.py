"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # rows here are small but costly (nested decisions): keep enough tasks on small stages
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split skewed join partitions even where that costs one more exchange afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # tables clustered on customer_id join on (customer_id, day) without another exchange
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# This rule copies a generator's input into a `size(...) > 0` filter below it. Decision arrays
# are nested columns that refer to each other several times, so the copy would be evaluated
# over and over; the generators here skip empty arrays by themselves.
EXCLUDED_RULE = "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"
RULES_KEY = "spark.sql.optimizer.excludedRules"

# read once at start-up, so only sessions made here carry them: capturing the call site of
# every column costs more than the call itself on wide plans
START_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the operators rely on to a session someone else created."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    excluded = [r for r in (spark.conf.get(RULES_KEY, None) or "").split(",") if r.strip()]
    if EXCLUDED_RULE not in excluded:
        spark.conf.set(RULES_KEY, ",".join([*excluded, EXCLUDED_RULE]))
    return spark


def make_session(app: str = "holdfast", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **START_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: the cluster's `spark.checkpoint.dir`.

    A temporary folder is used only where that is unset and the session is local.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame, name: str = "stage", partition_by: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: a stage hand-over in columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def spread(df: DataFrame, parts: int) -> DataFrame:
    """One round-robin exchange into `parts`; keyless, so a hot key stays spread."""
    return df.repartition(parts)


def few_files(df: DataFrame) -> DataFrame:
    """`df` in fewer tasks, for hand-overs of little work: a file costs more than its rows there.
    At least two tasks a core, and a sixteenth of the session's shuffle partitions."""
    spark = df.sparkSession
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism,
                           int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))


def side_by_side[T](work: Mapping[str, Callable[[], T]]) -> dict[str, T]:
    """Results by name of steps that do not need each other: one fills the cores that the short
    passes and last tasks of another leave idle. An error of any of them is raised."""
    with ThreadPoolExecutor(len(work)) as pool:
        begun = {name: pool.submit(step) for name, step in work.items()}
        return {name: step.result() for name, step in begun.items()}
