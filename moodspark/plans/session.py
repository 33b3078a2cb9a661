"""Session settings and the shared folder for cutting lineage."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution splits skewed join partitions and sizes reducers at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # An answer that names a key twice counts with the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


# On a cluster a shuffle starts with many partitions, which adaptive execution merges to about this size.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def build_session(app: str = "moodspark", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    cluster = {} if master and master.startswith("local") else CLUSTER_SETTINGS
    for key, value in {**SETTINGS, **cluster, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach; a private one only in local mode with none configured."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    current = context._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="moodspark-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which goes when the session's JVM ends."""
    folder = f"{shared_folder(spark)}/moodspark-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there, so that lost executors cost no replay.

    Parquet, so that later steps read only the columns they need.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark, "rows")
    df.write.mode("overwrite").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
