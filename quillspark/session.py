"""Session settings and the shared scratch folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession


_made = []


def build_session(master=None, app="quillspark", **conf):
    """Session with the settings the operators assume: UTC, AQE with skew handling, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def scratch_root(spark):
    """Folder all executors share: the one the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="quillspark-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_folder(spark, name):
    """A path below the shared folder that no other run uses. `clear_scratch` removes it."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def scratch_mark():
    """A point in time, for `clear_scratch_between`."""
    return len(_made)


def clear_scratch(spark):
    """Remove all scratch folders of this process. For their owner, when no result that reads them is needed any more."""
    clear_scratch_between(spark, 0, len(_made))


def clear_scratch_between(spark, first, last):
    """Remove the scratch folders made between two marks. The marks of others stay valid."""
    for i in range(first, min(last, len(_made))):
        if _made[i]:
            path = spark._jvm.org.apache.hadoop.fs.Path(_made[i])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            _made[i] = None


def written(df, name, partition_by=()):
    """Write `df` to a new scratch folder and return the read-back, cutting lineage durably."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
