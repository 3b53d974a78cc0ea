"""Registry and application tables: Parquet versions, CSV interchange, folders by class, JDBC."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillspark import schemas

_CSV = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSxxx",
}


# a null's text in registry files: an empty field stays an empty text
NULL_TEXT = "\u0001"


def write_csv(df, path, null_text=NULL_TEXT):
    """CSV that keeps quotes, line ends, outer blanks and the difference of null and empty text."""
    df.write.options(**_CSV, nullValue=null_text).csv(path)


def read_csv(spark, path, schema, null_text=NULL_TEXT):
    return spark.read.schema(schema).options(**_CSV, nullValue=null_text).csv(path)


def fs_path(spark, path):
    """The file system of a path, and the path for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _listing(spark, root):
    files, path = fs_path(spark, root)
    return files, ([s.getPath() for s in files.listStatus(path)] if files.exists(path) else [])


def versions(spark, root):
    """Numbers of the complete versions below `root`, in order."""
    files, paths = _listing(spark, root)
    done = spark._jvm.org.apache.hadoop.fs.Path
    named = [p for p in paths if p.getName().startswith("v") and files.exists(done(p, "_SUCCESS"))]
    return sorted(int(p.getName()[1:]) for p in named)


def _save_next(spark, root, write):
    """Write to the next free version number. Of two writers of one number the second fails over to the next.

    A folder without `_SUCCESS` was left by a writer that failed, or belongs to one at work: it is never reused.
    """
    files, paths = _listing(spark, root)
    taken = [int(p.getName()[1:]) for p in paths if p.getName().startswith("v")]
    number = max(taken, default=0) + 1
    for _ in range(100):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v{number:06d}")
        if not files.exists(path):
            try:
                write(f"{root}/v{number:06d}")
                return number
            except AnalysisException as error:
                if "PATH_ALREADY_EXISTS" not in str(error):
                    raise
        number += 1
    raise RuntimeError(f"no free version below {root}")


def save_version(df, root):
    """Write the next version next to the ones being read; returns its number."""
    return _save_next(df.sparkSession, root, _evenly(df, "split").write.mode("error").partitionBy("split").parquet)


def _evenly(df, *folders):
    """Rows gathered per folder in parts of even size: few files, and a hot folder gets many tasks."""
    return df.hint("rebalance", *[F.col(c) for c in folders])


def load_version(spark, root, schema=schemas.REGISTRY, number=None):
    number = number or versions(spark, root)[-1]
    rows = spark.read.schema(schema).parquet(f"{root}/v{number:06d}")
    return rows.select(*schema.names)


def read_or_create(spark, root, ingest):
    """The newest saved registry; without one, `ingest()` is saved as the first version."""
    if not versions(spark, root):
        save_version(ingest(), root)
    return load_version(spark, root)


def write_class_folders(registry, path):
    """Scored rows below `split=<split>/score=<score>/`."""
    scored = registry.where(F.col("score").isNotNull())
    _evenly(scored, "split", "score").write.partitionBy("split", "score").parquet(path)


def read_class_folders(spark, path, split=None):
    """Rows of a class-folder tree; asking for a split reads that folder only."""
    schema = "img_path string, label string, split string, score int"
    rows = spark.read.schema(schema).parquet(path)
    return rows if split is None else rows.where(F.col("split") == split)


def list_class_files(spark, root):
    """(path, split, class) of every file below `<root>/<split>/<class>/<name>`; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.col("path")
    return files.select(
        path,
        F.regexp_extract(path, r"/([^/]+)/[^/]+/[^/]+$", 1).alias("split"),
        F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1).cast("int").alias("score"),
    )


def read_jdbc(spark, url, table, lower, upper, partitions, column="id", **options):
    """An application table over JDBC, cut by id ranges; filters and limits go to the database."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=column, numPartitions=partitions)
        .options(lowerBound=lower, upperBound=upper, **options)
        .load()
    )


def write_export(rows, path):
    """CSV download: null and empty text are both an empty field."""
    rows.write.options(**_CSV, nullValue="", emptyValue="").csv(path)


def read_export(spark, path, schema):
    return read_csv(spark, path, schema, null_text="")


def export_gens(gens, session_id):
    """A session's generations, newest first, with the columns of the CSV download."""
    rows = gens.where(F.col("session_id") == session_id).orderBy(F.desc("request_at"), F.desc("id"))
    return rows.select("session_id", "request_at", "image_url", "image_b64", "response", "failed")


def export_keys(keys, session_id):
    rows = keys.where(F.col("session_id") == session_id).orderBy(F.desc("granted_at"), F.desc("id"))
    return rows.select("session_id", "key", "granted_at")
