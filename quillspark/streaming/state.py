"""State of foreachBatch jobs: one row per key, in hash buckets, of which a micro-batch reads and rewrites only those it touches.

A bucket's rows lie in `<root>/v=<micro-batch>/b=<bucket>`; the newest version before a micro-batch is what it starts from. A micro-batch that runs again after a
failure starts from the same rows and overwrites its own, so every result is the same however often it runs. Versions that a finished micro-batch has
replaced are removed. Buckets are set once, so that one fits a task: their number is part of the layout.
"""

from pyspark.sql import functions as F

from quillspark.session import scratch_folder
from quillspark.sources.tables import fs_path

BUCKETS = 16
_BUCKET = "__b"


class BucketedState:
    def __init__(self, spark, root, keys, schema, buckets=BUCKETS):
        self.spark, self.root, self.keys, self.schema, self.buckets = spark, root, keys, schema, buckets

    def _with_bucket(self, rows):
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _versions(self):
        """Numbers of the versions of each bucket."""
        files, pattern = fs_path(self.spark, f"{self.root}/v=*/b=*")
        found = {}
        for status in files.globStatus(pattern) or []:
            path = status.getPath()
            found.setdefault(int(path.getName()[2:]), []).append(int(path.getParent().getName()[2:]))
        return found

    def touched(self, batch):
        """Buckets that hold a key of the batch: `buckets` numbers at most."""
        return sorted(r[0] for r in self._with_bucket(batch).select(_BUCKET).distinct().collect())

    def before(self, number, buckets=None):
        """State rows as they were before micro-batch `number`, of some or all buckets."""
        newest = {b: max((v for v in vs if v < number), default=None) for b, vs in self._versions().items() if buckets is None or b in buckets}
        paths = [f"{self.root}/v={v}/b={b}" for b, v in newest.items() if v is not None]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def replace(self, number, rows):
        """Write `rows`, all that the touched buckets hold from now on, as the state after micro-batch `number`."""
        rows = self._with_bucket(rows.select(*self.schema.names)).withColumnRenamed(_BUCKET, "b")
        rows.hint("rebalance", F.col("b")).write.mode("overwrite").partitionBy("b").parquet(f"{self.root}/v={number}")
        for bucket, numbers in self._versions().items():
            settled = [v for v in numbers if v < number]  # earlier micro-batches will not run again
            for old in sorted(settled)[:-1]:
                files, path = fs_path(self.spark, f"{self.root}/v={old}/b={bucket}")
                files.delete(path, True)

    def has_versions(self):
        return bool(self._versions())

    def seed(self, rows):
        """State before the first micro-batch."""
        self.replace(-1, rows)

    def mark(self, number, value):
        """Remember a number of micro-batch `number`, as of all its rows."""
        self.spark.createDataFrame([(value,)], "value double").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/marks/n={number}")

    def marked(self, number):
        """The greatest number remembered before micro-batch `number`, or none."""
        files, pattern = fs_path(self.spark, f"{self.root}/marks/n=*")
        paths = [s.getPath() for s in files.globStatus(pattern) or []]
        paths = [str(p) for p in paths if int(p.getName()[2:]) < number]
        return self.spark.read.schema("value double").parquet(*paths).agg(F.max("value")).first()[0] if paths else None

    def rows(self):
        """All rows after the last micro-batch."""
        return self.before(1 << 62)


def run_folds(stream, state, fold, out=None, checkpoint=None):
    """Fold what is there, micro-batch by micro-batch, and stop: (output rows, new state) = fold(batch, state rows of its buckets, number).

    Output goes to `<out>/batch=<number>`, which a repeated micro-batch overwrites. Returns all output so far, if there is an `out`.
    """
    spark = stream.sparkSession
    schemas = []

    def step(batch, number):
        batch = batch.persist()
        try:
            touched = state.touched(batch)
            if touched:
                shown, after = fold(batch, state.before(number, touched), number)
                if out:
                    schemas.append(shown.schema)
                    shown.write.mode("overwrite").parquet(f"{out}/batch={number}")
                state.replace(number, after)
        finally:
            batch.unpersist()

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint or scratch_folder(spark, "folds"))
    query.trigger(availableNow=True).start().awaitTermination()
    if out:
        files, path = fs_path(spark, out)
        if files.exists(path):
            return spark.read.parquet(out).drop("batch")
        return spark.createDataFrame([], schemas[-1]) if schemas else None
