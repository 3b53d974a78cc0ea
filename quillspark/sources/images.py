"""Image scan and the perceptual hash of its pixels."""

import pandas as pd
from pyspark.sql import functions as F

from quillspark import fixed, workers


def read_images(spark, root):
    """Images below `root`, decoded by Spark; files that cannot be decoded have height -1."""
    files = spark.read.format("image").option("recursiveFileLookup", "true").load(root)
    return files.select(F.col("image.origin").alias("path"), "image")


def perceptual_hash(image, side=fixed.HASH_SIDE):
    """Hex text of the low frequencies of an image; null for a broken one."""

    @F.pandas_udf("string")
    def fingerprint(images: pd.DataFrame) -> pd.Series:
        rows = zip(images["height"], images["width"], images["nChannels"], images["data"], strict=True)
        return pd.Series([workers.pixel_hash(*row, side) for row in rows])

    return fingerprint(image)
