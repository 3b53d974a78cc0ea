"""Fixed column types. Nothing in this package infers a schema."""

from pyspark.sql import types as T

MESSAGE = T.StructType(
    [T.StructField("from", T.StringType()), T.StructField("value", T.StringType())]
)

REGISTRY = T.StructType(
    [
        T.StructField("img_path", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("score", T.IntegerType()),
    ]
)

SFT_SAMPLE = T.StructType(
    [
        T.StructField("conversations", T.ArrayType(MESSAGE)),
        T.StructField("images", T.ArrayType(T.StringType())),
    ]
)

DPO_SAMPLE = T.StructType(
    [
        T.StructField("conversations", T.ArrayType(MESSAGE)),
        T.StructField("chosen", MESSAGE),
        T.StructField("rejected", MESSAGE),
        T.StructField("images", T.ArrayType(T.StringType())),
    ]
)

GENERATION = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("request_at", T.TimestampType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("image_b64", T.StringType()),
        T.StructField("failed", T.BooleanType()),
        T.StructField("response", T.StringType()),
        T.StructField("session_id", T.StringType()),
    ]
)

API_KEY = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("granted_at", T.TimestampType()),
        T.StructField("session_id", T.StringType()),
    ]
)

EPOCH_METRICS = T.StructType(
    [
        T.StructField("epoch", T.IntegerType()),
        T.StructField("phase", T.StringType()),
        T.StructField("loss", T.DoubleType()),
        T.StructField("lr", T.DoubleType()),
    ]
)

# the XML source puts attributes under "_" and element text under "_VALUE"
INK_XML = T.StructType(
    [
        T.StructField(
            "annotation",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("_VALUE", T.StringType()),
                        T.StructField("_type", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("trace", T.ArrayType(T.StringType())),
    ]
)
