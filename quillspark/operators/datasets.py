"""Nested chat records for supervised, preference and calibration data."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import fixed, schemas
from quillspark.functions.text import data_uri, strip, tagged_prompt, untagged


def message(sender, value):
    return F.struct(F.lit(sender).alias("from"), value.alias("value"))


def sft_records(samples, question=fixed.USER_PROMPT, keep=()):
    """One tagged question and its answer per sample, and the columns `keep`."""
    return samples.select(
        *keep,
        F.array(message("human", tagged_prompt(question)), message("gpt", F.col("label"))).alias("conversations"),
        F.array("img_path").alias("images"),
    )


def mismatches(predictions):
    """Rows whose stripped prediction differs from the label as it is."""
    return predictions.withColumn("pred", strip(F.col("pred"))).where(F.col("label") != F.col("pred"))


def dpo_records(predictions, question=fixed.USER_PROMPT):
    """The right label as chosen and the model's answer as rejected, for wrong answers only."""
    return mismatches(predictions).select(
        F.array(message("human", tagged_prompt(question))).alias("conversations"),
        message("gpt", F.col("label")).alias("chosen"),
        message("gpt", F.col("pred")).alias("rejected"),
        F.array("img_path").alias("images"),
    )


def write_records(records, path, *folders):
    """JSON Lines, so that writing stays parallel; one dataset for each value of the columns `folders`."""
    records.write.option("ignoreNullFields", "false").partitionBy(*folders).json(path)


def read_records(spark, path, schema=schemas.SFT_SAMPLE, array_file=False, splits=False):
    """Chat records from JSON Lines, or from files that hold one JSON array each; `splits`: from one folder per split."""
    if splits:
        schema = T.StructType([*schema.fields, T.StructField("split", T.StringType())])
    return spark.read.schema(schema).option("multiLine", array_file).json(path)


def answers(records):
    """The columns img_path and label of SFT records."""
    return [F.element_at("images", 1).alias("img_path"), F.element_at("conversations", 2)["value"].alias("label")]


def read_back(records):
    """(img_path, label) of SFT records."""
    return records.select(*answers(records))


def first_messages(messages, keys, position, sender, value):
    """The first two messages of each conversation, without gathering the whole conversation."""

    def at(i):
        told = F.struct(F.col(sender).alias("from"), F.col(value).alias("value"))
        return F.max(F.when(F.col(position) == i, told))

    return messages.where(F.col(position) < 2).groupBy(*keys).agg(at(0).alias("first"), at(1).alias("second"))


def calibration_messages(first, second, image, root="/"):
    """Messages for calibration. Only the first message decides which form is taken; image paths below `root` become absolute."""

    def part(kind, text=None, image_url=None):
        nothing = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("type"),
            (nothing if text is None else text).alias("text"),
            (nothing if image_url is None else image_url).alias("image"),
        )

    def said(role, *parts):
        return F.struct(role.alias("role"), F.array(*parts).alias("parts"))

    asked = (first["from"] == "human") & F.contains(first["value"], F.lit(fixed.IMAGE_TAG))
    picture = F.concat(F.lit("file://"), F.when(image.startswith("/"), image).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), image)))
    return F.when(
        F.coalesce(asked, F.lit(False)),
        F.array(
            said(F.lit("user"), part("image", image_url=picture), part("text", untagged(first["value"]))),
            said(F.lit("assistant"), part("text", second["value"])),
        ),
    ).otherwise(F.array(said(first["from"], part("text", first["value"]))))


def chat_request(content, question=fixed.USER_PROMPT):
    """System and user messages of one model call, with the picture as a data URI."""
    nothing = F.lit(None).cast("string")

    def part(kind, text, url):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), url.alias("image_url"))

    return F.array(
        F.struct(
            F.lit("system").alias("role"),
            F.array(part("text", F.lit(fixed.SYSTEM_PROMPT), nothing)).alias("parts"),
        ),
        F.struct(
            F.lit("user").alias("role"),
            F.array(
                part("text", F.lit(question), nothing), part("image_url", nothing, data_uri(content))
            ).alias("parts"),
        ),
    )


def manifest(file_names):
    """Manifest text: the file and column names of each dataset in `file_names`."""
    return json.dumps(
        {name: {"file_name": file, **fixed.DATASETS[name]} for name, file in file_names.items()}, indent=4
    )


def read_manifest(spark, path):
    """(dataset, file_name, name of the trainer, name in our table) of every column in a manifest file."""
    columns = T.MapType(T.StringType(), T.StringType())
    kind = T.MapType(T.StringType(), T.StructType().add("file_name", "string").add("columns", columns))
    text = spark.read.text(path, wholetext=True)
    each = text.select(F.explode(F.from_json("value", kind)).alias("dataset", "about"))
    return each.select("dataset", F.col("about.file_name").alias("file_name"), F.explode("about.columns").alias("theirs", "ours"))


def write_manifest(spark, file_names, path):
    spark.createDataFrame([(manifest(file_names),)], "value string").coalesce(1).write.text(path)
