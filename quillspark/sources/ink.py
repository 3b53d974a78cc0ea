"""InkML scan: labels, strokes and points from files or from a text column."""

from pyspark.sql import functions as F

from quillspark import fixed, schemas
from quillspark.functions.text import bind, rendered_path


def _columns(ink):
    named = F.filter(F.coalesce(ink["annotation"], F.array()), lambda note: note["_type"].isNotNull())

    def last_of_each_type(s):
        return F.filter(
            s["notes"],
            lambda note, i: ~F.array_contains(F.slice(s["types"], i + 2, F.size(s["types"])), note["_type"]),
        )

    kept = bind(
        F.struct(named.alias("notes"), F.transform(named, lambda note: note["_type"]).alias("types")),
        last_of_each_type,
    )
    notes = bind(
        kept,
        lambda k: F.map_from_arrays(
            F.transform(k, lambda note: note["_type"]), F.transform(k, lambda note: note["_VALUE"])
        ),
    )

    def point(text):
        at = F.split(F.trim(text), " ")
        return F.struct(
            at[0].cast("double").alias("x"), at[1].cast("double").alias("y"), at[2].cast("double").alias("t")
        )

    strokes = F.transform(ink["trace"], lambda trace: F.transform(F.split(F.trim(trace), ","), point))
    return notes.alias("annotations"), notes["label"].alias("label"), strokes.alias("strokes")


def read_ink(spark, root):
    """One row per file below `<root>/<split>/`: path, split, annotations, label and strokes."""
    files = (
        spark.read.format("xml")
        .schema(schemas.INK_XML)
        .option("rowTag", "ink")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.inkml")
        .load(root)
    )
    path = F.col("_metadata.file_path")
    return files.select(
        path.alias("path"),
        F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1).alias("split"),
        *_columns({name: F.col(name) for name in ("annotation", "trace")}),
    )


def parse_ink(df, column):
    """The same columns from InkML text in a column."""
    ink = F.from_xml(F.col(column), schemas.INK_XML, {"rowTag": "ink"})
    return df.withColumn("__ink", ink).select(
        *[c for c in df.columns if c != column], *_columns(F.col("__ink"))
    )


def registry_rows(inks, splits=fixed.SPLITS):
    """(img_path, label, split) of ink files in the folders of known splits: the path is that of the drawn picture."""
    known = inks.where(F.col("split").isin(*splits))
    return known.select(rendered_path(F.col("path")).alias("img_path"), "label", "split")


def points(ink, keys):
    """One row per point, with its stroke and its place in it, both from 0."""
    strokes = ink.select(*keys, F.posexplode("strokes").alias("stroke", "__points"))
    each = strokes.select(*keys, "stroke", F.posexplode("__points").alias("point", "__p"))
    return each.select(*keys, "stroke", "point", "__p.x", "__p.y", "__p.t")


def bounds(points_df, keys):
    """Lowest and highest x and y per ink."""
    return points_df.groupBy(*keys).agg(
        F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax")
    )
