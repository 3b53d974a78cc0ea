"""Geometry of ink canvases, stitched grids and their augmentation."""

from pyspark.sql import functions as F

from quillspark import fixed
from quillspark.functions.hashing import hash32, uniform


def canvas_side(low, high, margin=fixed.INK_MARGIN):
    """Pixels from the lowest to the highest point plus both margins, truncated."""
    return (high - low + 2 * margin).cast("int")


def canvas_shift(low, margin=fixed.INK_MARGIN):
    return -low + F.lit(float(margin))


def clamped_side(side):
    return F.greatest(F.lit(fixed.MIN_CANVAS), F.least(side, F.lit(fixed.MAX_CANVAS)))


def grid_columns(n):
    return F.ceil(F.sqrt(n)).cast("int")


def grid_rows(n, columns):
    return F.ceil(n / columns).cast("int")


def tile_side(side, count):
    return F.floor(side / count).cast("int")


def cell_column(i, columns):
    return (i % columns).cast("int")


def cell_row(i, columns):
    return F.floor(i / columns).cast("int")


def rotation_angle(*seed):
    return (uniform("angle", *seed) * 2 - 1) * fixed.ROTATE_MAX


def blur_radius(*seed):
    return uniform("blur", *seed)


def jitter(axis, tile, *seed):
    """Whole pixels within an eighth of the tile on both sides, floored like `-tile // 8`."""
    low, high = F.floor(-tile / F.lit(8)), F.floor(tile / F.lit(8))
    return (low + hash32("jitter", axis, *seed) % (high - low + 1)).cast("int")
