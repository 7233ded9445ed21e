"""Crop manifests from box annotations (no image data)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the crop protocol (pixels).
BOX_SIDE = 50
BACKGROUND_SHIFT = 100
TILE = 64


def square_boxes(ann: DataFrame, side: int = BOX_SIDE) -> DataFrame:
    return ann.where((F.col("x1") - F.col("x0") == side) & (F.col("y1") - F.col("y0") == side))


def background_candidates(boxes: DataFrame, images: DataFrame, shift: int = BACKGROUND_SHIFT) -> DataFrame:
    """Each box moved right by ``shift``, kept when it lies inside its image."""
    moved = boxes.select(
        "image_id", "ann_id", (F.col("x0") + shift).alias("x0"), "y0", (F.col("x1") + shift).alias("x1"), "y1"
    ).join(images.select("image_id", "width", "height"), "image_id")
    inside = (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x1") < F.col("width")) & (F.col("y1") < F.col("height"))
    return moved.where(inside).drop("width", "height")


def without_touching(candidates: DataFrame, ann: DataFrame, tile: int = TILE) -> DataFrame:
    """Drop candidates whose top-left or bottom-right corner is strictly inside an annotation.

    Boxes are listed under the grid tiles they cover and corners under their one tile, so a
    crowded image joins by tile instead of box against box.
    """

    def tiles(lo, hi):
        return F.sequence(F.floor(F.col(lo) / tile).cast("int"), F.floor(F.col(hi) / tile).cast("int"))

    covered = (
        ann.select("image_id", "x0", "y0", "x1", "y1")
        .withColumn("tx", F.explode(tiles("x0", "x1")))
        .withColumn("ty", F.explode(tiles("y0", "y1")))
    )
    corners = candidates.select(
        "image_id",
        "ann_id",
        F.explode(
            F.array(
                F.struct(F.col("x0").alias("px"), F.col("y0").alias("py")),
                F.struct(F.col("x1").alias("px"), F.col("y1").alias("py")),
            )
        ).alias("c"),
    ).select(
        "image_id",
        "ann_id",
        "c.px",
        "c.py",
        F.floor(F.col("c.px") / tile).cast("int").alias("tx"),
        F.floor(F.col("c.py") / tile).cast("int").alias("ty"),
    )
    hit = corners.alias("c").join(
        covered.alias("a"),
        (F.col("c.image_id") == F.col("a.image_id"))
        & (F.col("c.tx") == F.col("a.tx"))
        & (F.col("c.ty") == F.col("a.ty"))
        & (F.col("a.x0") < F.col("c.px"))
        & (F.col("c.px") < F.col("a.x1"))
        & (F.col("a.y0") < F.col("c.py"))
        & (F.col("c.py") < F.col("a.y1")),
        "left_semi",
    )
    return candidates.join(hit.select("image_id", "ann_id"), ["image_id", "ann_id"], "left_anti")


def crop_path(image_id, ann_id, label):
    return F.format_string("%03d_%d_%d.tiff", image_id, ann_id, label)


def crop_manifest(images: DataFrame, ann: DataFrame) -> DataFrame:
    """Foreground crops (their category) and background crops (category 0) with file names."""
    boxes = square_boxes(ann)
    back = without_touching(background_candidates(boxes, images), ann)
    cols = ["image_id", "ann_id", "category_id", "x0", "y0", "x1", "y1"]
    both = boxes.select(*cols).unionByName(back.withColumn("category_id", F.lit(0)).select(*cols))
    return both.withColumn("path", crop_path(F.col("image_id"), F.col("ann_id"), F.col("category_id")))
