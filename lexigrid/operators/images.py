"""Character images: selection, rename plans, compositing on white."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_suffix, join_path, stem_and_extension


def select_images(names: DataFrame, name_col: str = "name", suffix: str = ".png") -> DataFrame:
    return names.where(has_suffix(F.col(name_col), suffix))


def rename_plan(names: DataFrame, folder: str, name_col: str = "name", prefix: str = "digit", suffix: str = ".png") -> DataFrame:
    """(name, target, old_path, new_path, collides): a new name for each name with the suffix. It collides if another one has the same
    target, or if the target is there now: files are renamed in no order, so even one that is renamed away may be written over. Renaming
    twice prefixes twice."""
    stem, extension = stem_and_extension(F.col(name_col))
    plan = select_images(names, name_col, suffix).select(F.col(name_col).alias("name"), F.concat(F.lit(prefix), stem, extension).alias("target"))
    present = names.select(F.col(name_col).alias("target")).distinct().withColumn("there", F.lit(True))
    often = plan.groupBy("target").agg((F.count("*") > 1).alias("twice"))
    joined = plan.join(often, "target").join(present, "target", "left")
    return joined.select("name", "target", join_path(folder, F.col("name")).alias("old_path"), join_path(folder, F.col("target")).alias("new_path"), (F.col("twice") | F.coalesce("there", F.lit(False))).alias("collides"))


def on_white(channel: Column, alpha: Column) -> Column:
    """c * a / 255 + 255 * (1 - a / 255), rounded half to even and held in 0..255."""
    share = alpha.cast("double") / F.lit(255.0)
    mixed = channel.cast("double") * share + F.lit(255.0) * (F.lit(1.0) - share)
    return F.greatest(F.lit(0), F.least(F.lit(255), F.bround(mixed, 0).cast("int")))


def composite_pixels(pixels: DataFrame) -> DataFrame:
    """Pixel rows (b, g, r, a and any keys): the three channels on white, without a."""
    return pixels.select(*[F.col(c) for c in pixels.columns if c not in tuple("bgra")], *[on_white(F.col(c), F.col("a")).alias(c) for c in "bgr"])


def flatten_alpha(data: np.ndarray) -> np.ndarray:
    """Whole images: (pixels, 4) of bytes to (pixels, 3)."""
    share = data[:, 3:].astype("f8") / 255.0
    return np.clip(np.rint(data[:, :3] * share + 255.0 * (1.0 - share)), 0, 255).astype("u1")


def composite_images(images: DataFrame) -> DataFrame:
    """Rows of Spark's image source: those with four channels put on white, others unchanged. Rows that could not be decoded (nChannels
    -1) go through as they are; unreadable() gives them."""

    def composite(images: pa.Array) -> pa.Array:
        out = []
        for x in images.to_pylist():
            if x is not None and x["nChannels"] == 4:
                x = x | {"nChannels": 3, "mode": 16, "data": flatten_alpha(np.frombuffer(x["data"], "u1").reshape(-1, 4)).tobytes()}
            out.append(x)
        return pa.array(out, images.type)

    kind = images.schema["image"].dataType
    return images.withColumn("image", F.arrow_udf(composite, kind)("image"))


def unreadable(images: DataFrame) -> DataFrame:
    return images.where(F.col("image.nChannels") == -1)
