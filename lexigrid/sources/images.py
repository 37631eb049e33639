"""Image folders and files."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_images(spark: SparkSession, folder: str, suffix: str = ".png") -> DataFrame:
    """(path, name, length) of the files in a folder, not below it; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Spark's image source: bytes in the order blue, green, red, alpha. A file that cannot be decoded has -1 everywhere."""
    return spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", "*.png").load(folder)


def png(height: int, width: int, channels: int, data: bytes) -> bytes:
    """A PNG file from bytes in the order of Spark's image source; channels: 1 grey, 3 or 4."""
    pixels = np.frombuffer(data, "u1").reshape(height, width, channels)
    if channels > 1:
        pixels = pixels[:, :, [2, 1, 0, 3][:channels]]
    lines = np.concatenate([np.zeros((height, 1), "u1"), pixels.reshape(height, width * channels)], 1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def write_images(images: DataFrame, folder: str, name_col: str = "name") -> DataFrame:
    """Write image rows (name and the image struct) as PNG files; overwrites files of the same name. Returns (name, written), which has
    to be consumed; images that are null or could not be decoded (nChannels -1), and rows without a name, are not written. A file is
    written under another name and then renamed, so a task that is run again leaves whole files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri("/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            done = []
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                done.append(name is not None and x is not None and (x["nChannels"] or 0) > 0)
                if not done[-1]:
                    continue
                new = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(new) as f:
                    f.write(png(x["height"], x["width"], x["nChannels"], x["data"]))
                store.move(new, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.bool_())], names=["name", "written"])

    return images.select(F.col(name_col).alias("name"), "image").mapInArrow(write, "name string, written boolean")


def apply_renames(plan: DataFrame) -> int:
    """Carry out a rename plan on a file system of this machine, one row at a time as it comes; refuses if any row collides."""
    if plan.where("collides").limit(1).count():
        raise ValueError("the plan has names that collide")
    n = 0
    for row in plan.select("old_path", "new_path").toLocalIterator():
        os.replace(row["old_path"], row["new_path"])
        n += 1
    return n
