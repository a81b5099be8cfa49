"""Plain TIFF planes as a Spark source: binary files to rows of pixels, and stacks to their largest values."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellforge.operators.tables import parse_names

#: Fixed values of the format: field types by size in bytes, and the tags that are read.
SIZES = {1: 1, 3: 2, 4: 4}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, ROWS, COUNTS, SAMPLE_FORMAT = 256, 257, 258, 259, 273, 278, 279, 339


def decode(content: bytes) -> list[np.ndarray]:
    """The pages of an uncompressed grey TIFF of 8, 16 or 32 bits in either byte order; anything else raises ValueError."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(content[:2]))
    if order is None or struct.unpack(order + "H", content[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at, pages = struct.unpack(order + "I", content[4:8])[0], []
    while at:
        (n,) = struct.unpack(order + "H", content[at : at + 2])
        tags = {}
        for k in range(n):
            entry = content[at + 2 + 12 * k : at + 14 + 12 * k]
            tag, kind, count = struct.unpack(order + "HHI", entry[:8])
            if kind in SIZES:
                size = SIZES[kind] * count
                raw = entry[8 : 8 + size] if size <= 4 else content[(p := struct.unpack(order + "I", entry[8:])[0]) : p + size]
                tags[tag] = struct.unpack(order + {1: "B", 3: "H", 4: "I"}[kind] * count, raw)
        if tags.get(COMPRESSION, (1,))[0] != 1 or len(tags.get(BITS, (1,))) != 1:
            raise ValueError("compressed or coloured TIFF")
        h, w, bits = tags[HEIGHT][0], tags[WIDTH][0], tags[BITS][0]
        kind = "f" if tags.get(SAMPLE_FORMAT, (1,))[0] == 3 else "u"
        data = b"".join(content[o : o + c] for o, c in zip(tags[OFFSETS], tags[COUNTS]))
        pages.append(np.frombuffer(data, np.dtype(f"{order}{kind}{bits // 8}"), h * w).reshape(h, w))
        (at,) = struct.unpack(order + "I", content[at + 2 + 12 * n : at + 6 + 12 * n])
    return pages


def encode(pages: list[np.ndarray], order: str = "<") -> bytes:
    """An uncompressed grey TIFF of the pages, one strip each."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8))
    for k, page in enumerate(pages):
        bits, body = page.dtype.itemsize * 8, page.astype(page.dtype.newbyteorder(order)).tobytes()
        kind = 3 if page.dtype.kind == "f" else 1
        start = len(out) + 2 + 12 * 8 + 4
        fields = [(WIDTH, page.shape[1]), (HEIGHT, page.shape[0]), (BITS, bits), (COMPRESSION, 1), (OFFSETS, start), (ROWS, page.shape[0]), (COUNTS, len(body)), (SAMPLE_FORMAT, kind)]
        out += struct.pack(order + "H", len(fields))
        for tag, value in fields:
            out += struct.pack(order + "HHII", tag, 4, 1, value)
        following = start + len(body) + (start + len(body)) % 2
        out += struct.pack(order + "I", following if k < len(pages) - 1 else 0) + body
        out += b"\0" * (len(out) % 2)
    return bytes(out)


def read_planes(spark: SparkSession, path: str, glob: str = "*.tif*") -> DataFrame:
    """(file_path, filename, page, height, width, px): one row per page of every file below `path`; px is row-major.

    Files are decoded where they are read. A file that cannot be decoded has one row with a null px.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return decoded(files.select("path", "content"))


def decoded(files: DataFrame) -> DataFrame:
    """The planes of files that are already in a table (path, content), as `read_planes` gives them; nulls cannot be decoded."""

    def planes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                try:
                    pages = decode(content if content is not None else b"")
                except (ValueError, KeyError, struct.error):
                    yield pd.DataFrame({"file_path": [name], "page": [None], "height": [None], "width": [None], "px": [None]})
                    continue
                for k, page in enumerate(pages):
                    yield pd.DataFrame({"file_path": [name], "page": [k], "height": [page.shape[0]], "width": [page.shape[1]], "px": [page.ravel().astype(float)]})

    rows = files.select("path", "content").mapInPandas(planes, "file_path string, page int, height int, width int, px array<double>")
    return rows.withColumn("filename", F.element_at(F.split("file_path", "/"), -1))


def encoded(images: DataFrame, width: int) -> DataFrame:
    """(path, content): each image (path, px) as a TIFF of one plane of 32-bit floats."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "content": [encode([np.asarray(x, np.float32).reshape(-1, width)]) for x in b["px"]]})

    return images.select("path", "px").mapInPandas(write, "path string, content binary")


def projected(planes: DataFrame, by: list[str]) -> DataFrame:
    """Largest pixel over the planes of each group: (by.., height, width, px). Planes of unlike shape raise on execution.

    Pixels are folded element-wise; planes are exploded by position, so a stack of any depth is aggregated in parts.
    """
    shape = planes.groupBy(*by).agg(F.max("height").alias("height"), F.max("width").alias("width"), F.assert_true((F.min("height") == F.max("height")) & (F.min("width") == F.max("width")), "planes of unlike shape").alias("_ok"))
    pixels = planes.select(*by, F.posexplode("px").alias("k", "v")).groupBy(*by, "k").agg(F.max("v").alias("v"))
    stacked = pixels.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("px"))
    return stacked.join(shape, by).filter(F.col("_ok").isNull()).drop("_ok")


def image_table(spark: SparkSession, path: str, pattern: str, groups: dict[str, int]) -> DataFrame:
    """Planes with the fields of their names: what a listing of an image folder gives."""
    return parse_names(read_planes(spark, path), pattern, groups)
