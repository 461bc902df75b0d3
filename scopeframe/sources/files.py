"""Whole files as rows of sources(source_id, code), and back."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """source_id (the file's path) and code of each file below ``path``. strict: a file that isn't UTF-8 is an error."""
    rows = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_id"), "content")
    text = F.col("content").cast("string")
    if strict:
        text = F.when(F.is_valid_utf8(text), text).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("source_id"))))
    else:
        text = F.make_valid_utf8(text)
    return rows.select("source_id", text.alias("code"))


def read_text(spark: SparkSession, argument: str) -> DataFrame:
    """One source: a local file, or standard input for ``-``. Both must be UTF-8."""
    if argument == "-":
        if sys.stdin.isatty():
            print("scopeframe: reading from standard input; end with Ctrl-D", file=sys.stderr)
        code = sys.stdin.buffer.read().decode("utf-8")
    else:
        with open(argument, "rb") as f:
            code = f.read().decode("utf-8")
    return spark.createDataFrame([(argument, code)], "source_id string, code string")


def write_files(df: DataFrame, folder: str, name: str = "source_id", text: str = "output", root: str = "") -> DataFrame:
    """Each row's text as a file of its own, nothing added, by its name's path below ``root``, or without a root by the last part
    of its name. The table of what was written. A null name, and one that isn't below the root, is an error.

    Files are written beside their place and then moved, so a task that is run again leaves no half file. ``folder`` must be
    one that executors share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths, sizes = [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key is None:
                    raise ValueError("a text without a name can't be written")
                inner = key.rstrip("/").rpartition("/")[2]
                if root:
                    inner = key.partition(root.rstrip("/") + "/")[2]
                    if not inner or ".." in inner.split("/"):
                        raise ValueError(f"{key} isn't below {root}")
                path = os.path.join(folder, inner)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write((value or "").encode())
                os.replace(part, path)
                paths.append(path)
                sizes.append(len((value or "").encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths), pa.array(sizes, pa.int64())], ["source_id", "path", "n_bytes"])

    return df.select(F.col(name).cast("string").alias("source_id"), text).mapInArrow(run, "source_id string, path string, n_bytes long")
