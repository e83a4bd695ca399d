"""Content-addressed blobs: written by digest, verified when read."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def put(values: DataFrame, root: str, column: str = "content") -> DataFrame:
    """Store the bytes of ``column`` below ``root``; digest and size_bytes of each.

    A blob's place is its digest, and it is renamed into it when complete, so
    repeated and retried writes are harmless.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            rows = []
            for data in batch.column(0).to_pylist():
                digest = hashlib.sha256(data).hexdigest()
                folder = f"{base}/{digest[:2]}"
                target = f"{folder}/{digest[2:]}"
                if store.get_file_info(target).type == fs.FileType.NotFound:
                    store.create_dir(folder, recursive=True)
                    part = f"{folder}/.{uuid.uuid4().hex}"
                    with store.open_output_stream(part) as f:
                        f.write(data)
                    store.move(part, target)
                rows.append((digest, len(data)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["digest", "size_bytes"])

    return values.select(F.col(column).cast("binary")).filter(F.col(column).isNotNull()).mapInArrow(run, "digest string, size_bytes long")


def get(spark: SparkSession, root: str) -> DataFrame:
    """digest, size_bytes, content, intact of every blob; intact tells whether the bytes have their digest."""
    blobs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    digest = F.regexp_replace(F.regexp_extract("path", "([0-9a-f]{2}/[0-9a-f]{62})$", 1), "/", "")
    return blobs.filter(digest != "").select(digest.alias("digest"), F.col("length").alias("size_bytes"), "content", (F.sha2("content", 256) == digest).alias("intact"))
