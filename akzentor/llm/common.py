"""Shared plumbing: working tables in the cluster's shared folder, table access, Arrow batch sizes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from akzentor.sources.scratch import discard, keep, shared_dir, work_path

__all__ = ["BATCH_ROWS", "discard", "keep", "shared_dir", "slices", "table", "work_path"]

#: Rows that a Python function works on at a time; texts are long, so these are few.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of so many rows, so that what Python holds besides stays small; the
    session's own settings are left alone."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
