"""Sinks: the partitioned metrics table (A5) and transcript exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_metrics(df: DataFrame, path: str, partitions: Sequence[str] = ("dataset_id",)) -> None:
    """A5 — replace the rows of the datasets present in ``df`` and leave all
    other datasets untouched: Parquet partitioned by ``partitions`` with
    dynamic partition overwrite, set on this write only.  Callers stage to a
    new path when ``df`` reads from ``path`` itself.

    A rebalance by the partition columns comes before the write: small
    datasets end up in one file each, and a dataset larger than the advisory
    partition size is split over several tasks instead of landing in one."""
    (df.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partitions).parquet(path))


def flatten_for_csv(df: DataFrame) -> DataFrame:
    """Nested values (arrays, maps, structs) become JSON strings."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def export_turns(df: DataFrame, fmt: str, path: str) -> None:
    """A8 — write audit turns as JSON Lines or CSV (header, nested values as
    JSON strings).  Cells with line breaks are quoted; read such a CSV back
    with ``multiLine``."""
    if fmt == "jsonl":
        # nulls are written as null (not dropped), so every line has every field
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    elif fmt == "csv":
        flatten_for_csv(df).write.mode("overwrite").option("header", "true").csv(path)
    else:
        raise ValueError("fmt must be 'jsonl' or 'csv'")
