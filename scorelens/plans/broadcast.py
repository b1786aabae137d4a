"""Broadcast only behind a size check, with a shuffle join beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Row limit under which a derived lookup table is broadcast explicitly.
DEFAULT_MAX_BROADCAST_ROWS = 200_000
DEFAULT_MAX_BROADCAST_BYTES = 32 << 20


def _bytes_of(c: str, kind: T.DataType):
    """About the bytes of a value: text and binary by length, nested values by their JSON text, others 8."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return F.lit(8)


def checked_broadcast(small: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Return ``broadcast(small)`` when it has at most ``max_rows`` rows and ``max_bytes`` bytes.

    ``small`` (an aggregate) is stored, so that it is computed once, measured from
    the files and read again by the join; nothing stays in executor storage.
    Beyond the limits the plain DataFrame is returned and Catalyst/AQE plan a
    shuffle join instead.
    """
    small = materialize(small)
    width = sum((_bytes_of(f.name, f.dataType) for f in small.schema.fields), F.lit(0))
    row = small.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return F.broadcast(small) if row["n"] <= max_rows and row["bytes"] <= max_bytes else small


def bounded_broadcast(small: DataFrame, bound: int, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast a table whose row count is bounded by construction (``bound``)."""
    return F.broadcast(small) if bound <= max_rows else small


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage of a reused table: written as Parquet under the shared
    spark.checkpoint.dir, so it survives executor loss and later reads prune columns."""
    from scorelens.session import scratch_path

    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
