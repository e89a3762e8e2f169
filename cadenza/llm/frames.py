"""Small helpers around DataFrames and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_ID = -(1 << 63)


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def extend(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """df with new columns from fn(batch); columns of the same names (in any case) are replaced."""
    new = {f.name.lower() for f in fields}
    have = df.schema.fields
    kept = [i for i, f in enumerate(have) if f.name.lower() not in new]
    names, made = [f.name for f in have], [f.name for f in fields]
    safe = [f"c{i}" for i in range(len(kept) + len(fields))]  # names with dots don't pass through mapInArrow

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(pa.RecordBatch.from_arrays(batch.columns, names))
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [out[n] for n in made], safe)

    types = [have[i].dataType for i in kept] + [f.dataType for f in fields]
    rows = df.toDF(*[f"c{i}" for i in range(len(have))])
    return rows.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in zip(safe, types, strict=True)])).toDF(*[names[i] for i in kept], *made)


def ids(column: pa.Array) -> np.ndarray:
    """Integer ids; null becomes the smallest integer."""
    return np.asarray(pc.fill_null(column.cast(pa.int64()), NO_ID))


def shard_count(df: DataFrame, text: str, each: int = 16 << 20) -> int:
    """How many shards keep each one's share of a text column near `each` bytes at any size (a scan of that one column).

    A shard is built in one task's memory: `each` is what that allows, and the larger it is the fewer files a lookup meets.
    Small inputs have two for each shuffle partition, or 48.
    """
    total = df.agg(F.sum(F.octet_length(col(text)).cast("long"))).first()[0] or 0
    return max(min(48, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-total // each))


def spread(df: DataFrame, *sizes: str, most: int = 64 << 20) -> DataFrame:
    """df, dealt over all cores if the columns named hold at most `most` bytes: a small table may be one row group, and so one task."""
    total = df.agg(F.sum(sum((F.coalesce(F.octet_length(col(c)), F.lit(0)).cast("long") for c in sizes), F.lit(0).cast("long")))).first()[0] or 0
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if total <= most else df


def top_shard(h: np.ndarray, n: int) -> np.ndarray:
    """Shard of each 64-bit hash by its upper half: non-decreasing in the hash."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def every_shard(packed: DataFrame, n: int) -> DataFrame:
    """packed (shard, cells ...) with a row without cells for each of n shards: so every shard is built, if only as empty."""
    return packed.unionByName(packed.sparkSession.range(n).select(F.col("id").cast("int").alias("shard")), allowMissingColumns=True)


def binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def joined(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """All values of packed binary rows, one after another."""
    found = [np.frombuffer(x.as_buffer(), kind) for x in column if x.is_valid]
    return np.concatenate(found) if found else np.zeros(0, kind)


def range_count(df: DataFrame, size: Column, each: int = 32 << 20) -> int:
    """Ranges of about `each` bytes, at least two for each shuffle partition."""
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // each))


def range_bounds(keys: DataFrame, buckets: int, sample: int = 4000) -> list[str]:
    """Bounds that cut the strings of a one-column table to `buckets` ranges, from about `sample` of them, or 20 a range.

    Rows are drawn by a threshold on a hash of the key, so that what reaches the driver follows the ranges, not the rows.
    """
    total = keys.count()
    if not total:
        return []
    sample = max(sample, 20 * buckets)
    key = col(keys.columns[0])
    drawn = sorted(r[0] for r in keys.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 40)) / float(1 << 40) < min(1.0, sample / total)).distinct().collect())
    return sorted({drawn[len(drawn) * i // buckets] for i in range(1, buckets)}) if drawn else []
