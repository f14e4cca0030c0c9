"""Two-pass external shuffle into shards.

Pass 1 scatters the rows over ``ceil(total bytes / bucket_bytes)`` buckets by a
seeded hash of the row and its occurrence number, so buckets are uniform however
many rows are equal, and each fits a task's memory.  Pass 2 takes one bucket at a
time, puts it in a fixed order, applies a Fisher-Yates shuffle seeded by the
bucket's number and emits the rows with their shard and position.

Occurrences are counted within a partition of the input (which of several equal
rows gets which number is all one), and from the second on the partition's number
goes into the hash, too.  So nothing is gathered by row value, a third of all rows
may be equal, and a task that runs again after a lost executor gives the same
rows.  Where no row repeats, the result is a function of the rows and the seed
alone, whatever the partitions.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, unused


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of range(n)."""
    order = list(range(n))
    draw = random.Random(seed).random
    for i in range(n - 1, 0, -1):
        j = int(draw() * (i + 1))
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def _flat(docs: DataFrame, c: str) -> Column:
    """The column in a form that can be hashed and measured."""
    return docs[c].cast("string") if _nested(docs.schema[c].dataType) else docs[c]


def bucket_count(docs: DataFrame, bucket_bytes: int) -> int:
    """Buckets needed for the bytes of all values: text as it is, nested ones as text, 8 for others."""
    size = F.lit(16).cast("bigint")
    for c in docs.columns:
        kind = docs.schema[c].dataType
        wide = _nested(kind) or isinstance(kind, (T.StringType, T.BinaryType))
        size = size + (F.coalesce(F.octet_length(_flat(docs, c)), F.lit(0)) if wide else F.lit(8))
    total = docs.agg(F.sum(size)).first()[0] or 0
    return max(1, -(-int(total) // bucket_bytes))


def occurrences(marks: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """How many equal marks came before each one; ``seen`` holds the counts so far."""
    order = np.argsort(marks, kind="stable")
    ordered = marks[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(starts, len(ordered)))
    base = np.empty(len(starts), np.int64)
    for k, (mark, n) in enumerate(zip(ordered[starts].tolist(), counts.tolist())):
        base[k] = seen.get(mark, 0)
        seen[mark] = int(base[k]) + n
    out = np.empty(len(marks), np.int64)
    out[order] = np.arange(len(marks)) - np.repeat(starts - base, counts)
    return out


def salted(marks: np.ndarray, number: np.ndarray, partition: int, seed: int) -> np.ndarray:
    """Hash of mark, occurrence and, from the second occurrence on, partition."""
    at = np.where(number > 0, number.astype(np.uint64) << np.uint64(24) | np.uint64(partition + 1), np.uint64(0))
    return mix64(mix64(marks.view(np.uint64) + np.uint64(2 * seed + 1)) + at)


def shard(
    docs: DataFrame,
    *,
    seed: int = 42,
    bucket_bytes: int = 64 << 20,
    shard_col: str = "shard",
    position_col: str = "position",
) -> DataFrame:
    """Every row once, with its shard and its position there (both from 0).

    Columns are kept; where one is already called ``shard`` or ``position`` the
    new column gets underscores before its name.  Nulls are hashed as such, no
    column has a special role, and rows equal in all columns are spread like any
    others.  An empty table stays empty.
    """
    shard_col, position_col, mark_col, second_col = unused(docs.columns, shard_col, position_col, "mark", "second")
    n = bucket_count(docs, bucket_bytes)
    flat = [_flat(docs, c) for c in docs.columns]
    marked = docs.withColumns({mark_col: F.xxhash64(*flat, F.lit(seed)), second_col: F.hash(*flat)})

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        partition = TaskContext.get().partitionId()
        for b in batches:
            marks = np.asarray(b.column(mark_at).to_numpy(zero_copy_only=False), np.int64)
            key = salted(marks, occurrences(marks, seen), partition, seed)
            cols = list(b.columns)
            cols[mark_at] = pa.array(key.view(np.int64))
            to = pa.array((key % np.uint64(n)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*cols, to], [*b.schema.names, shard_col])

    mark_at = marked.columns.index(mark_col)
    keyed = marked.mapInArrow(scatter, T.StructType([*marked.schema.fields, T.StructField(shard_col, T.IntegerType())]))

    def mix(bucket: pa.Table) -> pa.Table:
        number = bucket.column(shard_col)[0].as_py()
        fixed = pc.sort_indices(bucket.select([mark_col, second_col]), [(mark_col, "ascending"), (second_col, "ascending")])
        order = fixed.take(pa.array(fisher_yates(len(fixed), seed * 1_000_003 + number)))
        out = bucket.drop_columns([mark_col, second_col]).take(order)
        return out.append_column(position_col, pa.array(np.arange(len(order), dtype=np.int64)))

    schema = keyed.drop(mark_col, second_col).schema.add(position_col, T.LongType())
    # As many partitions as buckets: a task reads about one of them.
    return keyed.repartition(n, shard_col).groupBy(shard_col).applyInArrow(mix, schema)


def write_shards(docs: DataFrame, path: str, *, shard_col: str = "shard", position_col: str = "position", **options) -> DataFrame:
    """Shuffle and write: one folder a shard, rows in shuffled order; what was written.

    The folders are named by the shard's column, which gets underscores before its
    name where the table has one already; so does the position's.  A bucket lies in
    one task, which writes it as one file.  An empty table is written as one.
    """
    shard_col, position_col = unused(docs.columns, shard_col, position_col)
    out = shard(docs, shard_col=shard_col, position_col=position_col, **options)
    out.sortWithinPartitions(shard_col, position_col).write.partitionBy(shard_col).parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path).select(out.columns)
