"""Shuffles of packed NumPy columns.

A row of Spark's is (bucket, kind, blob): the records that one task has for one bucket, packed column by
column. Buckets are a hash of the records' key, so they are even once each task has merged its own repeats
of a key; rows and (de)serialisation cost per blob and not per record.
"""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "bucket int, kind int, blob binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


#: Bytes of a table, as Spark estimates them, that one bucket gets at most.
BUCKET_BYTES = 16 << 20


def buckets(spark: SparkSession, docs: DataFrame | None = None) -> int:
    """As many as the session shuffles into, or more where the table that is dealt out asks for it."""
    least = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if docs is None:
        return least
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, size // BUCKET_BYTES) if size < 1 << 50 else least  # Spark tells a huge number where it doesn't know


def shared(spark: SparkSession) -> None:
    """Checkpoints go to the folder in spark.checkpoint.dir. Where that is unset: to the warehouse's, or, on one machine, to one made here."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        alone = sc.master.split("[")[0] == "local"
        own = os.path.join(tempfile.gettempdir(), "kinfold-checkpoints") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/kinfold-checkpoints"
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint: what comes later neither computes it again nor needs the executor that made it."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def place(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    shared(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"


def deleted(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    path = place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def pack(columns) -> bytes:
    return zstandard.compress(pickle.dumps(columns, protocol=5), 1)


def unpack(blob: bytes):
    return pickle.loads(zstandard.decompress(blob))


def split(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, columns) for each bucket; a record keeps its place among those of its bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cuts = np.flatnonzero(np.diff(sorted_)) + 1
    for part in np.split(order, cuts):
        yield int(bucket[part[0]]), tuple(c[part] for c in columns)


def rows(found: Iterable[tuple[int, int, bytes]], per_batch: int = 64) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int, bytes]] = []
    size = 0
    for row in found:
        out.append(row)
        size += len(row[2])
        if len(out) >= per_batch or size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


#: The kind of a row that holds several: all that a task has for a bucket.
MANY = -1


def table(found: Iterable[tuple[int, int, bytes]]) -> pa.Table:
    """One row a bucket, so that rows grow with tasks times buckets, whatever kinds there are."""
    own: dict[int, list] = {}
    for bucket, kind, blob in found:
        own.setdefault(bucket, []).append((kind, blob))
    return pa.Table.from_batches(list(rows((b, MANY, pickle.dumps(x, protocol=5)) for b, x in own.items())), schema=_ARROW)


def _unpacked(group: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    for bucket, kind, blob in zip(group.column("bucket").to_pylist(), group.column("kind").to_pylist(), group.column("blob"), strict=True):
        if kind == MANY:
            for k, b in pickle.loads(blob.as_buffer()):
                yield bucket, k, b
        else:
            yield bucket, kind, blob.as_buffer()


def each(group: pa.Table, kind: int) -> Iterator:
    """What a bucket holds of a kind, one blob after another."""
    return (unpack(b) for _, k, b in _unpacked(group) if k == kind)


def blobs(group: pa.Table, kind: int) -> list:
    return list(each(group, kind))


def passed(group: pa.Table, *kinds: int) -> list[tuple[int, int, bytes]]:
    """Rows that go on as they are."""
    return [(b, k, bytes(x)) for b, k, x in _unpacked(group) if k in kinds]


def columns(parts: list[tuple], types: list) -> list[np.ndarray]:
    """Blobs' columns end to end; types: of columns that no blob has."""
    if not parts:
        return [np.zeros(0, t) for t in types]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def by_bucket(df: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str = SCHEMA) -> DataFrame:
    return df.groupBy("bucket").applyInArrow(work, schema)


def with_bucket(left: DataFrame, right: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str = SCHEMA) -> DataFrame:
    return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(work, schema)
