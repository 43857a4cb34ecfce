"""What the corpus operators share: table reading and tables written to the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers on this machine find the package where the driver found it
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may go without; it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def byte_slices(it: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about most bytes of a text column; a longer text is a slice of its own."""
    for batch in it:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker gives memory back to the system when a task ends: workers that wait for another stage's tasks stay small."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(it)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return task


def deflated(docs: DataFrame) -> DataFrame:
    """docs with each text (or null) compressed, as bytes, for a shuffle or a table."""
    at = docs.columns.index("text")
    schema = StructType([StructField("text", BinaryType()) if f.name == "text" else f for f in docs.schema.fields])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for part in byte_slices(it, "text"):
            packed = pa.array([pack(t.as_buffer()) if t.is_valid else None for t in part.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if i == at else c for i, c in enumerate(part.columns)], names=part.schema.names)

    return docs.mapInArrow(trimmed(run), schema)


def inflated(it: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Slices of batches, of 512 rows and about 4 MB of texts at most, and the texts of some compressed columns (null: None)."""
    size = lambda t: zstandard.frame_content_size(t.as_buffer()) if t.is_valid else 0
    for batch in it:
        ends = np.cumsum([sum(map(size, row)) for row in zip(*(batch.column(c) for c in columns), strict=True)], dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 22), side="right"))
            part = batch.slice(lo, min(512, max(1, to - lo)))
            unpack = zstandard.ZstdDecompressor().decompress
            yield part, *([unpack(t.as_buffer()) if t.is_valid else None for t in part.column(c)] for c in columns)
            lo += part.num_rows


def inflate(docs: DataFrame) -> DataFrame:
    """The reverse of deflated."""
    at = docs.columns.index("text")
    schema = StructType([StructField("text", StringType()) if f.name == "text" else f for f in docs.schema.fields])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in inflated(it, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()) if i == at else c for i, c in enumerate(part.columns)], names=part.schema.names)

    return docs.mapInArrow(trimmed(run), schema)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a dense number (from 0) in the order of some columns, which must tell all rows apart; no task gets more than a range."""
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))  # one row a range
    starts = sizes.select("_range", (F.sum("_size").over(W.orderBy("_range")) - F.col("_size")).alias("_start"))
    at = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_at", at).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_at")).drop("_range", "_start", "_at")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def whole_runs(it: Iterator[pa.RecordBatch], key: str, rows: int = 50_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of batches that come sorted by key, cut between keys, with the bounds of their runs of two rows or more."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        k = t.column(key).to_numpy()
        end = len(k) if last else int(np.searchsorted(k, k[-1]))
        held[:] = t.slice(end).to_batches()
        at = np.concatenate([[0], np.flatnonzero(np.diff(k[:end])) + 1, [end]])
        more = np.diff(at) > 1
        return t.slice(0, end), np.column_stack([at[:-1][more], at[1:][more]])

    for batch in it:
        if batch.num_rows:
            held.append(batch)
            if sum(b.num_rows for b in held) > rows and held[0].column(key)[0] != batch.column(key)[-1]:
                yield cut(False)
    if held:
        yield cut(True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Words of one length at a time, with their places in words."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, [words[i] for i in at]


def letter_codes(words: list[str]) -> np.ndarray:
    """A row of hashed letters for each of some words of one length, between two marks."""
    n, length = len(words), len(words[0])
    codes = np.empty((n, length + 2), dtype=np.uint64)
    codes[:, 0], codes[:, length + 1] = 2, 3
    codes[:, 1:-1] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, length)
    return mix64(codes)
