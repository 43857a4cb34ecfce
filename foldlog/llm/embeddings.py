"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_runs, written
from .components import connected_components

#: TABLES tables; a bucket is named by HASHES rotations' nearest axes; in each table a vector also stands in the bucket
#: that one rotation's second nearest axis names. A bucket of more than BLOCK rows is compared block by block.
TABLES, HASHES, BLOCK, SEED = 8, 2, 1024, 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def bucket_keys(vectors: np.ndarray) -> np.ndarray:
    """Keys of the buckets of each vector, 1 + HASHES a table: all nearest axes, and one of them replaced by the second."""
    dim = vectors.shape[1]
    wide = 1 << max(1, (dim - 1).bit_length())
    x = np.zeros((len(vectors), wide))
    x[:, :dim] = vectors
    rng, out = np.random.default_rng([SEED, dim]), []
    for t in range(TABLES):
        first, second = [], []
        for _ in range(HASHES):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], wide))
            top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            size = np.take_along_axis(y, top, 1)
            turn = np.abs(size[:, 0]) < np.abs(size[:, 1])
            top[turn], size[turn] = top[turn][:, ::-1], size[turn][:, ::-1]
            axis = 2 * top + (size < 0)
            first.append(axis[:, 0])
            second.append(axis[:, 1])
        for probe in range(HASHES + 1):
            key = np.full(len(x), t + TABLES * dim, np.int64)
            for i in range(HASHES):
                key = key * (2 * wide) + (second if i + 1 == probe else first)[i]
            out.append(key)
    return np.stack(out, axis=1)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _postings(reps: DataFrame) -> DataFrame:
    """key, rep, n, keys, vector: a row of each rep in each of its buckets."""
    kind = reps.schema["vector"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for dim in np.unique(sizes):
                own = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                for lo in range(0, own.num_rows, 512):
                    part = own.slice(lo, 512)
                    v = _vectors(part.column("vector"))
                    keys = bucket_keys(v / np.linalg.norm(v, axis=1, keepdims=True))
                    where = [np.unique(k) for k in keys]
                    rows = pa.array(np.repeat(np.arange(len(v)), [len(w) for w in where]))
                    full = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(where)), *(x.take(rows) for x in (part.column("rep"), part.column("n"), full, part.column("vector")))], names=["key", "rep", "n", "keys", "vector"])

    return reps.mapInArrow(run, f"key long, rep long, n long, keys array<long>, vector {kind}")


def _pairs(v: np.ndarray, group: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with cosine >= least; where there are two groups, of rows of different groups."""
    norm = np.sqrt((v * v).sum(axis=1))
    cross = group[0] != group[-1]
    for lo in range(0, len(v), 256):
        cos = (v[lo : lo + 256] @ v.T) / (norm[lo : lo + 256, None] * norm)
        a, b = np.nonzero(cos >= least)
        a += lo
        keep = (a < b) & ((group[a] != group[b]) if cross else True)
        yield a[keep], b[keep]


def linked(reps: DataFrame, least: float) -> DataFrame:
    """Of reps (rep, n copies, vector): kind 'count' rows (a: rep, b: vectors linked) and kind 'link' rows (a, b) that span them.

    Every pair that shares a bucket is verified in double precision, and counted in the smallest key it shares, so a
    pair that meets in several buckets counts once. No task emits pairs: counts are summed and links are thinned
    to a forest where they are found. A bucket of more than BLOCK rows is dealt in blocks of rows, each pair of blocks
    to a task of its own: exact for any size, in bounded memory.
    """
    posts = _postings(reps)
    large = posts.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    own = F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1))).cast("int")
    others = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("lo"), F.greatest(o, "block").alias("hi"))))
    dealt = posts.join(large, "key", "left").withColumn("block", own).withColumn("pair", F.explode(others)).select(
        F.xxhash64("key", "pair").alias("task"), "key", "block", "rep", "n", "keys", "vector")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, runs in whole_runs(it, "task", 4096):
            count: dict[int, int] = {}
            links: list[tuple[int, int]] = []
            for lo, hi in runs.tolist():
                part = t.slice(lo, hi - lo).combine_chunks()
                col = lambda c, part=part: part.column(c).chunk(0)
                v, keys = _vectors(col("vector")), col("keys").flatten().to_numpy().reshape(hi - lo, -1)
                rep, n, key = (col(c).to_numpy() for c in ("rep", "n", "key"))
                root = np.arange(hi - lo)
                for a, b in _pairs(v, col("block").to_numpy(), least):
                    shared = np.full(len(a), np.iinfo(np.int64).max)
                    for i in range(keys.shape[1]):
                        hit = (keys[b] == keys[a, i][:, None]).any(axis=1)
                        shared = np.where(hit, np.minimum(shared, keys[a, i]), shared)
                    first = shared == key[0]
                    a, b = a[first], b[first]
                    both = np.bincount(a, n[b], hi - lo) + np.bincount(b, n[a], hi - lo)
                    for i in np.flatnonzero(both):
                        count[int(rep[i])] = count.get(int(rep[i]), 0) + int(both[i])
                    while len(a):
                        low = np.minimum(root[a], root[b])
                        np.minimum.at(root, root[a], low)
                        np.minimum.at(root, root[b], low)
                        root = root[root]
                        open_ = root[a] != root[b]
                        a, b = a[open_], b[open_]
                while (root[root] != root).any():
                    root = root[root]
                links += [(int(rep[i]), int(rep[root[i]])) for i in np.flatnonzero(root != np.arange(hi - lo))]
            a = [*count, *(x for x, _ in links)]
            b = [*count.values(), *(y for _, y in links)]
            yield pa.RecordBatch.from_pydict({"kind": pa.array(["count"] * len(count) + ["link"] * len(links), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.repartition("task").sortWithinPartitions("task", "block").mapInArrow(run, "kind string, a long, b long")


def near_duplicate_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """key, n_links (other rows with cosine >= least) and component_id (smallest key reachable) of every row.

    Equal vectors are one rep with their number, so a group of copies of any size costs one row. Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing, nor do rows without key; vectors of
    different lengths don't link. A repeated key counts as rows of their own in n_links.
    """
    v = F.col(vector)
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False)) & F.col(key).isNotNull()
    own = rows.select(key, F.when(fine, v).alias("vector"))
    reps = written(own.where("vector is not null").groupBy("vector").agg(F.min(key).cast("long").alias("rep"), F.count("*").alias("n")), "vectors")
    found = written(linked(reps, least), "vector-links")
    count = found.where("kind = 'count'").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    roots = connected_components(found.where("kind = 'link'").select("a", "b"))
    about = reps.join(count, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select(
        "vector", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    return own.join(about, "vector", "left").select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", key).alias("component_id"))


def op10_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
