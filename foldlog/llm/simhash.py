"""SimHash near-duplicates: fingerprints, a byte-position inverted index with count filtering, verified links, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, mix64, table, trimmed, whole_runs, written
from .components import connected_components
from .shingles import similar_sets, texts_of, verified

SEED = 42
#: Postings that a list of the index may have to be scanned by one task; a longer one is dealt again.
LONG_LIST = 2048


def shingle_hashes(text: str | bytes | None, size: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; of all words if they are fewer; none without words."""
    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return np.array([digest(view[a:b], SEED) for a, b in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def majority_bits(h: np.ndarray) -> int:
    """The bits that are set in over half of h; 0 of none."""
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[lo : lo + (1 << 15)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """docs without its text, with fp (_fp where docs has such a column): 8 bytes of each whole text. Null and empty texts: zeros."""
    keep, name = [c for c in docs.columns if c != "text"], free_name(docs, "fp")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", {name} binary"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = pa.array([majority_bits(shingle_hashes(t.as_py(), shingle)).to_bytes(8, "big") for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), fps], names=[*keep, name])

    return docs.mapInArrow(trimmed(run), schema)


def byte_triples() -> list[tuple[int, ...]]:
    """Twenty choices of three of eight places, one of which lies within any four places.

    The places stand in three groups in a circle. Of four places either three are in one group, or two are in one and a third
    in the next: those are the choices.
    """
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    inside = [g for g in groups if len(g) == 3]
    return inside + [(*pair, p) for i, g in enumerate(groups) for pair in combinations(g, 2) for p in groups[(i + 1) % 3]]


def _postings(raw: np.ndarray, places: list[tuple[int, ...]], above: np.ndarray | None = None) -> np.ndarray:
    """A key for each row of raw and choice of places: the list above, the choice, and what raw has there."""
    out = np.empty((len(raw), len(places)), np.uint64)
    for j, choice in enumerate(places):
        k = np.full(len(raw), j, np.uint64)
        for p in choice:
            k = (k << np.uint64(8)) | raw[:, p]
        out[:, j] = mix64(k if above is None else above ^ mix64(k))
    return out


def _bytes_of(fps: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(len(fps), 8).astype(np.uint64)


def _index(rows: DataFrame, level: int) -> DataFrame:
    """Postings (key, used, rep, fp) of the index's lists; used has a bit for each byte that all in the list share.

    Level 0: rows are fingerprints, lists hold those that share a choice of three positional bytes. Level 1: rows are postings
    of a long list, dealt by each further byte. Level 2: dealt by each choice of four of the eight half bytes that are left.
    """
    triples, halves = byte_triples(), list(combinations(range(8), 4))
    masks = np.array([sum(1 << p for p in t) for t in triples], np.int32)

    def dealt(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        raw = _bytes_of(part.column("fp"))
        if level == 0:
            return _postings(raw, triples), np.tile(masks, len(raw))
        above, used = part.column("key").to_numpy().view(np.uint64), part.column("used").to_numpy()
        free = np.argsort((used[:, None] >> np.arange(8)) & 1, axis=1, kind="stable")[:, : 5 if level == 1 else 4]
        left = np.take_along_axis(raw, free, axis=1)
        if level == 1:
            return _postings(left, [(i,) for i in range(5)], above), (used[:, None] | (1 << free)).astype(np.int32).ravel()
        nibbles = np.concatenate([left >> np.uint64(4), left & np.uint64(15)], axis=1)
        return _postings(nibbles, halves, above), np.repeat(used, len(halves))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                keys, used = dealt(part)
                at = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(used, pa.int32()), part.column("rep").take(at), part.column("fp").take(at)],
                    names=["key", "used", "rep", "fp"])

    return rows.mapInArrow(trimmed(run), "key long, used int, rep long, fp binary")


def _spanning_links(words: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Links that join what most differing bits join, one for each fingerprint that is reached.

    A fingerprint that has been reached is compared no more, so a dense list costs little more than its length. Shared positional
    bytes are tallied for each pair, and bits are compared of those alone that share as many as most differing bits leave.
    """
    raw = words.view(np.uint8).reshape(len(words), 8)
    left = np.arange(len(words))
    while len(left) > 1:
        wave, left = [left[0]], left[1:]
        while wave and len(left):
            a = wave.pop()
            shared = left[(raw[left] == raw[a]).sum(axis=1) >= 8 - most]
            near = shared[np.bitwise_count(words[shared] ^ words[a]) <= most]
            if len(near):
                yield from ((int(a), int(b)) for b in near)
                wave.extend(near.tolist())
                left = left[~np.isin(left, near, assume_unique=True)]


def _scanned(postings: DataFrame, most: int) -> DataFrame:
    """Links (a, b) of the lists, each scanned by its task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, runs in whole_runs(it, "key"):
            rep, a, b = t.column("rep").to_numpy(), [], []
            for lo, hi in runs.tolist():
                words = np.frombuffer(b"".join(t.column("fp").slice(lo, hi - lo).to_pylist()), np.uint64)
                for x, y in _spanning_links(words, most):
                    a.append(rep[lo + x])
                    b.append(rep[lo + y])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return postings.select("key", "rep", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(run), "a long, b long")


def near_links(fps: DataFrame, most: int = 4, long: int = LONG_LIST) -> DataFrame:
    """Links (a, b) between reps that have the components of all pairs within most differing bits (4 at most).

    fps: rep and fp (8 bytes), each fp once. A pair within 4 bits shares 4 bytes or more in place, so it meets in one of
    the 20 lists of three such bytes each; there the bytes it shares are tallied, and what shares enough is verified. A list of more
    than long postings isn't scanned but dealt by each further byte (the pair shares one), and if that is long again, by four of the
    half bytes left (the pair shares four): such a list has 65,536 fingerprints at most, as 16 bits are open. A scan gives a
    spanning forest of its list, never all its pairs.
    """
    if not 0 <= most <= 4:
        raise ValueError("the index is exact up to 4 differing bits")
    rows, parts = fps.select("rep", "fp"), []
    for level in range(3):
        postings = _index(rows, level)
        if level == 2:
            parts.append(_scanned(postings, most))
            break
        crowded = written(postings.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > long).select("key"), "simhash-crowded")
        if crowded.isEmpty():
            parts.append(_scanned(postings, most))
            break
        parts.append(_scanned(postings.join(crowded, "key", "left_anti"), most))
        rows = postings.join(crowded, "key", "left_semi")
    return reduce(DataFrame.unionByName, parts).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", shingle: int = 4, most: int = 4) -> DataFrame:
    """docs' columns but the text, with fp and component (smallest key reachable) of each document.

    Equal fingerprints are one rep (the smallest key) before the index sees them, whatever their number. Null keys get
    a fingerprint, but no component unless a document with a key has the same. Without words the fingerprint is
    zero and links like any other. An empty table gives an empty result. Where docs has columns named fp or component, the results'
    names begin with _.
    """
    fp, name = free_name(docs, "fp"), free_name(docs, "component")
    own = written(fingerprints(docs, shingle), "simhash")
    reps = written(own.groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("rep")).where("rep is not null"), "simhash-reps")
    roots = connected_components(near_links(reps, most))
    by_fp = reps.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias(fp), F.coalesce("root", "rep").alias(name))
    return own.join(by_fp, fp, "left")


def firsts_by_fingerprint(docs: DataFrame, key: str, size: int = 5, most: int = 4) -> DataFrame:
    """The key, smallest of its group, of each group of documents whose fingerprints are linked; key may have any type that has an order.

    Fingerprints and links are those of near_duplicates. A link between different fingerprints counts only after the whole sets of size-word
    shingles are compared, so that unlike texts of near fingerprints stay. Equal keys must have equal texts.
    """
    own = written(fingerprints(docs.select(F.col(key).alias("key"), "text")).withColumn("node", F.conv(F.hex("fp"), 16, -10).cast("long")), "simhash")
    reps = written(own.groupBy("fp", F.col("node").alias("rep")).agg(F.min("key").alias("least")), "simhash-reps")
    links = written(near_links(reps, most), "links")
    texts = texts_of(links, own, docs.select(F.col(key).alias("key"), "text"), "key")
    roots = connected_components(verified(links, texts, size).where("ok").select("a", "b"))
    return reps.join(roots, F.col("rep") == F.col("node"), "left").groupBy(F.coalesce("root", "rep").alias("group")).agg(F.min("least").alias(key)).select(key)


def similar_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Components of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    Fingerprints can only estimate that, so the sets themselves are indexed and compared; no such pair is missed.
    """
    return similar_sets(docs, key, 5)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document; rows without doc_id as near_duplicates says."""
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
