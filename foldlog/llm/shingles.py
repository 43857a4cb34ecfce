"""Near-duplicates by the Jaccard similarity of shingle sets: prefix-filtered lists, links verified on whole sets, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import byte_slices, deflated, inflated, trimmed, whole_runs, written
from .components import connected_components

#: Sets are similar at a Jaccard similarity of NUM / DEN or more.
NUM, DEN = 4, 5
#: The sample that tells common shingles from rare ones: SAMPLE_SETS sets, but no less than one of SAMPLE_STEP, so that the lists of those
#: that pass for rare don't grow with the corpus. It sets the order of shingles, never the result.
SAMPLE_SETS, SAMPLE_STEP, COMMON, COMMON_MOST = 20_000, 10, 3, 1_000_000
#: Lists up to this length give all their pairs at once; longer ones a spanning forest first.
SHORT, PARITY_BITS, SEED = 8, 512, 42


def _sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """The node (a hash of the set) and the sorted shingles of each text."""
    from .simhash import shingle_hashes

    for t in texts:
        s = np.unique(shingle_hashes(t.as_py(), size))
        yield xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63), s


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """docs without its text, with node (a hash of the set of shingles), and the set's n, parity and wide.

    parity has a bit for each of PARITY_BITS classes of shingles, set where the class has an odd number of them. Sets of more
    shingles, whose parities are as good as random, have as many classes as shingles or up to twice as many in wide; it is null for others.
    """
    keep = [c for c in docs.columns if c != "text"]
    schema = StructType([docs.schema[c] for c in keep]).add("node", "long").add("n", "integer").add("parity", "binary").add("wide", "binary")

    def odd(s: np.ndarray, classes: int) -> bytes:
        return np.packbits((np.bincount((s % np.uint64(classes)).astype(np.int64), minlength=classes) & 1).astype(np.uint8)).tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(it, "text"):
            rows = []
            for node, s in _sets(batch.column("text"), size):
                rows.append((node, len(s), odd(s, PARITY_BITS), odd(s, 1 << (len(s) - 1).bit_length()) if len(s) > PARITY_BITS else None))
            types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True))], names=[*keep, "node", "n", "parity", "wide"])

    return docs.mapInArrow(trimmed(run), schema)


def _common(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample of the texts, sorted, and the rank of each by its count (from 1)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(it, "text"):
            flat = np.concatenate([s for _, s in _sets(batch.column("text"), size)])
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], names=["token"])

    step = min(max(1, docs.count() // SAMPLE_SETS), SAMPLE_STEP)
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).dropDuplicates()
    counts = some.mapInArrow(trimmed(run), "token long").groupBy("token").count()
    # at most COMMON_MOST rows
    rows = counts.where(F.col("count") >= COMMON).orderBy(F.desc("count"), "token").limit(COMMON_MOST).toArrow()
    tokens = rows.column("token").to_numpy().view(np.uint64)
    by = np.argsort(tokens)
    return tokens[by], (len(tokens) - np.arange(len(tokens)))[by]


def _postings(docs: DataFrame, size: int) -> DataFrame:
    """A row (token, node, n, rest) of each shingle in each set's prefix; rest: how many shingles stand from it on.

    Shingles stand in one order for all sets, rare ones first. Sets of n shingles that are similar to another share at
    least ceil(n * NUM / DEN) with it, so two similar sets share one of the n - that + 1 first of each. A task lists a set once.
    """
    hot, rank = _common(docs, size)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for part in byte_slices(it, "text"):
            nodes, sets = [], []
            for node, s in _sets(part.column("text"), size):
                if len(s) and (mark := hash((node, len(s), int(s[0])))) not in met:  # a number, small beside the three
                    met.add(mark)
                    nodes.append(node)
                    sets.append(s)
            if not sets:
                continue
            flat, n = np.concatenate(sets), np.array([len(s) for s in sets])
            row = np.repeat(np.arange(len(n)), n)
            late = np.zeros(len(flat), np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, flat), len(hot) - 1)
                late = np.where(hot[at] == flat, rank[at], 0)
            order = np.argsort(row * (COMMON_MOST + 1) + late, kind="stable")
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            first = place < np.repeat(n - (NUM * n + DEN - 1) // DEN + 1, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[order[first]].view(np.int64)), pa.array(np.array(nodes, np.int64)[row[first]]), pa.array(n[row[first]].astype(np.int32)), pa.array((n[row] - place)[first].astype(np.int32))],
                names=["token", "node", "n", "rest"])

    return docs.select("text").mapInArrow(trimmed(run), "token long, node long, n int, rest int")


def _shared(postings: DataFrame) -> DataFrame:
    """Postings of tokens that stand in two sets or more, each set once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in whole_runs(it, "token"):
            token, node = t.column("token").to_numpy(), t.column("node").to_numpy()
            if not len(token):
                continue
            at = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])]))
            _, which, times = np.unique(token[at], return_inverse=True, return_counts=True)
            yield from t.take(pa.array(at[times[which] > 1])).to_batches()

    return _in_lists(postings).mapInArrow(trimmed(run), postings.schema)


def _in_lists(rows: DataFrame) -> DataFrame:
    return rows.repartition("token").sortWithinPartitions("token", "node")


def _may_be_similar(x: np.ndarray, y: np.ndarray, n: np.ndarray, rest: np.ndarray, words: np.ndarray) -> np.ndarray:
    """False only where sets x and y, whose first common shingle is this list's, can't be similar.

    Similar sets share NUM / (NUM + DEN) of the sum of their sizes, and differ in the rest; the bits in which parities
    differ are a lower bound of that.
    """
    total = n[x] + n[y]
    ok = (DEN * np.minimum(n[x], n[y]) >= NUM * np.maximum(n[x], n[y])) & ((NUM + DEN) * np.minimum(rest[x], rest[y]) >= NUM * total)
    at = np.flatnonzero(ok)
    xs, ys = (v if np.ndim(v) == 0 else v[at] for v in (x, y))
    differ = np.bitwise_count(words[xs] ^ words[ys]).sum(axis=-1, dtype=np.int64)
    ok[at] = (NUM + DEN) * differ <= (DEN - NUM) * total[at]
    return ok


def _forest(lo: int, hi: int, *columns: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Candidate links of the list lo..hi that join what all its candidate links join."""
    left = np.arange(lo, hi)
    while len(left) > 1:
        wave, left = [left[0]], left[1:]
        while wave and len(left):
            a = wave.pop()
            near = _may_be_similar(a, left, *columns)
            if near.any():
                yield int(a), left[near]
                wave.extend(left[near].tolist())
                left = left[~near]


def _across(lo: int, hi: int, root: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """All candidate links of the list lo..hi between different roots."""
    _, which, times = np.unique(root[lo:hi], return_inverse=True, return_counts=True)
    largest = which == np.argmax(times)
    at = np.arange(lo, hi)
    for i in np.flatnonzero(~largest).tolist():
        others = at[(which != which[i]) & (largest | (at > lo + i))]
        near = _may_be_similar(lo + i, others, *columns)
        if near.any():
            yield lo + i, others[near]


def _candidates(lists: DataFrame, parities: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Candidate pairs (a < b, each once): of short lists all, of long lists a forest, or, with roots, all between roots."""
    rows, again = lists.join(parities, "node"), roots is not None
    if again:
        rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, runs in whole_runs(it, "token"):
            if not len(runs):
                continue
            node = t.column("node").to_numpy()
            n, rest = (t.column(c).to_numpy().astype(np.int64) for c in ("n", "rest"))
            words = np.frombuffer(b"".join(t.column("parity").to_pylist()), np.uint64).reshape(len(node), -1)
            xs, ys = [], []
            long = runs[:, 1] - runs[:, 0] > SHORT
            if not again:
                end = np.zeros(len(node), np.int64)
                for lo, hi in runs[~long].tolist():
                    end[lo:hi] = hi
                for d in range(1, SHORT):
                    x = np.flatnonzero(np.arange(len(node)) + d < end)
                    x = x[_may_be_similar(x, x + d, n, rest, words)]
                    xs.append(x)
                    ys.append(x + d)
            root = t.column("root").to_numpy() if again else None
            for lo, hi in runs[long].tolist():
                for a, b in _forest(lo, hi, n, rest, words) if root is None else _across(lo, hi, root, n, rest, words):
                    xs.append(np.full(len(b), a))
                    ys.append(b)
            if xs:
                a, b = node[np.concatenate(xs)], node[np.concatenate(ys)]
                pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return _in_lists(rows).mapInArrow(trimmed(run), "a long, b long").distinct()


def _screened(pairs: DataFrame, own: DataFrame, key: str) -> DataFrame:
    """pairs, with may: false only where the wide parities of both sets differ in more classes than similar sets of their sizes can.

    Of sets with one node that of the smallest key counts, as in texts_of. Parities of unlike width are folded to the smaller.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = own.join(nodes, "node").groupBy("node").agg(F.min_by(F.struct("n", "wide"), key).alias("s")).where("s.wide is not null").select("node", "s.n", "s.wide")
    both = pairs.join(sets.toDF("b", "nb", "wb"), "b", "left").join(sets.toDF("a", "na", "wa"), "a", "left")

    def may(n: int, x: bytes, y: bytes) -> bool:
        u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if len(u) < len(v):
            u, v = v, u
        while len(u) > len(v):
            u = u[: len(u) // 2] ^ u[len(u) // 2 :]
        return (NUM + DEN) * int(np.bitwise_count(u ^ v).sum(dtype=np.int64)) <= (DEN - NUM) * n

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            columns = (batch.column(c) for c in ("na", "nb", "wa", "wb"))
            ok = [not (x.is_valid and y.is_valid) or may(m.as_py() + n.as_py(), x.as_py(), y.as_py()) for m, n, x, y in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "may"])

    return both.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(trimmed(run), "a long, b long, may boolean")


def texts_of(pairs: DataFrame, own: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """node and its text, compressed, of each node of pairs."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = own.join(nodes, "node").groupBy("node").agg(F.min(key).alias(key))
    found = deflated(docs.select(key, "text")).join(one, key).dropDuplicates(["node"])
    return written(found.select("node", "text"), "texts-of-pairs")


def verified(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """pairs, with ok: whether the Jaccard similarity of the two whole sets reaches the threshold."""
    from .simhash import shingle_hashes

    both = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a").sortWithinPartitions("a")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, np.zeros(0, np.uint64)
        for batch, left, right in inflated(it, "ta", "tb"):
            ok = []
            for a, p, q in zip(batch.column("a").to_pylist(), left, right, strict=True):
                if a != last:
                    last, x = a, np.unique(shingle_hashes(p, size))
                y = np.unique(shingle_hashes(q, size))
                common = np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)
                ok.append((NUM + DEN) * common >= NUM * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return both.select("a", "b", "ta", "tb").mapInArrow(trimmed(run), "a long, b long, ok boolean")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose nodes have different roots so far."""
    root = lambda side: F.coalesce(f"_r{side}", side)
    both = pairs.join(roots.toDF("a", "_ra"), "a", "left").join(roots.toDF("b", "_rb"), "b", "left")
    return both.where(root("a") != root("b")).select("a", "b")


def _with_components(own: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """own's columns but node, n, parity and wide, with component: the smallest key of all nodes of one root.

    A node is a 64-bit hash of a set. Where sets that differ in n or parity have the same node, its links hold for the set with the
    smallest key, whose text was compared; each other set is a component of its own, so that none goes for a link it hasn't.
    """
    sets = own.groupBy("node", "n", "parity").agg(F.min(key).alias("least"))
    first = F.row_number().over(W.partitionBy("node").orderBy("least")) == 1
    sets = sets.withColumn("first", first).join(roots, "node", "left")
    sets = written(sets.withColumn("root", F.when(F.col("first"), F.coalesce("root", "node"))), "nodes")
    least = sets.where("first").groupBy("root").agg(F.min("least").alias("component"))
    named = sets.join(least, "root", "left").select("node", "n", "parity", F.coalesce("component", "least").alias("component"))
    return own.join(named, ["node", "n", "parity"]).drop("node", "n", "parity", "wide")


def similar_sets(docs: DataFrame, key: str, size: int) -> DataFrame:
    """docs' columns but the text, with component: the smallest key reachable over pairs of similar sets of word shingles.

    All pairs at NUM / DEN or more are linked and no others: the prefixes' lists hold every such pair, and a link counts
    only after the whole sets are compared, those of pairs that wide parities leave. Of each set one candidate is tried first, then those between what is still apart.
    Long lists give a spanning forest of their candidates; where a link of it fails, all their candidates between what is
    still apart are tried as well. Equal sets are one node whatever their number, and so are texts without words. Equal
    keys must have equal texts.
    """
    own = written(shingle_sets(docs, size), "shingle-sets")
    lists = written(_shared(_postings(docs, size)), "shingle-lists")
    parities = own.select("node", "parity").distinct()
    pairs = written(_screened(written(_candidates(lists, parities), "candidates"), own, key), "pairs")
    like, unlike = (pairs.where(c).select("a", "b") for c in ("may", "not may"))
    texts = texts_of(like, own, docs, key)
    tried = written(verified(like.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), texts, size), "links")
    roots = written(connected_components(tried.where("ok").select("a", "b")), "roots")
    rest = written(_apart(like.join(tried, ["a", "b"], "left_anti"), roots), "pairs")
    if not rest.isEmpty():
        tried = tried.unionByName(written(verified(rest, texts, size), "links"))
        roots = written(connected_components(tried.where("ok").select("a", "b")), "roots")
    failed = tried.where("not ok").select("a", "b").unionByName(unlike)
    if not failed.isEmpty():
        long = lists.groupBy("token").agg(F.count("*").alias("_n")).where(F.col("_n") > SHORT).select("token")
        more = _candidates(lists.join(long, "token", "left_semi"), parities, roots).join(tried.select("a", "b").unionByName(unlike), ["a", "b"], "left_anti")
        rest = written(_screened(written(more, "candidates"), own, key).where("may").select("a", "b"), "pairs")
        if not rest.isEmpty():
            more = written(verified(rest, texts_of(rest, own, docs, key), size).where("ok").select("a", "b"), "links")
            roots = written(connected_components(tried.where("ok").select("a", "b").unionByName(more)), "roots")
    return _with_components(own, roots, key)
