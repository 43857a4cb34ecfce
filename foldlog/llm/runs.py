"""Periodic runs of words: stretches that repeat a short sequence, found with suffix trees and Lyndon roots.

Spark deals the documents; a task works on one stretch of one document at a time.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import byte_slices, free_name, mix64, table

#: A run has so many words, and so many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
_BLOCK, _SLICE = 32, 1 << 16
_ODD = 0x9E3779B97F4A7C15


class SuffixTree:
    """Ukkonen's tree of some symbols (small non-negative numbers), with a last symbol of its own that is less than all others.

    Nodes are numbered as they are made; a leaf's suffix starts at start - depth of its parent. Edges are one dictionary by
    (node, symbol). LCE queries are range minima over the string depths of an Euler tour, by blocks: constant time, linear space.
    """

    def __init__(self, symbols: list[int]):
        self.size = len(symbols)
        self.sigma = max(symbols, default=0) + 2
        self._grow([x + 1 for x in symbols] + [0])

    def _grow(self, s: list[int]) -> None:
        n, sigma = len(s), self.sigma
        start, end, link, edges = array("i", [0]), array("i", [0]), array("i", [0]), {}
        node, edge, length, left = 0, 0, 0, 0  # the active point, and the suffixes that wait
        for i, c in enumerate(s):
            left += 1
            last = 0
            while left:
                if not length:
                    edge = i
                key = node * sigma + s[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    at = start[child]
                    span = min(end[child], i + 1) - at
                    if length >= span:
                        node, edge, length = child, edge + span, length - span
                        continue
                    if s[at + length] == c:
                        length += 1
                        if last and node:
                            link[last] = node
                        break
                    middle = len(start)
                    start.append(at)
                    end.append(at + length)
                    link.append(0)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    edges[key] = middle
                    edges[middle * sigma + c] = middle + 1
                    start[child] = at + length
                    edges[middle * sigma + s[at + length]] = child
                    if last:
                        link[last] = middle
                    last = middle
                left -= 1
                if not node and length:
                    length -= 1
                    edge = i - left + 1
                elif node:
                    node = link[node]
        self._tour(edges, start, end, n)

    def _tour(self, edges: dict[int, int], start: array, end: array, n: int) -> None:
        """String depths along the Euler tour, where it first meets each suffix's leaf, and the suffixes' ranks under both alphabets."""
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        below = np.fromiter(edges.values(), np.int64, len(edges))
        edges.clear()
        by_symbol = np.argsort(keys)
        keys, below = keys[by_symbol], below[by_symbol].tolist()
        ends = (keys % self.sigma == 0).tolist()
        first = np.searchsorted(keys, np.arange(len(start) + 1, dtype=np.int64) * self.sigma).tolist()
        tour, place, rank, suffix_of = array("i", [0]), array("i", bytes(4 * n)), array("i", bytes(4 * n)), array("i", bytes(4 * len(start)))
        path, depths, met = [0], [0], 0
        at = first[:-1]
        while path:
            node, depth = path[-1], depths[-1]
            i = at[node]
            if i == first[node + 1]:
                path.pop()
                depths.pop()
                if path:
                    tour.append(depths[-1])
                continue
            at[node] = i + 1
            child = below[i]
            if end[child] == n:  # a leaf
                suffix = suffix_of[child] = start[child] - depth
                place[suffix], rank[suffix] = len(tour), met
                met += 1
                tour.append(n - suffix)
                tour.append(depth)
            else:
                path.append(child)
                depths.append(depth + end[child] - start[child])
                tour.append(depths[-1])
        self.place, self.rank = (np.frombuffer(x, np.int32).astype(np.int64) for x in (place, rank))
        # the alphabet turned round, but for the last symbol, which stays the least
        todo, met = [0], 0
        while todo:
            node = todo.pop()
            lo, hi = first[node], first[node + 1]
            if lo == hi:
                rank[suffix_of[node]] = met
                met += 1
            elif ends[lo]:
                todo += below[lo + 1 : hi]
                todo.append(below[lo])
            else:
                todo += below[lo:hi]
        self.turned_rank = np.frombuffer(rank, np.int32).astype(np.int64)
        self._index(np.frombuffer(tour, np.int32))

    def _index(self, depths: np.ndarray) -> None:
        pad = -len(depths) % _BLOCK
        blocks = np.concatenate([depths, np.full(pad, np.iinfo(np.int32).max, np.int32)]).reshape(-1, _BLOCK)
        self.depths = blocks.ravel()
        self.from_left = np.minimum.accumulate(blocks, 1).ravel()
        self.from_right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        self.levels = [blocks.min(1)]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            x, reach = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(x[: len(x) - reach], x[reach:]))

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at i and j (which differ) share; a suffix at the end is empty. Slices keep what it holds small."""
        return np.concatenate([np.zeros(0, np.int64), *(self._lce(i[k : k + _SLICE], j[k : k + _SLICE]) for k in range(0, len(i), _SLICE))])

    def _lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.place[i], self.place[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        x, y = lo // _BLOCK, hi // _BLOCK
        out = np.minimum(self.from_right[lo], self.from_left[hi])
        wide = y - x > 1
        if wide.any():
            l, r = x[wide] + 1, y[wide]
            level = np.frexp((r - l).astype(float))[1] - 1
            best = out[wide]
            for k in np.unique(level):
                own = level == k
                best[own] = np.minimum(best[own], np.minimum(self.levels[k][l[own]], self.levels[k][r[own] - (1 << k)]))
            out[wide] = best
        near = np.flatnonzero(x == y)
        if len(near):
            span = lo[near, None] + np.arange(_BLOCK)
            inside = np.where(span <= hi[near, None], self.depths[np.minimum(span, len(self.depths) - 1)], np.iinfo(np.int32).max)
            out[near] = inside.min(1)
        return out


def lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """Where the longest Lyndon word from each place ends: the next place whose suffix is less."""
    ranks = rank.tolist()
    out, stack = array("q", bytes(8 * len(ranks))), []
    for i, r in enumerate(ranks):
        while stack and ranks[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    for i in stack:
        out[i] = len(ranks)
    return np.frombuffer(out, np.int64)


def runs_of(symbols: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least so many symbols and periods (2 or more), by start, then period.

    A run of two periods or more has, in one of the two orders of the alphabet, a period that is the longest Lyndon word from its
    first place. So each place gives two candidates, which common extensions to both sides turn into runs.
    """
    n = len(symbols)
    if n < least_words:
        return np.zeros((0, 3), np.int64)
    codes = np.unique(symbols, return_inverse=True)[1].tolist()
    ahead = SuffixTree(codes)
    start = np.arange(n)
    period = np.concatenate([lyndon_ends(ahead.rank[:n]) - start, lyndon_ends(ahead.turned_rank[:n]) - start])
    pairs = np.unique(np.column_stack([np.concatenate([start, start]), period]), axis=0)
    i, period = pairs.T
    right = ahead.lce(i, i + period)
    del ahead
    behind = SuffixTree(codes[::-1])
    # the reversal's suffix at n - i holds what stands before place i
    before = behind.lce(n - i, n - i - period)
    first, last = i - before, i + period + right
    length = last - first
    own = (length >= least_periods * period) & (length >= least_words)
    found = np.unique(np.column_stack([first, period, length])[own], axis=0)
    return found[:, [0, 2, 1]]


def periodic_stretches(symbols: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int]]:
    """Stretches (lo, hi) outside which no run lies: each run, with all that would extend it, is within one.

    A run of L symbols and period q holds each of its n-grams of L - 2 * q symbols again q places off, and q is L / least_periods
    at most. Places whose n-gram is not found that near, for the stretch they stand in, are left out until nothing changes.
    Hashes that fall together only make a stretch longer.
    """
    gram = max(1, -(-least_words * (least_periods - 2) // least_periods))
    if len(symbols) < least_words:
        return []
    x, width, base, tail = mix64(symbols.astype(np.uint64) + np.uint64(1)), 1, _ODD, gram
    out = None
    while tail:  # the n-gram's width in powers of two
        if tail & 1:
            out = (x, width) if out is None else (out[0][: len(symbols) - out[1] - width + 1] + np.uint64(pow(_ODD, out[1], 1 << 64)) * x[out[1] : len(symbols) - width + 1], out[1] + width)
        tail >>= 1
        if tail:
            x = x[: len(x) - width] + np.uint64(base) * x[width:]
            width, base = 2 * width, base * base % (1 << 64)
    grams = out[0]
    order = np.argsort(grams, kind="stable")
    twin = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
    if not len(twin):
        return []
    near = np.full(len(grams), len(symbols))
    gap = order[twin + 1] - order[twin]
    np.minimum.at(near, order[twin], gap)
    np.minimum.at(near, order[twin + 1], gap)
    marked = near < len(symbols)
    while True:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.view(np.int8), [0]])))
        lo, hi = edges[::2], edges[1::2]
        size = hi - lo + gram - 1
        reach = np.zeros(len(grams), np.int64)
        reach[marked] = np.repeat(np.where(size >= least_words, size // least_periods, 0), hi - lo)
        stay = marked & (near <= reach)
        if (stay == marked).all():
            return list(zip(lo.tolist(), (hi + gram - 1).tolist(), strict=True))
        marked = stay


def word_runs(words: list[bytes], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of the runs of some words, by start, then period."""
    seen: dict[bytes, int] = {}
    symbols = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    found = [runs_of(symbols[lo:hi], least_words, least_periods) + [lo, 0, 0] for lo, hi in periodic_stretches(symbols, least_words, least_periods)]
    return np.concatenate([np.zeros((0, 3), np.int64), *found])


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that stay when each run keeps its first period only, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    start, length, period = runs.T
    over = np.zeros(len(words) + 1, np.int64)
    np.add.at(over, start + period, 1)
    np.add.at(over, start + length, -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(over[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """docs with runs (array of start, length, period, in words from 0) of each whole text, and collapsed, the text without their repeats.

    Words are runs of characters other than ASCII white space. A run is a stretch of words of smallest period q, of least_words
    and least_periods * q words at least, that no neighbour extends. Collapsed keeps a word unless some run holds it after
    that run's first q words. Null and empty texts have no run and collapse to an empty text; repeated rows come back like others, an
    empty table empty. Other columns stay, whatever their names; runs and collapsed get leading underscores where docs has them.

    A task holds one slice of texts, and one stretch's trees at a time: about 900 bytes for each word of the longest periodic stretch.
    """
    run = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
    names = [free_name(docs, "runs"), free_name(docs, "collapsed")]
    schema = StructType([*docs.schema.fields, StructField(names[0], ArrayType(run)), StructField(names[1], StringType())])
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    columns, at = docs.columns, docs.columns.index("text")

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(it, columns[at]):
            found, texts = [], []
            for text in part.column(at):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                runs = word_runs(words, least_words, least_periods)
                found.append(runs)
                texts.append(collapsed(words, runs))
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.concatenate(found)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], fields=list(kind)))
            yield pa.RecordBatch.from_arrays([*part.columns, listed, pa.array(texts, pa.binary()).cast(pa.string())], names=[*columns, *names])

    return docs.mapInArrow(find, schema)


def with_period(doc_id: Column, text: Column) -> Column:
    """The text of every tenth document by its id's checksum with a periodic tail, as the query's contract puts it; other texts as they are.

    With h = crc32(id), g = h div 10, n words: each word from a = g mod n on becomes word a + (i - a) mod p, for p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")

    def tail(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (3 + g % 8))
        head = F.slice(w, F.lit(1), a.cast("int"))
        return F.array_join(F.concat(head, F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.get(w, (a + i % p).cast("int")))), " ")

    planted = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w))), F.lit(0))
    return F.coalesce(F.when(h % 10 == 0, planted), text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: its runs' number, the one of most periods, and digests; see periodic_runs for nulls and repeated rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", with_period(F.col("doc_id"), F.col("text")).alias("text"))
    most = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return periodic_runs(docs).select(
        "doc_id", "collapsed", "runs", F.aggregate("runs", none, most).alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        sha(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
