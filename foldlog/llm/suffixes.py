"""Repeated passages: every byte in a string of LENGTH bytes that also starts earlier, by merging front-coded sorted suffix runs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import deflated, inflated, mix64, numbered, table, trimmed, written

LENGTH, GRAM = 100, 44
_WINDOWS = LENGTH - GRAM + 1
#: A suffix to sort is led by _LEAD bytes of its first n-gram's hash, so that ranges are even; up to _REACH bytes before it go along.
_LEAD, _REACH = 8, _WINDOWS - 1
_WIDTH = _LEAD + LENGTH
CHUNK, FLUSH_RUNS, RUN_CONTEXTS, RANGE_CONTEXTS = 1 << 19, 300_000, 60_000, 120_000
#: An n-gram that more windows' runs share than this, and more than one in HOT_SHARE, is sorted window by window: at most HOT_SHARE n-grams are.
HOT_RUNS, HOT_SHARE = 20_000, 4096
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % (1 << 64)))
    out[0] = 1
    return np.multiply.accumulate(out)


class _Hasher:
    """Hashes of any stretch of some bytes in constant time: a polynomial modulo 2**64 over random byte values."""

    up = down = _powers(1, 1)

    def __init__(self, data: np.ndarray):
        if len(_Hasher.up) <= len(data):
            n = 1 << (len(data) + 1).bit_length()
            _Hasher.up, _Hasher.down = _powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix64((self.sums[hi] - self.sums[lo]) * self.down[lo])


def _sliding_least(x: np.ndarray) -> np.ndarray:
    """The least of each _WINDOWS values in a row."""
    reach = 1
    while 2 * reach <= _WINDOWS:
        x = np.minimum(x[: len(x) - reach], x[reach:])
        reach *= 2
    rest = _WINDOWS - reach
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def window_runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """lo, hi, gram, place of the n-gram, of the runs of windows that share their least n-gram.

    data: texts end to end, bounds: where they begin, and the end. Windows are LENGTH bytes within one text; those that
    start at lo to hi have the same n-gram of the least hash. Equal windows have equal least n-grams, wherever they stand,
    and have them at the same place.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    hasher = _Hasher(data)
    at = np.arange(len(data) - GRAM + 1)
    own = hasher.of(at, at + GRAM) & ~np.uint64(255)
    # the place goes along in the low bits, counted so that it doesn't wrap within the window: of equal ones the first counts,
    # or a periodic text could hold equal windows that share an n-gram's place
    turn = np.arange(len(data) - LENGTH + 1) & 255
    least = np.where(turn + _WINDOWS <= 256, _sliding_least(own | (at & 255).astype(np.uint64)), _sliding_least(own | ((at + 128) & 255).astype(np.uint64)))
    place = ((least & np.uint64(255)).astype(np.int64) - np.where(turn + _WINDOWS <= 256, 0, 128)) & 255
    # windows that don't cross a bound
    fits = np.zeros(len(data) + 1, np.int32)
    start, end = bounds[:-1], np.maximum(bounds[1:] - LENGTH + 1, bounds[:-1])
    np.add.at(fits, start, 1)
    np.add.at(fits, end, -1)
    s = np.flatnonzero(np.cumsum(fits)[: len(least)] > 0)
    if not len(s):
        return none, none, none, none
    anchor = s + (place[s] - s) % 256
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1)])
    # two texts that meet without a gap between their windows have different bounds
    text = np.searchsorted(bounds, s, side="right")
    new[1:] |= text[1:] != text[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(s) - 1]])
    lo, hi, a = s[first], s[last], anchor[first]
    return lo, hi, own[a], a


def _texts(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts end to end in chunks: data, bounds, doc and tie of each."""
    for batch in it:
        column = batch.column("text")
        offsets = column.offsets.to_numpy() if hasattr(column, "offsets") else np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        offsets = offsets.astype(np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        doc, tie = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
            yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], doc[at:to], tie[at:to]
            at = to


#: A run's meta: windows after its first one, the n-gram's distance from lo, two marks, and how many runs of its task it stands for.
_LEFT, _PASS, _SHARED, _TIMES = 6, 1 << 12, 1 << 13, 14
_RUNS = "key long, doc long, place long, meta int"


def _listed_runs(docs: DataFrame) -> DataFrame:
    """The runs of docs' windows: key (the n-gram's hash), doc, place (tie and lo) and meta.

    A task groups its own runs first: the first of those that share an n-gram asks for all of them, and the others are dealt
    anywhere, as it is known already that they share it. So a task asks once for an n-gram, however often it stands in its texts.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def settle() -> pa.RecordBatch:
            gram, doc, place, meta = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.argsort(gram, kind="stable")
            gram, doc, place, meta = gram[order], doc[order], place[order], meta[order]
            first = np.concatenate([[True], gram[1:] != gram[:-1]])
            times = np.diff(np.append(np.flatnonzero(first), len(gram)))
            meta[first] |= np.where(times > 1, _SHARED, 0) | np.minimum(times, (1 << 17) - 1) << _TIMES
            meta[~first] |= _PASS
            key = np.where(first, gram, mix64((doc * 31 + place).view(np.uint64)))
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(place), pa.array(meta.astype(np.int32))], names=["key", "doc", "place", "meta"])

        for data, bounds, doc, tie in _texts(it):
            lo, hi, gram, at = window_runs(data, bounds)
            if len(lo):
                own = np.searchsorted(bounds, lo, side="right") - 1
                held.append((gram, doc[own], (tie[own] << 32) | (lo - bounds[own]), (hi - lo) | (at - lo) << _LEFT))
            if sum(len(h[0]) for h in held) > FLUSH_RUNS:
                yield settle()
        if held:
            yield settle()

    return docs.select("doc", "tie", "text").mapInArrow(trimmed(run), _RUNS)


def _shared_runs(listed: DataFrame, hot: int) -> DataFrame:
    """Of listed runs those whose n-gram stands in another run, too; and a row (key, no doc) for each n-gram of more than hot runs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc", "place", "meta"]
        last: tuple[np.ndarray, ...] | None = None  # the row before, which may share the next one's key
        total = 0

        def judged(cols: tuple[np.ndarray, ...], held: bool, final: bool) -> pa.RecordBatch:
            """All rows but the last one (unless final); held: the first row's group has total runs so far."""
            nonlocal total
            key, doc, place, meta = cols
            ask = (meta & _PASS) == 0
            pair = (key[1:] == key[:-1]) & ask[1:] & ask[:-1]
            shared = np.concatenate([[False], pair]) | np.concatenate([pair, [False]]) | ~ask | ((meta & _SHARED) != 0)
            shared[0] |= held
            begin = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            sums = np.add.reduceat(np.where(ask, meta >> _TIMES, 0).astype(np.int64), begin)
            sums[0] += total
            over = np.flatnonzero(sums[: len(begin) if final else -1] > hot)
            end = len(key) if final else len(key) - 1
            # the last row is judged with the next batch, and its group goes on there
            total = int(sums[-1] - (0 if final or not ask[-1] else meta[-1] >> _TIMES))
            pick = np.flatnonzero(shared[:end])
            out = [np.concatenate([c[pick], x]) for c, x in ((key, key[begin[over]]), (doc, np.zeros(len(over), np.int64)), (place, np.zeros(len(over), np.int64)), (meta, np.full(len(over), -1, meta.dtype)))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)

        held = False
        for b in it:
            if not b.num_rows:
                continue
            cols = tuple(b.column(c).to_numpy() for c in names)
            if last is not None:
                cols = tuple(np.concatenate([x, y]) for x, y in zip(last, cols, strict=True))
            yield judged(cols, held, False)
            key, ask = cols[0], (cols[3] & _PASS) == 0
            # whether the last row shares its n-gram with one that has been passed on
            held = len(key) > 1 and bool(key[-1] == key[-2] and ask[-1] and ask[-2]) or (len(key) == 1 and held)
            last = tuple(c[-1:] for c in cols)
        if last is not None:
            yield judged(last, held, True)

    return listed.repartition("key").sortWithinPartitions("key", F.col("meta").bitwiseAND(_PASS)).mapInArrow(trimmed(run), _RUNS)


def front_coded(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Of sorted rows of bytes of one width: how many bytes each shares with the row before, and the bytes that it doesn't share."""
    width = rows.shape[1]
    equal = np.ones((len(rows), width + 1), bool)
    equal[0, 0], equal[:, width] = False, False
    equal[1:, :width] = rows[1:] == rows[:-1]
    shared = equal.argmin(axis=1).astype(np.uint8)
    return shared, rows[np.arange(width) >= shared[:, None]].tobytes()


def merge_runs(runs: list[tuple[bytes, bytes]], width: int = _WIDTH) -> Iterator[tuple[int, int]]:
    """In sorted order, the run that each suffix comes from and how many bytes it shares with the suffix before, from
    front-coded sorted runs, by a loser tree.

    The tree keeps, with each run's head, how much of it is known to agree with the last suffix put out. Of two heads the one
    that agrees further comes first; only where both agree as far are bytes compared, and only from there on.
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    head: list[bytes] = [b""] * k
    known = [-1] * k  # -1: the run is over

    def reader(i: int) -> Iterator[int]:
        shared, rest = runs[i]
        at, now = 0, b""
        for n in shared:
            to = at + width - n
            now = now[:n] + rest[at:to]
            at = to
            head[i] = now
            yield n

    feeds = [reader(i) for i in range(len(runs))]
    for i, f in enumerate(feeds):
        known[i] = min(next(f, -1), 0)

    def before(a: int, b: int) -> bool:
        """Whether a's head comes before b's, which agree with the last suffix equally far; sets what is known of the later one."""
        n = known[a]
        x, y = head[a][n:], head[b][n:]
        if x == y:
            known[b] = width
            return True
        gap = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
        same = width - (gap.bit_length() + 7) // 8
        first = x[same - n] < y[same - n]
        known[b if first else a] = same
        return first

    loser = [0] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        if known[a] != known[b]:
            win, lose = (a, b) if known[a] > known[b] else (b, a)
        elif known[a] < 0 or before(a, b):
            win, lose = a, b
        else:
            win, lose = b, a
        loser[node] = lose
        return win

    now = play(1)
    while known[now] >= 0:
        yield now, known[now]
        known[now] = next(feeds[now], -1)
        node = (now + k) >> 1
        while node:
            other = loser[node]
            a, b = known[now], known[other]
            if b > a or (a == b and a >= 0 and not before(now, other)):
                loser[node], now = now, other
            node >>= 1


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    """The hash of each row of bytes, as _Hasher has it."""
    out = np.zeros(len(rows), np.uint64)
    for j in reversed(range(rows.shape[1])):
        out = out * np.uint64(_BASE) + _VALUES[rows[:, j]]
    return mix64(out)


def contexts(text: np.ndarray, lo: np.ndarray, more: np.ndarray, left: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Suffixes (a row of _WIDTH bytes: a hash of the leading n-gram, and the text from it on), the bytes before each (backwards,
    _REACH of them), lo, more, left. Bytes that are in no window of the run are 0.

    Runs whose n-gram's hash is in hot come apart into windows: such a suffix is led by the hash of its whole window.
    """
    padded = np.concatenate([np.zeros(_REACH, np.uint8), text, np.zeros(LENGTH, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, _REACH + LENGTH)
    lead = _hash_rows(view[lo + left][:, _REACH : _REACH + GRAM])
    if len(hot):
        own = np.isin(lead & ~np.uint64(255), hot)
        if own.any():
            each = np.repeat(lo[own] - np.cumsum(more[own] + 1) + more[own] + 1, more[own] + 1) + np.arange((more[own] + 1).sum())
            zero = np.zeros(len(each), np.int64)
            lead = np.concatenate([lead[~own], _hash_rows(view[each][:, _REACH:])])
            lo, more, left = np.concatenate([lo[~own], each]), np.concatenate([more[~own], zero]), np.concatenate([left[~own], zero])
    # least n-grams have low hashes: mixed again they fall evenly into ranges
    lead = mix64(lead + np.uint64(1))
    m = view[lo + left]
    at = np.arange(_REACH + LENGTH)
    m[(at < (_REACH - left)[:, None]) | (at >= (_REACH + more + LENGTH - left)[:, None])] = 0
    suffix = np.concatenate([lead.astype(">u8").view(np.uint8).reshape(-1, _LEAD), m[:, _REACH:]], axis=1)
    return suffix, m[:, :_REACH][:, ::-1], lo, more, left


_PARTS = "part int, shared binary, rest binary, before binary, docs binary, places binary, metas binary"


def _packed(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 3)


def _sorted_runs(work: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """Front-coded sorted runs of suffixes, a row for each range of their hashes.

    Of contexts that are equal within a run the earliest stands for all; the others are repeats already, and go along as a row without
    bytes. So a passage that stands in a third of all texts is one suffix a run.
    """
    step = -(-(1 << 32) // parts)
    step_runs = RUN_CONTEXTS // (4 * _WINDOWS if len(hot) else 4)  # a hot run comes apart into up to _WINDOWS

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            suffix, before, doc, place, more, left = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            whole = np.concatenate([suffix, before, more[:, None].astype(np.uint8), left[:, None].astype(np.uint8)], axis=1)
            order = np.lexsort((place, doc))
            order = order[np.argsort(whole[order].view(f"S{whole.shape[1]}").ravel(), kind="stable")]
            whole, doc, place, meta = whole[order], doc[order], place[order], (more | left << _LEFT)[order].astype(np.int32)
            again = np.concatenate([[False], (whole[1:] == whole[:-1]).all(axis=1)])
            head = np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))
            found = again & ((doc != doc[head]) | (place != place[head]))  # a row that stands twice is no repeat of itself
            out: list[tuple] = []
            if found.any():
                # any part will do: these are only passed on
                out.append((int(place[0]) % parts, b"", b"", b"", _packed(doc[found]), _packed(place[found]), _packed(meta[found])))
            whole, doc, place, meta = whole[~again], doc[~again], place[~again], meta[~again]
            part = whole[:, :4].copy().view(">u4").ravel().astype(np.int64) // step
            cuts = np.searchsorted(part, np.arange(parts + 1))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                lo, hi = cuts[i], cuts[i + 1]
                shared, rest = front_coded(whole[lo:hi, :_WIDTH])
                out.append((i, shared.tobytes(), zstandard.compress(rest, 3), _packed(whole[lo:hi, _WIDTH : _WIDTH + _REACH]), _packed(doc[lo:hi]), _packed(place[lo:hi]), _packed(meta[lo:hi])))
            types = [pa.int32(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["part", "shared", "rest", "before", "docs", "places", "metas"])

        size = 0
        for batch, texts in inflated(it, "text"):
            for i in range(batch.num_rows):
                text = np.frombuffer(texts[i], np.uint8)
                runs, doc = batch.column("runs")[i].values, batch.column("doc")[i].as_py()
                place, meta = (runs.field(c).to_numpy() for c in ("place", "meta"))
                tie = int(place[0]) & ~0xFFFFFFFF
                for k in range(0, len(place), step_runs):
                    own = slice(k, k + step_runs)
                    n = meta[own].astype(np.int64)
                    suffix, before, lo, more, left = contexts(text, place[own] & 0xFFFFFFFF, n & 63, (n >> _LEFT) & 63, hot)
                    held.append((suffix, before, np.full(len(lo), doc, np.int64), tie | lo, more, left))
                    size += len(lo)
                    if size >= RUN_CONTEXTS:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return work.select("doc", "text", "runs").mapInArrow(trimmed(run), _PARTS)


def repeated_offsets(shared: np.ndarray, before: np.ndarray, doc: np.ndarray, place: np.ndarray, more: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which windows of sorted contexts also start earlier: a row each, a column for each distance of the n-gram from the window's start.

    shared: how many bytes a suffix shares with the one before. Two windows are equal where the n-gram has the same distance d in
    both, the suffixes share LENGTH - d bytes, and the d bytes before agree. Both are read from sorted orders: neighbours
    between which no smaller number stands agree that far.
    """
    k = len(shared)
    rank = np.lexsort((place, doc))
    by = np.argsort(np.ascontiguousarray(before).view(f"S{_REACH}").ravel(), kind="stable")
    rows = before[by]
    equal = np.zeros((k, _REACH + 1), bool)
    equal[1:, :_REACH] = rows[1:] == rows[:-1]
    agree = equal.argmin(axis=1)
    agree[0] = -1
    out = np.zeros((k, _WINDOWS), bool)
    behind = np.empty(k, np.int64)
    for d in range(_WINDOWS):
        on = rank[((left - more <= d) & (left >= d))[rank]]  # in order of documents and places
        if len(on) < 2:
            continue
        behind[by] = np.cumsum(agree < d)
        key = np.cumsum(shared < _WIDTH - d)[on] * (k + 1) + behind[on]
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        one = on[first[which]]
        out[on, d] = (doc[on] != doc[one]) | (place[on] + left[on] != place[one] + left[one])
    return out


_FOUND = "doc long, place long, more int"


def _merge_range(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs, columns = [], []

    def rows(doc: np.ndarray, place: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place), pa.array(more.astype(np.int32))], names=["doc", "place", "more"])

    for b in batches:
        for r in b.to_pylist():
            doc, place = (np.frombuffer(zstandard.decompress(r[c]), np.int64) for c in ("docs", "places"))
            meta = np.frombuffer(zstandard.decompress(r["metas"]), np.int32).astype(np.int64)
            if not r["shared"]:
                yield rows(doc, place, meta & 63)
                continue
            runs.append((r["shared"], zstandard.decompress(r["rest"])))
            columns.append((doc, place, meta, np.frombuffer(zstandard.decompress(r["before"]), np.uint8).reshape(-1, _REACH)))
    if not runs:
        return
    doc, place, meta, before = (np.concatenate(c) for c in zip(*columns, strict=True))
    next_ = np.cumsum([0, *(len(r[0]) for r in runs)])[:-1].tolist()
    order, shared = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    for i, (run, n) in enumerate(merge_runs(runs)):
        order[i], shared[i] = next_[run], n
        next_[run] += 1
    # a suffix that shares no n-gram with a neighbour has no equal windows
    near = shared >= _LEAD + GRAM
    some = near | np.append(near[1:], False)
    order, shared = order[some], shared[some]
    if not len(order):
        return
    doc, place, meta, before = doc[order], place[order], meta[order], before[order]
    more, left = meta & 63, (meta >> _LEFT) & 63
    hit = np.zeros((len(doc), _WINDOWS + 2), bool)
    hit[:, 1:-1] = repeated_offsets(shared, before, doc, place, more, left)
    row, least = np.nonzero(hit[:, 1:-1] & ~hit[:, :-2])
    _, most = np.nonzero(hit[:, 1:-1] & ~hit[:, 2:])
    yield rows(doc[row], place[row] + left[row] - most, most - least)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc, place, more: windows of LENGTH bytes that start at place to place + more and also start earlier.

    docs: doc (long), tie (which of a doc's texts) and text (binary). Written steps:
    1. Windows are grouped by their least n-gram (a function of the window's bytes alone), in runs of 29 on average. A run whose
       n-gram stands nowhere else has no repeat.
    2. The others' suffixes, from the n-gram on, are sorted with the bytes before them: each task sorts its own, front-codes
       them and deals them by range. A task merges the runs of its range; what neighbours share tells which windows are equal.
    Windows count as equal only where all their bytes have been compared; hashes choose what is compared, and its order.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hot = max(HOT_RUNS, size // (_WINDOWS // 2) // HOT_SHARE)
    runs = written(_shared_runs(_listed_runs(docs), hot), "suffix-runs")
    # at most HOT_SHARE rows, but for roundings
    keys = [r[0] for r in runs.where("meta = -1").select("key").distinct().collect()]
    runs = runs.where("meta != -1").select("doc", F.shiftright("place", 32).alias("tie"), "place", F.col("meta").bitwiseAND(_PASS - 1).alias("meta"))
    parts = max(1, math.ceil(runs.count() / RANGE_CONTEXTS))
    lists = runs.groupBy("doc", "tie").agg(F.collect_set(F.struct("place", "meta")).alias("runs"))
    front = _sorted_runs(deflated(docs).join(lists, ["doc", "tie"]), parts, np.array(keys, np.int64).view(np.uint64))
    return written(front.groupBy("part").applyInArrow(_merge_range, _FOUND), "suffix-repeats")


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """doc, tie, null (whether the text is), text (bytes), and own: the other columns, so that their names can't clash.

    doc and tie name a text: a null key counts as the largest one, and of several texts under one key each gets a number, in the
    order of 128 bits of their hashes. Keys of one text (the rule) have tie 0 and are told by a narrow count alone.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("i"),
        F.col("text").isNull().alias("null"), F.struct(*others).alias("own"), text.alias("text"))
    texts = written(rows.select("doc", "h", "i").distinct(), "texts")
    several = texts.join(texts.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1"), "doc", "left_semi")
    number = numbered(several, ["doc", "h", "i"], "number")
    if number.isEmpty():
        return rows.withColumn("tie", F.lit(0).cast("long")).drop("h", "i")
    ties = number.join(number.groupBy("doc").agg(F.min("number").alias("least")), "doc").select("doc", "h", "i", (F.col("number") - F.col("least")).alias("tie"))
    out = rows.join(ties, ["doc", "h", "i"], "left").withColumn("tie", F.coalesce("tie", F.lit(0)).cast("long"))
    return out.withColumn("tie", F.when(F.col("tie") < 1 << 31, F.col("tie")).otherwise(F.raise_error(F.lit("more than 2**31 texts under one key")))).drop("h", "i")


def repeat_spans(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """_keyed's columns, the text compressed, and spans: the stretches (lo, hi) that repeats cover, not merged; null if none.

    A null key comes last. Rows of one key and different texts are ordered by their texts' hashes, and are told apart however
    many they are; equal rows don't count as earlier than each other.
    """
    keyed = _keyed(docs, key)
    found = repeated_windows(keyed.select("doc", "tie", "text"))
    at = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    spans = found.groupBy("doc", F.shiftright("place", 32).alias("tie")).agg(F.collect_list(F.struct(at.alias("lo"), (at + F.col("more") + LENGTH).alias("hi"))).alias("spans"))
    return deflated(keyed).join(spans, ["doc", "tie"], "left")


def merged_spans(spans: pa.Scalar) -> np.ndarray:
    """Maximal covered stretches, as rows lo, hi."""
    if not spans.is_valid:
        return np.zeros((0, 2), np.int64)
    lo, hi = (spans.values.field(c).to_numpy() for c in ("lo", "hi"))
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.concatenate([[True], lo[1:] > hi[:-1]])
    return np.column_stack([lo[first], np.concatenate([hi[:-1][first[1:]], hi[-1:]])])


def _kept(text: bytes, spans: np.ndarray) -> bytes:
    at, out = 0, []
    for lo, hi in spans.tolist():
        out.append(text[at:lo])
        at = hi
    return b"".join([*out, text[at:]])


def without_repeats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with all repeats taken out of the text; a character that a repeat covers only in part stays.

    n_chars, where docs has it, is counted anew. A null text stays null, an empty table empty; other columns may have any names.
    """
    names, schema = docs.columns, docs.schema
    rows = repeat_spans(docs, key).select("own", "null", "text", "spans")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in inflated(it, "text"):
            out = []
            for text, spans, null in zip(texts, b.column("spans"), b.column("null"), strict=True):
                cut = merged_spans(spans)
                for i in range(len(cut)):  # to whole characters: a byte 10xxxxxx goes on with one
                    while cut[i, 0] < cut[i, 1] and cut[i, 0] < len(text) and text[cut[i, 0]] & 0xC0 == 0x80:
                        cut[i, 0] += 1
                    while cut[i, 1] > cut[i, 0] and cut[i, 1] < len(text) and text[cut[i, 1]] & 0xC0 == 0x80:
                        cut[i, 1] -= 1
                out.append(None if null.as_py() else _kept(text, cut).decode("utf-8"))
            own = b.column("own")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else own.field(c) for c in names], names=names)

    out = rows.mapInArrow(trimmed(run), schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def repeat_digest(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of each document; null and empty texts have 0 bytes."""
    rows = repeat_spans(docs.select(key, "text"), key).select("own", "text", "spans")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in inflated(it, "text"):
            n, removed, count, sha = [], [], [], []
            for text, spans in zip(texts, b.column("spans"), strict=True):
                cut = merged_spans(spans)
                n.append(len(text))
                removed.append(int((cut[:, 1] - cut[:, 0]).sum()))
                count.append(len(cut))
                sha.append(hashlib.sha256(_kept(text, cut)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("own").field(key), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha)], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(trimmed(run), f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents; see repeat_spans for null ids, repeated rows and texts that share an id."""
    return repeat_digest(table(spark, sf_dir, "documents"))
