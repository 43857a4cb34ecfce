"""Toxicity by two Kneser-Ney models of words as letter sequences, of toxic and of ordinary labelled texts, with shared backoff counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from .common import byte_slices, deflated, free_name, held_out, inflated, table, trimmed, written

#: Longer words are cut into pieces of PIECE letters. A part of the sorted word list has about PART_WORDS of them.
PIECE, PART_WORDS = 32, 100_000
#: Ratios of so many distinct words (12 bytes each: 48 MB), the most used, go to every task; those of all others are joined to the texts that hold them.
BROADCAST_WORDS = 4_000_000
#: Uses of a word are told apart up to so many when those words are chosen: the driver gets a row for each number.
USES = 65_536
#: Discounts: of a shared count, and the most of a class's count, so that what one text or two use once is left to the backoff.
SHARED_DISCOUNT, CLASS_DISCOUNT, UNIFORM = 0.75, 3, 1 / 64
WINDOW, CALIBRATION_ROWS, THRESHOLD = 2, 50_000, 0.3
SHARED, TOXIC, PLAIN = range(3)
_END = 3


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words (letters and digits, lower case; long ones in pieces), each word's place among them, and where texts begin."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+", " ")
    clean = pc.replace_substring_regex(clean, r"(\S{%d})" % PIECE, r"\1 ")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(clean))
    words = lists.flatten().dictionary_encode()  # a text without words gives one empty word
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()


def word_counts(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """word, n, n_toxic, n_plain of every distinct word of docs (text) and labelled (text as deflated, label): how often docs use it, and in how many
    texts of each class it stands.

    A task lists the distinct words of a few megabytes of text at a time; Spark adds them up before and after the shuffle.
    """

    def listed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(it, "text"):
            words, codes, _ = words_of(part.column("text"))
            zero, n = np.zeros(len(words), np.int64), np.bincount(codes, minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *map(pa.array, (n, zero, zero))], names=["word", "n", "n_toxic", "n_plain"])

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in inflated(it, "text"):
            words, codes, starts = words_of(pa.array(texts, pa.binary()).cast(pa.string()))
            row = np.repeat(np.arange(part.num_rows), np.diff(starts))
            label = np.asarray(part.column("label").to_pylist())
            seen = np.unique(row * len(words) + codes)  # a text counts a word once
            at, of = seen % len(words), label[seen // len(words)]
            times = [pa.array(np.bincount(at[of == c], minlength=len(words)).astype(np.int64)) for c in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.zeros(len(words), np.int64)), *times], names=["word", "n", "n_toxic", "n_plain"])

    ddl = "word string, n long, n_toxic long, n_plain long"
    both = docs.select("text").mapInArrow(trimmed(listed), ddl).unionByName(labelled.select("text", "label").mapInArrow(trimmed(counted), ddl))
    return both.where("word != ''").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "n_toxic", "n_plain")))


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken off each count (rows: shared, toxic, plain) and left to the backoff."""
    off = np.minimum(counts, CLASS_DISCOUNT).astype(np.float64)
    off[SHARED] = SHARED_DISCOUNT * (counts[SHARED] > 0)
    return off


class _Level:
    """The expressions of one length: contexts (the first letters of words), what follows each, and their counts by kind."""

    def __init__(self, active: np.ndarray, start: np.ndarray, letter: np.ndarray, counts: np.ndarray):
        self.active = active
        self.child_start = start.copy()
        self.child_start[1:] |= letter[1:] != letter[:-1]
        self.child = np.cumsum(self.child_start) - 1  # of each active word
        at = np.flatnonzero(self.child_start)
        self.child_counts = np.add.reduceat(counts[:, active], at, axis=1)
        self.parent = (np.cumsum(start) - 1)[at]  # of each child
        self._first = np.flatnonzero(np.concatenate([[True], self.parent[1:] != self.parent[:-1]]))
        self.parent_counts = np.add.reduceat(self.child_counts, self._first, axis=1)

    def mass(self, without: tuple[int, ...] = ()) -> np.ndarray:
        """The discounted mass of each context, leaving out some children."""
        off = discounts(self.child_counts)
        for i in without:
            off[:, i] = 0
        return np.add.reduceat(off, self._first, axis=1)


def levels(words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, Iterator[_Level]]:
    """Letters (with an end mark) and lengths of some sorted words, and their expressions by length."""
    flat = np.array(words, dtype=f"U{PIECE}")
    codes = np.zeros((len(words), PIECE + 1), np.uint32)
    codes[:, :PIECE] = flat.view(np.uint32).reshape(len(words), PIECE)
    length = (codes != 0).sum(axis=1)
    codes[np.arange(len(words)), length] = _END

    def run() -> Iterator[_Level]:
        active, start = np.arange(len(words)), np.zeros(len(words), bool)
        start[0] = True
        for d in range(int(length.max()) + 1):
            level = _Level(active, start, codes[active, d], counts)
            yield level
            on = length[active] > d
            # the first word that goes on within a child begins the next context
            no = level.child[on]
            start = np.concatenate([[True], no[1:] != no[:-1]]) if len(no) else no.astype(bool)
            active = active[on]

    return codes, length, run()


def _sorted_part(batches: Iterator[pa.RecordBatch]) -> tuple[list[str], np.ndarray, pa.ChunkedArray]:
    t = pa.Table.from_batches(list(batches)).sort_by("word")
    return t.column("word").to_pylist(), np.stack([np.ones(len(t), np.int64), t.column("n_toxic").to_numpy(), t.column("n_plain").to_numpy()]), t.column("n")


def _key(codes: np.ndarray) -> str:
    return "".join(map(chr, codes.tolist()))


_EDGE = "expression string, s long, t long, p long, mass_s double, mass_t double, mass_p double"


def _edges(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts in this part of the expressions that its neighbours may hold, too: the beginnings of its first and last word."""
    words, counts, _ = _sorted_part(batches)
    codes, length, each = levels(words, counts)
    rows: dict[str, tuple] = {}
    for d, level in enumerate(each):
        ends = [(i, w) for i, w in ((0, 0), (-1, len(words) - 1)) if length[w] >= d]
        mass = level.mass(tuple(i for i, _ in ends))
        for i, w in ends:
            rows[_key(codes[w, :d])] = (*level.parent_counts[:, i].tolist(), *mass[:, i].tolist())
            rows[_key(codes[w, : d + 1])] = (*level.child_counts[:, i].tolist(), 0.0, 0.0, 0.0)
    columns = zip(*((k, *v) for k, v in rows.items()), strict=True)
    types = [pa.string(), *[pa.int64()] * 3, *[pa.float64()] * 3]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["expression", "s", "t", "p", "mass_s", "mass_t", "mass_p"])


def _whole_edges(parts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Counts and discounted mass over all parts of the expressions at their edges: at most 2 * (PIECE + 2) a part."""
    own = parts.groupBy("part").applyInArrow(_edges, _EDGE)
    rows = own.groupBy("expression").agg(*(F.sum(c).alias(c) for c in ("s", "t", "p", "mass_s", "mass_t", "mass_p"))).collect()
    whole = {r[0]: (np.array(r[1:4], np.int64), np.array(r[4:7])) for r in rows}
    for k, (n, _) in whole.items():
        if k:
            whole[k[:-1]][1][:] += discounts(n[:, None])[:, 0]
    return whole


def part_ratios(words: list[str], counts: np.ndarray, whole: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of each of some sorted words: log probability by the toxic model less that by the ordinary one, a letter (the end counts as one).

    The probability of a letter after the letters before it is its discounted share of the class's texts, and what the discounts
    left over goes by the shared model: in how many different words of the whole corpus it follows, as Kneser and Ney count.
    """
    codes, length, each = levels(words, counts)
    out = np.zeros(len(words))
    for d, level in enumerate(each):
        mass, n, total = level.mass(), level.child_counts.copy(), level.parent_counts.copy()
        for i, w in ((0, 0), (-1, len(words) - 1)):
            if length[w] >= d:
                total[:, i], mass[:, i] = whole[_key(codes[w, :d])]
                n[:, i] = whole[_key(codes[w, : d + 1])][0]
        share = np.maximum(total[:, level.parent], 1)
        kept, left = (n - discounts(n)) / share, (mass[:, level.parent] / share)
        shared = kept[SHARED] + left[SHARED] * UNIFORM
        p = [np.where(total[k][level.parent] > 0, kept[k] + left[k] * shared, shared) for k in (TOXIC, PLAIN)]
        out[level.active] += np.log(p[0] / p[1])[level.child]
    return out / (length + 1)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64).view(np.int64)


def word_ratios(counts: DataFrame) -> DataFrame:
    """word (its hash), n and ratio of each word of word_counts' table: the model, which grows with the corpus. A table without n counts each word once.

    Words are dealt in sorted ranges, where all that begin alike stand together, so that a task counts its expressions by
    itself; those that reach over an edge are added up first. Neither counts nor ratios depend on how words are dealt.
    """
    counts = written(counts if "n" in counts.columns else counts.withColumn("n", F.lit(1).cast("long")), "toxicity-counts")
    parts = max(1, -(-counts.count() // PART_WORDS))
    ranges = written(counts.repartitionByRange(parts, "word").withColumn("part", F.spark_partition_id()), "toxicity-words")
    whole = counts.sparkSession.sparkContext.broadcast(_whole_edges(ranges))

    def run(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, n = _sorted_part(batches)
        ratio = part_ratios(words, counts, whole.value).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(word_hashes(words)), n.combine_chunks(), pa.array(ratio)], names=["word", "n", "ratio"])

    return written(ranges.groupBy("part").applyInArrow(run, "word long, n long, ratio float"), "toxicity-ratios")


def text_features(ratio: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the mean ratio a word, and the highest mean over window words in a row (all, if there are fewer)."""
    n = np.diff(starts)
    sums = np.concatenate([[0.0], np.cumsum(ratio, dtype=np.float64)])
    mean = (sums[starts[1:]] - sums[starts[:-1]]) / np.maximum(n, 1)
    best = mean.copy()
    for i in np.flatnonzero(n > window):
        a, b = starts[i], starts[i + 1]
        own = np.concatenate([[0.0], np.cumsum(ratio[a:b], dtype=np.float64)])
        mean[i] = own[-1] / n[i]  # a text's own sums: the same whatever stands beside it
        best[i] = (own[window:] - own[:-window]).max() / window
    return mean, best


def _found(words: np.ndarray, hashes: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Ratios of hashed words from sorted ones; 0 for those that aren't there, such as the empty word."""
    if not len(hashes):
        return np.zeros(len(words))
    at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
    return np.where(hashes[at] == words, ratios[at], 0.0)


def _holds(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashed words are among sorted ones."""
    if not len(hashes):
        return np.zeros(len(words), bool)
    return hashes[np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)] == words


def _least_uses(ratios: DataFrame, words: int) -> int:
    """The least number of uses that at most so many words of ratios reach; 0 where all words are few enough."""
    left, least = words, 0
    for r in ratios.groupBy(F.least("n", F.lit(USES)).alias("n")).count().orderBy(F.desc("n")).collect():
        left -= r["count"]
        if left < 0:
            return least or USES + 1
        least = r["n"]
    return 0


def score_texts(docs: DataFrame, ratios: DataFrame, mean: str, peak: str, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """docs with two columns named by mean and peak: the features of each whole text.

    ratios: word_ratios' table. The words most used, broadcast_words at most, go to every task. All others are joined to the
    texts that hold them, whose ratios come back to a text as a list: what is joined grows with the rare words of the
    corpus, not with its text. How words are divided doesn't change the features.
    """
    least = _least_uses(ratios, broadcast_words)
    # uses beyond USES aren't told apart: such words are all among the most used, or none is
    often = F.least("n", F.lit(USES)) >= least
    rows = ratios.where(often).select("word", "ratio").toArrow()
    hashes, values = rows.column("word").to_numpy(), rows.column("ratio").to_numpy()
    by = np.argsort(hashes)
    model = docs.sparkSession.sparkContext.broadcast((hashes[by], values[by]))
    schema = StructType([*docs.schema.fields]).add(mean, "double").add(peak, "double")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(it, "text"):
            words, codes, starts = words_of(part.column("text"))
            a, b = text_features(_found(word_hashes(words), *model.value)[codes], starts)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(a), pa.array(b)], names=[*part.schema.names, mean, peak])

    if not least:
        return docs.mapInArrow(trimmed(run), schema)

    # rows meet their ratios by a hash: where two rows have the same, both get the ratios of both, and look up their own words alone
    row, pairs, keep = free_name(docs, "row"), free_name(docs, "pairs"), docs.columns
    keyed = docs.withColumn(row, F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if f.name == "text" or isinstance(f.dataType, NumericType))))
    held = _rare_words(keyed, row, model).join(ratios.where(~often).select("word", "ratio"), "word").groupBy("row").agg(F.collect_list(F.struct("word", "ratio")).alias(pairs))

    def run_joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in inflated(it, "text"):
            text = pa.array(texts, pa.binary()).cast(pa.string())
            words, codes, starts = words_of(text)
            own = part.column(pairs).flatten()
            h, first = np.unique(own.field("word").to_numpy(), return_index=True)
            hashed = word_hashes(words)
            a, b = text_features((_found(hashed, *model.value) + _found(hashed, h, own.field("ratio").to_numpy()[first]))[codes], starts)
            yield pa.RecordBatch.from_arrays([*(text if c == "text" else part.column(c) for c in keep), pa.array(a), pa.array(b)], names=[*keep, mean, peak])

    return deflated(keyed).join(held.withColumnRenamed("row", row), row, "left").mapInArrow(trimmed(run_joined), schema)


def _rare_words(docs: DataFrame, row: str, often) -> DataFrame:
    """row and word (its hash): the distinct words of each text that aren't among the broadcast ones."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(it, "text"):
            words, codes, starts = words_of(part.column("text"))
            hashes = word_hashes(words)
            rare = (~_holds(hashes, often.value[0]) & np.array([bool(w) for w in words], bool))[codes]
            at = np.unique(np.repeat(np.arange(part.num_rows), np.diff(starts))[rare] * len(words) + codes[rare])
            yield pa.RecordBatch.from_arrays([part.column(row).take(pa.array(at // max(1, len(words)))), pa.array(hashes[at % max(1, len(words))])], names=["row", "word"])

    return docs.select(row, "text").mapInArrow(trimmed(run), "row long, word long")


def _fit(rows: pa.Table) -> np.ndarray:
    """Logistic regression on mean and peak by Newton's method, with a little ridge."""
    rows = rows.sort_by([(c, "ascending") for c in ("mean", "peak", "label")])  # sums don't depend on the order in which rows arrive
    y, n = rows.column("label").to_numpy().astype(float), len(rows)
    if len(np.unique(y)) < 2:
        base = float(y.mean()) if n else 0.0
        return np.array([np.log((base * n + 0.5) / ((1 - base) * n + 5)), 0, 0])
    x = np.column_stack([np.ones(n), rows.column("mean").to_numpy(), rows.column("peak").to_numpy()])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([1e-6, 1e-2, 1e-2])
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return w


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", train_parts: tuple[int, ...] = (0, 1), fit_parts: tuple[int, ...] = (3,)) -> tuple[DataFrame, np.ndarray]:
    """The ratio of every word of docs, and how mean and peak become a probability.

    docs: key, text; labels: key and toxic (1, or anything else that isn't null). Every text of docs counts for the shared
    backoff. Labels count where crc32(key as text) mod 4 is in train_parts (the models) or in fit_parts (three numbers, from
    at most CALIBRATION_ROWS labelled texts, those of the smallest hash). Null labels and labels without a document don't
    count; a document labelled twice counts twice, and so does a label of two documents. No labels at all: every score is low.
    """
    part = F.crc32(F.col(key).cast("string").cast("binary")) % 4
    own = labels.where("toxic is not null").select(F.col(key), F.when(F.col("toxic") == 1, 1).otherwise(0).alias("label"))
    text = docs.select(key, "text")
    learned = deflated(text.where(part.isin(*train_parts))).join(own.where(part.isin(*train_parts)), key)
    ratios = word_ratios(word_counts(docs, learned))
    # at most CALIBRATION_ROWS keys, and of the rows that have them as many: two numbers each
    some = own.where(part.isin(*fit_parts)).orderBy(F.xxhash64(key), "label").limit(CALIBRATION_ROWS)
    sample = text.where(part.isin(*fit_parts)).join(F.broadcast(some), key).select("text", "label")
    features = score_texts(sample, ratios, "mean", "peak").select("label", "mean", "peak")
    return ratios, _fit(features.orderBy(F.xxhash64("label", "mean", "peak")).limit(CALIBRATION_ROWS).toArrow())


def scored(docs: DataFrame, model: tuple[DataFrame, np.ndarray], name: str = "score") -> DataFrame:
    """docs with the score (0 to 1) of each whole text, in a column of that name (one that docs has is replaced).

    Null and empty texts have ratio 0 and get the fit's constant. Equal texts get equal scores. An empty table stays empty.
    """
    ratios, w = model
    docs = docs.drop(name)
    mean, peak = free_name(docs, "mean"), free_name(docs, "peak")
    z = F.lit(float(w[0])) + F.lit(float(w[1])) * F.col(mean) + F.lit(float(w[2])) * F.col(peak)
    out = score_texts(docs, ratios, mean, peak)
    return out.withColumn(name, 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))).drop(mean, peak)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of documents: null ids aren't held out, repeated rows get equal scores."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
