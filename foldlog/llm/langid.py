"""Language identification by n-gram filters: one bit-sliced Bloom filter answers for all languages at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_length, byte_slices, held_out, letter_codes, mix64, table

ORDERS, SLOTS, PROBES = range(1, 5), 1 << 20, 3
#: Texts are worked on in slices of so many bytes; results don't depend on it.
SLICE_BYTES = 1 << 22
#: A language's filter holds the n-grams of an order that are at least this share of its n-grams of that order: 4 * 5,000 at most.
LEAST_SHARE = 2e-4
UNKNOWN = "und"


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words (letters only, lower case), each word's place among them, and where texts begin."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}]+", " ")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(clean))
    words = lists.flatten().dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()


def ngrams(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """For words of one length and each order: hashes of their n-grams between two marks, a row for each word."""
    codes = letter_codes(words)
    gram = np.zeros_like(codes)
    for n in range(1, min(ORDERS[-1], codes.shape[1]) + 1):
        gram = gram[:, : codes.shape[1] - n + 1] + codes[:, n - 1 :] * np.uint64(pow(0x9E3779B97F4A7C15, n - 1, 1 << 64))
        if n in ORDERS:
            own = gram[:, 1:-1] if n == 1 else gram  # a mark alone is no n-gram
            yield n, mix64(own + np.uint64(n))


def language_ngrams(docs: DataFrame) -> DataFrame:
    """lang, order, gram (its hash), n: the n-grams that are frequent in each language of docs (text, lang; null lang: left out).

    A null or empty text has none, repeated rows count as often as they stand there, other columns aren't read.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(it, "text", SLICE_BYTES):
            words, codes, starts = words_of(part.column("text"))
            langs = np.repeat(np.asarray(part.column("lang").to_pylist(), dtype=object), np.diff(starts))
            for lang in set(langs):
                times = np.bincount(codes[langs == lang], minlength=len(words))
                own = [i for i in np.flatnonzero(times) if words[i]]
                found: dict[int, list] = {n: [] for n in ORDERS}
                for at, same in by_length([words[i] for i in own]):
                    weight = times[np.array(own)[at]]
                    for n, h in ngrams(same):
                        found[n].append((h.ravel(), np.repeat(weight, h.shape[1])))
                for n, parts in found.items():
                    if parts:
                        gram, place = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
                        count = np.bincount(place, np.concatenate([w for _, w in parts])).astype(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), n, np.int32)), pa.array(gram.view(np.int64)), pa.array(count)], names=["lang", "order", "gram", "n"])

    counts = docs.where("lang is not null").select("text", "lang").mapInArrow(run, "lang string, order int, gram long, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
    whole = counts.groupBy("lang", "order").agg(F.sum("n").alias("whole"))
    return counts.join(whole, ["lang", "order"]).where(F.col("n") >= LEAST_SHARE * F.col("whole")).select("lang", "order", "gram", "n")


class Filters:
    """A row of the table is a slot, a column is a language: PROBES rows, taken together, name all languages with an n-gram."""

    def __init__(self, grams: dict[str, list[int]]):
        self.langs = sorted(grams)
        self.table = np.zeros((SLOTS, (len(self.langs) + 63) // 64), dtype=np.uint64)
        for i, lang in enumerate(self.langs):
            self.table[slots(np.array(grams[lang], np.int64).view(np.uint64)).ravel(), i // 64] |= np.uint64(1 << (i % 64))
        filled = self.columns(self.table).mean(axis=0) if self.langs else np.zeros(0)
        self.false_rate = filled**PROBES  # of an n-gram that the language's filter doesn't hold

    def columns(self, masks: np.ndarray) -> np.ndarray:
        """masks' bits as 0 and 1, a column for each language."""
        return np.stack([(masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) for i in range(len(self.langs))], axis=1).astype(np.uint8)

    def hits(self, words: list[str]) -> np.ndarray:
        """For each word: number of n-grams, then hits by language."""
        out = np.zeros((len(words), 1 + len(self.langs)))
        for at, own in by_length(words):
            for _, h in ngrams(own) if own[0] else ():
                rows = np.bitwise_and.reduce(self.table[slots(h.ravel())], axis=1)
                out[at, 0] += h.shape[1]
                out[at, 1:] += self.columns(rows).reshape(*h.shape, -1).sum(axis=1, dtype=np.int64) if self.langs else 0
        return out


def slots(grams: np.ndarray) -> np.ndarray:
    return (grams.reshape(-1, 1) >> (np.uint64(20) * np.arange(PROBES, dtype=np.uint64))).astype(np.int64) % SLOTS


def train(docs: DataFrame) -> Filters:
    """Filters of the languages of docs; the driver gets at most 20,000 n-grams a language, from all texts."""
    grams: dict[str, list[int]] = {}
    for r in language_ngrams(docs).toLocalIterator():
        grams.setdefault(r["lang"], []).append(r["gram"])
    return Filters(grams)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs without its text, with lang_pred and score of each whole text.

    Of the n-grams of a text, a language's popcount, less the false positives its filter's fill lets expect, decides;
    score is its share of all languages' corrected counts. Ties go to the first language by code point. No letter or
    null text: und, 0. Letters that no filter knows: the first language, score 1 / number of languages. Repeated rows
    get equal answers; columns of docs that are named lang_pred or score give way to the results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    keep = [c for c in docs.columns if c.lower() not in ("text", "lang_pred", "score")]
    docs = docs.select(*(F.col(f"`{c}`") for c in [*keep, "text"]))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in byte_slices(it, "text", SLICE_BYTES):
            words, codes, starts = words_of(part.column("text"))
            by_word = own.hits(words)
            sums = np.vstack([np.zeros(by_word.shape[1]), np.cumsum(by_word[codes], axis=0)])
            got = sums[starts[1:]] - sums[starts[:-1]]
            lang, score = [], []
            for n, *hits in got:
                if not n or not own.langs:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                true = np.maximum((np.array(hits) - n * own.false_rate) / (1 - own.false_rate), 0)
                best, total = int(true.argmax()), true.sum()
                lang.append(own.langs[best])
                score.append(float(true[best] / total) if total > 0 else 1 / len(own.langs))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by filters of the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    filters = train(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), filters)
