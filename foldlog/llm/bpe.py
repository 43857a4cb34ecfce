"""Byte-level BPE: texts to ids with offsets, and ids back to bytes and text, over Arrow batches."""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import byte_slices, table, trimmed

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def byte_to_char() -> list[str]:
    """The printable character that stands for each byte: itself where printable Latin-1, else the next from U+0100 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def vocabulary(path: str) -> dict[str, int]:
    """The id of each token, its bytes written as characters."""
    table_ = byte_to_char()
    return {"".join(table_[x] for x in b): r for b, r in load_ranks(path).items()}


def tokenizer(path: str, pattern: str):
    """A tokenizers.Tokenizer that splits by pattern (none: not at all) and merges by the ranks of the file at path.

    Ranks name what is merged, not the two parts; so every way to part a token into two tokens is a merge, in the
    order of the token it makes. A match that is a token as a whole is not merged at all.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    ranks, table_ = load_ranks(path), byte_to_char()
    chars = lambda b: "".join(table_[x] for x in b)
    merges = [
        (chars(b[:i]), chars(b[i:])) for b, _ in sorted(ranks.items(), key=lambda x: x[1]) for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
    out = Tokenizer(models.BPE(vocab=vocabulary(path), merges=merges, ignore_merges=True))
    whole = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), whole]) if pattern else whole
    out.decoder = decoders.ByteLevel()
    return out


@functools.lru_cache(maxsize=2)
def id_bytes(path: str) -> list[bytes]:
    """The bytes of each id: what its characters in the vocabulary stand for, by the byte table's reverse."""
    back = {c: b for b, c in enumerate(byte_to_char())}
    vocab = vocabulary(path)
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(map(back.__getitem__, token))
    return out


def decode_bytes(ids: list[int], path: str) -> bytes:
    """The exact bytes of ids; ids may begin or end within a character."""
    return b"".join(map(id_bytes(path).__getitem__, ids))


def decode_text(ids: list[int], path: str) -> str:
    """The text of ids; a character that is split at either end, or broken within, becomes U+FFFD."""
    return decode_bytes(ids, path).decode("utf-8", "replace")


#: Characters that Python's re and Unicode classes see differently: numbers that are no decimals, and four separators.
_ODD = frozenset(c for c in map(chr, range(0x110000)) if unicodedata.category(c) in ("Nl", "No") or "\x1c" <= c <= "\x1f")
_CACHE_PIECES = 200_000


class Encoder:
    """Ids and offsets of texts, each match of a pattern encoded on its own by the tokenizers library.

    Matches that come again are looked up. The store is emptied when it is full: memory is bounded, results don't depend on it.
    """

    def __init__(self, path: str, pattern: str):
        import regex

        self.tok = tokenizer(path, "")  # pieces come split
        self.exact = regex.compile(pattern)
        # the same matches by the faster re module, wherever no odd character stands
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        self.quick = re.compile(plain)
        self.known: dict[str, tuple[int, ...]] = {}
        self.spans: dict[str, tuple[tuple[int, int], ...]] = {}

    def split(self, text: str) -> list[str]:
        return (self.quick if _ODD.isdisjoint(text) else self.exact).findall(text)

    def _learn(self, texts: list[list[str]], offsets: bool) -> None:
        if len(self.known) > _CACHE_PIECES:
            self.known, self.spans = {}, {}
        have = self.spans if offsets else self.known
        new = list({w for x in texts for w in x if w not in have})
        encode = self.tok.encode_batch if offsets else self.tok.encode_batch_fast
        for w, e in zip(new, encode(new, add_special_tokens=False), strict=True):
            self.known[w] = tuple(e.ids)
            if offsets:
                self.spans[w] = tuple(e.offsets)

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        self._learn(split, False)
        return [list(chain.from_iterable(map(self.known.__getitem__, x))) for x in split]

    def encode_with_offsets(self, texts: list[str]) -> list[tuple[list[int], list[int], list[int]]]:
        """ids, and where each begins and ends in characters; a character that is split between ids is in each of them."""
        split, out = [self.split(t) for t in texts], []
        self._learn(split, True)
        for x in split:
            ids, starts, ends, at = [], [], [], 0
            for w in x:
                ids += self.known[w]
                starts += [at + a for a, _ in self.spans[w]]
                ends += [at + b for _, b in self.spans[w]]
                at += len(w)
            out.append((ids, starts, ends))
        return out


def _slices(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of about a megabyte of text, so that memory is bounded by the longest one."""
    for part in byte_slices(it, "text", 1 << 20):
        yield part, [x or "" for x in part.column("text").to_pylist()]


def _with(schema: StructType, ddl: str) -> StructType:
    """schema without the columns that ddl names, and those."""
    new = StructType.fromDDL(ddl)
    return StructType([*(f for f in schema.fields if f.name not in new.names), *new.fields])


def bpe_encode(docs: DataFrame, path: str, pattern: str, offsets: bool = True) -> DataFrame:
    """docs with ids and, if asked for, starts and ends of each token in characters of the text.

    Whole texts, no special tokens. Null and empty texts: empty arrays. Columns of docs that are named so are replaced.
    """
    schema = _with(docs.schema, "ids array<int>" + (", starts array<int>, ends array<int>" if offsets else ""))
    keep = [c for c in docs.columns if c in schema.names and c not in ("ids", *(("starts", "ends") if offsets else ()))]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for part, texts in _slices(it):
            more = list(zip(*encoder.encode_with_offsets(texts), strict=True)) if offsets else [encoder.encode(texts)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(m, pa.list_(pa.int32())) for m in more)], names=schema.names)

    return docs.mapInArrow(trimmed(run), schema)


def bpe_decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with decoded (the exact bytes) and decoded_text (broken characters replaced). Null ids: null."""
    schema = _with(encoded.schema, "decoded binary, decoded_text string")
    keep = [c for c in encoded.columns if c not in ("decoded", "decoded_text")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                raw = [None if x is None else decode_bytes(x, path) for x in batch.column(ids).to_pylist()]
                text = [None if x is None else x.decode("utf-8", "replace") for x in raw]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(raw, pa.binary()), pa.array(text, pa.string())], names=schema.names)

    return encoded.mapInArrow(trimmed(run), schema)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text.

    What bpe_encode and bpe_decode do, one after the other in one task: ids are encoded, decoded through the byte table's reverse,
    and both are digested where they are made. Null and empty texts: no ids, digests of nothing. One row for each row of docs.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        decimal = [str(i) for i in range(len(id_bytes(path)))]
        for part, texts in _slices(it):
            n, ids_sha, text_sha = [], [], []
            for ids in encoder.encode(texts):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(decode_bytes(ids, path)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(trimmed(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents; see bpe_round_trip for null and empty texts."""
    import public_tokenizers

    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
