"""Encoding a corpus with a public byte-level BPE through a global shuffle of distinct words, and decoding it.

Method: documents are laid into blocks of bounded text; each block is cut into pre-tokens, its distinct words are numbered,
and it becomes one row per distinct word, with the word's number, and one row with the numbers in the order of their
positions. The words meet by word: every distinct word of the corpus is encoded once, and its ids are joined back to the
blocks that hold it. The blocks then gather their words' ids and put them down by position. Positions are shuffled once,
packed, at one or two bytes a token; a word that stands in every document is one row per block, never one per
occurrence. Decoding joins the token-byte table.

A null text has an empty list of ids as an empty one has, and decodes to an empty text; a repeated document is encoded again. Text longer than a block is a
block of its own.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import Workspace

TOKENIZER_DIR = "/opt/tokenizers"
#: How GPT-2 cuts text before the merges (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_CHARS = 2_000_000


@lru_cache(maxsize=4)
def _pattern():
    import regex

    return regex.compile(PATTERN)


@lru_cache(maxsize=4)
def ranks(tokenizer: str, folder: str = TOKENIZER_DIR) -> dict[bytes, int]:
    with open(os.path.join(folder, f"{tokenizer}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _word_encoder(tokenizer: str, folder: str):
    import tiktoken

    # One piece, whatever it holds: the words are cut already.
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks(tokenizer, folder), special_tokens={})


def encode_text(text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, memo: dict | None = None) -> list[int]:
    """Ids of one text; memo keeps the words met before."""
    enc = _word_encoder(tokenizer, folder)
    memo = {} if memo is None else memo
    out: list[int] = []
    for w in _pattern().findall(text):
        ids = memo.get(w)
        if ids is None:
            ids = enc.encode_ordinary(w)
            if len(memo) < 200_000:
                memo[w] = ids
        out += ids
    return out


def token_counts(docs: DataFrame, text: str, out: str = "n_tokens", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """docs with the number of tokens of the text, 0 for null; the text itself is left behind."""
    keep = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text) + f", `{out}` bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, cut, memo = _word_encoder(tokenizer, folder), _pattern(), {}
        for b in batches:
            counts = []
            for t in b.column(len(keep)).to_pylist():
                n = 0
                for w in cut.findall(t) if t else ():
                    k = memo.get(w)
                    if k is None:
                        k = len(enc.encode_ordinary(w))
                        if len(memo) < 200_000:
                            memo[w] = k
                    n += k
                counts.append(n)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(counts, pa.int64())], [*keep, out])

    return docs.select(*keep, text).mapInArrow(run, schema)


class _Numbers(dict):
    """word -> its number in order of first occurrence."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers in two or four bytes each, the width in front, compressed."""
    wide = len(numbers) and int(numbers.max()) > 0xFFFF
    raw = numbers.astype("<u4" if wide else "<u2").tobytes()
    return (b"4" if wide else b"2") + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    raw = pa.decompress(blob[9:], int.from_bytes(blob[1:9], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw, "<u4" if blob[:1] == b"4" else "<u2")


def _cut_blocks(docs: DataFrame, block_chars: int) -> DataFrame:
    """(block, doc_ids, ends, number, word, positions): word rows, and one row per block (word null) with its documents."""

    def flush(block: str, ids: list, texts: list) -> pa.RecordBatch:
        cut = _pattern()
        words: list[str] = []
        ends = []
        for t in texts:
            words += cut.findall(t)
            ends.append(len(words))
        code = _Numbers()
        codes = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
        n = len(code)
        none = [None] * n
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * (n + 1)), pa.array([*none, ids], pa.list_(pa.int64())), pa.array([*none, ends], pa.list_(pa.int64())), pa.array([*range(n), None], pa.int32()),
             pa.array([*code, None], pa.string()), pa.array([*none, _pack(codes)], pa.binary())],
            ["block", "doc_ids", "ends", "number", "word", "positions"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if texts and size + len(t) > block_chars:
                    yield flush(f"{part}-{k}", ids, texts)
                    k, ids, texts, size = k + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield flush(f"{part}-{k}", ids, texts)

    return docs.mapInArrow(run, "block string, doc_ids array<bigint>, ends array<bigint>, number int, word string, positions binary")


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR,
                  block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, ids): the token ids of every document without special tokens; an empty list for a null or empty text."""
    ws = Workspace(docs.sparkSession, "encode")
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    # Cut once and written: both the dictionary and the join below read it.
    rows = ws.write(_cut_blocks(d.where("text is not null"), block_chars), "words")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _word_encoder(tokenizer, folder)
        for b in batches:
            words = b.column(0)
            ids = [enc.encode_ordinary(w) for w in words.to_pylist()]
            yield pa.RecordBatch.from_arrays([words, pa.array(ids, pa.list_(pa.int32()))], ["w", "ids"])

    dictionary = rows.where("word is not null").select(F.col("word").alias("w")).distinct().mapInArrow(encode, "w string, ids array<int>")
    null = lambda kind: F.lit(None).cast(kind)
    placed = rows.where("word is not null").select("block", "number", "word").join(dictionary, F.col("word") == F.col("w")).select(
        "block", null("array<bigint>").alias("doc_ids"), null("array<bigint>").alias("ends"), "number", null("binary").alias("positions"), "ids")
    heads = rows.where("word is null").select("block", "doc_ids", "ends", "number", "positions", null("array<int>").alias("ids"))

    def assemble(t: pa.Table) -> pa.Table:
        doc_col = t.column("doc_ids").combine_chunks()
        head = int(np.flatnonzero(doc_col.is_valid().to_numpy(zero_copy_only=False))[0])
        docs_, ends = doc_col[head].as_py(), np.array(t.column("ends").combine_chunks()[head].as_py(), np.int64)
        at = _unpack(t.column("positions").combine_chunks()[head].as_py())
        ids = t.column("ids").combine_chunks()
        offsets, values = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy()
        rows_ = np.delete(np.arange(len(t)), head)
        numbers = t.column("number").combine_chunks().take(pa.array(rows_)).to_numpy(zero_copy_only=False).astype(np.int64)
        first, size = np.zeros(len(rows_), np.int64), np.zeros(len(rows_), np.int64)
        first[numbers], size[numbers] = offsets[rows_], offsets[rows_ + 1] - offsets[rows_]
        length = size[at]
        total = np.concatenate([[0], np.cumsum(length)])
        out = values[np.repeat(first[at] - total[:-1], length) + np.arange(total[-1])] if total[-1] else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], total[ends]]).astype(np.int32)), pa.array(out, pa.int32()))
        return pa.table({"doc_id": pa.array(docs_, pa.int64()), "ids": lists})

    whole = placed.unionByName(heads).groupBy("block").applyInArrow(assemble, "doc_id bigint, ids array<int>")
    return whole.unionByName(d.where("text is null").select("doc_id", F.array().cast("array<int>").alias("ids")))


def byte_table(spark, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(token, bytes) of the vocabulary: as many rows as it has tokens, 50 thousand at most here."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in ranks(tokenizer, folder).items()], "token int, bytes binary")


def decode_corpus(encoded: DataFrame, *, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the ids of all documents join the token-byte table."""
    table = byte_table(encoded.sparkSession, tokenizer, folder)
    pieces = encoded.where("ids is not null").select("doc_id", F.posexplode("ids").alias("pos", "token")).join(F.broadcast(table), "token")
    joined = pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("bytes").alias("h")))).alias("p"))
    text = joined.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")), "UTF-8").alias("text"))
    rest = encoded.where("ids is null or size(ids) = 0").select("doc_id", F.when(F.col("ids").isNotNull(), F.lit("")).alias("text"))
    return text.unionByName(rest)
