"""Distinct-word tables by blocks of documents.

Texts are split into words once; a block of documents keeps its distinct words and, for each word position, a code into them.
The blocks are written to the shared warehouse, bucketed, so their codes never move. A block then sends each of its distinct words once, however often it occurs, to the
word's bucket, packed with the block's other words there; a resolver answers each distinct word of a bucket once, and the answers
go back to the blocks. A word has one entry per block at most, so frequent words are no hot keys.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.common import bound_batches, bucketed, byte_view, slices

BLOCK_BYTES = 10 << 20
BLOCKS = "block long, doc_ids array<long>, flags array<boolean>, sizes binary, codes binary, words array<string>, counts array<int>"


def pack(values: np.ndarray) -> bytes:
    """32-bit integers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_codes(data: bytes) -> np.ndarray:
    """The integers as they were packed, of 32 bits."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel()


def unpack(data: bytes) -> np.ndarray:
    return unpack_codes(data).view("<u4").astype(np.int64)


class Block:
    """What is kept of the documents of a block so far: their words' codes and the distinct words, not their texts."""

    def __init__(self, number: int) -> None:
        self.number, self.size, self.ids, self.flags, self.codes = number, 0, [], [], []
        self.known: dict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__

    def add(self, doc: int | None, flag: bool, words: list[str], size: int) -> None:
        self.ids.append(doc)
        self.flags.append(flag)
        self.codes.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))
        self.size += size

    def row(self) -> pa.RecordBatch:
        sizes, codes = np.array([len(c) for c in self.codes]), np.concatenate(self.codes)
        counts = np.bincount(codes[np.repeat(self.flags, sizes)], minlength=len(self.known))
        row = {"block": self.number, "doc_ids": self.ids, "flags": self.flags, "sizes": pack(sizes), "codes": pack(codes), "words": list(self.known), "counts": counts.astype(np.int32)}
        kinds = {"block": pa.int64(), "doc_ids": pa.list_(pa.int64()), "flags": pa.list_(pa.bool_()), "sizes": pa.binary(), "codes": pa.binary(), "words": pa.list_(pa.string()), "counts": pa.list_(pa.int32())}
        return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in kinds.items()], names=list(kinds))


def split_blocks(docs: DataFrame, words_of: Callable[[], Callable[[str], list[str]]], most: int = BLOCK_BYTES) -> DataFrame:
    """Write blocks of docs (doc_id long, flag boolean, text string). words_of() gives the splitter, made once a task.

    counts has each word's occurrences in documents whose flag is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, block = words_of(), Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            _, starts = byte_view(batch.column("text"))
            for i, j in slices(starts, 1 << 20):
                part = batch.slice(i, j - i)
                for doc, flag, text, size in zip(*(part.column(c).to_pylist() for c in ("doc_id", "flag", "text")), np.diff(starts[i : j + 1]).tolist()):
                    if block.ids and block.size + size > most:
                        yield block.row()
                        block = Block(block.number + 1)
                    block.add(doc, flag, split(text), size)
        if block.ids:
            yield block.row()

    bound_batches(docs.sparkSession)
    return bucketed(docs.select("doc_id", "flag", "text").mapInArrow(run, BLOCKS), "blocks", "block")


def bucket_of(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.int64, len(words)) % buckets


DEALT = {"bucket": pa.int32(), "block": pa.int64(), "at": pa.binary(), "words": pa.binary(), "counts": pa.binary()}
ANSWERS = "block long, at binary, ends binary, values binary, summary array<long>"


def _deal(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The words of a block by bucket, packed: a few rows for each block, however many words it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, listed, counted in (x for b in batches for x in zip(b.column("block").to_pylist(), b.column("words"), b.column("counts"))):
            words, counts, rows = listed.values.cast(pa.large_binary()), counted.values.to_numpy().astype(np.int64), []
            bucket = bucket_of(words.to_pylist(), buckets)
            order = np.argsort(bucket, kind="stable")
            data, starts = byte_view(words.take(pa.array(order)))
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
            for a, b in zip(cuts[:-1], cuts[1:]):
                at = order[a:b]
                text = pack(np.diff(starts[a : b + 1]))
                raw = zstandard.ZstdCompressor(level=1).compress(data[starts[a] : starts[b]].tobytes())
                rows.append((int(bucket[at[0]]), block, pack(np.diff(at, prepend=0)), len(text).to_bytes(4) + text + raw, pack(counts[at])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, DEALT.values())], names=list(DEALT))

    return run


def _words(data: bytes) -> list[str]:
    n = int.from_bytes(data[:4])
    ends = np.cumsum(unpack(data[4 : 4 + n]))
    text = zstandard.ZstdDecompressor().decompress(data[4 + n :])
    return [text[a:b].decode() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def resolve(blocks: DataFrame, resolver: Callable[[], Callable[[list[str], np.ndarray], tuple[list[list[int]], list[int] | None]]], bucket_words: int = 2_000_000) -> DataFrame:
    """Rows (block, at, ends, values, summary): answers for words of blocks, packed.

    Words are dealt into buckets by their hash; each bucket is read once and its distinct words are answered once. resolver() gives
    a function from distinct words and their counts over all blocks to a list of integers for each word, and a summary, which is on
    one row of the bucket. The number of buckets follows the number of words, so a bucket's size is bounded at any scale."""
    total = blocks.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    buckets = max(256, total // bucket_words)

    def answered(held: list[dict], answer: Callable) -> pa.RecordBatch:
        known: dict[str, int] = defaultdict()
        known.default_factory = known.__len__
        codes = [np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in (_words(r["words"]) for r in held)]
        totals = np.bincount(np.concatenate(codes), np.concatenate([unpack(r["counts"]) for r in held])).astype(np.int64)
        answers, summary = answer(list(known), totals)
        start = np.r_[0, np.cumsum(np.fromiter(map(len, answers), np.int64, len(answers)))]
        values = np.fromiter((x for a in answers for x in a), np.int64, int(start[-1]))
        rows = [(r["block"], r["at"], pack(start[c + 1] - start[c]), pack(pick(start, values, c)), summary if not k else None) for k, (r, c) in enumerate(zip(held, codes))]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["block", "at", "ends", "values", "summary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer, held = resolver(), []
        for row in (r for b in batches for r in b.to_pylist()):
            if held and row["bucket"] != held[0]["bucket"]:
                yield answered(held, answer)
                held = []
            held.append(row)
        if held:
            yield answered(held, answer)

    dealt = blocks.select("block", "words", "counts").mapInArrow(_deal(buckets), "bucket int, block long, at binary, words binary, counts binary")
    return dealt.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(run, ANSWERS)


def gathered(rows: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (one more than words) and values of the answers to a block's n words."""
    size, parts = np.zeros(n, np.int64), []
    for at, ends, values in zip(*(rows.column(k).to_pylist() for k in ("at", "ends", "values"))):
        at, k = np.cumsum(unpack(at)), unpack(ends)
        size[at] = k
        parts.append((at, k, unpack(values)))
    start = np.r_[0, np.cumsum(size)]
    out = np.zeros(start[-1], np.int64)
    for at, k, v in parts:
        out[np.repeat(start[at] - (np.cumsum(k) - k), k) + np.arange(len(v))] = v
    return start, out


def pick(start: np.ndarray, values: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The answers of a sequence of words, end to end."""
    n = start[codes + 1] - start[codes]
    return values[np.repeat(start[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def assemble(blocks: DataFrame, packed: DataFrame, build: Callable[[dict, pa.Table], pa.Table], schema: str) -> DataFrame:
    """build(block row, its packed rows) for each block, whose words, if they are among its columns, are an Arrow array; a block and its answers are bounded by BLOCK_BYTES of text. The chunks of
    the tables that it makes go on one by one."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.drop_columns([c for c in ("words",) if c in left.column_names]).to_pylist()
        words = [w.values for w in left.column("words")] if "words" in left.column_names else [None] * len(rows)
        return pa.concat_tables([build(row | {"words": w}, right) for row, w in zip(rows, words)])

    return blocks.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(run, schema)
