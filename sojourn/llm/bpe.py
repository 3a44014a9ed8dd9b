"""BPE encoding through a distinct-word table, and decoding through an id-to-piece table.

Words are what the vocabulary's splitting pattern finds, and the special token, which texts may hold. Each distinct word is
encoded once (see dictionary.py) and ids go back to documents by position. The vocabulary file is a parameter, read in the tasks
by its path on their machines.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sojourn.llm import dictionary
from sojourn.llm.common import text_or_empty

#: Fixed value: how the byte-level vocabulary splits texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Beyond these ranges, versions of Unicode may differ in what is a letter: there the library splits.
RARE = regex.compile(r"[^\x00-՗ -⁰₠-₿℀-↋　-ゖ゠-ヿ一-龥가-힣]")
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def specials(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """The bytes of each id; special tokens are their own text."""
    t, letters, own = tokenizer(path), byte_letters(), specials(path)
    names = {i: w for w, i in t.get_vocab(with_added_tokens=True).items()}
    return [names[i].encode() if names.get(i) in own else bytes(letters[c] for c in names.get(i, "")) for i in range(max(names) + 1)]


def splitter(path: str) -> Callable[[str], list[str]]:
    """A text's words in order; nothing is lost between them."""
    found, mark = regex.compile(PATTERN).findall, regex.compile("(" + "|".join(map(regex.escape, specials(path))) + ")")
    library = tokenizer(path).pre_tokenizer

    def plain(text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)] if RARE.search(text) else found(text)

    def split(text: str) -> list[str]:
        parts = mark.split(text)
        if len(parts) == 1:
            return plain(text)
        return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else plain(p))]

    return split


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """id, piece: one row per id of the vocabulary."""
    return spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(pieces(path))], "id int, piece binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """row_id, text of a table (row_id, ids array<int>), by a join of the ids with the vocabulary's pieces. Null or empty ids decode
    to an empty text, bytes that are no UTF-8 to U+FFFD. row_id must be unique. The vocabulary bounds the side that is broadcast."""
    rows = encoded.select("row_id", F.posexplode_outer("ids").alias("at", "id"))
    joined = rows.join(F.broadcast(piece_table(encoded.sparkSession, path)), "id", "left")
    whole = joined.groupBy("row_id").agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", F.hex("piece").alias("piece"))))).alias("p"))
    return whole.select("row_id", F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["piece"]), "")), "utf-8").alias("text"))


def blocks_of(docs: DataFrame, path: str) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(False).alias("flag"), text_or_empty().alias("text"))
    return dictionary.split_blocks(rows, lambda: splitter(path))


def encoder(path: str) -> Callable[[list[str], np.ndarray], tuple[list[list[int]], None]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    t = tokenizer(path)

    def answer(words: list[str], _: np.ndarray) -> tuple[list[list[int]], None]:
        return [e.ids for i in range(0, len(words), 1000) for e in t.encode_batch(words[i : i + 1000], add_special_tokens=False)], None

    return answer


def _encoded(docs: DataFrame, path: str, keep_ids: bool) -> DataFrame:
    blocks = blocks_of(docs, path)

    def build(row: dict, found: pa.Table) -> pa.Table:
        table = pieces(path)
        sizes, codes = dictionary.unpack(row["sizes"]), dictionary.unpack_codes(row["codes"])
        start, ids = dictionary.gathered(found, int(codes.max()) + 1 if len(codes) else 0)
        length = np.fromiter(map(len, table), np.int64, len(table))
        begin, every = np.r_[0, np.cumsum(length)], np.frombuffer(b"".join(table), np.uint8)
        ends, docs = np.cumsum(sizes), len(sizes)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + keep_ids]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())][: 4 + keep_ids]

        def digest(doc: int | None, a: int, b: int) -> tuple:
            own = dictionary.pick(start, ids, codes[a:b])
            text = dictionary.pick(begin, every, own).tobytes().decode("utf-8", errors="replace")
            return doc, len(own), hashlib.sha256(own.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), own.astype(np.int32) if keep_ids else None

        parts = []
        for i in range(0, docs, 250):
            rows = [digest(*x) for x in zip(row["doc_ids"][i : i + 250], (ends - sizes)[i : i + 250], ends[i : i + 250])]
            parts.append(pa.table([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names))
        return pa.concat_tables(parts)

    found = dictionary.resolve(blocks, lambda: encoder(path))
    return dictionary.assemble(blocks.select("block", "doc_ids", "sizes", "codes"), found.drop("summary"), build, DIGESTS + ", ids array<int>" * keep_ids)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids. One row per row; null texts are empty, null doc_id stays null, repeated
    rows are encoded alike, an empty table gives no rows, further columns are ignored. Texts are encoded whole."""
    return _encoded(docs, path, True)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """`encode` without the ids themselves."""
    return _encoded(docs, path, False)
