"""Alignment of two tokenizers' tokens over the same text, by a transducer of dangling suffixes.

Both token sequences spell the same bytes. The transducer's state is the side that is ahead and its bytes that the other side hasn't
spelt yet; the next token always comes from the side behind, and a group closes whenever no bytes are left over. Transitions by
state and token are remembered. Neither vocabulary has a token that goes on over the start of white space before a word, so texts
are aligned by such words: each distinct word of a block of documents once, and each part of words once (see Words).

How often an id pair ends together over all documents needs one grouping by pair. Where two tokens end together one is a suffix of the
other, so there are at most as many pairs as the two vocabularies' tokens have bytes (some half a million for 50,000 and 32,000 tokens):
that table, and no more, goes to all tasks.
"""

from __future__ import annotations

import gc
import hashlib
import os
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sojourn.llm.bpe import PATTERN, RARE, byte_letters
from sojourn.llm.common import bound_batches, byte_view, materialize, slices, text_or_empty
from sojourn.llm.dictionary import pack, unpack, unpack_codes

BLOCK_BYTES = 8 << 20
#: Words, and parts of words, of a task that are remembered from block to block; then it forgets them all.
KNOWN = 400_000
#: White space before a word, and the word; a space or line feed ends it, other white space doesn't. Spaces at the text's end go with the last word.
WORDS = regex.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:\s+\Z)?|\s+")
#: Code points that are white space to some libraries only: a text with them is one word.
ODD = regex.compile("[\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]")
SPLIT = regex.compile(PATTERN).findall
#: What may close a word of letters; the first vocabulary splits it off as one.
CLOSING = ".,;:!?\"')"
PAIR = 1 << 20


class Transducer:
    """States are numbered from 0 (nothing left over); `ahead` tells which side's bytes `left` holds, and next[state] remembers the
    states after tokens: -1 if a token's bytes contradict those left over."""

    def __init__(self, a: list[bytes], b: list[bytes], most: int = 1 << 20) -> None:
        self.tokens, self.most = (a, b), most
        self.clear()

    def clear(self) -> None:
        self.ahead, self.left, self.next, self.size = [1], [b""], [{}], 0
        self.number = {(1, b""): 0}

    def step(self, state: int, token: int) -> int:
        """The state after the next token of the side behind."""
        ahead, left = self.ahead[state], self.left[state]
        new = self.tokens[1 - ahead][token]
        short, long_ = sorted((left, new), key=len)
        found = -1
        if long_.startswith(short):
            rest = long_[len(short) :]
            key = (1, b"") if not rest else (ahead if long_ is left else 1 - ahead, rest)
            found = self.number.setdefault(key, len(self.left))
            if found == len(self.left):
                self.ahead.append(key[0])
                self.left.append(rest)
                self.next.append({})
        self.next[state][token] = found
        self.size += 1
        return found

    def cuts(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """Tokens of either side up to the end of each group; None if the two sides spell different bytes."""
        if self.size > self.most:
            self.clear()
        following, ahead, n, m, i, j, out, state = self.next, self.ahead, len(a), len(b), 0, 0, [], 0
        while i < n or j < m:
            if ahead[state]:
                if i == n:
                    return None
                token, i = a[i], i + 1
            else:
                if j == m:
                    return None
                token, j = b[j], j + 1
            after = following[state].get(token)
            state = self.step(state, token) if after is None else after
            if not state:
                out.append((i, j))
            elif state < 0:
                return None
        return None if state else out


@lru_cache(maxsize=1)
def _sides(a_path: str, b_path: str) -> tuple:
    """The two tokenizers and the bytes of their tokens."""
    a, b, letters = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path), byte_letters()
    a.encode_special_tokens = True  # the strings of special tokens are plain text
    names = {i: w for w, i in a.get_vocab(with_added_tokens=True).items()}
    left = [bytes(letters[c] for c in names.get(i, "")) if all(c in letters for c in names.get(i, "")) else names[i].encode() for i in range(max(names) + 1)]
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    if max(len(left), len(pieces)) > PAIR:
        raise ValueError("a vocabulary has more ids than a pair's code can hold")
    if not set(letters) <= set(names.values()):
        raise ValueError("the byte-level vocabulary lacks a byte")
    if any(regex.search("[^▁]▁", p) for p in pieces):
        raise ValueError("a piece goes on over a space: texts can't be aligned word by word")
    right = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    joined = {p[i : i + 2] for p in (p.replace("▁", " ") for i, p in enumerate(pieces) if not b.is_byte(i)) for i in range(len(p) - 1)}
    if any("\n" in p for p in joined):
        raise ValueError("a piece has a line feed: parts of words can't be encoded apart")
    return a, b, left, right, joined


def pair_bound(a_path: str, b_path: str) -> int:
    """More pairs than this can't end together: one token of a pair is a suffix of the other."""
    _, _, left, right, _ = _sides(a_path, b_path)
    tails: dict[bytes, int] = {}
    for t in right:
        tails[t] = tails.get(t, 0) + 1
    heads: dict[bytes, int] = {}
    for t in left:
        heads[t] = heads.get(t, 0) + 1
    return sum(tails.get(t[i:], 0) for t in left for i in range(len(t))) + sum(heads.get(t[i:], 0) for t in right for i in range(1, len(t)))


class Words:
    """Aligned words of a task: groups as text, numbers of tokens of either side, codes of the pairs that end together (64-bit integers
    as bytes); None where the bytes differ.

    A word is cut into parts where the first vocabulary splits and no piece of the second has the two characters next to each other:
    neither has a token over such a place. Parts are encoded and aligned once."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a, self.b, self.left, self.right, self.joined = _sides(a_path, b_path)
        self.transducer, self.model, self.split = Transducer(self.left, self.right), self.a.model, self.a.pre_tokenizer
        self.letters = {b: c for c, b in byte_letters().items()}
        self.space = self.letters[32]
        self.names = [[str(i) for i in range(len(side))] for side in (self.left, self.right)]
        self.known: dict[str, tuple | None] = {}
        self.parts: dict[str, tuple | None] = {}

    def cut(self, word: str) -> list[tuple[str, list[str]]]:
        """The parts of a word, each with how the first vocabulary splits it."""
        if not word.isascii() and RARE.search(word):
            split = [word[a:b] for _, (a, b) in self.split.pre_tokenize_str(word)]
        elif word[0] == " " and (core := word.rstrip(CLOSING))[1:].isalpha():
            split = [word] if len(core) == len(word) else [core, word[len(core) :]]
        else:
            split = SPLIT(word)
        if len(split) == 1 or "▁" in word:
            return [(word, split)]
        out, begin = [], 0
        for k in range(1, len(split)):
            if split[k - 1][-1] + split[k][0] not in self.joined:
                out.append(("".join(split[begin:k]), split[begin:k]))
                begin = k
        return [*out, ("".join(split[begin:]), split[begin:])]

    def first_ids(self, split: list[str]) -> list[int]:
        ids = []
        for s in split:
            spelt = s.replace(" ", self.space) if s.isascii() and s.isprintable() else s.encode().decode("latin-1").translate(self.letters)
            ids += [t.id for t in self.model.tokenize(spelt)]
        return ids

    def add(self, words: list[str]) -> None:
        """Encode and align words that aren't known yet."""
        parts, todo, cut = self.parts, {}, []
        for w in words:
            own = self.cut(w)
            cut.append(own)
            for k, split in own:
                if k not in parts:
                    todo[k] = split
        items = iter(todo.items())
        while own := list(islice(items, 1000)):
            # the model adds a space in front: it is the part's own, or a line feed, which no piece has, keeps it apart
            plain = [k[0] == " " and k != " " for k, _ in own]
            other = self.b.encode([k[1:] if p else "\n" + k for (k, _), p in zip(own, plain)], num_threads=1)
            for (k, split), p, ids in zip(own, plain, other):
                parts[k] = self.aligned(self.first_ids(split), ids if p else ids[2:])
        for w, own in zip(words, cut):
            if len(own) == 1:
                self.known[w] = parts[w]
                continue
            found = [parts[k] for k, _ in own]
            self.known[w] = None if None in found else (";".join([e[0] for e in found]), sum([e[1] for e in found]), sum([e[2] for e in found]), b"".join([e[3] for e in found]))

    def aligned(self, a: list[int], b: list[int]) -> tuple | None:
        """Groups of a part; the first vocabulary has all bytes, so it always spells the text, and the other side has to agree."""
        cuts = self.transducer.cuts(a, b)
        if cuts is None:
            return None
        names, other = self.names
        ids, more, groups, i, j = [names[x] for x in a], [other[x] for x in b], [], 0, 0
        for k, m in cuts:
            groups.append(f"{ids[i] if k - i == 1 else ','.join(ids[i:k])}|{more[j] if m - j == 1 else ','.join(more[j:m])}")
            i, j = k, m
        return ";".join(groups), len(a), len(b), array("q", [a[k - 1] * PAIR + b[m - 1] for k, m in cuts]).tobytes()

    def forget(self) -> None:
        for kept in (self.known, self.parts):
            if len(kept) > KNOWN:
                kept.clear()


def words_of(text: str) -> list[str]:
    """The words of a space and the text, in order, each of which begins with a space; nothing is lost between them."""
    text = " " + text
    return [text] if ODD.search(text) else WORDS.findall(text)


BLOCKS = pa.schema(
    [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("codes", pa.binary()), ("digests", pa.list_(pa.string())), ("groups", pa.list_(pa.string())), ("n_a", pa.binary()), ("n_b", pa.binary()), ("ends", pa.binary()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
)
_BLOCKS = "block long, doc_ids array<long>, sizes binary, codes binary, digests array<string>, groups array<string>, n_a binary, n_b binary, ends binary, links binary, pairs array<long>, counts array<long>"


class Block:
    """Documents as codes of the block's distinct words, and the words' links as places among the block's distinct pairs."""

    def __init__(self, number: int, words: Words, keep: bool) -> None:
        self.number, self.words, self.keep, self.size = number, words, keep, 0
        self.code: dict[str, int] = defaultdict(count().__next__)  # no cycle: they aren't collected here
        self.entries: list[tuple] = []
        self.texts: list[str] = []
        self.broken: set[int] = set()
        self.ids, self.codes, self.digests, self.groups = [], [], [], []

    def add(self, doc: int | None, text: str, size: int) -> None:
        own, n = words_of(text) if text else [], len(self.code)
        codes = list(map(self.code.__getitem__, own))
        if len(self.code) > n:
            known, fresh = self.words.known, [*islice(reversed(self.code), len(self.code) - n)][::-1]
            self.words.add([w for w in fresh if w not in known])
            for k, w in enumerate(fresh, n):
                entry = known[w]
                if entry is None:
                    self.broken.add(k)
                    entry = ("", 0, 0, b"")
                self.entries.append(entry)
                self.texts.append(entry[0])
        if self.broken and not self.broken.isdisjoint(codes):
            codes = []
        groups = ";".join(map(self.texts.__getitem__, codes))
        self.ids.append(doc)
        self.codes.append(np.array(codes, np.int32))
        self.digests.append(hashlib.sha256(groups.encode()).hexdigest() if codes else "")
        self.groups.append(groups if self.keep else None)
        self.size += size

    def row(self) -> pa.RecordBatch:
        entries = self.entries
        pairs, links = np.unique(np.frombuffer(b"".join([e[3] for e in entries]), np.int64), return_inverse=True)
        sizes, codes = np.array([len(c) for c in self.codes]), np.concatenate(self.codes)
        ends = np.fromiter((len(e[3]) // 8 for e in entries), np.int64, len(entries))
        often = np.repeat(np.bincount(codes, minlength=len(entries)), ends)
        counts = np.bincount(links, often, minlength=len(pairs)).astype(np.int64)
        a, b = (np.fromiter((e[k] for e in entries), np.int64, len(entries)) for k in (1, 2))
        values = [self.number, self.ids, pack(sizes), pack(codes), self.digests, self.groups if self.keep else None, pack(a), pack(b), pack(ends), pack(links), pairs, counts]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, BLOCKS.types)], schema=BLOCKS)


def _blocks(docs: DataFrame, a_path: str, b_path: str, keep: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # millions of small tuples, and no cycles among them
        words = Words(a_path, b_path)
        block = Block(TaskContext.get().partitionId() << 32, words, keep)
        for batch in batches:
            _, starts = byte_view(batch.column("text"))
            for i, j in slices(starts, 1 << 20):
                part = batch.slice(i, j - i)
                for doc, text, size in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), np.diff(starts[i : j + 1]).tolist()):
                    if block.ids and block.size + size > BLOCK_BYTES:
                        yield block.row()
                        words.forget()
                        block = Block(block.number + 1, words, keep)
                    block.add(doc, text, size)
        if block.ids:
            yield block.row()
        gc.enable()

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return materialize(rows.mapInArrow(run, _BLOCKS), "aligned-blocks")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, a, b, count, best: how often ids a and b end together in all documents, and whether that is the most of any a with this b."""
    rows = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.counts").alias("count"))
    sums = rows.groupBy("pair").agg(F.sum("count").alias("count")).where("count > 0")
    named = materialize(sums.select("pair", F.expr(f"pair div {PAIR}").cast("int").alias("a"), F.expr(f"pair % {PAIR}").cast("int").alias("b"), "count"), "pair-counts")
    most = named.groupBy(F.col("b").alias("_b")).agg(F.max("count").alias("_most"))
    return named.join(most, F.col("b") == F.col("_b")).select("pair", "a", "b", "count", (F.col("count") == F.col("_most")).alias("best"))


OUT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string())])
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, so many each."""
    total = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def align(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs). documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups of each row of
    docs (doc_id, text). pairs: a, b, count, best of each pair of ids that end together somewhere.

    A space and the text are encoded by the byte-level vocabulary of a_path, the text by the sentencepiece model of b_path, which adds
    the space. Groups are written `a1,a2|b1;a3|b2,b3`, kept as text only if keep_groups. Texts that are null or empty, or of which
    a side doesn't give back the bytes, have no tokens: zeros and empty strings. Null doc_id stays null, repeated rows are each counted,
    ties for the highest count are all best, an empty table gives no rows, further columns are ignored. Texts are aligned whole. Memory:
    a block of documents of BLOCK_BYTES, or one longer document; and the table of pairs, whose size the vocabularies bound."""
    blocks = _blocks(docs, a_path, b_path, keep_groups)
    pairs = materialize(pair_counts(blocks), "pairs")
    if (n := pairs.count()) > (bound := pair_bound(a_path, b_path)):
        raise ValueError(f"{n} pairs of ids, more than the {bound} that two vocabularies allow")
    table = pairs.select("pair", "count", "best").toArrow().sort_by("pair")
    pair, count, best = (table.column(c).to_numpy() for c in ("pair", "count", "best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            sizes, codes, ends, links = unpack(row["sizes"]), unpack_codes(row["codes"]), unpack(row["ends"]), unpack_codes(row["links"])
            at = np.minimum(np.searchsorted(pair, np.array(row["pairs"], np.int64)), max(len(pair) - 1, 0))
            word = [unpack(row["n_a"]), unpack(row["n_b"]), ends]
            word += [_sums(x[at][links] if len(links) else np.zeros(0, np.int64), ends) for x in (best.astype(np.int64), count)]
            a, b, n, best_, sum_ = (_sums(w[codes] if len(w) else np.zeros(0, np.int64), sizes) for w in word)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((row["doc_ids"], a, b, n, n, best_, sum_, row["digests"], row["groups"] or [None] * len(a)), OUT.types)], schema=OUT)

    columns = ["doc_ids", "sizes", "codes", "digests", "groups", "n_a", "n_b", "ends", "links", "pairs"]
    return blocks.select(*columns).mapInArrow(run, _OUT), pairs.drop("pair")
