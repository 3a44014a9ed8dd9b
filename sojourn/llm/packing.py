"""Packing of tokenized documents into sequences by best fit and a local search of swaps.

Encoding is map-only. Where pieces of documents go depends on their lengths alone, so only a row number and a length are dealt into
shards, evenly. A shard starts from best fit by decreasing length. Then the emptiest sequence gives documents to other sequences that
aren't full: one moves, one goes for one, one for two, or two for one, and of all exchanges that is taken which raises the sum of
squared fills most. Sequences run empty by this; the search ends where no exchange raises the sum, or a lower bound shows that no fewer
sequences are possible. The emptiest sequence of each shard is packed again with those of the other shards, in fewer shards, until there
is one.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sojourn.llm.bpe import byte_letters
from sojourn.llm.common import bound_batches, materialize, text_or_empty

#: Words and parts of a task whose ids are remembered; then it forgets them all.
KNOWN = 500_000
SHARD_PIECES = 100_000


#: Words of ASCII and Latin letters, whose lower case and normal form are the same everywhere; the vocabulary's rule for splitting them.
PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+", re.ASCII)


class PartIds(dict):
    """Ids of a word's parts, from the vocabulary's model alone."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.model, self.letters = tokenizer.model, {b: c for c, b in byte_letters().items()}

    def __missing__(self, part: str) -> bytes:
        found = self.model.tokenize(part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters))
        ids = self[part] = array("I", [t.id for t in found]).tobytes()
        return ids


class WordIds(dict):
    """Ids of words between ASCII white space, as 32-bit little-endian bytes, encoded once. The vocabulary drops white space and no rule of
    its own goes on over it, so words give the ids of the text. Plain words are cut into parts here; others go through the library whole."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.parts, self.marks = PartIds(self.tokenizer), [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if word.isascii() or PLAIN.fullmatch(text):
            parts = self.parts
            ids = b"".join([parts[p] for p in PARTS.findall(text.lower())])
        else:
            ids = self.whole(word)
        if len(word) <= 100:
            self[word] = ids
        return ids

    def of(self, text: bytes) -> bytes:
        if len(self) + len(self.parts) > KNOWN:
            self.clear()
            self.parts.clear()
        words = text.split()
        if any(m in text for m in self.marks):
            self.update({w: self.whole(w) for w in set(words) if any(m in w for m in self.marks)})
        return b"".join([self[w] for w in words])


PIECES = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int32())}


def pieces(docs: DataFrame, path: str, most: int = 4096, closing: int = 1, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if keep_ids, ids: each document's ids and then `closing`, in pieces of `most` ids
    of which only the last may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, names = WordIds(path), np.array([closing], "<u4").tobytes(), list(PIECES)[: 5 + keep_ids]
        for doc_ids, texts in ((p.column(0).to_pylist(), p.column(1).cast(pa.binary()).to_pylist()) for b in batches for p in (b.slice(i, 200) for i in range(0, b.num_rows, 200))):
            rows = []
            for doc, text in zip(doc_ids, texts):
                ids = words.of(text) + end
                for k, a in enumerate(range(0, len(ids), 4 * most)):
                    own = ids[a : a + 4 * most]
                    rows.append((doc, k, a // 4, len(own) // 4, zlib.crc32(own), *([np.frombuffer(own, "<i4")] * keep_ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, PIECES[k]) for k, c in zip(names, zip(*rows))], names=names)

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def lower_bound(lengths: np.ndarray, most: int) -> int:
    """No packing has fewer sequences: by the sum, and, for each k up to half of most, counting that pieces longer than most - k stand
    without any of k or more, and those over a half apart from each other."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=most + 1)
    number, total = np.cumsum(count), np.cumsum(count * np.arange(most + 1))
    k = np.arange(most // 2 + 1)
    alone, over = number[most] - number[most - k], number[most - k] - number[most // 2]
    free = over * most - (total[most - k] - total[most // 2])
    small = total[most // 2] - np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    return max(-(-int(lengths.sum()) // most), int((alone + over + np.maximum(0, -(-(small - free) // most))).max()))


class Packing:
    """Sequences of pieces, by their places in lengths."""

    def __init__(self, lengths: np.ndarray, most: int) -> None:
        self.lengths, self.most = lengths.tolist(), most
        self.bins: list[list[int]] = []
        self.fill: list[int] | np.ndarray = []
        self.returns: list[np.ndarray | None] = []

    def best_fit(self) -> None:
        """Longest first, each into the fullest sequence that has room for it."""
        rooms: list[list[int]] = [[] for _ in range(self.most + 1)]
        free = 0  # bit r: a sequence with room r
        for i in np.argsort(-np.array(self.lengths, np.int64), kind="stable").tolist():
            n = self.lengths[i]
            fits = free >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                b = rooms[room].pop()
                if not rooms[room]:
                    free ^= 1 << room
            else:
                room, b = self.most, len(self.bins)
                self.bins.append([])
                self.fill.append(0)
            self.bins[b].append(i)
            self.fill[b] += n
            room -= n
            if room:
                rooms[room].append(b)
                free |= 1 << room

    def given(self, b: int) -> dict[tuple[int, int], list[int]]:
        """What sequence b can give: one or two pieces, by their sum and number; equal lengths are alike."""
        of: dict[int, list[int]] = {}
        for i in self.bins[b]:
            of.setdefault(self.lengths[i], []).append(i)
        out = {(n, 1): own[:1] for n, own in of.items()}
        for n, own in of.items():
            for m, other in of.items():
                if n < m or (n == m and len(own) > 1):
                    out.setdefault((n + m, 2), [own[0], other[0] if n < m else own[1]])
        return out

    def returned(self, b: int) -> np.ndarray:
        """Sums that sequence b can return: nothing, one piece, or two (those are marked by being negative)."""
        if self.returns[b] is None:
            self.returns[b] = np.array([0, *(s if n == 1 else -s for s, n in self.given(b))], np.int64)
        return self.returns[b]

    def exchange(self, a: int, others: np.ndarray) -> bool:
        """The exchange between a and one of the others, none emptier, that raises the sum of squared fills most; False without one.

        Others are tried in blocks, by what filling them up would raise the sum: what is found ends the search once no later one can
        do better."""
        own = self.given(a)
        sides = [np.sort(np.array([s for s, n in own if n == k], np.int64)) for k in (1, 2)]
        room, lead = self.most - self.fill[others], self.fill[others] - self.fill[a]
        most = room * (lead + room)
        order = np.argsort(-most, kind="stable")
        best, chosen = 0, None
        for i in range(0, len(order), 200):
            block = order[i : i + 200]
            if most[block[0]] <= best:
                break
            sums = [self.returned(b) for b in others[block].tolist()]
            back, at = np.concatenate(sums), np.repeat(block, [len(x) for x in sums])
            for k, totals in enumerate(sides):
                if not len(totals):
                    continue
                place = np.searchsorted(totals, np.abs(back) + room[at], side="right") - 1
                more = np.where((place >= 0) & ((k == 0) | (back > 0)), totals[place] - np.abs(back), 0)  # two go for one only
                gain = np.where(more > 0, more * (lead[at] + more), 0)
                j = int(gain.argmax())
                if gain[j] > best:
                    best, chosen = gain[j], (int(totals[place[j]]), k + 1, int(others[at[j]]), int(back[j]))
        if chosen is None:
            return False
        total, n, b, back = chosen
        other = self.pick(b, abs(back), 1 + (back < 0)) if back else []
        for x, y, moved in ((a, b, self.pick(a, total, n)), (b, a, other)):
            for i in moved:
                self.bins[x].remove(i)
                self.bins[y].append(i)
                self.fill[x] -= self.lengths[i]
                self.fill[y] += self.lengths[i]
        self.returns[a] = self.returns[b] = None
        return True

    def pick(self, b: int, total: int, n: int) -> list[int]:
        """n pieces of sequence b that make up the total."""
        return self.given(b)[total, n]

    def search(self, steps: int) -> None:
        """Empty the emptiest sequences by exchanges until the lower bound is reached, none helps, or `steps` were tried. A sequence
        without an exchange is tried again only when it has changed."""
        least, stuck = lower_bound(np.array(self.lengths, np.int64), self.most), np.zeros(len(self.bins), bool)
        self.fill, self.returns = np.array(self.fill, np.int64), [None] * len(self.bins)
        while steps and np.count_nonzero(self.fill) > least:
            steps -= 1
            open_ = np.flatnonzero((self.fill > 0) & (self.fill < self.most))
            tried = open_[~stuck[open_]]
            if not len(tried):
                return
            a = int(tried[self.fill[tried].argmin()])
            others = open_[(open_ != a) & (self.fill[open_] >= self.fill[a])]
            stuck[a] = not len(others) or not self.exchange(a, others)

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each piece its sequence, numbered from 0, its offset there, and whether that is the emptiest of several and not full."""
        sequence, offset, low = (np.zeros(len(self.lengths), np.int64) for _ in range(3))
        alive = [b for b, own in enumerate(self.bins) if own]
        least = min(alive, key=lambda b: self.fill[b], default=None)
        for number, b in enumerate(alive):
            at = 0
            for i in self.bins[b]:
                sequence[i], offset[i], low[i] = number, at, b == least and len(alive) > 1 and self.fill[b] < self.most
                at += self.lengths[i]
        return sequence, offset, low.astype(bool)


def packed(lengths: np.ndarray, most: int, steps: int) -> Packing:
    out = Packing(lengths, most)
    out.best_fit()
    out.search(steps)
    return out


def place(rows: DataFrame, most: int = 4096, shard: int = SHARD_PIECES, steps: int = 2_000) -> DataFrame:
    """row, sequence_id, offset for a table (row long, length long) of lengths from 1 to most, each row once. Rows are dealt into shards
    of some `shard` pieces, whatever their lengths; `steps` bounds the exchanges of a shard: what it bounds is effort, all rows are placed."""

    def pack_shard(held: pa.Table) -> pa.Table:
        held = held.sort_by("row")
        numbers = held.column("shard")[0].as_py()
        sequence, offset, low = packed(held.column("length").to_numpy(), most, steps).places()
        columns = [held.column("row"), held.column("length"), pa.array(sequence + (numbers << 24)), pa.array(offset), pa.array(low)]
        return pa.table(columns, names=["row", "length", "sequence_id", "offset", "low"])

    done, n, turn = None, rows.count(), 0
    while True:
        shards = max(1, -(-n // shard))
        dealt = rows.select("row", "length", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(shards)).alias("shard"))
        out = materialize(dealt.groupBy("shard").applyInArrow(pack_shard, "row long, length long, sequence_id long, offset long, low boolean"), "packed")
        last = shards == 1
        kept = (out if last else out.where("not low")).select("row", (F.col("sequence_id") + F.lit(turn << 56)).alias("sequence_id"), "offset")
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        rows, turn = out.where("low").select("row", "length"), turn + 1
        n = rows.count()


def pack(docs: DataFrame, path: str, most: int = 4096, closing: int = 1, keep_ids: bool = True, shard: int = SHARD_PIECES, steps: int = 2_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if keep_ids, ids: where each piece of each row of docs
    (doc_id, text) goes. Pieces of a sequence follow each other without gaps, up to `most` ids; only documents of more ids are cut.

    Null and empty texts have the closing id alone; null doc_id stays null; repeated rows are each packed; ties go by row, so a rerun over the same files gives the
    same places; an empty table gives no rows; further columns are ignored. Texts are encoded whole."""
    rows = materialize(pieces(docs, path, most, closing, keep_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return rows.join(place(rows.select("row", "length"), most, shard, steps), "row").drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, ends: the packed ids of each sequence, and where each of its pieces ends. A sequence is bounded, whatever the table."""
    listed = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(listed.alias("p"))
    return rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["offset"] + x["length"]).alias("ends"))
