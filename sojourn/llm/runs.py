"""Periodic runs of words, by Stoye and Gusfield's suffix tree algorithm.

The documents of a batch share one suffix tree in arrays: leaves in their order, nodes as ranges of leaves with a string depth. A
tandem repeat aa that can't be rotated right has its two starts in different children of the node of a, so at every node only the
leaves of all children but the largest are tried, with the leaf one depth to their left and to their right. What is found is
rotated left as far as it goes, which gives the maximal run. Documents don't meet in the tree. All is map-only.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.common import bound_batches, text_or_empty

BATCH_WORDS = 200_000
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
_FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class SuffixTree:
    """The suffix tree of sequences of codes that lie end to end; starts has their first places and the end.

    leaves: suffixes in order, one sequence after another. place: where each suffix is among them. lcp[t]: codes that leaves t - 1
    and t share, never across sequences. children(): the tree below its root."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray) -> None:
        self.codes, sizes = codes, np.diff(starts)
        self.begin, self.end = np.repeat(starts[:-1], sizes), np.repeat(starts[1:], sizes)
        self.lcp = np.zeros(len(codes) + 1, np.int64)
        self.lcp[[0, -1]] = -1
        key = np.repeat(np.arange(len(sizes)), sizes) * (int(codes.max()) + 1) + codes
        self._sort(key)

    def _sort(self, key: np.ndarray) -> None:
        """Sort suffixes by doubled prefixes; only those that still tie are sorted again. How far neighbours agree follows from the
        ranks by 1, 2, 4, ... codes, read back from the longest."""
        n, h = len(key), 1
        leaves, rank, slots = np.argsort(key), np.empty(n, np.int64), np.arange(n)
        at, key, levels, ties = leaves, key[leaves], [], []
        while True:
            head = np.r_[True, key[1:] != key[:-1]]
            rank = rank.copy()
            rank[at] = slots[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
            levels.append(rank.astype(np.int32))
            ties.append(slots[~head])
            slots = slots[~(head & np.r_[head[1:], True])]
            if not len(slots):
                break
            at = leaves[slots]
            after = at + h
            key = rank[at] * (n + 1) + np.where(after < self.end[at], rank[np.minimum(after, n - 1)], -1) + 1
            order = np.argsort(key)
            at, key = at[order], key[order]
            leaves[slots] = at
            h *= 2
        self.leaves, self.place = leaves, rank
        for k in range(len(levels) - 1, -1, -1):
            t, level = ties[k], levels[k]
            i, j = leaves[t - 1] + self.lcp[t], leaves[t] + self.lcp[t]
            inside = np.maximum(i, j) < self.end[leaves[t]]
            same = inside & (level[np.minimum(i, n - 1)] == level[np.minimum(j, n - 1)])
            self.lcp[t] += same.astype(np.int64) << k

    def _nearest(self, t: np.ndarray, step: int) -> np.ndarray:
        """For each place the nearest one to that side with no greater lcp, by jumps over jumps."""
        to = np.arange(len(self.lcp)) + step
        while len(t := t[self.lcp[to[t]] > self.lcp[t]]):
            to[t] = to[to[t]]
        return to

    def children(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """node, low, high: the children's ranges of leaves, by node, the largest of a node first; and by node (a place in lcp, whose
        value is the node's depth) its own range."""
        t = np.flatnonzero(self.lcp > 0)
        before, after = self._nearest(t, -1), self._nearest(t, 1)
        first, last = np.arange(len(self.lcp)), np.arange(len(self.lcp))
        for to, near in ((first, before), (last, after)):
            to[t] = np.where(self.lcp[near[t]] == self.lcp[t], near[t], t)
            while (to[to[t]] != to[t]).any():
                to[t] = to[to[t]]
        ends = t[last[t] == t]
        node, low, high = np.r_[first[t], first[ends]], np.r_[before[t], ends], np.r_[t, after[ends]]
        order = np.argsort(node * (len(self.lcp) + 1) - (high - low), kind="stable")
        return node[order], low[order], high[order], before[first], after[last]


def branching_repeats(tree: SuffixTree, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """start, period of each tandem repeat whose next code breaks the period; some come twice. `most` leaves are tried at once."""
    node, low, high, left, right = tree.children()
    light = np.r_[False, node[1:] == node[:-1]] if len(node) else np.zeros(0, bool)
    node, low, size = node[light], low[light], (high - low)[light]
    ends = np.cumsum(size)
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(most, ends[-1] if len(ends) else 0, most)), len(node)])
    starts, periods = [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        s, v = size[a:b], np.repeat(node[a:b], size[a:b])
        leaf = tree.leaves[np.repeat(low[a:b] - (np.cumsum(s) - s), s) + np.arange(s.sum())]
        depth = tree.lcp[v]
        for first, other in ((leaf, leaf + depth), (leaf - depth, leaf - depth)):
            ok = (other >= tree.begin[leaf]) & (other < tree.end[leaf])
            i, o, d, w, e = first[ok], other[ok], depth[ok], v[ok], tree.end[leaf[ok]]
            there = (left[w] <= tree.place[o]) & (tree.place[o] < right[w])
            i, d, e = i[there], d[there], e[there]
            broken = (i + 2 * d >= e) | (tree.codes[np.minimum(i + 2 * d, len(tree.codes) - 1)] != tree.codes[i + d])
            starts.append(i[broken])
            periods.append(d[broken])
    return np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate([np.zeros(0, np.int64), *periods])


def rotated(tree: SuffixTree, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How far left the period of each repeat goes."""
    start, begin, open_, width = start.copy(), tree.begin[start], np.arange(len(start)), 16
    while len(open_):
        at = start[open_, None] - 1 - np.arange(width)
        inside = at >= begin[open_, None]
        at = np.maximum(at, 0)
        same = inside & (tree.codes[at] == tree.codes[at + period[open_, None]])
        n = np.where(same.all(axis=1), width, same.argmin(axis=1))
        start[open_] -= n
        open_ = open_[n == width]
        width = max(16, min(4 * width, (1 << 20) // max(len(open_), 1)))
    return start


def maximal_runs(codes: np.ndarray, starts: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period of the maximal runs of at least `exponent` (2 or more) periods and `least` codes, by start and period.

    Repeats that end at one place are taken from the shortest period on; multiples of it within its run are the same run."""
    if not len(codes):
        return (np.zeros(0, np.int64),) * 3
    tree = SuffixTree(codes, starts)
    start, period = branching_repeats(tree)
    end = start + 2 * period
    found = []
    order = np.lexsort((period, end))
    end, period = end[order], period[order]
    while len(end):
        first = np.r_[True, end[1:] != end[:-1]]
        e, p = end[first], period[first]
        s = rotated(tree, e - 2 * p, p)
        found.append((s, e - s, p))
        group = np.cumsum(first) - 1
        rest = (period % p[group] != 0) | (end - 2 * period < s[group])
        end, period = end[rest], period[rest]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = map(np.concatenate, zip(*found))
    kept = length >= np.maximum(least, exponent * period)
    start, length, period = start[kept], length[kept], period[kept]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _find(ids: list[int | None], sequences: list[list[bytes]], exponent: int, least: int) -> pa.RecordBatch:
    """Runs of the words of some documents, and their texts without what runs repeat."""
    known: dict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
    starts = np.r_[0, np.cumsum(sizes)]
    codes = np.fromiter((known[w] for s in sequences for w in s), np.int64, int(starts[-1]))
    start, length, period = maximal_runs(codes, starts, exponent, least)
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    doc = np.searchsorted(starts, start, side="right") - 1
    texts = []
    for s, a, b in zip(sequences, starts[:-1].tolist(), starts[1:].tolist()):
        own = kept[a:b]
        texts.append(b" ".join(s if own.all() else [s[i] for i in np.flatnonzero(own).tolist()]))
    runs = pa.StructArray.from_arrays([pa.array(start - starts[doc]), pa.array(length), pa.array(period)], fields=list(RUN))
    offsets = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(sizes)))].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), runs)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), lists, pa.array(texts, pa.binary()).cast(pa.string())], schema=FOUND)


def find_runs(docs: DataFrame, exponent: int = 4, least: int = 6, arrange: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs, collapsed of each row of docs (doc_id, text).

    runs: the maximal stretches of words `[^\\x20\\x09-\\x0D]+` of at least `exponent` times their smallest period and `least` words,
    as (start, length, period), by start and period. collapsed: the words joined by a space, without those that a run holds after its
    first period. arrange(doc_id, n) may give places of a document's n words to be read instead of 0 to n - 1, or None.

    Texts are read whole, as UTF-8. Null and empty texts have no words: no runs and an empty text. Null doc_id stays null, rows that repeat are
    each judged alike, an empty table gives no rows, and further columns, whatever their names, are ignored. A batch of documents is
    worked on together up to BATCH_WORDS words; a longer document is alone, with memory in proportion to its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, n = [], [], 0
        for doc, text in ((d, t) for b in batches for d, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist())):
            words = text.split()
            order = arrange(doc, len(words)) if arrange else None
            if order is not None:
                words = [words[i] for i in order.tolist()]
            if ids and n + len(words) > BATCH_WORDS:
                yield _find(ids, held, exponent, least)
                ids, held, n = [], [], 0
            ids.append(doc)
            held.append(words)
            n += len(words)
        if ids:
            yield _find(ids, held, exponent, least)

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, _FOUND)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest length / period (the first by start, then period; nulls without runs) and digests of
    find_runs' runs and collapsed texts."""
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda b, x: F.when(x["length"] * b["period"] > b["length"] * x["period"], x).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    rows = found.withColumn("best", best).withColumn("lines", F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""))
    top = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    exact = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *top, exact, F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
