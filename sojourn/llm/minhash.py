"""Near-duplicate documents: MinHash with banding, signature verification, exact check, connected components.

1. A sketch per row: the count of distinct word shingles, a digest of the word sequence, and `BANDS` x `ROWS` minima of universal
   hashes (low 16 bits each). At a similarity of 0.8 a pair shares no band with a chance of 4e-7.
2. Rows with the same word sequence are one class; only classes are compared.
3. In a bucket (a band's value) each class is paired with the bucket's first class, not with all others. Pairs whose signatures
   are far apart go, the rest are checked on the full sets, and components are taken.
4. Classes of buckets that are still in several components may have links that no first class shows. A link of sets of sizes n and m
   needs an intersection of a = ceil(0.8 / 1.8 * (n + m)); in any one order of all shingles, two such sets then share one among
   their first n - a + 1 and m - a + 1. With the rare ones first these are mostly shingles of few classes, so pairs from different
   components that share one at such places are few, and none of the links between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.common import bound_batches, broadcast_if_small, byte_view, materialize, slices, text_key, text_or_empty
from sojourn.llm.components import connected_components

ROWS, BANDS = 4, 28
#: Signatures that agree in fewer than this share are not checked: at a similarity of 0.8 six standard deviations below.
FAR = 0.56
MIX = np.uint64(0x9E3779B97F4A7C15)


def _multipliers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = x = xxhash.xxh3_64_intdigest(word)
        return x


def shingles(words: list[bytes], k: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of k words in a row; of fewer words, one of them all; none of no words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    factors, _ = _FACTORS
    if n < k:
        x = (h * factors[:n]).sum(keepdims=True) + np.uint64(n)
    else:
        x = h[: n - k + 1] * factors[0]
        for i in range(1, k):
            x = x + h[i : n - k + 1 + i] * factors[i]
    x = (x ^ (x >> np.uint64(32))) * MIX
    return np.unique(x ^ (x >> np.uint64(29)))


_FACTORS = _multipliers(64, 11)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Low 16 bits of the minima of ROWS * BANDS multiply-shift hashes, a row per set; sets must not be empty."""
    a, b = _multipliers(ROWS * BANDS, 17)
    x = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), ROWS * BANDS), "<u2")
    y = np.empty_like(x)
    for i in range(ROWS * BANDS):
        np.multiply(x, a[i], out=y)
        np.add(y, b[i], out=y)
        np.right_shift(y, np.uint64(32), out=y)
        out[:, i] = np.minimum.reduceat(y, first) & np.uint64(0xFFFF)
    return out


def split_words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _texts(batch: pa.RecordBatch, name: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    data, starts = byte_view(batch.column(name))
    whole = data.tobytes()
    for i, j in slices(starts, most):
        yield batch.slice(i, j - i), [split_words(whole[starts[r] : starts[r + 1]]) for r in range(i, j)]


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key, n, same, sig of each row; sig is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part, words in _texts(batch):
                sets = [shingles(w, k, known) for w in words]
                some = [s for s in sets if len(s)]
                sig = iter(signatures(some)) if some else iter(())
                sigs = [next(sig).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(w) for w in words], pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "text_key", "n", "same", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, n long, same binary, sig binary")


def classes_of(sketches: DataFrame) -> DataFrame:
    """node, id, text_key, same, n, sig of each distinct word sequence. node is its smallest doc_id, or where another class or no class has
    that id a negative hash of the class; text_key is that of a row with this id."""
    own = sketches.where("n > 0").groupBy("same").agg(F.min("doc_id").alias("id"), F.coalesce(F.min_by("text_key", "doc_id"), F.min("text_key")).alias("text_key"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    other = -F.abs(F.xxhash64("same"))
    place = F.row_number().over(Window.partitionBy(F.coalesce("id", other)).orderBy("same"))
    return own.withColumn("place", place).select(F.when(F.col("id").isNotNull() & (F.col("place") == 1), F.col("id")).otherwise(other).alias("node"), "id", "text_key", "same", "n", "sig")


def buckets_of(classes: DataFrame) -> DataFrame:
    """key, node, n of classes in buckets that hold more than one class. The count is joined back, so large buckets are no groups."""
    width = 2 * ROWS
    parts = F.array(*(F.xxhash64(F.lit(i), F.substring("sig", 1 + width * i, width)) for i in range(BANDS)))
    keys = classes.select("node", "n", F.explode(parts).alias("key"))
    shared = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")  # apart, so a large bucket's join can be split
    return keys.join(shared, "key").select("key", "node", "n", "size")


def near(x: str, y: str, percent: int):
    """What sizes allow: the smaller set is at least that share of the larger."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in a share of FAR at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            if p.num_rows:
                x, y = (np.frombuffer(b"".join(p.column(c).to_pylist()), "<u2").reshape(p.num_rows, -1) for c in ("x", "y"))
                yield pa.RecordBatch.from_arrays([p.column("a"), p.column("b")], names=["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= FAR))

    side = lambda n, s: classes.select(F.col("node").alias(n), F.col("sig").alias(s))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, shingles (sorted hashes as bytes) of the given nodes, from the whole texts. Texts are read where they lie while the
    wanted ones are few enough to send, else both sides are dealt by id and text."""
    wanted = materialize(classes.select("node", "id", "text_key", "same").join(nodes, "node", "left_semi"), "wanted")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), text_or_empty().alias("text")).alias("d")
    ids = broadcast_if_small(wanted.alias("w"), wanted.count(), 100)
    found = rows.join(ids, F.col("d.doc_id").eqNullSafe(F.col("w.id")) & (F.col("d.text_key") == F.col("w.text_key"))).select("node", "same", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part, words in _texts(batch):
                nodes, same = part.column("node").to_pylist(), part.column("same").to_pylist()
                out = [(n, shingles(w, k, known).tobytes()) for n, s, w in zip(nodes, same, words) if digest(w) == s]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["node", "shingles"])

    return materialize(found.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"]), "sets")


def checked(pairs: DataFrame, sets: DataFrame, percent: int, most: int = 100) -> DataFrame:
    """Pairs (a, b) that the full sets confirm. The set of a goes once for each `most` of its pairs, ahead of the sets of their b, so
    neither a long document nor one with very many pairs is more than a few sets in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, hub = None, None
        for p in batches:
            a, b = [], []
            for x, y, s in zip(p.column("a").to_pylist(), p.column("b").to_pylist(), p.column("shingles")):
                own = np.frombuffer(s.as_buffer(), np.uint64)
                if y is None:
                    of, hub = x, own.copy()
                    continue
                both = len(hub) + len(own) - len(np.union1d(hub, own)) if of == x else 0
                if 100 * both >= percent * (len(hub) + len(own) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    pairs = materialize(pairs, "to-check")
    parts = materialize(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts")), "parts")
    own = sets.select(F.col("node"), "shingles")
    hubs = parts.join(own, parts["a"] == own["node"]).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "shingles")
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    members = dealt.join(own, dealt["b"] == own["node"]).select("a", "part", "b", "shingles")
    rows = hubs.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "shingles").mapInArrow(run, "a long, b long")


def first_shingles(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """key (a shingle), node, n, root, place of the places, from 0, that can show a link, in the order of how many of the nodes
    (node, n, root) have the shingle, the rarest first. Shingles of one node alone only take places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                b = batch.slice(i, 1000)
                parts = [np.frombuffer(v.as_buffer(), np.int64) for v in b.column("shingles")]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("node").to_numpy(), [len(x) for x in parts])), pa.array(np.concatenate(parts))], names=["node", "key"])

    each = sets.join(nodes, "node", "left_semi").select("node", "shingles").mapInArrow(run, "node long, key long")
    common = materialize(each.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "common")
    shared = each.join(common, "key").join(nodes, "node")
    w = Window.partitionBy("node")
    alone = F.col("n") - F.count(F.lit(1)).over(w)
    placed = shared.withColumn("place", alone + F.row_number().over(w.orderBy("c", "key")) - 1)
    return placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100)).select("key", "node", "n", "root", "place")


def _split(rooted: DataFrame) -> DataFrame:
    """Rows of buckets whose classes are in several components."""
    split = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return rooted.join(materialize(split, "split"), "key")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key (a hash of the text); one row per row of docs.

    Words are what lies between white space, A-Z lower-cased; a document's set is its distinct k-word shingles. Documents are
    linked if 100 * intersection >= percent * union (percent 80 or more); component_id is the smallest doc_id reachable. Documents
    without words are linked with nothing. Null doc_id: such a row is a document too, its component_id the smallest id linked
    with it, or null. Rows that share a doc_id but not the text are nodes of their own. An empty table gives no rows; further
    columns are ignored.
    """
    bound_batches(docs.sparkSession)
    sketches = materialize(sketch(docs, k), "sketch")
    classes = materialize(classes_of(sketches), "classes")
    members = materialize(buckets_of(classes), "members")
    sets = full_sets(docs, classes, members.select("node").distinct(), k)
    first = materialize(members.groupBy("key").agg(F.min(F.struct("node", "n")).alias("h")).select("key", F.col("h.node").alias("hub"), F.col("h.n").alias("m")), "hubs")
    pairs = members.join(first, "key").where("node <> hub").where(near("n", "m", percent)).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    tested = materialize(pairs.distinct(), "pairs")
    links = materialize(checked(agreeing(tested, classes), sets, percent), "links-found")
    roots = materialize(connected_components(links), "roots")
    rooted = members.where("size > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = materialize(_split(rooted.select("key", "node", "n", "root")).select("node", "n", "root").distinct(), "open")
    if not open_.isEmpty():
        places = materialize(_split(first_shingles(sets, open_, percent)), "places")
        side = lambda x: places.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "root", "place")))
        least = F.ceil(percent * (F.col("n_x") + F.col("n_y")) / (100 + percent))
        shown = (F.col("place_x") <= F.col("n_x") - least) & (F.col("place_y") <= F.col("n_y") - least)
        more = side("x").join(side("y"), "key").where("root_x < root_y").where(near("n_x", "n_y", percent) & shown)
        more = more.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        found = materialize(checked(agreeing(materialize(more, "more-pairs"), classes), sets, percent), "links-found")
        if not found.isEmpty():
            roots = materialize(connected_components(links.unionAll(found)), "roots")
    named = classes.select("same", "id", "node")
    smallest = roots.join(classes.select("node", "id"), "node").groupBy("root").agg(F.min("id").alias("least"))
    named = named.join(roots.join(smallest, "root").select("node", "least"), "node", "left")
    named = named.select("same", F.coalesce("least", "id").alias("found"))
    rows = sketches.select("doc_id", "text_key", "n", "same").join(named, "same", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("found"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key")
