"""Repeated passages: strings of `length` units (bytes, or words) that occur more than once in the corpus.

1. Each text's anchors (anchors.py) are hashed with the content of their run. Runs with equal content are one class: where a class
   has several members, all their windows are repeated, with no comparison, so copies cost one row each.
2. Only where one anchor string has several classes is text compared. One context of each such class goes to the shard of its
   anchor, in batches, where a logarithmic family of suffix arrays (`Family`) finds the windows that contexts have in common:
   a new batch gets suffix arrays of what follows and what precedes the anchors, is merge-scanned against the existing levels,
   and levels of like size merge.
3. Spans are gathered by document, and the texts that lose something are read again and cut.

`RepeatIndex` keeps the anchors of a growing corpus in levels on shared storage, sorted by anchor: a new batch is scanned against all
levels for repeats among its own documents and with older ones, and levels of like size merge.

An anchor with very many classes is dealt further (`hot_classes`): each class is cut into small ranges of windows. Ranges of equal
text are counted by hash; where several are equal, all their windows are repeated, with no comparison, and one of them goes on. It
is dealt by the content that its windows have in common. Where very many different ranges have that in common too, as at the
edges of a passage with many surroundings, each window is hashed and counted on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sojourn.llm import anchors
from sojourn.llm.common import bound_batches, broadcast_if_small, byte_view, materialize, text_or_empty

RANGE = 32


@dataclass(frozen=True)
class Units:
    """What texts are read as: windows of `length` units, anchors of `gram`. across: whether only windows count that another document
    has too; else another place of the same document is enough."""

    length: int
    gram: int
    words: bool = False
    across: bool = False

    @property
    def width(self) -> int:
        return 8 if self.words else 1

    @property
    def kind(self) -> type:
        return np.uint64 if self.words else np.uint8


def byte_units(length: int = 400) -> Units:
    return Units(length, 64)


def word_units(length: int = 51) -> Units:
    """Passages of over 50 words that several documents have."""
    return Units(length, max(1, length // 5), True, True)


def units_of(text: bytes, units: Units) -> np.ndarray:
    """The bytes of a text, or a 64-bit hash of each word, which takes no longer than to look it up."""
    if not units.words:
        return np.frombuffer(text, np.uint8)
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def text_digest(text: bytes) -> bytes:
    """`same` of a text: as same_of gives it in columns."""
    return hashlib.md5(text).digest()


def same_of():
    return F.unhex(F.md5(F.col("text").cast("binary")))


def scan(docs: DataFrame, units: Units) -> DataFrame:
    """doc_id, same (digest of the text), n_bytes, sha256 (null for words), and of each run: gram, content, anchor, lo, hi."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, n = units.width, units.length
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            data, starts = byte_view(batch.column("text"))
            texts = [data[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            own, begin = data, starts
            if units.words:
                split = [units_of(text, units) for text in texts]
                own, begin = np.concatenate(split), np.cumsum([0, *map(len, split)])
            grams, at, lo, hi, runs = anchors.runs_of_many(own, begin, n, units.gram)
            raw, base = own.view(np.uint8).data, np.repeat(begin[:-1], runs)
            content = np.fromiter((xxhash.xxh3_64_intdigest(raw[x:y], z) for x, y, z in zip(((lo + base) * w).tolist(), ((hi + base + n) * w).tolist(), (at - lo).tolist())), np.uint64, len(lo))
            ends = pa.array(np.cumsum(np.r_[0, runs]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (grams.view(np.int64), content.view(np.int64), at.astype(np.int32), lo.astype(np.int32), hi.astype(np.int32))]
            sha256 = [None if units.words else hashlib.sha256(text).hexdigest() for text in texts]
            columns = [batch.column("doc_id"), pa.array(list(map(text_digest, texts)), pa.binary()), pa.array(np.diff(starts)), pa.array(sha256, pa.string()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "same", "n_bytes", "sha256", "gram", "content", "anchor", "lo", "hi"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, same binary, n_bytes long, sha256 string, gram array<long>, content array<long>, anchor array<int>, lo array<int>, hi array<int>")


class Level:
    """Contexts with suffix arrays of what follows their anchors (at most `length` units) and of what precedes them, read backward.

    ranks(d) of a side are equal for contexts that agree in d units there at least; they come from the longest common prefixes of
    neighbours in the side's order."""

    def __init__(self, after: np.ndarray, before: np.ndarray, least: np.ndarray, most: np.ndarray, owner: list, orders: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.after, self.before, self.least, self.most, self.owner = after, before, least, most, owner
        self.orders = orders or (np.argsort(after, kind="stable"), np.argsort(before, kind="stable"))

    def __len__(self) -> int:
        return len(self.owner)

    def ranks(self, side: int, units: Units):
        keys = (self.after, self.before)[side][self.orders[side]]
        raw = keys.view(units.kind).reshape(len(keys), units.length)
        differ = raw[1:] != raw[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), units.length)
        back = np.empty(len(keys), np.int64)
        back[self.orders[side]] = np.arange(len(keys))

        def of(depth: int) -> np.ndarray:
            return np.r_[0, np.cumsum(common < depth)][back]

        return of


def merged(old: Level, new: Level) -> Level:
    """One level of both; the orders are merged, not sorted anew."""
    orders = []
    for side in (0, 1):
        x, y = ((lv.after, lv.before)[side][lv.orders[side]] for lv in (old, new))
        at = np.searchsorted(x, y, side="right") + np.arange(len(y))
        out = np.empty(len(x) + len(y), np.int64)
        first = np.ones(len(out), bool)
        first[at] = False
        out[at], out[first] = new.orders[side] + len(old), old.orders[side]
        orders.append(out)
    both = [np.concatenate([getattr(old, k), getattr(new, k)]) for k in ("after", "before", "least", "most")]
    return Level(*both, old.owner + new.owner, tuple(orders))


def matches(level: Level, units: Units, cut: int = 0) -> np.ndarray:
    """(context, offset) -> the window that starts so many units before the anchor is also in another context (units.across: of
    another document); with a cut, in one on the other side of it (contexts from `cut` on are new)."""
    length, after, before = units.length, level.ranks(0, units), level.ranks(1, units)
    docs: dict = {}
    doc = np.array([docs.setdefault(o[:2], len(docs)) for o in level.owner]) if units.across else None
    lo, hi = int(level.least.min()), int(level.most.max())
    out = np.zeros((len(level), hi - lo + 1), bool)
    for t in range(lo, hi + 1):
        on = np.flatnonzero((level.least <= t) & (t <= level.most))
        if len(on) < 2:
            continue
        key = before(t)[on] * len(level) + after(length - t)[on]
        _, code = np.unique(key, return_inverse=True)
        if cut:
            old, new = np.bincount(code[on < cut], minlength=code.max() + 1), np.bincount(code[on >= cut], minlength=code.max() + 1)
            hit = (old[code] > 0) & (new[code] > 0)
        else:
            hit = np.bincount(code)[code] > 1
        if units.across:
            some = np.empty(code.max() + 1, np.int64)
            some[code] = doc[on]
            hit &= np.bincount(code, doc[on] != some[code])[code] > 0
        out[on, t - lo] = hit
    return out


class Family:
    """The levels of one shard. add() returns spans (owner, start, end) that a batch and the contexts before it have in common."""

    def __init__(self, units: Units) -> None:
        self.units, self.levels = units, []

    def spans(self, level: Level, found: np.ndarray) -> list[tuple]:
        lo, out = int(level.least.min()), []
        for c in np.flatnonzero(found.any(axis=1)):
            edge = np.flatnonzero(np.diff(found[c].astype(np.int8), prepend=0, append=0))
            out += [(level.owner[c], lo + int(a), lo + int(b) - 1) for a, b in zip(edge[::2], edge[1::2])]
        return out

    def add(self, contexts: list[tuple[bytes, int, int, int, object]]) -> list[tuple]:
        """contexts: text, the anchor's place in it, least and most offset of windows before the anchor, owner. Spans are in offsets."""
        n, w = self.units.length, self.units.width
        kind = f"S{n * w}"
        after = np.array([t[a * w : (a + n) * w] for t, a, *_ in contexts], kind)
        before = np.array([np.frombuffer(t[max(0, a - n) * w : a * w], self.units.kind)[::-1].tobytes() for t, a, *_ in contexts], kind)
        new = Level(after, before, np.array([c[2] for c in contexts]), np.array([c[3] for c in contexts]), [c[4] for c in contexts])
        out = self.spans(new, matches(new, self.units))
        for old in self.levels:
            both = merged(old, new)
            out += self.spans(both, matches(both, self.units, len(old)))
        while self.levels and len(self.levels[-1]) <= 2 * len(new):
            new = merged(self.levels.pop(), new)
        self.levels.append(new)
        return out


CONTEXT = "shard long, doc_id long, same binary, anchor int, text binary, at int, least int, most int, equal binary"
SPAN = "doc_id long, same binary, first int, last int"


def cut_contexts(wanted: DataFrame, docs: DataFrame, units: Units) -> DataFrame:
    """The contexts (CONTEXT) of wanted classes (doc_id, same, gram, anchor, lo, hi, hot), from the whole texts. Ranges of hot anchors
    with one `equal` have the same anchor string, offsets and text; others have null."""
    lists = materialize(wanted.groupBy("doc_id", "same").agg(F.collect_list(F.struct("gram", "anchor", "lo", "hi", "hot")).alias("runs")), "wanted-runs")
    rows = texts_of(docs, lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        names, length, w = [x.split()[0] for x in CONTEXT.split(", ")], units.length, units.width
        for batch in (b.slice(i, 100) for b in batches for i in range(0, b.num_rows, 100)):
            out = []
            for r in batch.to_pylist():
                text = r["text"].encode()
                text = units_of(text, units).tobytes()
                part = lambda i, j: text[i * w : j * w]  # noqa: B023, E731
                for x in r["runs"]:
                    a, lo, hi = x["anchor"], x["lo"], x["hi"]
                    if not x["hot"]:
                        out.append((x["gram"], r["doc_id"], r["same"], a, part(lo, hi + length), a - lo, a - hi, a - lo, None))
                        continue
                    for s in range((a - hi) // RANGE * RANGE, a - lo + 1, RANGE):  # offsets s .. s + RANGE - 1
                        least, most = max(s, a - hi), min(s + RANGE - 1, a - lo)
                        core = part(max(a - s, 0), a - s - RANGE + 1 + length)
                        shard = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=s.to_bytes(4), key=x["gram"].to_bytes(8, signed=True)).digest(), signed=True)
                        own = part(a - most, a - least + length)
                        out.append((shard, r["doc_id"], r["same"], a, own, most, least, most, digest(b"%d %d %d " % (shard, least, most) + own)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 9, kinds)], names=names)

    return rows.mapInArrow(run, CONTEXT)


def texts_of(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """lists (doc_id, same, ...) with their texts, once for each (doc_id, same): an id, or no id, may stand for any number of texts. Rows of
    docs that aren't wanted go before the join while the wanted ids are few enough to send."""
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), text_or_empty().alias("text"))
    if (n := lists.count()) <= 500_000:  # ids alone: 16 MB
        rows = rows.join(F.broadcast(lists.select("doc_id").distinct()), F.col("d").eqNullSafe(F.col("doc_id")), "left_semi")
    rows = rows.withColumn("s", same_of())
    return rows.join(broadcast_if_small(lists, n, 16_000), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("s") == F.col("same"))).drop("d", "s")


def same_place(a: str, b: str):
    """Whether structs a and b are the same anchor of the same text."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.same") == F.col(f"{b}.same")) & (F.col(f"{a}.anchor") == F.col(f"{b}.anchor"))


def several_places(units: Units):
    """Condition on groups: windows at several places, of several documents if units.across."""
    doc = F.struct("doc_id", "same")
    return F.min(doc) != F.max(doc) if units.across else F.count(F.lit(1)) > 1


def equal_ranges(ranges: DataFrame, units: Units) -> tuple[DataFrame, DataFrame]:
    """SPAN of the ranges (CONTEXT) that several places have with equal text, and ranges with one place only of each such text."""
    place = F.struct("doc_id", "same", "anchor")
    counts = ranges.groupBy("equal").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one"), several_places(units).alias("several")).where("several")
    marked = materialize(ranges.withColumn("own", place).join(counts, "equal", "left"), "ranges")
    spans = marked.where("n > 1").select("doc_id", "same", (F.col("anchor") - F.col("most")).alias("first"), (F.col("anchor") - F.col("least")).alias("last"))
    return spans, marked.where(F.col("n").isNull() | same_place("own", "one")).drop("own", "n", "one", "several")


def equal_windows(ranges: DataFrame, units: Units) -> DataFrame:
    """SPAN of single windows that several ranges (CONTEXT) have in common, counted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, w = units.length, units.width
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            rows = []
            for r in batch.to_pylist():
                for t in range(r["least"], r["most"] + 1):
                    at = r["at"] - t
                    rows.append((digest(b"%d %d " % (r["shard"], t) + r["text"][at * w : (at + length) * w]), r["doc_id"], r["same"], r["anchor"] - t))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, [pa.binary(), pa.int64(), pa.binary(), pa.int32()])], names=["window", "doc_id", "same", "first"])

    windows = materialize(ranges.mapInArrow(run, "window binary, doc_id long, same binary, first int"), "windows")
    several = windows.groupBy("window").agg(several_places(units).alias("several")).where("several")
    return windows.join(several, "window").select("doc_id", "same", "first", F.col("first").alias("last"))


def shard_spans(batches: Iterator[pa.RecordBatch], units: Units, batch_contexts: int) -> Iterator[pa.RecordBatch]:
    """SPAN of windows that contexts of a shard have in common; shards come whole and in order. Shards that end within a batch share a
    family that ends with it; one that goes on has its own, which is dropped when the next shard begins."""
    family, held, shard = Family(units), [], None

    def found(own: Family, rows: list[tuple]) -> pa.RecordBatch:
        spans = [(doc, same, a - last, a - first) for (doc, same, a), first, last in own.add([c[1:] for c in rows])]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*spans) if spans else [[]] * 4, [pa.int64(), pa.binary(), pa.int32(), pa.int32()])], names=["doc_id", "same", "first", "last"])

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The rows of the shard that goes on to its family, the others, which are whole, to one of their own."""
        nonlocal family
        n = next((i for i, r in enumerate(rows) if r[0] != shard), len(rows))
        if n:
            yield found(family, rows[:n])
        if n < len(rows):
            family = Family(units)
            yield found(Family(units), rows[n:])

    for batch in batches:
        for r in (x for i in range(0, batch.num_rows, 1000) for x in batch.slice(i, 1000).to_pylist()):
            if len(held) >= batch_contexts:
                last = held[-1][0]
                cut = len(held) if r["shard"] != last else next(i for i, x in enumerate(held) if x[0] == last)
                yield from flush(held[:cut])  # shards that are whole
                held = held[cut:]
                if last != shard:
                    family, shard = Family(units), last
                if len(held) >= batch_contexts:
                    yield from flush(held)
                    held = []
            if not held and r["shard"] != shard:
                family, shard = Family(units), r["shard"]
            held.append((r["shard"], r["text"], r["at"], r["least"], r["most"], (r["doc_id"], r["same"], r["anchor"])))
    if held:
        yield from flush(held)


def common_spans(contexts: DataFrame, units: Units, batch_contexts: int = 4000) -> DataFrame:
    """SPAN of windows that contexts of a shard have in common. Shards come whole and in order to a task."""
    run = lambda batches: shard_spans(batches, units, batch_contexts)
    return contexts.drop("equal").repartition(F.col("shard")).sortWithinPartitions("shard").mapInArrow(run, SPAN)


def found_spans(contexts: DataFrame, units: Units, hot: bool, hot_classes: int) -> DataFrame:
    """SPAN of the windows that contexts (CONTEXT) have in common; hot: whether there may be ranges of hot anchors."""
    if not hot:
        return common_spans(contexts, units)
    contexts = materialize(contexts, "contexts")
    spans, ranges = equal_ranges(contexts.where("equal is not null"), units)
    crowded = materialize(ranges.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_classes).select("shard"), "crowded")
    crowd = ranges.join(crowded, "shard", "left_semi")
    rest = contexts.where("equal is null").unionByName(ranges.join(crowded, "shard", "left_anti"))
    return spans.unionByName(equal_windows(crowd, units)).unionByName(common_spans(rest, units))


CUT = "doc_id long, same binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def cut_texts(spans: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """CUT of each (doc_id, same) of spans (SPAN): windows start at first .. last."""
    lists = materialize(spans.groupBy("doc_id", "same").agg(F.collect_set(F.struct("first", "last")).alias("runs")), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        for batch in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
            out = []
            for r in batch.to_pylist():
                text = r["text"].encode()
                step = np.zeros(len(text) + 1, np.int32)
                np.add.at(step, [x["first"] for x in r["runs"]], 1)
                np.add.at(step, [x["last"] + length for x in r["runs"]], -1)
                gone = np.cumsum(step)[:-1] > 0
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((r["doc_id"], r["same"], int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=[x.split()[0] for x in CUT.split(", ")[:6]])

    return texts_of(docs, lists).mapInArrow(run, CUT).dropDuplicates(["doc_id", "same"])


def runs_of(scanned: DataFrame) -> DataFrame:
    """RUN rows of a scan: one for each anchor of each text."""
    return scanned.select("doc_id", "same", F.explode(F.arrays_zip("gram", "content", "anchor", "lo", "hi")).alias("r")).select("doc_id", "same", "r.*")


def repeated(runs: DataFrame, docs: DataFrame, units: Units, hot_classes: int) -> tuple[DataFrame, DataFrame]:
    """SPAN of whole runs that other places have with equal content, and SPAN of windows that runs of different content have in
    common. docs holds the texts of all runs."""
    classes = runs.groupBy("gram", "content").agg(F.count(F.lit(1)).alias("members"), several_places(units).alias("several"))
    grams = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("classes"), F.bool_or("several").alias("any")).where("classes > 1 or any")
    marked = materialize(classes.join(grams, "gram").select("gram", "content", "several", "classes"), "marked")
    hits = materialize(runs.join(marked, ["gram", "content"]), "hits")
    whole = hits.where("several").select("doc_id", "same", F.col("lo").alias("first"), F.col("hi").alias("last"))
    open_ = hits.where("classes > 1")
    one = open_.where("several").groupBy("gram", "content", "classes").agg(F.min(F.struct("doc_id", "same", "anchor", "lo", "hi")).alias("r")).select("gram", "classes", "r.*")
    wanted = open_.where("not several").select("gram", "classes", "doc_id", "same", "anchor", "lo", "hi").unionByName(one).withColumn("hot", F.col("classes") > hot_classes)
    hot = bool(marked.where(F.col("classes") > hot_classes).limit(1).count())
    return whole, found_spans(cut_contexts(wanted, docs, units), units, hot, hot_classes)


def covered(spans: DataFrame, length: int) -> DataFrame:
    """doc_id, same, units, passages: how many units of each text windows from first to last cover, in how many maximal runs."""
    w = Window.partitionBy("doc_id", "same").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("last") + length).over(w), F.lit(-1))
    new = F.greatest(F.col("last") + length - F.greatest("first", "reach"), F.lit(0))
    rows = spans.distinct().withColumn("reach", reach)
    return rows.groupBy("doc_id", "same").agg(F.sum(new).cast("long").alias("units"), F.count_if(F.col("first") > F.col("reach")).cast("long").alias("passages"))


HOT_CLASSES = 2_000


def shared_passages(docs: DataFrame, words: int = 51, hot_classes: int = HOT_CLASSES) -> DataFrame:
    """doc_id, same (digest of the text), passage_words, n_passages of the texts that have a passage of `words` words or more which
    another document has too; one row for each such text of an id. Words are what lies between white space. Rows that repeat both id
    and text are one document here. Null and empty texts have none; an empty table gives no rows; further columns are ignored."""
    units = word_units(words)
    scanned = materialize(scan(docs, units).select("doc_id", "same", "gram", "content", "anchor", "lo", "hi"), "word-anchors")
    whole, found = repeated(runs_of(scanned), docs, units, hot_classes)
    return covered(whole.unionByName(found), words).withColumnsRenamed({"units": "passage_words", "passages": "n_passages"})


class RepeatIndex:
    """The repeats of a growing corpus: levels on shared storage, each the runs of some batches, sorted by anchor, and their texts.

    add() scans a batch against itself and all levels; what it returns for all batches together are the spans of the whole corpus.
    Levels of like size merge, so n batches are rewritten about log2(n) times each."""

    def __init__(self, spark: SparkSession, units: Units, hot_classes: int = HOT_CLASSES) -> None:
        self.spark, self.units, self.hot_classes = spark, units, hot_classes
        self.levels: list[tuple[DataFrame, DataFrame, int]] = []

    def _level(self, runs: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        runs = materialize(runs.repartitionByRange("gram").sortWithinPartitions("gram", "content"), "index-runs")
        return runs, materialize(texts, "index-texts"), runs.count()

    def add(self, docs: DataFrame) -> DataFrame:
        """SPAN (in units) of windows of the batch that are repeated, and of older windows that it repeats."""
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        runs, texts, n = self._level(runs_of(scan(texts, self.units)), texts)
        own, every = runs, texts
        for old, old_texts, _ in self.levels:
            own = own.unionByName(old.join(runs.select("gram").distinct(), "gram", "left_semi"))
            every = every.unionByName(old_texts)
        whole, found = repeated(own, every, self.units, self.hot_classes)
        spans = materialize(whole.unionByName(found), "index-spans")
        while self.levels and self.levels[-1][2] <= 2 * n:
            old, old_texts, _ = self.levels.pop()
            runs, texts, n = self._level(old.unionByName(runs), old_texts.unionByName(texts))
        self.levels.append((runs, texts, n))
        return spans


def remove_repeats(docs: DataFrame, length: int = 400, hot_classes: int = HOT_CLASSES, passage_words: int = 51) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (maximal removed runs of bytes), passage_words, n_passages (words in
    passages of `passage_words` words or more that other documents have, see shared_passages); one row per row of docs.

    Texts are taken as UTF-8; null is empty; matches never cross documents but may overlap and lie in one document. `length` is at
    least 64. Texts shorter than `length` lose nothing. Repeated rows lose all if they are long enough. Null ids are ids like
    any other; an empty table gives no rows; further columns are ignored.
    """
    units = Units(length, 64)
    scanned = materialize(scan(docs, units), "anchors")
    whole, found = repeated(runs_of(scanned), docs, units, hot_classes)
    all_gone = whole.distinct().groupBy("doc_id", "same").agg(F.sum(F.col("last") - F.col("first") + 1).alias("windows"))
    state = scanned.select("doc_id", "same", "n_bytes", "sha256")
    spans = materialize(whole.unionByName(found), "spans-found")
    full = materialize(all_gone.join(state.select("doc_id", "same", "n_bytes").distinct(), (all_gone.doc_id.eqNullSafe(scanned.doc_id)) & (all_gone.same == scanned.same)).where(F.col("windows") == F.col("n_bytes") - length + 1).select(all_gone.doc_id, all_gone.same), "gone")
    shared = materialize(shared_passages(docs, passage_words, hot_classes), "passages").select(F.col("doc_id").alias("p_id"), F.col("same").alias("p_same"), "passage_words", "n_passages")
    state = state.join(shared, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("same") == F.col("p_same")), "left")
    return _result(state.fillna(0, ["passage_words", "n_passages"]), spans, full, docs, length)


def _result(state: DataFrame, spans: DataFrame, full: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    f = full.select(F.col("doc_id").alias("f_id"), F.col("same").alias("f_same"))
    part = spans.join(f, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("same") == F.col("f_same")), "left_anti")
    c = cut_texts(part, docs, length).withColumnRenamed("doc_id", "c_id").withColumnRenamed("same", "c_same")
    rows = state.join(c, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("same") == F.col("c_same")), "left")
    rows = rows.join(f, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("same") == F.col("f_same")), "left")
    gone = F.col("f_same").isNotNull()
    pick = lambda x, every, none: F.when(gone, every).otherwise(F.coalesce(x, none))
    kind = "array<struct<start:int,end:int>>"
    return rows.select("doc_id", "n_bytes", pick("n_removed", F.col("n_bytes"), F.lit(0)).cast("long").alias("n_removed"), pick("n_spans", F.lit(1), F.lit(0)).cast("long").alias("n_spans"), pick("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest()), F.col("sha256")).alias("kept_sha256"),
                       pick("spans", F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end"))).cast(kind), F.array().cast(kind)).alias("spans"), "passage_words", "n_passages")
