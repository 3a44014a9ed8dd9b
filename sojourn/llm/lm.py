"""Language-model scoring: a gated recurrent network with a class-factored output, in numpy.

A word's chance is the network's chance of its class times its chance within the class, both given all words before it in the
document. Classes are frequent words on their own, the other words by their last letters and closing punctuation, and the end of
a text. Within a class the network has a softmax over the class's named words (the `WORDS` most frequent after the heads) and one
bucket for all its rare words; the vector of a named word or bucket is the same as input and as output. In its bucket a rare word
has the share of its count, and the bucket keeps the share of its hapax legomena for unknown words. Classes, named words and
counts come from all training documents. The weights start from a bounded sample (`sample_docs`); then training documents are dealt
into groups by a hash, each group trains its own copy on its documents, whole, by truncated backpropagation with the state carried
from window to window, and the copies are averaged by their tokens. Groups don't depend on how the table is laid out.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm import dictionary
from sojourn.llm.common import least_hashes, materialize, text_or_empty

HIDDEN, WINDOW, LONGEST, HEADS, SUFFIXES, OTHERS, WORDS = 16, 16, 64, 72, 23, 4, 2000
#: Tokens of a group that trains a copy.
GROUP_TOKENS = 8_000_000
CLASSES = 1 + HEADS + 2 * (SUFFIXES + OTHERS)
SHAPES = {"x": (CLASSES, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "v": (HIDDEN, CLASSES), "c": (CLASSES,)}
CLOSING = ".,;:!?)\"'"


def words_of(text: str) -> list[bytes]:
    """What lies between white space, A-Z lower-cased."""
    return text.encode().lower().split()


def suffix_of(word: str) -> str:
    return word.rstrip(CLOSING)[-2:]


class Inventory:
    """The class of a word by its spelling: 0 is the end of a text. Its unit is its class, or a number from CLASSES on if it is named."""

    def __init__(self, heads: list[str], suffixes: list[str], named: list[str] = ()) -> None:
        self.heads, self.suffixes = {w: 1 + i for i, w in enumerate(heads)}, {s: i for i, s in enumerate(suffixes)}
        self.named = {w: CLASSES + i for i, w in enumerate(named)}
        self.class_of = np.array([*range(CLASSES), *map(self, named)], np.int64)
        self.order = np.argsort(self.class_of, kind="stable")  # a class's bucket, then its named words
        self.starts = np.searchsorted(self.class_of[self.order], np.arange(CLASSES + 1))
        self.place = np.empty(len(self.order), np.int64)
        self.place[self.order] = np.arange(len(self.order)) - self.starts[self.class_of[self.order]]

    def __call__(self, word: str) -> int:
        if found := self.heads.get(word):
            return found
        core = word.rstrip(CLOSING)
        return self.ending(core[-2:], core != word)

    def ending(self, suffix: str, closed: bool) -> int:
        """The class of words by suffix and closing punctuation; suffixes that aren't known are dealt by a hash."""
        known = self.suffixes.get(suffix)
        return 1 + HEADS + 2 * (SUFFIXES + crc32(suffix.encode()) % OTHERS if known is None else known) + closed

    def unit(self, word: str) -> int:
        return self.named.get(word) or self(word)

    def units(self, words: pa.Array) -> np.ndarray:
        """`unit` of many words at once."""
        core = pc.utf8_rtrim(words, characters=CLOSING)
        closed = pc.not_equal(core, words).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = pc.utf8_slice_codeunits(core, start=-2).dictionary_encode()
        first = np.array([self.ending(e, False) for e in ends.dictionary.to_pylist()], np.int64)
        out = first[ends.indices.to_numpy(zero_copy_only=False)] + closed if len(words) else np.zeros(0, np.int64)
        own = {**self.heads, **self.named}
        at = pc.index_in(words, value_set=pa.array(list(own), pa.string())).to_numpy(zero_copy_only=False)
        found = ~np.isnan(at.astype(float))
        out[found] = np.array(list(own.values()), np.int64)[at[found].astype(np.int64)]
        return out

    def members(self, c: int) -> np.ndarray:
        return self.order[self.starts[c] : self.starts[c + 1]]


Params = dict[str, np.ndarray]


def fresh(seed: int = 1) -> Params:
    rng = np.random.default_rng(seed)
    return {k: (rng.normal(0, 0.0 if k == "c" else 0.25 if k == "u" else 0.1, s)).astype(np.float32) for k, s in SHAPES.items()}


def shapes(known: Inventory) -> dict[str, tuple[int, ...]]:
    """With those of the words: a vector and an offset of each unit, and the way from vectors to inputs."""
    n = len(known.class_of)
    return SHAPES | {"w": (n, HIDDEN), "b": (n,), "a": (HIDDEN, 3 * HIDDEN)}


def flat(p: Params) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def shaped(values: np.ndarray, known: Inventory) -> Params:
    ends = np.cumsum([np.prod(s) for s in shapes(known).values()])
    return {k: v.reshape(s).astype(np.float32) for (k, s), v in zip(shapes(known).items(), np.split(values, ends[:-1]))}


def inputs(p: Params, known: Inventory) -> np.ndarray:
    """What each unit gives to the gates."""
    return p["x"][known.class_of] + p["w"] @ p["a"]


class Lanes:
    """Sequences of classes or units side by side, the longest first: inputs begin with the end class, targets end with it."""

    def __init__(self, sequences: list[np.ndarray]) -> None:
        self.order = np.argsort([-len(s) for s in sequences], kind="stable")
        own = [sequences[i] for i in self.order]
        self.size = np.array([len(s) + 1 for s in own])
        self.first = np.cumsum(self.size) - self.size
        self.values = np.concatenate([x for s in own for x in (s, [0])] + [np.zeros(LONGEST, np.int64)]).astype(np.int64)

    def windows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Lanes still open, inputs and targets (time, lane), and which targets are there. Windows are longer when few lanes are open."""
        t, n = 0, 0
        while (t := t + n) < self.size[0]:
            m = int(np.searchsorted(-self.size, -t))
            n = min(LONGEST, max(WINDOW, 8192 // m), int(self.size[0]) - t)
            at = self.first[:m] + t + np.arange(n)[:, None]
            given = self.values[np.maximum(at - 1, 0)]
            if t == 0:
                given[0] = 0
            yield m, given, self.values[np.minimum(at, len(self.values) - 1)], (t + np.arange(n))[:, None] < self.size[:m]


def by_gate(weights: np.ndarray) -> np.ndarray:
    """(gate, row, hidden) of rows that hold the three gates' weights side by side."""
    return np.ascontiguousarray(weights.reshape(-1, 3, HIDDEN).transpose(1, 0, 2))


def forward(p: Params, h: np.ndarray, given: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """States after each input (time, lane, hidden), and what the way back needs. table: inputs of units, if `given` has units. Each
    gate's numbers lie together."""
    u, out, kept = by_gate(p["u"]), np.empty((*given.shape, HIDDEN), h.dtype), []
    x = np.take(by_gate(p["x"] if table is None else table), given, axis=1)
    for t in range(len(given)):
        a = h @ u
        g = a[:2]
        g += x[:2, t]
        np.exp(np.negative(g, out=g), out=g)
        g += 1
        np.reciprocal(g, out=g)
        z, r = g
        new = r * a[2]
        new += x[2, t]
        np.tanh(new, out=new)
        kept.append((h, z, r, new, a[2]))
        h = np.subtract(h, new, out=out[t])
        h *= z
        h += new
    return out, kept


def highest(w: np.ndarray, b: np.ndarray) -> float:
    """No state gives larger odds, in logs, nor smaller ones below zero: states lie between -1 and 1."""
    return float((np.abs(w).sum(axis=0) + np.abs(b)).max())


def class_logs(p: Params, states: np.ndarray, targets: np.ndarray, there: np.ndarray | None = None, rows: int = 1024) -> tuple[np.ndarray, Params, np.ndarray | None]:
    """Natural log of each target's chance; with `there`, which targets count, also gradients of their mean loss by v and c and by the
    states. Goes by slices of rows, so that odds stay in a core's cache."""
    flat_states, flat_targets, ones = states.reshape(-1, HIDDEN), targets.ravel(), np.ones(CLASSES, states.dtype)
    logs, high = np.empty(len(flat_targets), states.dtype), highest(p["v"], p["c"]) > 60
    g = {k: np.zeros_like(p[k]) for k in "vc"} if there is not None else {}
    back = np.empty_like(flat_states) if there is not None else None
    weight = None if there is None else (there.ravel() / max(int(there.sum()), 1)).astype(states.dtype)
    for i in range(0, len(flat_targets), rows):
        h, own = flat_states[i : i + rows], flat_targets[i : i + rows]
        at, s = np.arange(len(own)), h @ p["v"]
        s += p["c"]
        if high:  # else exp has room
            s -= s.max(axis=1, keepdims=True)
        said = s[at, own]
        total = np.exp(s, out=s) @ ones
        logs[i : i + rows] = said - np.log(total)
        if there is not None:
            w = weight[i : i + rows]
            s *= (w / total)[:, None]
            s[at, own] -= w
            g["v"] += h.T @ s
            g["c"] += np.ones(len(own), s.dtype) @ s
            back[i : i + rows] = s @ p["v"].T
    return logs.reshape(targets.shape), g, None if back is None else back.reshape(states.shape)


def word_logs(p: Params, known: Inventory, states: np.ndarray, targets: np.ndarray, there: np.ndarray, learn: bool = False) -> tuple[np.ndarray, Params, np.ndarray]:
    """Natural log of each target unit's chance within its class; to learn, gradients of the mean loss by w and b and by the states."""
    s, units, classes = states.reshape(-1, HIDDEN), targets.ravel(), known.class_of[targets.ravel()]
    logs, back = np.zeros(len(units), s.dtype), np.zeros_like(s) if learn else s
    g = {k: np.zeros_like(p[k]) for k in "wb"} if learn else {}
    scale, high = s.dtype.type(1 / max(int(there.sum()), 1)), highest(p["w"].T, p["b"]) > 60
    on = np.flatnonzero(there.ravel() & (np.diff(known.starts) > 1)[classes])
    on = on[np.argsort(classes[on].astype(np.uint8), kind="stable")]
    cuts = np.flatnonzero(np.diff(classes[on], prepend=-1, append=CLASSES))
    for i, j in zip(cuts[:-1], cuts[1:]):
        m = known.members(classes[on[i]])
        w, b, step, ones = p["w"][m].T, p["b"][m], max(1, (1 << 15) // len(m)), np.ones(len(m), s.dtype)
        for k in range(i, j, step):  # odds of a slice take 2 MB
            at = on[k : min(k + step, j)]
            own, h = (np.arange(len(at)), known.place[units[at]]), s[at]
            odds = h @ w
            odds += b
            if high:  # else exp has room
                odds -= odds.max(axis=1, keepdims=True)
            said = odds[own]
            total = np.exp(odds, out=odds) @ ones
            logs[at] = said - np.log(total)
            if learn:
                odds[own] -= total
                weight = (scale / total)[:, None]
                g["w"][m] += odds.T @ (h * weight)
                g["b"][m] += weight[:, 0] @ odds
                back[at] = odds @ w.T * weight
    return logs.reshape(targets.shape), g, back.reshape(states.shape)


def backward(p: Params, kept: list[tuple[np.ndarray, ...]], given: np.ndarray, states: np.ndarray, slope: np.ndarray, rows: int = CLASSES) -> Params:
    """Gradients by u and x of a loss whose slope by the states is given; the state before the window counts as given. That by x is for
    as many `rows` as there are inputs."""
    dh_out, n, out = slope, HIDDEN, {"u": np.zeros_like(p["u"])}
    dx, dh, da, ut = np.empty((*given.shape, 3 * n), np.float32), np.zeros_like(states[0]), np.empty((given.shape[1], 3 * n), states.dtype), p["u"].T
    for t in range(len(given) - 1, -1, -1):
        h, z, r, new, a = kept[t]
        dh = dh + dh_out[t]
        rest = 1 - z
        rest *= dh
        dz = (h - new) * z
        dz *= rest
        dn = 1 - new * new
        dn *= rest
        back = dn * r
        dr = (1 - r) * a
        dr *= back
        da[:, :n], da[:, n : 2 * n], da[:, 2 * n :] = dz, dr, dn
        dx[t] = da
        da[:, 2 * n :] = back
        out["u"] += h.T @ da
        dh *= z
        dh += da @ ut
    order = np.argsort(given.ravel().astype(np.uint16), kind="stable")  # units are under 65536
    own = given.ravel()[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    out["x"] = np.zeros((rows, 3 * n), p["x"].dtype)
    out["x"][own[starts]] = np.add.reduceat(dx.reshape(-1, 3 * n)[order], starts)
    return out


def slopes(p: Params, known: Inventory, h: np.ndarray, given: np.ndarray, targets: np.ndarray, there: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients of the mean loss of a window of units by all weights, and the state after it."""
    states, kept = forward(p, h, given, inputs(p, known))
    classes = known.class_of[targets]
    _, own, slope = class_logs(p, states, classes, there)
    _, words, more = word_logs(p, known, states, targets, there, learn=True)
    g = own | backward(p, kept, given, states, slope + more, len(known.class_of))
    by_unit = g["x"]
    g["x"] = np.add.reduceat(by_unit[known.order], known.starts[:-1])
    return g | {"w": words["w"] + by_unit @ p["a"].T, "b": words["b"], "a": p["w"].T @ by_unit}, states[-1]


def train(p: Params, known: Inventory, sequences: list[np.ndarray], lanes: int, rate: float, epochs: int = 1, seed: int = 0) -> Params:
    """Adam over windows; documents of like length go side by side, and a lane's state goes from window to window."""
    p, by_length, rng = {k: v.copy() for k, v in p.items()}, sorted(sequences, key=len), np.random.default_rng(seed)
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    groups = [by_length[i : i + lanes] for i in range(0, len(by_length), lanes)]
    for _ in range(epochs):
        for i in rng.permutation(len(groups)):
            h = np.zeros((len(groups[i]), HIDDEN), np.float32)
            for m, given, targets, there in Lanes(groups[i]).windows():
                g, h = slopes(p, known, h[:m], given, targets, there)
                step += 1
                scale = min(1.0, 1.0 / (float(np.sqrt(sum((x * x).sum() for x in g.values()))) + 1e-9))
                move = rate * min(1.0, int(there.sum()) / (lanes * WINDOW))  # windows of few tokens, as at the end of a long text, move little
                for k in p:
                    m1[k] = 0.9 * m1[k] + 0.1 * scale * g[k]
                    m2[k] = 0.999 * m2[k] + 0.001 * (scale * g[k]) ** 2
                    p[k] = p[k] - move * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return p


def class_scores(p: Params, sequences: list[np.ndarray], known: Inventory | None = None, side_by_side: int = 1024) -> np.ndarray:
    """Natural log of the chance of each whole sequence of classes, or of units if there is an inventory, and its end. So many
    documents of like length go side by side."""
    result, table = np.empty(len(sequences)), inputs(p, known) if known else None
    order = np.argsort([len(s) for s in sequences], kind="stable")
    for i in range(0, len(order), side_by_side):
        own = order[i : i + side_by_side]
        lanes, h, out = Lanes([sequences[j] for j in own]), np.zeros((len(own), HIDDEN), np.float32), np.zeros(len(own))
        for m, given, targets, there in lanes.windows():
            states = forward(p, h[:m], given, table)[0]
            h = states[-1]
            logs = class_logs(p, states, known.class_of[targets] if known else targets)[0]
            if known:
                logs = logs + word_logs(p, known, states, targets, there)[0]
            out[:m] += np.where(there, logs, 0.0).sum(axis=0, dtype=np.float64)
        result[own[lanes.order]] = out
    return result


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 10, is 0; so are rows without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(True))


def surveyor() -> Callable[[list[str], np.ndarray], tuple[list[list[int]], list[int]]]:
    """For each word its training count. As a bucket's summary, in integers: of words by suffix and whether punctuation closes them
    their occurrences and hapax legomena, the most frequent words, and how many distinct words there are."""

    def answer(words: list[str], totals: np.ndarray) -> tuple[list[list[int]], list[int]]:
        every, once = Counter(), Counter()
        for w, n in zip(words, totals.tolist()):
            if n:
                key = suffix_of(w), CLOSED if w.endswith(tuple(CLOSING)) else PLAIN
                every[key] += n
                once[key] += n == 1
        most = HEADS + WORDS
        least = max(1, int(np.partition(totals, -most)[-most])) if len(totals) > most else 1
        top = heapq.nsmallest(most, ((-int(totals[i]), words[i]) for i in np.flatnonzero(totals >= least)))
        out = []
        for kind, key, n, k in [*((kind, e, n, once[e, kind]) for (e, kind), n in every.items()), *((TOP, w, -n, 0) for n, w in top), (DISTINCT, "", int((totals > 0).sum()), 0)]:
            raw = key.encode()
            out += [kind, n, k, len(raw), *np.frombuffer(raw + bytes(-len(raw) % 8), "<i8").tolist()]
        return totals.reshape(-1, 1).tolist(), out

    return answer


TOP, PLAIN, CLOSED, DISTINCT = range(4)


class Counts:
    """The inventory, occurrences of each unit, hapax legomena of each class's bucket, and how many distinct words there are."""

    def __init__(self, known: Inventory, units: np.ndarray, once: np.ndarray, distinct: int) -> None:
        self.known, self.units, self.once, self.distinct = known, units, once, distinct


def survey(packed: DataFrame) -> Counts:
    """Heads, suffixes of the other words and named words, by the counts of all training documents (what `surveyor` gave)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in (x for b in batches for x in b.column("summary")):
            values, i, rows = data.values.to_numpy(zero_copy_only=False), 0, []
            while i < len(values):
                kind, n, once, size = values[i : i + 4].tolist()
                end = i + 4 + -(-size // 8)
                rows.append((kind, values[i + 4 : end].astype("<i8").tobytes()[:size].decode(), n, once))
                i = end
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["kind", "key", "n", "once"])

    found = materialize(packed.where("summary is not null").select("summary").mapInArrow(read, "kind long, key string, n long, once long"), "survey")
    spark = found.sparkSession
    top = [(r.key, r.n) for r in found.where(F.col("kind") == TOP).orderBy(F.desc("n"), "key").limit(HEADS + WORDS).collect()]
    taken = [(CLOSED if w.endswith(tuple(CLOSING)) else PLAIN, suffix_of(w), -n, -(n == 1), i < HEADS) for i, (w, n) in enumerate(top)]
    less = spark.createDataFrame(taken, "kind long, key string, n long, once long, head boolean")  # at most HEADS + WORDS rows
    ends = found.where(F.col("kind").isin(PLAIN, CLOSED)).withColumn("head", F.lit(True)).unionByName(less)
    order = ends.where("head").groupBy("key").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("n"), "key")
    suffixes = [r.key for r in order.limit(SUFFIXES).collect()]
    words = [w for w, _ in top]
    known = Inventory(words[:HEADS], suffixes, words[HEADS:])
    units, once = np.zeros(len(known.class_of), np.int64), np.zeros(CLASSES, np.int64)
    for w, n in top:
        units[known.unit(w)] = n
        if w in known.heads:
            once[known.heads[w]] = n == 1
    rest = F.crc32(F.col("key").cast("binary")) % OTHERS  # few groups: named suffixes, or what the others are dealt by
    named = F.col("key").isin(suffixes)
    sums = ends.groupBy(F.when(named, F.col("key")).alias("suffix"), F.when(~named, rest).alias("other"), "kind")
    for r in sums.agg(F.sum("n").alias("n"), F.sum("once").alias("once"), F.min("key").alias("key")).collect():
        c = known.ending(r.key, r.kind == CLOSED)
        units[c], once[c] = r.n, r.once
    distinct = found.where(F.col("kind") == DISTINCT).agg(F.sum("n")).first()[0] or 0
    return Counts(known, units, once, distinct)


def coded(blocks: DataFrame, known: Inventory, groups: int) -> DataFrame:
    """group, doc_id, units (16 bits each) of training documents, dealt into groups by a hash of id and units."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words in ((r, w.values) for b in batches for r, w in zip(b.drop_columns(["words"]).to_pylist(), b.column("words"))):
            units = known.units(words).astype("<u2")
            parts = np.split(units[dictionary.unpack_codes(row["codes"])], np.cumsum(dictionary.unpack(row["sizes"]))[:-1])
            own = [(doc, u.tobytes()) for doc, u, f in zip(row["doc_ids"], parts, row["flags"]) if f]
            of = [xxhash.xxh3_64_intdigest(u, seed=(doc or 0) % 2**64) % groups for doc, u in own]
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array([d for d, _ in own], pa.int64()), pa.array([u for _, u in own], pa.binary())], names=["group", "doc_id", "units"])

    return blocks.select("doc_ids", "flags", "sizes", "codes", "words").mapInArrow(deal, "group long, doc_id long, units binary")


def sequence(units: pa.Scalar) -> np.ndarray:
    return np.frombuffer(units.as_buffer(), "<u2")


def start(rows: DataFrame, counts: Counts, docs: int, sample_docs: int) -> Params:
    """First weights from at most `sample_docs` of the `docs` whole training documents (what `coded` gave), chosen by a hash, in one
    task."""
    known, mass = counts.known, counts.units

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = [sequence(u) for b in batches for u in b.column("units")]
        p, rng = fresh(), np.random.default_rng(2)
        share = np.bincount(known.class_of[np.concatenate([[0] * len(sequences), *sequences]).astype(np.int64)], minlength=CLASSES) + 0.5
        p["c"] = np.log(share / share.sum()).astype(np.float32)
        p |= {"w": rng.normal(0, 0.1, (len(mass), HIDDEN)).astype(np.float32), "b": np.log(mass + 1).astype(np.float32), "a": np.zeros((HIDDEN, 3 * HIDDEN), np.float32)}
        yield pa.RecordBatch.from_arrays([pa.array([flat(train(p, known, sequences, 48, 0.01, 3)).astype(float)], pa.list_(pa.float64()))], names=["weights"])

    sample = least_hashes(rows.select("doc_id", "units"), F.xxhash64(F.lit(2), "doc_id", "units"), docs, sample_docs)
    found = sample.select("units").coalesce(1).mapInArrow(learn, "weights array<double>").collect()
    return shaped(np.array(found[0].weights), known) if found else {k: np.zeros(s, np.float32) for k, s in shapes(known).items()}


def averaged(rows: DataFrame, known: Inventory, p: Params, lanes: int = 1024, rate: float = 0.002) -> Params:
    """Each group of rows (what `coded` gave) trains a copy on its documents in the order of id and units. The copies' mean by tokens;
    what comes back is as large as the model."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(sum(int(np.prod(s)) for s in shapes(known).values())), 0
        now, held = None, []

        def close() -> None:
            nonlocal total, weight
            n = sum(len(s) + 1 for s in held)
            total, weight = total + n * flat(train(p, known, held, lanes, rate, seed=now)).astype(float), weight + n

        for b in batches:
            for group, u in zip(b.column("group").to_pylist(), b.column("units")):
                if held and group != now:
                    close()
                    held = []
                now = group
                held.append(sequence(u))
        if held:
            close()
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([total / weight], pa.list_(pa.float64())), pa.array([weight], pa.int64())], names=["weights", "tokens"])

    ordered = rows.repartition(F.col("group")).sortWithinPartitions("group", "doc_id", "units")
    each = ordered.mapInArrow(learn, "weights array<double>, tokens long").select("tokens", F.posexplode("weights").alias("i", "w"))
    mean = each.groupBy("i").agg((F.sum(F.col("w") * F.col("tokens")) / F.sum("tokens")).alias("w")).orderBy("i").collect()
    return shaped(np.round([r.w for r in mean], 6), known) if mean else p


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, sample_docs: int = 1500, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's chance). One row per row.

    Null and empty texts have one token, the end. Null ids are held out. Repeated rows count as often as they are there. Without
    training documents all classes are equally likely. An empty table gives no rows; further columns are ignored. The same rows
    give the same scores, up to rounding, however they are partitioned.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held_out()).alias("flag"), text_or_empty().alias("text"))
    blocks = dictionary.split_blocks(rows, lambda: words_of)
    packed = materialize(dictionary.resolve(blocks, surveyor), "counts")
    counts = survey(packed)
    known, distinct = counts.known, counts.distinct
    ends = blocks.agg(F.coalesce(F.sum(F.size(F.filter("flags", lambda f: f))), F.lit(0))).first()[0]
    total, distinct = int(counts.units.sum()) + ends, distinct + (ends > 0)
    learning = materialize(coded(blocks, known, max(1, total // group_tokens)), "coded")
    p = averaged(learning, known, start(learning, counts, ends, sample_docs))
    mass, spare = counts.units[:CLASSES].astype(float), counts.once + 1.0

    def build(row: dict, found: pa.Table) -> pa.Table:
        sizes, codes = dictionary.unpack(row["sizes"]), dictionary.unpack_codes(row["codes"])
        _, count = dictionary.gathered(found, len(row["words"]))
        units = known.units(row["words"])
        bucket = np.minimum(units, CLASSES - 1)
        below = np.log10(total + 0.1 * (distinct + 1))
        base = np.log10(count + 0.1) - below
        share = np.where(units < CLASSES, np.log10(np.where(count > 0, count, spare[bucket]) / (mass + spare)[bucket]), 0.0)
        cuts = np.cumsum(sizes)[:-1]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        add = lambda x: np.bincount(owner, x[codes], len(sizes))
        chain = class_scores(p, np.split(units[codes], cuts), known) / np.log(10)
        out = [pa.array(row["doc_ids"], pa.int64()), pa.array([not f for f in row["flags"]]), pa.array(sizes + 1), pa.array((add((count > 0).astype(float)) + (ends > 0)).astype(np.int64)), pa.array(np.full(len(sizes), total, np.int64)), pa.array(add(base) + np.log10(ends + 0.1) - below), pa.array(chain + add(share))]
        return pa.table(out, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return dictionary.assemble(blocks.select("block", "doc_ids", "flags", "sizes", "codes", "words"), packed.drop("summary"), build, SCORED)
