"""Keyed lookups and joins of plans with sandbox tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.operators import windows
from sojourn.operators.steps import kept

from sojourn.functions import text


def equal_to(df: DataFrame, **keys: object) -> DataFrame:
    """Rows whose columns have these values: the lookup by two or three keys."""
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def by_plain_key(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows by a key that is compared without what stands in parentheses."""
    return df.where(text.before_parenthesis(F.col(column)) == text.before_parenthesis(F.lit(value)))


def by_name(df: DataFrame, city: str, name: str, of_city: str, of_name: str) -> DataFrame:
    """Rows by city and name, without regard to case and outer blanks."""
    plain = lambda c: F.trim(F.lower(c))
    return df.where((plain(F.col(city)) == plain(F.lit(of_city))) & (plain(F.col(name)) == plain(F.lit(of_name))))


def in_dates(df: DataFrame, column: str, dates: Column) -> DataFrame:
    """Rows from the first to the last date of a list."""
    return df.where(F.col(column).between(F.element_at(dates, 1), F.element_at(dates, -1)))


def without_words(df: DataFrame, column: str, words: list[str]) -> DataFrame:
    for w in words:
        df = df.where(~F.col(column).contains(w))
    return df


def with_any(df: DataFrame, items: str, wanted: list[str]) -> DataFrame:
    """Rows whose list has one of the wanted values."""
    return df.where(F.arrays_overlap(F.col(items), F.array(*map(F.lit, wanted))))


def guarded(df: DataFrame, group: list[str], least: int) -> DataFrame:
    """Rows per group with a status instead of an error where a group has too few."""
    n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"))
    return n.withColumn("status", F.when(F.col("rows") < least, "too_few").otherwise("ok"))


def first_match(facts: DataFrame, dim: DataFrame, on: list[str], order: str, values: list[str]) -> DataFrame:
    """Each fact with the values of the first row, in file order, that matches: the table is reduced before the join."""
    first = dim.groupBy(*on).agg(F.min_by(F.struct(*values), F.col(order)).alias("_first"))
    return facts.join(first, on, "left").select(*facts.columns, *(F.col(f"_first.{v}").alias(v) for v in values))


def known(facts: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    return facts.join(dim.select(*on), on, "left_semi")


def unknown(facts: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    return facts.join(dim.select(*on), on, "left_anti")


def _grams(c: Column, sizes: list[int]) -> Column:
    """All different runs of so many letters, and the empty one."""
    runs = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit("")), *map(runs, sizes)))


def containing(left: DataFrame, right: DataFrame, on: list[str], text_column: str, name: str, q: int = 3, repeated: bool = True) -> DataFrame:
    """Equal in `on`, and the text has the name in it; the two are columns of different sides. Different names meet different texts, and rows
    join those pairs; no side is sent whole to all tasks, however small its file is. repeated: False where left has each name of a key
    once, and nothing else."""
    if not repeated:
        return pairs_containing(left, right, on, text_column, name, q)
    own, other = (name, text_column) if name in left.columns else (text_column, name)
    names, texts = (left, right) if own == name else (right, left)
    met = pairs_containing(names.select(*on, name).distinct(), texts.select(*on, text_column).distinct(), on, text_column, name, q)
    rows = left.hint("merge").join(met, [*on, own]).hint("merge").join(right.hint("merge"), [*on, other])
    return rows.select(*on, *(c for c in (*left.columns, *right.columns) if c not in on))


def pairs_containing(names: DataFrame, texts: DataFrame, on: list[str], text_column: str, name: str, q: int = 3) -> DataFrame:
    """on, further columns of texts, name: different names of a key, and its texts that have them. Texts are indexed by their runs of q letters (a shorter name's
    own length); each name looks among the texts of its rarest run, so the texts of a hot key are split by runs and few of them are
    compared. Names with a run that no text has match nothing. Empty names match every text of their key."""
    names = names.where(F.col(name).isNotNull())
    each = names.withColumn("_gram", F.explode(F.when(F.length(name) < q, F.array(name)).otherwise(F.array_remove(_grams(F.col(name), [q]), ""))))
    runs = texts.withColumn("_gram", F.explode(_grams(F.col(text_column), list(range(1, q + 1)))))
    often = runs.groupBy(*on, "_gram").agg(F.count(F.lit(1)).alias("_often"))
    found = each.join(often.hint("merge"), [*on, "_gram"], "left").groupBy(*on, name).agg(F.min_by("_gram", "_often").alias("_gram"), F.count_if(F.col("_often").isNull()).alias("_lost")).where("_lost = 0").drop("_lost")
    return found.join(runs.hint("merge"), [*on, "_gram"]).where(F.contains(F.col(text_column), F.col(name))).drop("_gram")


def first_containing(left: DataFrame, right: DataFrame, on: list[str], text_column: str, name: str, order: str, values: list[str]) -> DataFrame:
    """on, name, `found`: for each different name of left that some text of its key in right has in it, the values of the first such row
    by order. Different names meet different texts, each with its first row, so what is compared doesn't grow with repetitions."""
    firsts = right.groupBy(*on, text_column).agg(F.min_by(F.struct(order, *values), order).alias("_first"))
    met = containing(left.select(*on, name).distinct(), firsts, on, text_column, name, 3, False)
    return met.groupBy(*on, name).agg(F.min_by(F.struct(*(F.col(f"_first.{v}") for v in values)), F.col(f"_first.{order}")).alias("found"))


def names_within(left: DataFrame, right: DataFrame, on: list[str], text_column: str, name: str) -> DataFrame:
    """on and name: the different names of left that some text of their key in right has in it."""
    return containing(left.select(*on, name).distinct(), right.select(*on, text_column).distinct(), on, text_column, name, 3, False).select(*on, name).distinct()


def holding(texts: DataFrame, passages: DataFrame, text_column: str, passage: str, words: int = 8) -> DataFrame:
    """Pairs of a text and a passage that it holds, letter by letter. A passage's words but for the first and last stand in such a text
    whole, so both sides meet by the hash of the passage's first inner words, up to `words` of them: texts are cut into runs of as
    many words as some passage has there. Passages of fewer than three words are compared with all texts."""
    inner = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    p = passages.withColumn("_w", inner(F.col(passage)))
    p = p.withColumn("_k", F.least(F.lit(words), F.size("_w") - 2))
    keyed = p.where("_k > 0").withColumn("_h", F.xxhash64(F.slice("_w", F.lit(2), F.col("_k"))))
    lengths = [r["_k"] for r in keyed.select("_k").distinct().collect()]  # `words` values at most
    t = texts.withColumn("_t", inner(F.col(text_column)))
    runs = lambda n: F.when(F.size("_t") >= n, F.transform(F.sequence(F.lit(1), F.size("_t") - n + 1), lambda i: F.xxhash64(F.slice("_t", i, n)))).otherwise(F.array().cast("array<bigint>"))
    cut = t.withColumn("_h", F.explode(F.array_distinct(F.concat(*(runs(n) for n in lengths))) if lengths else F.array().cast("array<bigint>"))).drop("_t")
    met = cut.join(keyed.drop("_w", "_k"), "_h").where(F.contains(text_column, passage)).drop("_h")
    short = texts.join(p.where("_k <= 0").drop("_w", "_k"), F.contains(F.col(text_column), F.col(passage)))
    return met.unionByName(short.select(*met.columns))


def within_band(left: DataFrame, right: DataFrame, on: list[str], a: Column, b: Column, tolerance: float) -> DataFrame:
    """Equal in `on`, and a of left within the tolerance of b of right. Values meet by bands twice as wide as the tolerance, each of left's
    also in the two beside its own, so rows that are compared are near each other; nulls meet nothing."""
    width = F.lit(2.0 * tolerance if tolerance > 0 else 1.0)
    own = left.withColumn("_a", a).withColumn("_band", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.floor(F.col("_a") / width) + i)))
    other = right.withColumn("_b", b).withColumn("_band", F.floor(F.col("_b") / width))
    return own.join(other, [*on, "_band"]).where(F.abs(F.col("_a") - F.col("_b")) <= tolerance).drop("_a", "_b", "_band")


def either_key(facts: DataFrame, dim: DataFrame, first: str, second: str, key: str, value: str) -> DataFrame:
    """The value by the first key, or else by the second."""
    a = dim.select(F.col(key).alias(first), F.col(value).alias("_a"))
    b = dim.select(F.col(key).alias(second), F.col(value).alias("_b"))
    return facts.join(a, first, "left").join(b, second, "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def in_all(keys: DataFrame, key: str, tables: list[DataFrame]) -> DataFrame:
    """Keys that every table has."""
    for t in tables:
        keys = keys.join(t.select(key), key, "left_semi")
    return keys


def numbered(df: DataFrame, order: list, name: str = "idx", group: list[str] | None = None) -> DataFrame:
    """Ordinals from 1 within a group, or without one over all rows, in ascending order."""
    if not group:
        return windows.global_rank(df, [(F.col(c) if isinstance(c, str) else c, False) for c in order], name)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))


def zipped(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the same ordinals; the rest of the longer side has nulls."""
    return left.join(right, on, "full_outer")


def least_distance(points: DataFrame, group: str, key: str, distance) -> DataFrame:
    """The least distance of two points of a group. Every pair is made, so groups must be small, as the sights of a city."""
    other = points.select(F.col(group).alias("_g"), *(F.col(c).alias(f"other_{c}") for c in points.columns if c != group))
    return points.join(other, (F.col(group) == F.col("_g")) & (F.col(key) < F.col(f"other_{key}"))).groupBy(group).agg(F.min(distance).alias("least"))


def nearest_pair(points: DataFrame, group: str, key: str, coordinates: list[str], crowd: int = 32, part_rows: int = 10_000) -> DataFrame:
    """group, least: the least straight distance of two points of a group, null for groups of one point. Points with a null coordinate
    aren't looked at.

    Neighbours along the coordinates give a first bound, which is the side of a grid's cells: nearer points lie in the same cell or in
    one beside it. While a cell holds more than `crowd` points, the least distance is smaller than its side by what so many points can
    keep apart, or by their neighbours, and the grid is made finer; then points are compared with those of the cells around them."""
    n = len(coordinates)
    rows = points.select(group, key, *(F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(coordinates)))
    axes = [f"_c{i}" for i in range(n)]
    for c in axes:
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.join(rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")), group)
    rows = kept(rows.withColumn("_part", F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / part_rows))), "points")
    apart = lambda a, b: F.sqrt(sum((F.pow(x - y, F.lit(2)) for x, y in zip(a, b)), F.lit(0.0)))

    def neighbours(table: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(group, *by).orderBy(*axes, key)
        return table.withColumn("_d", apart([F.col(c) for c in axes], [F.lag(c).over(w) for c in axes]))

    bound = kept(neighbours(rows, ["_part"]).groupBy(group).agg(F.min("_d").alias("_b")), "bounds")
    cells = [F.floor(F.col(c) / (F.col("_b") * 1.000001)).alias(f"_g{i}") for i, c in enumerate(axes)]
    names = [f"_g{i}" for i in range(n)]
    while True:
        placed = rows.join(bound.where("_b > 0"), group).select(group, key, *axes, "_b", *cells)
        full = placed.groupBy(group, *names).agg(F.count(F.lit(1)).alias("_m"), F.min("_b").alias("_b")).where(F.col("_m") > crowd)
        full = kept(full, "crowded")
        if full.isEmpty():
            break
        most = F.col("_b") * 1.000001 * (n**0.5) / (F.ceil(F.pow(F.col("_m"), F.lit(1.0 / n)) - 1e-9) - 1)
        inside = neighbours(placed.drop("_b").join(full.withColumn("_most", most), [group, *names]), names)
        finer = inside.groupBy(group).agg(F.least(F.min("_most"), F.min("_d")).alias("_f"))
        bound = kept(bound.join(finer, group, "left").select(group, F.least("_b", F.coalesce("_f", "_b")).alias("_b")), "bounds")
    around = placed
    for g in names:
        around = around.withColumn(g, F.explode(F.array(F.col(g) - 1, F.col(g), F.col(g) + 1)))
    other = placed.select(group, *names, F.col(key).alias("_k"), *(F.col(c).alias(f"{c}o") for c in axes))
    near = around.join(other, [group, *names]).where(F.col(key) < F.col("_k"))
    least = near.groupBy(group).agg(F.min(apart([F.col(c) for c in axes], [F.col(f"{c}o") for c in axes])).alias("_l"))
    return bound.join(least, group, "left").select(group, F.when(F.col("_l").isNull(), F.col("_b")).otherwise(F.least("_l", "_b")).alias("least"))


def scored_pairs(queries: DataFrame, rows: DataFrame, on: str, key: str, values: list[str], score, chunk: int = 256, part_pairs: int = 20_000_000) -> DataFrame:
    """on, a, b, score: each query with each row of its `on` (itself, too, if it is one); both sides carry key and values, and score is a
    function of two structs of values. Different values are scored once for each two that meet. Keys of an `on` with the same values go
    as lists of some `chunk`, two lists meet with their score in one row, and those rows are dealt to a task for some `part_pairs`
    pairs: no pair is moved or sorted, and a task holds the pairs of two lists. Rows without a key are left out."""
    own = lambda df: df.where(F.col(key).isNotNull()).select(on, key, F.struct(*values).alias("_c"))
    alike = queries is rows
    every = own(rows) if alike else own(rows).unionByName(own(queries))
    classes = kept(every.select("_c").distinct().withColumn("_id", F.monotonically_increasing_id()), "classes")

    def lists(df: DataFrame) -> DataFrame:
        placed = kept(own(df).join(classes, "_c").select(on, "_id", key), "placed")
        sizes = placed.groupBy(on, "_id").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("_lists"))
        dealt = placed.join(sizes, [on, "_id"]).withColumn("_list", F.pmod(F.xxhash64(key), F.col("_lists")))
        return kept(dealt.groupBy(on, "_id", "_list").agg(F.sort_array(F.collect_list(key)).alias("_keys")).drop("_list"), "lists")

    b = lists(rows)
    a = b if alike else lists(queries)
    a, b = (t.select(on, F.col("_id").alias(c), F.col("_keys").alias(k)) for t, c, k in ((a, "_x", "a"), (b, "_y", "b")))
    met = a.select(on, "_x").distinct().join(b.select(on, "_y").distinct(), on)
    side = lambda c, v: classes.select(F.col("_id").alias(c), F.col("_c").alias(v))
    scores = met.select("_x", "_y").distinct().join(side("_x", "_p"), "_x").join(side("_y", "_q"), "_y").select("_x", "_y", score(F.col("_p"), F.col("_q")).alias("score"))
    many = lambda t, k: t.groupBy(on).agg(F.sum(F.size(k)).cast("double").alias(f"_{k}"))
    pairs = many(a, "a").join(many(b, "b"), on).agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 0
    two = a.join(met.join(scores, ["_x", "_y"]), [on, "_x"]).join(b, [on, "_y"]).select(on, "a", "b", "score")
    return _dealt(two, pairs, part_pairs).withColumn("a", F.explode("a")).withColumn("b", F.explode("b"))


def _dealt(lists: DataFrame, rows: float, part_rows: int) -> DataFrame:
    """Rows of lists in tasks that make some part_rows rows of them, or fewer, so that 32 tasks share what is to be made."""
    return lists.repartition(max(min(32, math.ceil(rows / 500_000)), math.ceil(rows / part_rows), 1))


def combinations(members: DataFrame, group: str, key: str, k: int, most: int = 32_768, part_rows: int = 20_000_000) -> DataFrame:
    """Every k members of a group, their keys ascending in an array. A group's keys lie in ascending lists; every k lists meet in one row,
    and make `most` combinations at most. Those rows are dealt to a task for some `part_rows` combinations, so none is moved or sorted."""
    size = max(1, int(most ** (1 / k) + 1e-9))
    w = Window.partitionBy(group).orderBy(key)
    placed = members.where(F.col(key).isNotNull()).select(group, key, F.floor((F.row_number().over(w) - 1) / size).alias("_list"))
    lists = kept(placed.groupBy(group, "_list").agg(F.sort_array(F.collect_list(key)).alias("_keys")), "lists")
    n = lists.groupBy(group).agg(F.sum(F.size("_keys")).cast("double").alias("_n"))
    ways = n.select(F.expr(" * ".join(["cast(1 as double)", *(f"(_n - {i}) / {i + 1}" for i in range(k))])).alias("_ways")).where("_ways > 0")
    rows = ways.agg(F.sum("_ways")).first()[0] or 0
    out = lists.select(group, "_list", F.col("_keys").alias("_k0"))
    for i in range(1, k):
        more = lists.select(F.col(group).alias("_g"), F.col("_list").alias("_l"), F.col("_keys").alias(f"_k{i}"))
        out = out.join(more, (F.col(group) == F.col("_g")) & (F.col("_list") <= F.col("_l"))).select(group, F.col("_l").alias("_list"), *(f"_k{x}" for x in range(i + 1)))
    out = _dealt(out.drop("_list"), rows, part_rows)
    for i in range(k):
        out = out.withColumn(f"_k{i}", F.explode(f"_k{i}"))
        out = out.where(F.col(f"_k{i - 1}") < F.col(f"_k{i}")) if i else out
    return out.select(group, F.array(*(f"_k{i}" for i in range(k))).alias("members"))


def parse_predicate(args: str) -> Column:
    """A filter in words: 'a >= 3', 'name contains x', 'rules ~contains y', joined by commas."""
    out = F.lit(True)
    for part in filter(None, (p.strip() for p in args.split(","))):
        for op in (" ~contains ", " contains ", "<=", ">=", "="):
            if op in part:
                left, right = (x.strip() for x in part.split(op, 1))
                c = F.col(left)
                out &= {" ~contains ": ~c.contains(right), " contains ": c.contains(right)}[op] if "contains" in op else {"<=": c <= float(right), ">=": c >= float(right)}[op] if op != "=" else c.cast("string") == right
                break
        else:
            raise ValueError(f"not a predicate: {part}")
    return out


def profile_columns(columns: list[str], allow: list[str] | None = None, deny: tuple[str, ...] = ()) -> list[str]:
    return [c for c in columns if (allow is None or c in allow) and c not in deny]


def is_stated(*values: Column) -> Column:
    """Whether any of several optional wishes is there: neither null, nor '-', nor empty."""
    out = F.lit(False)
    for v in values:
        out = out | F.coalesce(~F.trim(v).isin("", "-", "[]", "None"), F.lit(False))
    return out


def among(df: DataFrame, column: str, values: list, measure: str, least: float) -> DataFrame:
    """Rows of some values that reach a measure, as flights of some dates or lodgings for so many guests."""
    return df.where(F.col(column).isin(*values) & (F.col(measure) >= least))


def fanned_out(areas: DataFrame, places: DataFrame, area: str, facts: DataFrame, place: str) -> DataFrame:
    """Facts of every place of the areas; places without facts stay, with nulls."""
    return areas.join(places, area).join(facts, place, "left")


def index_merged(lists: DataFrame, key: str, items: str, dim: DataFrame, on: str, value: str) -> DataFrame:
    """The values of a key's items in the items' order: key, merged; items that aren't found are left out."""
    each = lists.select(key, F.posexplode(items).alias("_i", on))
    found = each.join(dim.select(on, F.col(value).alias("_v")), on)
    return found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias("merged"))


def hydrated(ids: DataFrame, log: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """ids with the value of their last row of a log, if there is one."""
    last = log.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))
    return ids.join(last, key, "left")
