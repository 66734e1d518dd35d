"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole blocks, edit similarity (DataFrame operations only)."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.llm.common import LAST_ID, col, columns_of, connected_components, field, join_spread, materialize, row_of, tidied

RADIUS = 3
SIMILARITY = 0.8
#: Members of a block up to which it is compared as it is; larger ones are split once more.
BLOCK = 24
#: Members of a split block that meet as many others in one task.
CELL = 1024
#: Rows of a few longs up to which a counted table is broadcast.
BROADCAST_ROWS = 200_000
_ROW = ("id", "tie", "pos")
#: Lowest bit of the number that tells keys of different blocks apart.
_NUMBER = 55


def normalised(line: Column) -> Column:
    """Lower case, runs of anything but letters and digits made one space, ends trimmed."""
    return F.btrim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def _ones(lanes: int) -> int:
    return sum(1 << (64 // lanes * i) for i in range(lanes))


def _gap(n: Column, lanes: int) -> Column:
    """What lifts a counter of over half of n to its lane's last bit but one; nothing carries into the next lane."""
    return (F.lit(1 << (64 // lanes - 2)) - F.shiftright(n, 1) - 1) * F.lit(_ones(lanes))


def _over_half(counts: Column, gap: str, lanes: int) -> Column:
    """The lowest bit of each lane whose counter is over half."""
    return F.shiftrightunsigned(counts + F.col(gap), 64 // lanes - 2).bitwiseAND(F.lit(_ones(lanes)))


def _short_simhash(planes: list[str], gap: str) -> Column:
    """SimHash of fewer than 128 hashes from eight sums; counter i of sum b counts bit 8 * i + b. To be compared, the
    counters of a sum are spread over two longs."""
    every_other = F.lit(0x00FF00FF00FF00FF)
    bits = []
    for b, counts in enumerate(planes):
        bits.append(F.shiftleft(_over_half(F.col(counts).bitwiseAND(every_other), gap, 4), b))
        bits.append(F.shiftleft(_over_half(F.shiftrightunsigned(counts, 8).bitwiseAND(every_other), gap, 4), b + 8))
    return reduce(Column.bitwiseOR, bits)


def _wide_simhash(hashes: str, gap: str, lanes: int) -> Column:
    """SimHash of fewer than 2 ** (64 / lanes - 2) hashes of an array, by sums of `lanes` counters to a long."""
    ones = F.lit(_ones(lanes))

    def plane(b: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(x, b).bitwiseAND(ones))

    return reduce(Column.bitwiseOR, [F.shiftleft(_over_half(plane(b), gap, lanes), b) for b in range(64 // lanes)])


def occurrences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, tie, pos, k, fp) of every line that has letters or digits: k is a hash of its normalised words in order,
    fp the SimHash over its distinct ones.

    The bits of short lines are summed up in a grouping by line, combined where the lines lie; for lines of 128 words
    or more an aggregate over the array has wider counters, for any length.
    """
    at = _keyed(docs, doc_id, text).select("id", "tie", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    words = F.transform(F.split(F.lower("line"), r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(w))
    rows = at.select(*_ROW, F.array_remove(words, F.xxhash64(F.lit(""))).alias("w"))
    rows = rows.select(*_ROW, F.xxhash64("w").alias("k"), F.array_distinct("w").alias("h"))
    n = F.size("h")
    rows = rows.withColumns({"gap4": F.when(n < 1 << 14, _gap(n.cast("long"), 4)), "gap2": _gap(n.cast("long"), 2)})
    wide = F.when(n >= 1 << 14, _wide_simhash("h", "gap2", 2)).when(n >= 1 << 7, _wide_simhash("h", "gap4", 4))
    rows = rows.select(*_ROW, "k", wide.alias("wide"), F.explode(F.when(n < 1 << 7, F.col("h")).otherwise(F.array(F.lit(0).cast("long")))).alias("x"))
    eight = F.lit(_ones(8))
    sums = [F.sum(F.shiftrightunsigned("x", b).bitwiseAND(eight)).alias(f"p{b}") for b in range(8)]
    counted = rows.groupBy(*_ROW, "k", "wide").agg(F.count("*").alias("n"), *sums).withColumn("gap", _gap(F.col("n"), 4))
    return counted.select(*_ROW, "k", F.coalesce("wide", _short_simhash([f"p{b}" for b in range(8)], "gap")).alias("fp"))


def _small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _chosen(n: int, radius: int) -> int:
    """How many of radius + so many blocks make a key, so that strangers rarely share one among n fingerprints."""
    chosen = 2
    while chosen < 7 and 64 * chosen / (radius + chosen) < math.log2(max(n, 1)) + 5:
        chosen += 1
    return chosen


def _cuts(blocks: int) -> list[tuple[int, int]]:
    return [(64 * i // blocks, 64 * (i + 1) // blocks) for i in range(blocks)]


def _blocks(fp: str, radius: int, chosen: int) -> list[Column]:
    """Keys of radius + chosen blocks, `chosen` at a time: fingerprints within the radius agree on one key at least."""
    part = [F.shiftrightunsigned(F.shiftleft(fp, 64 - hi), 64 - hi + lo) for lo, hi in _cuts(radius + chosen)]
    width = -(-64 // (radius + chosen))
    return [reduce(Column.bitwiseOR, [F.shiftleft(part[i], width * at) for at, i in enumerate(some)], F.lit(t << _NUMBER).cast("long")) for t, some in enumerate(combinations(range(radius + chosen), chosen))]


def _rest(radius: int, chosen: int) -> list[list[int]]:
    """Per key masks of the other bits, cut into radius + 1: fingerprints within the radius agree on one at least."""
    cuts, out = _cuts(radius + chosen), []
    for some in combinations(range(radius + chosen), chosen):
        bits = [b for t, (lo, hi) in enumerate(cuts) if t not in some for b in range(lo, hi)]
        ends = [len(bits) * s // (radius + 1) for s in range(radius + 2)]
        masks = [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(ends, ends[1:], strict=False)]
        out.append([m - (m >> 63 << 64) for m in masks])
    return out


def _squares(left: DataFrame, right: DataFrame, n: str, m: str, cell: int) -> DataFrame:
    """Join of left and right by key, dealt over squares of `cell` members a side; n and m are a key's members on each side."""
    gl, gr = F.greatest(F.lit(1), F.ceil(F.col(n) / cell)).cast("int"), F.greatest(F.lit(1), F.ceil(F.col(m) / cell)).cast("int")

    def dealt(side: DataFrame, by: str, own: Column, other: Column, names: tuple[str, str]) -> DataFrame:
        rest = [c for c in side.columns if c not in (n, m)]
        return side.select(*rest, F.pmod(F.xxhash64(by), own).cast("int").alias(names[0]), F.explode(F.sequence(F.lit(0), other - 1)).alias(names[1]))

    return dealt(left, "x", gl, gr, ("row", "column")).join(dealt(right, "y", gr, gl, ("column", "row")), ["key", "row", "column"])


def apart_pairs(members: DataFrame, cell: int = CELL) -> DataFrame:
    """All pairs (x, y) of members v of a key that belong to different roots, some of them both ways round.

    Members of a key's commonest root stand on one side only, so that a group that is connected already costs as
    many comparisons as its key has others. A null root is like no other.
    """
    members = members.withColumn("r", F.coalesce("root", F.col("v")))
    held = members.groupBy("key", "r").agg(F.count("*").alias("c"))
    most = held.groupBy("key").agg(F.count("*").alias("roots"), F.sum("c").alias("m"), F.max("c").alias("c")).where("roots > 1")
    main = held.join(most, ["key", "c"]).groupBy("key", "c", "m").agg(F.min("r").alias("main")).select("key", "main", "m", (F.col("m") - F.col("c")).alias("n"))
    named = members.join(main, "key").select("key", "v", "root", "r", "main", "n", "m")
    left = named.where("r <> main").select("key", F.col("v").alias("x"), F.col("root").alias("rx"), "n", "m")
    right = named.select("key", F.col("v").alias("y"), F.col("root").alias("ry"), "n", "m")
    return _squares(left, right, "n", "m", cell).where("x <> y and (rx is null or ry is null or rx <> ry)").select("x", "y")


class Candidates:
    """Pairs of different line keys (k, fp) whose fingerprints differ in `radius` bits at most.

    Such fingerprints are equal or agree on a key of blocks; the more fingerprints there are, the longer the keys.
    stars pairs every member of a block with its least one; rest() gives all pairs of members whose lines what is known
    by then does not connect, so that a large group of near copies costs its size and not its square. A block of two
    is a star by itself; of blocks of more than `block` members the rest is found by pigeonhole over their other bits,
    which loses no pair.
    """

    def __init__(self, lines: DataFrame, radius: int = RADIUS, block: int = BLOCK, chosen: int | None = None) -> None:
        self.lines, self.radius, self.block = lines, radius, block
        reps = materialize(lines.groupBy("fp").agg(F.min("k").alias("least"), F.count("*").alias("same")))
        self.chosen = chosen or _chosen(reps.count(), radius)
        keyed = reps.select("fp", F.explode(F.array(*_blocks("fp", radius, self.chosen))).alias("key"))
        # nearly all keys occur once: a sort finds the others without a hash table of all of them
        every = Window.partitionBy("key")
        met = keyed.select("fp", "key", F.count("*").over(every).alias("n"), F.min("fp").over(every).alias("x"), F.max("fp").over(every).alias("y"))
        met = materialize(met.where("n > 1").where((F.col("n") > 2) | (self.close("x", "y"))))
        self.met = met.where("n > 2").select("fp", "key", "n", "x")
        fps = self.met.select("x", F.col("fp").alias("y")).where("x <> y").where(self.close("x", "y"))
        self.twos = met.where("n = 2 and fp = x").select("x", "y")
        self.pairs = _small(materialize(self.twos.union(fps).distinct()))
        self.split = _small(materialize(reps.where("same > 1").select("fp", "least")))
        equal = lines.join(self.split, "fp").where("k <> least").select(F.col("least").alias("a"), F.col("k").alias("b"))
        least = reps.select("fp", "least")
        named = least.toDF("x", "a").join(self.pairs, "x")
        named = least.toDF("y", "b").join(_small(materialize(named)), "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        #: (a, b) of lines of one fingerprint and of the least lines of fingerprints, with the least of each group.
        self.stars = materialize(equal.union(named))

    def close(self, x: str, y: str) -> Column:
        return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= self.radius

    def rest(self, roots: DataFrame) -> DataFrame:
        """All pairs (a, b) of lines that aren't connected yet; roots (node, root) name what is."""
        # only lines of these fingerprints can have more pairs
        fps = _small(materialize(self.met.select("fp").union(self.twos.select("x")).union(self.twos.select("y")).union(self.split.select("fp")).distinct()))
        known = materialize(self.lines.select("k", "fp").join(fps, "fp").join(_small(roots).withColumnRenamed("node", "k"), "k", "left").select("k", "fp", F.coalesce("root", "k").alias("root")))
        # a fingerprint whose lines differ in root has none
        whole = materialize(known.groupBy("fp").agg(F.when(F.min("root") == F.max("root"), F.min("root")).alias("root")))
        equal = apart_pairs(known.join(whole.where("root is null").select("fp"), "fp").select(F.col("fp").alias("key"), F.col("k").alias("v"), "root")).toDF("a", "b")
        met = materialize(self.met.drop("x").join(_small(whole), "fp"))
        open_ = met.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.when(F.col("root").isNull(), 1)).alias("none")).where("lo <> hi or none > 0").select("key")
        met = materialize(met.join(open_, "key"))
        few = met.where(F.col("n") <= self.block)
        both = few.select("key", F.col("fp").alias("x"), F.col("root").alias("rx")).join(few.select("key", F.col("fp").alias("y"), F.col("root").alias("ry")), "key")
        few = both.where("x < y and (rx is null or ry is null or rx <> ry)").where(self.close("x", "y")).select("x", "y")
        rest = F.array(*[F.array(*[F.lit(m).cast("long") for m in masks]) for masks in _rest(self.radius, self.chosen)])
        masks = F.get(rest, F.shiftright("key", _NUMBER).cast("int"))
        many = met.where(F.col("n") > self.block).select("fp", "root", "key", F.posexplode(masks).alias("s", "mask"))
        many = materialize(many.select(F.xxhash64("key", "s", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), F.col("fp").alias("v"), "root"))
        many = apart_pairs(many).where(self.close("x", "y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        pairs = _small(materialize(self.twos.union(few).union(many).distinct()))
        named = materialize(known.select(F.col("fp").alias("x"), F.col("k").alias("a"), F.col("root").alias("ra")).join(pairs, "x"))
        named = known.select(F.col("fp").alias("y"), F.col("k").alias("b"), F.col("root").alias("rb")).join(_small(named), "y").where("ra <> rb").select("a", "b")
        named = equal.union(named).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return named.join(_small(self.stars), ["a", "b"], "left_anti")


def candidate_pairs(lines: DataFrame, radius: int = RADIUS, block: int = BLOCK, chosen: int | None = None) -> DataFrame:
    """All pairs (a, b) of different line keys whose fingerprints differ in `radius` bits at most."""
    nothing = lines.limit(0).select(F.col("k").alias("node"), F.col("k").alias("root"))
    found = Candidates(lines, radius, block, chosen)
    return found.stars.union(found.rest(materialize(nothing)))


def _first_of(docs: DataFrame, seen: DataFrame, asked: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(k, norm): the normalised line of every key asked for, cut out of the first document that has it."""
    where = materialize(seen.join(_small(asked), "k", "left_semi").groupBy("k").agg(F.min(F.struct(*_ROW)).alias("at")).select("k", "at.*"))
    one_each = _small(materialize(where.groupBy("id", "tie").agg(F.collect_set(F.struct("pos", "k")).alias("asked"))))
    texts = _keyed(docs, doc_id, text).join(one_each, ["id", "tie"]).select(F.split("text", "\n").alias("all"), F.explode("asked").alias("q"))
    return materialize(texts.select("q.k", normalised(F.get("all", F.col("q.pos"))).alias("norm")).dropDuplicates(["k"]))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(col(text)).alias("tie"), col(text).alias("text"))


def linked_lines(docs: DataFrame, seen: DataFrame, lines: DataFrame, *, doc_id: str, text: str, radius: int, similarity: float, block: int) -> DataFrame:
    """(node, root): the groups of line keys connected by candidates of enough edit similarity, 1 - distance / longer length."""

    def verified(pairs: DataFrame) -> DataFrame:
        asked = materialize(pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct())
        texts = _first_of(docs, seen, asked, doc_id, text)
        both = pairs.join(texts.select(F.col("k").alias("a"), F.col("norm").alias("x")), "a").join(texts.select(F.col("k").alias("b"), F.col("norm").alias("y")), "b")
        return materialize(both.where(_similar("x", "y", similarity)).select("a", "b"))

    found = Candidates(lines, radius, block)
    roots = materialize(connected_components(verified(found.stars)))
    more = materialize(found.rest(roots))
    if more.isEmpty():
        return roots
    # what is left joins groups, so it is enough to connect their roots
    of = _small(roots)
    between = verified(more).join(of.toDF("a", "ra"), "a", "left").join(of.toDF("b", "rb"), "b", "left")
    between = materialize(between.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    joined = materialize(connected_components(between)).toDF("root", "top")
    grown = roots.join(_small(joined), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return materialize(grown.union(joined.toDF("node", "root")).distinct())


def _similar(x: str, y: str, similarity: float) -> Column:
    """Whether the edit distance is at most 1 - similarity of the longer length, tested by what is cheapest first.

    Word by word, distances of lines with equally many words add up to a bound from above. Words that both lines
    begin and end with don't count, so the distance itself is taken of what lies between, first in a narrow band.
    """
    most = F.floor(F.greatest(F.length(x), F.length(y)) * (1 - similarity) + 1e-9).cast("int")
    a, b = F.split(x, " "), F.split(y, " ")
    apart = F.aggregate(F.zip_with(a, b, lambda u, v: F.when(u == v, 0).otherwise(F.levenshtein(u, v))), F.lit(0), lambda s, d: s + d)
    head = F.array_position(F.zip_with(a, b, lambda u, v: u.eqNullSafe(v)), F.lit(False)) - 1
    tail = F.array_position(F.zip_with(F.reverse(a), F.reverse(b), lambda u, v: u.eqNullSafe(v)), F.lit(False)) - 1
    tail = F.least(tail, F.least(F.size(a), F.size(b)) - head)

    def middle(words: Column) -> Column:
        return F.array_join(F.slice(words, (head + 1).cast("int"), (F.size(words) - head - tail).cast("int")), " ")

    u, v = middle(a), middle(b)
    exact = (F.call_function("levenshtein", u, v, (most / 8).cast("int")) >= 0) | (F.call_function("levenshtein", u, v, most) >= 0)
    bounded = (F.size(a) == F.size(b)) & (F.coalesce(apart, F.lit(0)) <= most)
    return (F.abs(F.length(x) - F.length(y)) <= most) & ((F.col(x) == F.col(y)) | bounded | exact)


@tidied
def deduplicate_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Rows of docs with all columns, the text without repeated lines, and n_lines, n_removed (long).

    Lines are the pieces between line feeds. Of every group of lines that are equal once normalised or linked by
    near equality, the first occurrence (smallest doc_id, then text hash, then position) stays; all others go. Lines
    without letters or digits always stay. Linked are lines whose SimHash over distinct words differs in `radius`
    bits at most and whose normalised forms have an edit similarity of `similarity` at least; groups are connected
    through links. Groups are minima per key, and the few lines that many documents share meet their occurrences where
    these lie, so a line that a third of all documents share never meets in one task.

    A null text stays null and has no lines; an empty text is one line that stays. A null doc_id comes after all
    others. Rows equal in doc_id and text are one occurrence and get the same result. Columns named n_lines or
    n_removed give way; other columns may have any names. An empty table gives an empty result.
    """
    seen = materialize(occurrences(docs, doc_id, text))
    lines = materialize(seen.groupBy("k", "fp").agg(F.count("*").alias("n")))
    groups = linked_lines(docs, seen, lines, doc_id=doc_id, text=text, radius=radius, similarity=similarity, block=block).withColumnRenamed("node", "k")
    groups = materialize(lines.join(_small(groups), "k", "left").where("n > 1 or root is not null").select("k", "n", F.coalesce("root", "k").alias("root")))
    met = materialize(join_spread(seen.select("k", *_ROW), groups, "k"))
    firsts = met.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct(*_ROW)).alias("first"))
    gone = join_spread(met.select("root", *_ROW), materialize(firsts), "root").where(F.struct(*_ROW) != F.col("first")).groupBy("id", "tie").agg(F.collect_set("pos").alias("gone"))
    own = columns_of(docs, ("n_lines", "n_removed"))
    keyed = docs.select(row_of(own), col(text).alias("text"), F.coalesce(col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(col(text)).alias("tie"))
    both = keyed.join(gone, ["id", "tie"], "left").withColumn("all", F.split("text", "\n"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone")), lambda i: F.get("all", i))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    total, removed = F.coalesce(F.size("all"), F.lit(0)).cast("long"), F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    total = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(total)
    removed = F.when(F.col("gone").isNull(), F.lit(0).cast("long")).otherwise(removed)
    return both.select(*[kept.alias(c) if c == text else field(c) for c in own], total.alias("n_lines"), removed.alias("n_removed"))
