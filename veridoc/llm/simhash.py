"""SimHash near-duplicates: word-shingle fingerprints, linked through BK-trees of pigeonhole shards."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.llm.common import LAST_ID, col, connected_components, field, join_spread, materialize, row_of, stream_groups, tidied
from veridoc.llm.lines import _small

BITS = 64
#: Members of one shard's tree; larger shards are cut by further blocks of bits.
MAX_TREE = 2048
_CHUNK = 1 << 16
#: Bits of a wide fingerprint and 64-bit words of it that are compared in a shard.
WIDE, FIRST = 512, 4
#: Members of a shard on average, chance to agree on a bit at a similarity of 0.8 and to miss one another in all shards.
SHARD, AGREE, MISSED = 128, 0.84, 5e-4
#: Distance of the first word and of all words compared, five standard deviations above what a similarity of 0.8 gives.
NEAR_WORD, NEAR = 25, 72
#: Fingerprints and sets of shingles along the side of a square that one task compares.
CELL, SETS = 2048, 512


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned SimHash of the word shingles of a text lower-cased in A-Z; 0 if it has no words."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[:n].tolist()
    end = end[-n:].tolist()
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, _CHUNK):
        h = np.array([hash_of(joined[a:b], 42) for a, b in zip(begin[i : i + _CHUNK], end[i : i + _CHUNK], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist())


class BKTree:
    """Integers by Hamming distance: a child hangs under its distance to its parent."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, dict[int, int]]] = []

    def add(self, value: int) -> int:
        """Insert a value; returns its number, the old one if the value is there already."""
        nodes, new = self.nodes, len(self.nodes)
        at = 0
        while new:
            have, children = nodes[at]
            if not (d := (have ^ value).bit_count()):
                return at
            if (child := children.get(d)) is None:
                children[d] = new
                break
            at = child
        nodes.append((value, {}))
        return new

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of all values at most `radius` away; only edges that can lead there are followed."""
        nodes, found, todo = self.nodes, [], [0] if self.nodes else []
        while todo:
            at = todo.pop()
            have, children = nodes[at]
            d = (have ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in children.items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return found


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what lies within the radius: each value to the smallest one of its group."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for v in values:
        near = tree.within(v, radius)
        i = tree.add(v)
        for j in near:
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    out: dict[int, int] = {}
    for i in range(len(tree.nodes)):
        out[root(i)] = min(out.get(root(i), tree.nodes[i][0]), tree.nodes[i][0])
    return [(v, out[root(i)]) for i, (v, _) in enumerate(tree.nodes) if v != out[root(i)]]


def _shard_links(radius: int):
    def run(table) -> Iterator:
        import numpy as np
        import pyarrow as pa

        block, key, fp = (table.column(c).to_numpy() for c in ("path", "key", "fp"))
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(key) != 0)) + 1
        links: list[tuple[int, int]] = []
        for values in np.split(fp.view(np.uint64), cuts):
            if len(values) > 1:
                links += tree_links(values.tolist(), radius)
        a, b = np.array(links, np.uint64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    return run


def _pieces(free: list[int], n: int) -> list[list[int]]:
    """Bits dealt into n runs as equal as can be."""
    return [free[len(free) * i // n : len(free) * (i + 1) // n] for i in range(n)]


def _masked(bits: list[int]) -> Column:
    mask = sum(1 << b for b in bits)
    return F.col("fp").bitwiseAND(F.lit(mask - (mask >> 63 << 64)).cast("long"))


def fingerprint_links(fps: DataFrame, radius: int = 2, max_tree: int = MAX_TREE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, long) that connect all pairs within the radius.

    The bits are cut into radius + 1 blocks: fingerprints within the radius agree on one whole block, so each block
    value is a shard with a BK-tree of its own and every fingerprint only meets the trees of its own blocks. A tree
    is held to max_tree values: the bits that members of a larger shard don't have in common are cut into radius + 1
    blocks again, on one of which a pair within the radius agrees too, and so on until shards fit; at the latest they
    do when fewer bits are left than tell max_tree values apart.
    """
    levels: list[DataFrame] = []
    shards = {0: (list(range(BITS)), fps.select("fp", F.lit(0).alias("path"), F.lit(0).cast("long").alias("key")))}
    while shards:
        todo, cut = [], {}
        for path, (free, members) in shards.items():
            for i, own in enumerate(_pieces(free, radius + 1)):
                name = path * (radius + 1) + i + 1
                todo.append(members.select("fp", F.lit(name).alias("path"), F.xxhash64("key", _masked(own)).alias("key")))
                cut[name] = [b for b in free if b not in own]
        level = reduce(DataFrame.union, todo)
        sizes = level.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
        level = materialize(level.join(sizes, ["path", "key"]))
        large = {r["path"] for r in level.where(F.col("n") > max_tree).select("path").distinct().collect()}
        # a shard with so few bits left holds few values whatever max_tree says
        large = {p for p in large if len(cut[p]) > radius}
        fits = (F.col("n") <= max_tree) | ~F.col("path").isin(*large) if large else F.lit(True)
        levels.append(stream_groups(level.where(fits).select("path", "key", "fp"), ["path", "key"], _shard_links(radius), "a long, b long"))
        shards = {p: (cut[p], level.where((F.col("n") > max_tree) & (F.col("path") == p)).select("fp", "path", "key")) for p in sorted(large)}
    return reduce(DataFrame.union, levels)


def _classified(docs: DataFrame, doc_id: str, text: str, shingle: int, radius: int) -> DataFrame:
    """(doc_id, tie, fp, root, component_id) per row; tie is a hash of the text, root names the group."""

    def hashed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp.view(np.int64))], names=["doc_id", "tie", "fp"])

    keyed = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"), F.xxhash64(col(text)).alias("tie"))
    rows = materialize(keyed.mapInArrow(hashed, "doc_id long, tie long, fp long"))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    groups = connected_components(fingerprint_links(rows.select("fp").distinct(), radius))
    rooted = materialize(classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    counts = rows.groupBy("fp").agg(F.count("*").alias("n"))
    named = materialize(rooted.join(least, "root").join(counts, "fp").select("fp", "n", "root", "component_id"))
    return join_spread(rows, named, "fp")


@tidied
def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable by links.

    Whole texts of any length are hashed piece by piece. Null, empty and blank texts have fingerprint 0 and link
    like any other. Rows with equal fingerprints are one node, however many there are; repeated rows come back as
    often as they came in. A row without doc_id takes part and gets its group's smallest doc_id, null if the group
    has none. Other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    rows = _classified(docs, doc_id, text, shingle, radius)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@tidied
def keep_one_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of every group with all its columns: the smallest doc_id, then text hash; of exact repeats any.

    Null, empty and blank texts are one group; a null doc_id comes after all others.
    """
    rows = _classified(docs, doc_id, text, shingle, radius).select("root", F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "tie")
    kept = rows.groupBy("root").agg(F.min(F.struct("id", "tie")).alias("one")).select("one.*")
    keyed = docs.select(row_of(docs.columns), F.coalesce(col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(col(text)).alias("tie"))
    one = Window.partitionBy("id", "tie").orderBy("id")
    return keyed.join(kept, ["id", "tie"], "left_semi").withColumn("nth", F.row_number().over(one)).where("nth = 1").select(*[field(c) for c in docs.columns])


def shingle_set(text: str | None, shingle: int = 5):
    """Distinct 64-bit hashes, rising, of the word shingles of a text lower-cased in A-Z; none if it has no words."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(n)], np.uint64))


def wide_fingerprint(hashes) -> bytes:
    """SimHash of WIDE bits, 64 at a time, of hashes mixed anew for every 64: a bit is 1 if set in over half of them."""
    import numpy as np

    factors = np.random.default_rng(7).integers(0, 1 << 63, (2, WIDE // 64), np.uint64) * np.uint64(2) + np.uint64(1)
    ones = np.zeros(WIDE, np.int64)
    for i in range(0, len(hashes), 255):
        mixed = hashes[i : i + 255, None] * factors[0]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * factors[1]
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(mixed.view(np.uint8).reshape(-1, WIDE // 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def shard_bits(n: int):
    """(shards, bits): the bits by which n fingerprints are dealt to shards, one choice of them per row.

    Shards have some SHARD members. Two fingerprints of a similarity of 0.8 agree on a bit with a chance of AGREE at
    least, so there are as many choices as it takes for them to miss one another in all with a chance of MISSED."""
    import math

    import numpy as np

    bits = max(4, math.ceil(math.log2(max(n, 1) / SHARD)))
    choices = math.ceil(math.log(MISSED) / math.log(1 - AGREE**bits))
    rng = np.random.default_rng(11)
    return np.array([rng.choice(WIDE, bits, replace=False) for _ in range(choices)])


def _merge(a, b, root):
    """Those links (a, b) that join groups, as they are taken one after the other; root names the groups and changes."""
    import numpy as np

    out = []
    while True:
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        if not len(a):
            return out
        first = a[0]
        near = b[a == first]
        roots, at = np.unique(root[near], return_index=True)
        out += [(int(first), int(near[i])) for i in at]
        root[np.isin(root, roots)] = root[first]


def _groups(table, keys: list[str]) -> Iterator:
    """(start, end) of the groups of more than one row."""
    import numpy as np

    new = np.zeros(max(0, table.num_rows - 1), bool)
    for k in keys:
        new |= np.diff(table.column(k).to_numpy()) != 0
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows]
    return ((lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False) if hi - lo > 1)


_SQUARE = ["key", "row", "column"]


def _dealt(members: DataFrame, cell: int) -> DataFrame:
    """Members (key, v, ...) with the squares (row, column) of their key in which all pairs of its members meet."""
    large = materialize(members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cell))
    slots = F.coalesce(F.ceil(F.col("n") / cell), F.lit(1))
    named = members.join(_small(large), "key", "left").withColumns({"slot": F.pmod(F.xxhash64("v"), slots), "other": F.explode(F.sequence(F.lit(0).cast("long"), slots - 1))})
    return named.withColumns({"row": F.least("slot", "other"), "column": F.greatest("slot", "other")}).drop("n", "slot", "other")


def _close_links(table) -> Iterator:
    """Links that connect the fingerprints of a shard whose distance is at most NEAR of the first FIRST words' bits."""
    import numpy as np
    import pyarrow as pa

    v = table.column("v").to_numpy()
    w = [table.column(f"w{i}").to_numpy().view(np.uint64) for i in range(FIRST)]  # bits of negative numbers count otherwise
    links: list[tuple[int, int]] = []
    for lo, hi in _groups(table, _SQUARE):
        root = np.arange(hi - lo)
        for at in range(lo, hi, 512):
            a, b = np.nonzero(np.bitwise_count(w[0][at : min(hi, at + 512), None] ^ w[0][None, at:hi]) <= NEAR_WORD)
            a, b = a[a < b] + at, b[a < b] + at
            near = sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in w) <= NEAR if len(a) else []
            links += [(i + lo, j + lo) for i, j in _merge(a[near] - lo, b[near] - lo, root)] if len(a) else []
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    yield pa.RecordBatch.from_arrays([pa.array(v[a]), pa.array(v[b])], names=["a", "b"])


def _similar_links(similarity: float):
    def run(table) -> Iterator:
        """Links that connect the sets of a group which are similar: each set meets those that share its hashes."""
        import numpy as np
        import pyarrow as pa

        v, lists = table.column("v").to_numpy(), table.column("h").combine_chunks()
        ends, hashes = lists.offsets.to_numpy(), lists.values.to_numpy()
        links: list[tuple[int, int]] = []
        for lo, hi in _groups(table, _SQUARE):
            size = np.diff(ends[lo : hi + 1]).astype(np.int64)
            term = np.unique(hashes[ends[lo] : ends[hi]], return_inverse=True)[1]
            holder = np.repeat(np.arange(hi - lo), size)[np.argsort(term, kind="stable")]
            count = np.bincount(term) if len(term) else np.zeros(0, np.int64)
            start, cut = np.cumsum(count) - count, np.append(0, np.cumsum(size))
            root = np.arange(hi - lo)
            for i in range(hi - lo):
                own = term[cut[i] : cut[i + 1]]
                n = count[own]
                at = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                common = np.bincount(holder[at], minlength=hi - lo)
                near = np.flatnonzero(common >= (size + size[i] - common) * similarity - 1e-9)
                links += [(a + lo, b + lo) for a, b in _merge(np.full(len(near), i), near, root)]
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(v[a]), pa.array(v[b])], names=["a", "b"])

    return run


def close_links(fps: DataFrame, n: int) -> DataFrame:
    """Links (a, b) that connect the n classes v whose wide fingerprints (v, wide) are close, as far as shards find them.

    A fingerprint is dealt to one shard for every choice of bits, whose members agree on these, and a shard's members
    are all compared; those of more than CELL members are dealt over squares. A group of near copies gives as many
    links as it has members, not pairs."""
    chosen = shard_bits(n)

    def keyed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        power = 1 << np.arange(chosen.shape[1], dtype=np.int64)
        for batch in batches:
            wide = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, WIDE // 8)
            bits = np.unpackbits(wide, axis=1, bitorder="little")
            keys = np.stack([bits[:, c].astype(np.int64) @ power for c in chosen], axis=1) + (np.arange(len(chosen), dtype=np.int64) << 48)
            lists = pa.ListArray.from_arrays(np.arange(len(wide) + 1, dtype=np.int32) * len(chosen), pa.array(keys.reshape(-1)))
            words = np.ascontiguousarray(wide[:, : 8 * FIRST]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(FIRST)], lists], names=["v", *own, "keys"])

    own = [f"w{i}" for i in range(FIRST)]
    rows = materialize(fps.select("v", "wide").mapInArrow(keyed, "v long, " + "".join(f"{w} long, " for w in own) + "keys array<long>"))
    members = rows.select(F.explode("keys").alias("key"), "v", *own)
    return stream_groups(_dealt(members, CELL), _SQUARE, _close_links, "a long, b long")


def similar_links(sets: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect all similar sets (v, h) of one group (v, key): all of a group's sets are compared."""
    members = sets.join(groups, "v").select("key", "v", "h")
    return stream_groups(_dealt(members, SETS), _SQUARE, _similar_links(similarity), "a long, b long")


@tidied
def keep_one_similar(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of every group of similar texts with all its columns: the smallest doc_id, then text hash; of repeats any.

    SimHash fingerprints of WIDE bits over the distinct word shingles are dealt to shards by some of their bits, and
    those of a shard that are close are linked. Similar are texts in a group so linked whose sets of shingles have a
    Jaccard similarity of `similarity` at least, measured exactly between all of the group; groups are connected
    through these links. The bits are chosen for similarities of 0.8 and more. Null, empty and blank texts are one
    group. A null doc_id comes after all others; columns may have any names. An empty table gives an empty result.
    """

    def hashed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(2)]
            v = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
            wide = pa.array([wide_fingerprint(h) for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(v), wide], names=["id", "tie", "v", "wide"])

    def listed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle).view("int64") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["v", "h"])

    keyed = docs.select(F.coalesce(col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(col(text)).alias("tie"), col(text).alias("text"))
    rows = materialize(keyed.select("id", "tie", "text").mapInArrow(hashed, "id long, tie long, v long, wide binary"))
    classes = materialize(rows.groupBy("v").agg(F.min(F.struct("id", "tie")).alias("one"), F.min("wide").alias("wide")))
    close = materialize(connected_components(close_links(classes, classes.count())).toDF("v", "key"))
    asked = classes.join(_small(close), "v", "left_semi").select("v", "one.*")
    sets = materialize(keyed.join(_small(materialize(asked)), ["id", "tie"]).dropDuplicates(["v"]).select("v", "text").mapInArrow(listed, "v long, h array<long>"))
    groups = connected_components(similar_links(sets, close, similarity)).withColumnRenamed("node", "v")
    kept = classes.join(groups, "v", "left").groupBy(F.coalesce("root", "v").alias("root")).agg(F.min("one").alias("one")).select("one.*")
    whole = docs.select(row_of(docs.columns), F.coalesce(col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(col(text)).alias("tie"))
    one = Window.partitionBy("id", "tie").orderBy("id")
    return whole.join(kept, ["id", "tie"], "left_semi").withColumn("nth", F.row_number().over(one)).where("nth = 1").select(*[field(c) for c in docs.columns])
