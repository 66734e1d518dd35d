"""Embedding near-duplicates by collision-counting projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridoc.llm.common import connected_components, materialize, stream_groups, tidied

#: One-dimensional projections whose windows are counted for a pair.
PROJECTIONS = 32
#: Vectors that a bucket of strangers holds on average at most.
STRANGERS = 512
#: Members of a bucket compared in one task; larger buckets are dealt out as pairs of parts.
BUCKET = 4096
RECALL = 0.995
#: Half a window in standard deviations of the projected difference of a pair at the threshold, and in steps of a mark.
DEVIATIONS, STEPS = 2.0, 8


class Plan:
    """Projections, window, least count and tables.

    A pair exactly at the threshold, projected on a random line, differs by a normal deviate, so it falls into one
    another's windows with a known chance p, and its collisions over all lines are binomial: the least count is the
    largest one that such pairs reach with the chance sqrt(recall); closer pairs collide more often. Tables sort the
    vectors by the signs of `bits` more projections, enough to leave few strangers together, and then along one
    line; as many tables are made as let a pair at the threshold meet with the chance sqrt(recall). Nothing caps
    either number, so the recall holds for any n.
    """

    def __init__(self, n: int, threshold: float, recall: float = RECALL, seed: int = 7) -> None:
        self.threshold, self.seed = threshold, seed
        apart = math.sqrt(2 - 2 * threshold)
        self.window = DEVIATIONS * apart
        self.step = self.window / STEPS
        p, each = math.erf(DEVIATIONS / math.sqrt(2)), math.sqrt(recall)
        tail, self.least = 0.0, PROJECTIONS + 1
        while tail < each and self.least:
            self.least -= 1
            tail += math.comb(PROJECTIONS, self.least) * p**self.least * (1 - p) ** (PROJECTIONS - self.least)
        self.bits = min(62, max(0, math.ceil(math.log2(max(n, 1) / STRANGERS))))
        meet = (1 - math.acos(threshold) / math.pi) ** self.bits * p
        self.tables = math.ceil(math.log(1 - each) / math.log(1 - meet))

    def axes(self, dim: int):
        return _normal(self.seed, PROJECTIONS, dim)

    def lines(self, unit):
        """Places of vectors on all lines: (vectors, lines)."""
        return unit @ self.axes(unit.shape[1]).T

    def marks(self, lines):
        """Places in steps, a byte each; a pair within the window is at most STEPS + 1 steps apart."""
        import numpy as np

        return np.clip(np.floor(lines / self.step), -127, 127).astype(np.int8)

    def keys(self, unit):
        """Sign pattern of every vector in every table: (vectors, tables)."""
        import numpy as np

        out = np.zeros((len(unit), self.tables), np.int64)
        for t in range(self.tables if self.bits else 0):
            signs = unit @ _normal(self.seed + 1 + t, self.bits, unit.shape[1]).T > 0
            out[:, t] = signs @ (1 << np.arange(self.bits, dtype=np.int64))
        return out


@lru_cache(maxsize=4096)
def _normal(seed: int, rows: int, dim: int):
    import numpy as np

    return np.random.default_rng((seed, dim)).standard_normal((rows, dim))


def _units(column) -> Iterator:
    """(positions, unit vectors in double precision) of the rows of a list column, by length of the vector."""
    import numpy as np

    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        flat = column.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        flat = flat / np.abs(flat).max(axis=1)[:, None]
        yield at, flat / np.linalg.norm(flat, axis=1)[:, None]


def colliding(along, marks, mine, parts: tuple[int, int], plan: Plan):
    """Which members of a bucket have a partner in their window along the table's line with the least count at least.

    Members are sorted along the line; of a bucket dealt in parts only pairs of the two parts count.
    """
    import numpy as np

    order = np.argsort(along, kind="stable")
    along, marks, mine = along[order], marks[order].astype(np.int16), mine[order]
    end = np.searchsorted(along, along + plan.window, side="right")
    hit = np.zeros(len(along), bool)
    lo = 0
    while lo < len(along):
        hi = min(len(along), lo + max(16, (1 << 19) // max(1, int(end[lo]) - lo)))
        far = int(end[hi - 1])
        count = np.zeros((hi - lo, far - lo), np.int8)
        for j in range(PROJECTIONS):
            count += np.abs(marks[lo:hi, j, None] - marks[None, lo:far, j]) <= STEPS + 1
        i, k = np.nonzero(np.triu(count >= plan.least, 1))
        i, k = i + lo, k + lo
        fit = (k < end[i]) & (np.minimum(mine[i], mine[k]) == parts[0]) & (np.maximum(mine[i], mine[k]) == parts[1])
        hit[i[fit]] = hit[k[fit]] = True
        lo = hi
    out = np.zeros(len(hit), bool)
    out[order] = hit
    return out


def links_within(unit, table: int, mine, parts: tuple[int, int], plan: Plan):
    """Index pairs of one bucket that pass the count and reach the threshold; each pair in the first table it meets in."""
    import numpy as np

    lines, keys = plan.lines(unit), plan.keys(unit)
    marks = plan.marks(lines).astype(np.int16)
    on = lines[:, np.arange(plan.tables) % PROJECTIONS]
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(16, (1 << 20) // max(1, len(unit)))
    for lo in range(0, len(unit), step):
        i, k = np.nonzero(np.triu(unit[lo : lo + step] @ unit.T >= plan.threshold - 1e-9, lo + 1))
        i = i + lo
        for c in range(0, len(i), 1 << 15):
            x, y = i[c : c + (1 << 15)], k[c : c + (1 << 15)]
            fit = (np.minimum(mine[x], mine[y]) == parts[0]) & (np.maximum(mine[x], mine[y]) == parts[1])
            x, y = x[fit], y[fit]
            met = (keys[x] == keys[y]) & (np.abs(on[x] - on[y]) <= plan.window)
            fit = met[:, table] & (met.argmax(axis=1) == table)
            fit &= (np.abs(marks[x] - marks[y]) <= STEPS + 1).sum(axis=1) >= plan.least
            fit &= (unit[x] * unit[y]).sum(axis=1) >= plan.threshold
            out_a.append(x[fit])
            out_b.append(y[fit])
    return np.concatenate(out_a), np.concatenate(out_b)


def _buckets(table) -> Iterator:
    """(lo, hi, table, parts) of the runs of rows of one bucket."""
    import numpy as np

    columns = [table.column(c).to_numpy() for c in ("dim", "tab", "key", "pa", "pb")]
    cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), table.num_rows], strict=True):
        if hi - lo > 1:
            yield lo, hi, int(columns[1][lo]), (int(columns[3][lo]), int(columns[4][lo]))


@tidied
def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id (smallest id reachable) and kept.

    All vectors are projected on 32 lines and their places kept as marks of a byte. Tables sort them by sign pattern
    and then along one line; a member's window there gives the pairs to look at, and their window collisions are
    counted over the marks of all lines. Only marks are shuffled to all tables. The vectors of members with a
    pair that reaches the calibrated count follow them to that bucket, where the pair is verified by exact cosine in
    double precision. Every pair is counted in the first table where it meets; of a bucket's pairs a task returns only
    numbers of links and the links that connect its members, never all pairs. Equal vectors are one class,
    represented once; a row's links count all rows of linked classes. The exact count of a group of g different near
    copies takes g * g comparisons, dealt over tasks of `bucket` squared.

    Null, empty, zero or non-finite vectors and null components link with nothing and are their own component.
    Vectors link with others of the same length only. Rows with a null vec_id return null ids and count as links of
    others. Rows that repeat an id are separate rows. Other columns are ignored, whatever their names. An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    # -0.0 equals 0.0
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: x + 0.0)))
    name = (F.xxhash64("v"), F.xxhash64(F.lit(1), "v"))
    classes = rows.where("ok").groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), name[0].alias("h1"), name[1].alias("h2"), "first", "copies", "v"))
    plan = Plan(classes.count(), threshold, recall)
    row_type = T.StructType([T.StructField(c, T.IntegerType()) for c in ("dim", "tab")] + [T.StructField(c, T.LongType()) for c in ("key", "node")] + [T.StructField("along", T.DoubleType()), T.StructField("marks", T.BinaryType())])

    def keyed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at, unit in _units(batch.column(1)):
                lines, keys = plan.lines(unit), plan.keys(unit)
                marks = pa.array([m.tobytes() for m in plan.marks(lines)], pa.binary())
                node = batch.column(0).take(pa.array(at))
                for t in range(plan.tables):
                    same = [pa.array(np.full(len(at), x, np.int32)) for x in (unit.shape[1], t)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(keys[:, t]), node, pa.array(np.ascontiguousarray(lines[:, t % PROJECTIONS])), marks], names=row_type.names)

    met = classes.select("node", "v").mapInArrow(keyed, row_type)
    met = materialize(met)
    where = ["dim", "tab", "key"]
    sizes = met.groupBy(*where).agg(F.count("*").alias("n")).where("n > 1")
    met = met.join(sizes, where)
    met = met.withColumn("parts", F.ceil(F.col("n") / bucket).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = met.select(*where, "node", "along", "marks", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    where = [*where, "pa", "pb"]
    met = met.select("dim", "tab", "key", F.least("mine", "other").alias("pa"), F.greatest("mine", "other").alias("pb"), "mine", "node", "along", "marks")

    def counted(table) -> Iterator:
        import numpy as np
        import pyarrow as pa

        along, mine = table.column("along").to_numpy(), table.column("mine").to_numpy()
        marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.int8).reshape(-1, PROJECTIONS)
        hit = np.zeros(table.num_rows, bool)
        for lo, hi, _, parts in _buckets(table):
            hit[lo:hi] = colliding(along[lo:hi], marks[lo:hi], mine[lo:hi], parts, plan)
        yield from table.select([*where, "mine", "node"]).filter(pa.array(hit)).to_batches()

    asked = materialize(stream_groups(met, where, counted, "dim int, tab int, key long, pa int, pb int, mine int, node long"))

    def verified(table) -> Iterator:
        import numpy as np
        import pyarrow as pa

        mine, node, copies = (table.column(c).to_numpy() for c in ("mine", "node", "copies"))
        found: list = [[np.zeros(0, np.int64)] * 3]
        for lo, hi, tab, parts in _buckets(table):
            ((_, unit),) = _units(table.column("v").slice(lo, hi - lo))
            i, k = links_within(unit, tab, mine[lo:hi], parts, plan)
            if not len(i):
                continue
            many = np.zeros(hi - lo, np.int64)
            np.add.at(many, i, copies[lo + k])
            np.add.at(many, k, copies[lo + i])
            parent = list(range(hi - lo))

            def root(x: int, parent=parent) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for x, y in zip(i.tolist(), k.tolist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            own = np.flatnonzero(many)
            found.append([node[lo:hi][own], many[own], node[lo:hi][[root(x) for x in own.tolist()]]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["node", "links", "hub"])

    links = materialize(stream_groups(asked.join(classes.select("node", "copies", "v"), "node"), where, verified, "node long, links long, hub long"))
    groups = connected_components(links.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    degrees = links.groupBy("node").agg(F.sum("links").alias("links"))
    linked = classes.select("node", "h1", "h2", "first", "copies").join(degrees, "node", "left").join(groups, "node", "left")
    linked = materialize(linked.select("h1", "h2", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")))
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(least, "root").select("h1", "h2", "n_links", "component_id")
    back = rows.select("vec_id", "ok", F.when(F.col("ok"), name[0]).alias("h1"), F.when(F.col("ok"), name[1]).alias("h2")).join(named, ["h1", "h2"], "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id"))
    return back.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
