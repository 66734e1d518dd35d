"""Drawings against text: marks read by machine, their duplicates and artefacts, sheets, figures and labels.

Marks are rows (mark_id, page, numeral, confidence, x, y, w, h, engines array<string>, angles array<int>); coordinates
are shares of the sheet from its lower left corner.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.operators.lineage import cut

SAME_SPOT, FRAGMENT, CONFLICT, CONTAINED = 0.02, 0.025, 0.01, 0.03
TEXT_WINDOW = 2000
#: Rows up to which a table of cells or label pairs is broadcast.
BROADCAST_ROWS = 500_000
#: Cells of the radius' size along the side of a block whose marks one task pairs, pairs tried at once, and what a reach
#: has over its radius, so that rounding loses no pair before its distance is measured.
BLOCK_CELLS, PAIRS, SLACK = 16, 1 << 18, 1.001


def is_locatable(label: Column) -> Column:
    """Single digits aren't looked for on sheets."""
    return ~F.coalesce(label.rlike("^[0-9]+$") & (label.try_cast("long") < 10), F.lit(False))


def strobogrammatic(label: Column) -> Column:
    """What a label of 0, 1, 6, 8 and 9 reads upside down; null for others."""
    return F.when(label.rlike("^[01689]+$"), F.translate(F.reverse(label), "69", "96"))


def unrotated(angle: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Box on the page of a box read on a sheet turned counter-clockwise."""
    a = F.pmod(angle, F.lit(360))

    def pick(right: Column, over: Column, left: Column, same: Column) -> Column:
        return F.round(F.when(a == 90, right).when(a == 180, over).when(a == 270, left).otherwise(same), 4)

    return F.struct(pick(y, 1 - x - w, 1 - y - h, x).alias("x"), pick(1 - x - w, 1 - y - h, x, y).alias("y"), pick(h, w, h, w).alias("w"), pick(w, h, w, h).alias("h"))


def near_pairs(left: DataFrame, right: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """Rows of left and right (columns of right prefixed r_) of equal keys with |dx| and |dy| under the radius.

    Both sides are dealt by cells of the radius' size and right rows stand in the nine cells around theirs, so equality
    keys do the joining and a crowded page is spread over its cells."""
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = left.withColumns({"cx": cell("x"), "cy": cell("y")})
    b = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys], around.alias("o")).withColumns({"cx": F.floor(F.col("r_x") / radius) + F.col("o.i"), "cy": F.floor(F.col("r_y") / radius) + F.col("o.j")}).drop("o")
    met = a.join(b, [*keys, "cx", "cy"]).drop("cx", "cy")
    return met.where((F.abs(F.col("x") - F.col("r_x")) < radius) & (F.abs(F.col("y") - F.col("r_y")) < radius))


def first_come(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """(item, kept) of items that keep their place in order: one is kept unless a kept one before it blocks it.

    blocks: (item, by), where `by` comes before the item. An item is settled once all that could block it are, or one
    of them is kept; rounds go by the longest chain of items that wait for one another, not by their number."""
    waiting = cut(blocks.distinct())
    settled = cut(items.select("item").distinct().join(waiting.select("item").distinct(), "item", "left_anti").withColumn("kept", F.lit(True)))
    done, new = settled, settled
    while not waiting.isEmpty():
        met = waiting.join(new.withColumnRenamed("item", "by"), "by", "left")
        gone = met.where("kept").select("item").distinct()
        left = cut(met.where("kept is null").select("item", "by").join(gone, "item", "left_anti"))
        freed = waiting.select("item").distinct().join(gone, "item", "left_anti").join(left.select("item").distinct(), "item", "left_anti")
        new = cut(gone.withColumn("kept", F.lit(False)).union(freed.withColumn("kept", F.lit(True))))
        if new.isEmpty():
            raise ValueError("items block one another in a circle")
        done, waiting = done.union(new), left
    return done


def merge_same_spot(marks: DataFrame, radius: float = SAME_SPOT) -> DataFrame:
    """One mark for each label and spot: by falling confidence, a mark near a kept one of its label joins the first such.

    The order decides, so it isn't a closure. Marks are dealt by page and label and sorted once; a task goes through
    them in order and holds the kept ones of one page and label, of which a cell of the radius' size has room for one,
    so no pairs are made. Marks without page, label or finite place are kept as they are."""
    names = marks.columns
    at = {c: names.index(c) for c in ("page", "numeral", "x", "y", "engines", "angles")}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list = []  # kept rows not yet given out
        every: list[tuple] = []  # their engines and angles
        grid: dict[tuple[int, int], list[tuple[int, float, float]]] = {}
        last, first = None, 0  # the label at hand and the place of its first kept mark in `every`

        def merged(values, kind):
            return pa.array([None if v is None else sorted((x for x in v if x is not None)) + [None] * (None in v) for v in values], kind)

        def give(n: int) -> Iterator:
            nonlocal held, every, first
            table = pa.Table.from_batches(held).combine_chunks()
            out = table.slice(0, n)
            for i, c in enumerate(("engines", "angles")):
                out = out.set_column(at[c], table.schema.field(at[c]), merged([e[i] for e in every[:n]], table.schema.field(at[c]).type))
            yield from out.to_batches()
            held, every, first = table.slice(n).to_batches(), every[n:], first - n

        for batch in batches:
            page, numeral, x, y, engines, angles = (batch.column(i).to_pylist() for i in at.values())
            keep = []
            for i, key in enumerate(zip(page, numeral, strict=True)):
                if key != last:
                    last, first, grid = key, len(every), {}
                px, py = x[i], y[i]
                placed = None not in (*key, px, py) and math.isfinite(px) and math.isfinite(py)
                if placed:
                    cx, cy = math.floor(px / radius), math.floor(py / radius)
                    near = [m[0] for u in (cx - 1, cx, cx + 1) for v in (cy - 1, cy, cy + 1) for m in grid.get((u, v), ()) if abs(m[1] - px) < radius and abs(m[2] - py) < radius]
                    if near:
                        for have, new in zip(every[first + min(near)], (engines[i], angles[i]), strict=True):
                            if have is not None:
                                have.update(new or ())
                        continue
                    grid.setdefault((cx, cy), []).append((len(every) - first, px, py))
                every.append(tuple(None if v is None else set(v) for v in (engines[i], angles[i])))
                keep.append(i)
            if keep:
                held.append(batch.take(pa.array(keep)))
            if first:
                yield from give(first)
        if every:
            yield from give(len(every))

    order = (-F.col("confidence")).asc_nulls_first()
    return marks.repartition("page", "numeral").sortWithinPartitions("page", "numeral", order, "mark_id", "x", "y").mapInArrow(run, marks.schema)


def drop_strobogrammatic_twins(marks: DataFrame, radius: float = SAME_SPOT) -> DataFrame:
    """Without marks read upside down only that are an upright mark's ink: same spot, label turned around."""
    turned = F.array_contains("angles", F.lit(180)) & ~F.array_contains("angles", F.lit(0))
    suspects = marks.where(turned).withColumn("twin", strobogrammatic(F.col("numeral"))).where("twin is not null")
    upright = marks.where(F.array_contains("angles", F.lit(0))).select("page", "x", "y", F.col("numeral").alias("twin"))
    twins = near_pairs(suspects, upright, radius, ["page", "twin"]).select("mark_id").distinct()
    return marks.join(twins, "mark_id", "left_anti")


def gate_rotated(marks: DataFrame, recited: DataFrame) -> DataFrame:
    """Marks with `corroboration`: upright ones (null), those two engines read, and, unless only upside down, recited ones."""
    known = recited.select(F.col("label").alias("numeral"), F.lit(True).alias("recited")).distinct()
    rows = marks.join(known, "numeral", "left")
    upright = F.array_contains("angles", F.lit(0))
    crossed = F.size("engines") >= 2
    spec = F.coalesce("recited", F.lit(False)) & (F.array_distinct("angles") != F.array(F.lit(180)))
    why = F.when(upright, F.lit(None).cast("string")).when(crossed, "cross-engine").when(spec, "spec")
    return rows.where(upright | crossed | spec).select(*marks.columns, why.alias("corroboration"))


def same_spot_conflicts(sightings: DataFrame, radius: float = CONFLICT, labels: bool = True) -> DataFrame:
    """Pairs (page, a, b and, with `labels`, numeral_a, numeral_b) of different numbers at one spot, as marks a < b.

    Pairs grow with the square of a page's marks, so they are made where they are given out, in batches: marks are
    dealt to blocks of the sheet, those near a block's edge also to the next one, and nothing else is shuffled."""
    side, reach = BLOCK_CELLS * radius, radius * SLACK
    digits = sightings.where(F.col("numeral").rlike("^[0-9]+$")).select("page", "mark_id", "numeral", "x", "y").dropna()
    block = lambda c: F.floor(c / side)
    blocks = lambda lo, hi: F.explode(F.sequence(block(lo), block(hi)))
    rows = digits.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    # a pair is made in the block of its lower mark
    rows = rows.withColumn("by", blocks(F.col("y") - reach, F.col("y"))).withColumn("bx", blocks(F.col("x") - reach, F.col("x") + reach))
    rows = rows.withColumn("own", (F.col("by") == block(F.col("y"))) & (F.col("bx") == block(F.col("x"))))
    page, mark = (sightings.schema[c].dataType.simpleString() for c in ("page", "mark_id"))
    schema = f"page {page}, a {mark}, b {mark}" + (", numeral_a string, numeral_b string" if labels else "")
    return rows.repartition("page", "by", "bx").sortWithinPartitions("page", "by", "bx").mapInArrow(_block_pairs(radius, labels), schema)


def _block_pairs(radius: float, labels: bool):
    side, reach = BLOCK_CELLS * radius, radius * SLACK

    def pairs(table) -> Iterator:
        """Pairs of marks of whole blocks: each meets those not far above it in its column of cells and the next ones."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        new = np.zeros(table.num_rows, bool)
        for c in ("page", "by", "bx"):
            v = table.column(c)
            new[1:] |= pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)).to_numpy(zero_copy_only=False)
        rank, number = (pc.rank(table.column(c), tiebreaker="dense").to_numpy().astype(np.int64) for c in ("mark_id", "numeral"))
        x, y, by, bx = (table.column(c).to_numpy() for c in ("x", "y", "by", "bx"))
        own = table.column("own").to_numpy(zero_copy_only=False)
        column = np.cumsum(new) * (BLOCK_CELLS + 8) + np.floor((x - bx * side) / reach).astype(np.int64) + 3
        height = y - by * side + reach
        order = np.lexsort((height, column))
        rank, number, x, y, own, column, height = (v[order] for v in (rank, number, x, y, own, column, height))
        known, at = np.unique(column, return_inverse=True)
        span = side + 4 * reach
        place = at * span + height  # rising; exact to far less than what reach has over the radius
        slack = reach - radius
        lower = np.flatnonzero(own)
        for d in (-1, 0, 1):
            to = np.searchsorted(known, column[lower] + d)
            there = (to < len(known)) & (known[np.minimum(to, len(known) - 1)] == column[lower] + d)
            p0, base = lower[there], to[there] * span + height[lower[there]]
            first = np.searchsorted(place, base - slack)
            count = np.searchsorted(place, base + reach) - first
            ends = np.cumsum(count)
            done = 0
            while done < (ends[-1] if len(ends) else 0):
                until = min(done + PAIRS, int(ends[-1]))
                nth = np.arange(done, until)
                i = np.searchsorted(ends, nth, side="right")
                p, q = p0[i], first[i] + nth - (ends[i] - count[i])
                done = until
                met = (np.abs(x[p] - x[q]) < radius) & (np.abs(y[p] - y[q]) < radius) & (number[p] != number[q])
                met &= (y[p] < y[q]) & (rank[p] != rank[q]) | (y[p] == y[q]) & (rank[p] < rank[q])
                p, q = p[met], q[met]
                less = rank[p] < rank[q]
                a, b = pa.array(order[np.where(less, p, q)]), pa.array(order[np.where(less, q, p)])
                out = {"page": table.column("page").take(a), "a": table.column("mark_id").take(a), "b": table.column("mark_id").take(b)}
                if labels:
                    out |= {"numeral_a": table.column("numeral").take(a), "numeral_b": table.column("numeral").take(b)}
                yield from pa.table(out).to_batches()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            page, by, bx = (pc.equal(batch.column(c), batch.column(c)[batch.num_rows - 1]) for c in ("page", "by", "bx"))
            rest = pc.sum(pc.and_(page, pc.and_(by, bx))).as_py()
            if rest < batch.num_rows:
                table = pa.Table.from_batches(held)
                held = table.slice(table.num_rows - rest).combine_chunks().to_batches()
                yield from pairs(table.slice(0, table.num_rows - rest).combine_chunks())
        if held:
            yield from pairs(pa.Table.from_batches(held).combine_chunks())

    return run


def fig_to_sheets(labels: DataFrame, pages: DataFrame, known: DataFrame) -> DataFrame:
    """(page, fig, method, confidence) of known figures: labels read on sheets, and one more by elimination if exactly
    one figure and exactly one sheet are left. labels: page, fig, confidence; pages: page; known: fig."""
    figs = known.select(F.upper("fig").alias("fig")).distinct()
    read = labels.join(figs, "fig", "left_semi").select("page", "fig", F.lit("ocr").alias("method"), "confidence")
    missing = figs.join(read, "fig", "left_anti").agg(F.count("*").alias("n_figs"), F.min("fig").alias("fig"))
    unlabeled = pages.select("page").distinct().join(read, "page", "left_anti").agg(F.count("*").alias("n_pages"), F.min("page").alias("page"))
    last = missing.crossJoin(unlabeled).where("n_figs = 1 and n_pages = 1")  # one row each
    return read.unionByName(last.select("page", "fig", F.lit("elimination").alias("method"), F.lit(None).cast("double").alias("confidence")))


def numeral_figures(assignments: DataFrame, sightings: DataFrame) -> DataFrame:
    """(numeral, figures): the figures of the sheets where a label was seen; of several on a sheet the last counts."""
    page = assignments.groupBy("page").agg(F.max("fig").alias("fig"))
    met = sightings.select("page", "numeral").distinct().join(page, "page").groupBy("numeral").agg(F.collect_set(F.struct(F.length("fig").alias("n"), "fig")).alias("f"))
    return met.select("numeral", F.transform(F.array_sort("f"), lambda x: x["fig"]).alias("figures"))


def cross_check(text_labels: DataFrame, sightings: DataFrame) -> DataFrame:
    """(label, state, n_sightings): matched, text_only or sheet_only."""
    drawn = sightings.groupBy(F.col("numeral").alias("label")).agg(F.count("*").alias("n"))
    both = text_labels.select("label", F.lit(True).alias("in_text")).distinct().join(drawn, "label", "full")
    state = F.when(F.col("n").isNull(), "text_only").when(F.col("in_text").isNull(), "sheet_only").otherwise("matched")
    return both.select("label", state.alias("state"), F.coalesce("n", F.lit(0)).cast("long").alias("n_sightings"))


def nearest_before(mentions: DataFrame, refs: DataFrame, window: int = TEXT_WINDOW) -> DataFrame:
    """mentions (doc_id, label, pos) with the figure of the nearest reference (doc_id, fig, at) at or before, no more
    than `window` away: one sort of both together. Of references at one offset the first figure counts."""
    once = refs.groupBy("doc_id", "at").agg(F.min("fig").alias("fig"))
    both = mentions.select("doc_id", F.col("pos").alias("at"), F.lit(1).alias("kind"), "label", F.lit(None).cast("string").alias("fig")).unionByName(once.select("doc_id", "at", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("label"), "fig"))
    before = Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == 0, F.struct("at", "fig")), ignorenulls=True).over(before)
    rows = both.withColumn("ref", last).where("kind = 1")
    close = F.col("at") - F.col("ref.at") <= window
    return rows.select("doc_id", "label", F.col("at").alias("pos"), F.when(close, F.col("ref.fig")).alias("fig"))


def text_figures(mentions: DataFrame, refs: DataFrame, window: int = TEXT_WINDOW) -> DataFrame:
    """(doc_id, label, figures) of the figures that any mention of a label is near to."""
    near = nearest_before(mentions, refs, window).where("fig is not null").groupBy("doc_id", "label").agg(F.collect_set(F.struct(F.length("fig").alias("n"), "fig")).alias("f"))
    return near.select("doc_id", "label", F.transform(F.array_sort("f"), lambda x: x["fig"]).alias("figures"))


def sequence_gaps(labels: DataFrame) -> DataFrame:
    """Whole numbers missing between the least and the largest numeric label, as runs (first, last)."""
    numbers = labels.where(F.col("label").rlike("^[0-9]{1,9}$")).select(F.col("label").cast("int").alias("n")).distinct()
    spaced = numbers.withColumn("next", F.lead("n").over(Window.orderBy("n"))).where("next > n + 1")
    return spaced.select((F.col("n") + 1).alias("first"), (F.col("next") - 1).alias("last"))


def geometry_outliers(sheets: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """Sheets (doc_id, sheet, w, h) off their document's upper median width or height by more than the tolerance;
    documents of fewer than three sheets have none."""
    def median(c: str) -> Column:
        return F.get(F.sort_array(F.collect_list(c)), F.floor(F.count(c) / 2).cast("int"))

    mid = sheets.groupBy("doc_id").agg(median("w").alias("mw"), median("h").alias("mh"), F.count("*").alias("n")).where("n >= 3")
    off = (F.abs(F.col("w") - F.col("mw")) > tolerance * F.col("mw")) | (F.abs(F.col("h") - F.col("mh")) > tolerance * F.col("mh"))
    return sheets.join(mid, "doc_id").where(off).select("doc_id", "sheet", "w", "h")


def box_from_pixels(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, least: int = 4) -> Column:
    """Box in shares of the sheet from pixel corners in any order; null if a side is too short or leaves the sheet."""
    lo_x, hi_x, lo_y, hi_y = F.least(x0, x1), F.greatest(x0, x1), F.least(y0, y1), F.greatest(y0, y1)
    fits = (hi_x - lo_x >= least) & (hi_y - lo_y >= least) & (lo_x >= 0) & (lo_y >= 0) & (hi_x <= width) & (hi_y <= height)
    share = lambda a, b: F.round(a / b, 6)
    return F.when(fits, F.struct(share(lo_x, width).alias("x"), share(height - hi_y, height).alias("y"), share(hi_x - lo_x, width).alias("w"), share(hi_y - lo_y, height).alias("h")))


def apply_refutations(marks: DataFrame, refuted: DataFrame, radius: float = SAME_SPOT) -> DataFrame:
    """Without the marks whose label was refuted at their spot (refuted: page, numeral, x, y)."""
    gone = near_pairs(marks, refuted.select("page", "numeral", "x", "y"), radius, ["page", "numeral"]).select("mark_id").distinct()
    return marks.join(gone, "mark_id", "left_anti")


def cells(radius: float) -> int:
    """Cells along a sheet's side."""
    return math.ceil(1 / radius)


def _core(c: str) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def _small(table: DataFrame, rows: int) -> DataFrame:
    """A table computed already, to be broadcast if it is small."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def fragments(hits: DataFrame, records: DataFrame, radius: float = FRAGMENT) -> DataFrame:
    """hit_id of hits (hit_id, page, numeral, x, y) that lie on a longer record (page, text, x, y, w) that contains them.

    Labels that contain one another are found among the distinct labels. A record in a hit's own cell, which is smaller
    than the radius, is near it wherever both lie, so which labels a cell holds settles most hits of a crowded page
    without pairs; only those that are left meet records."""
    own = hits.withColumn("short", F.lower("numeral"))
    long = records.select("page", _core("text").alias("long"), "x", "y", F.coalesce("w", F.lit(0.0)).alias("w"))
    pairs = cut(label_pairs(cut(own.select(F.col("short").alias("low")).union(long.select("long")).distinct())).toDF("short", "long"))
    pairs = _small(pairs, pairs.count())
    at = {"gx": F.floor(F.col("x") / (radius * 0.999)), "gy": F.floor(F.col("y") / (radius * 0.999))}
    placed = (F.abs("x") < 1e6) & (F.abs("y") < 1e6)  # not of numbers so large that cells are lost by rounding, or NaN
    held = long.where(placed & (F.col("w") >= 0)).join(pairs, "long").withColumns(at).select("page", "gx", "gy", "short").distinct()
    held = cut(held.groupBy("page", "gx", "gy").agg(F.collect_set("short").alias("shorts")))
    n = held.agg(F.sum(F.size("shorts"))).first()[0] or 0
    known = own.withColumns(at).join(_small(held, n), ["page", "gx", "gy"], "left")
    known = known.withColumn("settled", F.coalesce(placed & F.array_contains("shorts", F.col("short")), F.lit(False)))
    near = _fragments_near(cut(known.where("not settled").select("hit_id", "page", "short", "x", "y")), long, pairs, radius)
    return known.where("settled").select("hit_id").union(near).distinct()


def _fragments_near(hits: DataFrame, long: DataFrame, pairs: DataFrame, radius: float) -> DataFrame:
    """hit_id of hits (hit_id, page, short, x, y) on records (page, long, x, y, w) of a label paired with theirs.

    Records are listed under the bands of y around theirs and the cells of x they cover, where hits lie."""
    span = F.explode(F.sequence(F.floor((F.col("x") - radius) / radius), F.floor((F.col("x") + F.col("w") + radius) / radius)))
    band = F.explode(F.array(*[F.floor(F.col("y") / radius) + i for i in (-1, 0, 1)]))
    hits = hits.withColumns({"cx": F.floor(F.col("x") / radius), "cy": F.floor(F.col("y") / radius)})
    asked = cut(hits.select("page", "cx", "cy").distinct())
    listed = long.select("page", "long", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("w").alias("rw"), span.alias("cx"), "y").withColumn("cy", band).drop("y")
    listed = listed.join(_small(asked, asked.count()), ["page", "cx", "cy"], "left_semi").join(pairs, "long")
    on = F.col("x").between(F.col("rx") - radius, F.col("rx") + F.col("rw") + radius) & (F.abs(F.col("ry") - F.col("y")) < radius)
    return hits.join(listed, ["page", "cx", "cy", "short"]).where(on).select("hit_id")


def label_pairs(labels: DataFrame) -> DataFrame:
    """(low, long) of distinct labels (low) of which the longer contains the shorter, by the longer one's substrings."""
    sizes = [r.n for r in labels.select(F.length("low").alias("n")).where("n is not null").distinct().collect()]

    def parts_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("low") - n + 1, F.lit(1)))
        return F.when(F.length("low") > n, F.transform(starts, lambda i: F.col("low").substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    cuts = [parts_of(n) for n in sizes]
    if not cuts:
        return labels.select("low", F.col("low").alias("long")).limit(0)
    parts = labels.select(F.col("low").alias("long"), F.explode(F.array_distinct(F.flatten(F.array(*cuts)))).alias("low"))
    return parts.join(labels, "low", "left_semi").select("low", "long")


def drop_fragment_hits(hits: DataFrame, radius: float = CONTAINED) -> DataFrame:
    """Hits without those contained in a longer kept one at their spot; longer labels come first, so order decides.

    Labels that contain one another are found among the distinct labels, and only hits of such labels meet."""
    low = F.lower("numeral")
    pairs = cut(label_pairs(cut(hits.select(low.alias("low")).distinct())))
    if pairs.isEmpty():
        return hits
    short, long = pairs.select("low").distinct(), pairs.select(F.col("long").alias("low")).distinct()
    both = cut(short.union(long).distinct())
    own = hits.withColumn("low", low)
    rows = cut(own.join(both, "low", "left_semi").withColumn("item", F.monotonically_increasing_id()))  # ids may be repeated
    slim = rows.select("item", "page", "low", "x", "y")
    left = slim.join(pairs, "low").select("item", "page", "long", "x", "y")
    met = near_pairs(left, slim.join(long, "low", "left_semi").withColumnRenamed("low", "long"), radius, ["page", "long"])
    kept = first_come(slim, met.select("item", F.col("r_item").alias("by")))
    alone = own.join(both, "low", "left_anti").select(*hits.columns)
    return alone.union(rows.join(kept.where("kept"), "item", "left_semi").select(*hits.columns))


def letters_read(observations: DataFrame, markers: DataFrame, marks: DataFrame, header: float = 0.88) -> DataFrame:
    """Observations below the header band that read exactly as a view marker the page has no mark of."""
    rows = observations.withColumn("numeral", F.regexp_replace("text", "[^A-Za-z0-9]", "")).where(F.col("y") < header)
    return rows.join(markers.select(F.col("marker").alias("numeral")).distinct(), "numeral", "left_semi").join(marks.select("page", "numeral").distinct(), ["page", "numeral"], "left_anti")


def numeral_coverage(text_labels: DataFrame, tied: DataFrame, drawn: DataFrame) -> DataFrame:
    """(label, kind) of disagreements: figure-tied labels on no sheet, drawn labels no text recites, and labels whose
    text names a figure where they weren't seen. text_labels: label; tied and drawn: label, fig."""
    seen = drawn.select("label").distinct()
    figs = tied.select("label").distinct()
    locatable = F.col("label").rlike("[^0-9]") | (F.col("label").try_cast("long") >= 10)
    missed = figs.where(locatable).join(seen, "label", "left_anti").select("label", F.lit("recited-not-drawn").alias("kind"))
    extra = seen.join(text_labels.select("label").distinct(), "label", "left_anti").select("label", F.lit("drawn-not-recited").alias("kind"))
    other = tied.join(seen, "label", "left_semi").join(drawn, ["label", "fig"], "left_anti").select("label", F.lit("figure-mismatch").alias("kind")).distinct()
    return missed.union(extra).union(other)


def sightings(marks: DataFrame, floor: float = 0.0) -> DataFrame:
    """(numeral, page, confidence, rank) of marks at or above a confidence, in order of page and natural label."""
    number = F.regexp_extract("numeral", r"^(\d+)", 1).try_cast("int")
    order = Window.partitionBy("page").orderBy(number.isNull(), number, "numeral", F.desc("confidence"), "mark_id")
    return marks.where(F.coalesce("confidence", F.lit(1.0)) >= floor).select("mark_id", "numeral", "page", "confidence", F.row_number().over(order).alias("rank"))


def numeral_issues(elements: DataFrame, seen: DataFrame) -> DataFrame:
    """(kind, numeral, detail): labels recited (label, element) but seen nowhere, and sightings that no text recites."""
    lost = elements.join(seen.select(F.col("numeral").alias("label")).distinct(), "label", "left_anti")
    extra = seen.join(elements.select(F.col("label").alias("numeral")).distinct(), "numeral", "left_anti")
    lost = lost.select(F.lit("recited-not-located").alias("kind"), F.col("label").alias("numeral"), F.col("element").alias("detail"))
    return lost.union(extra.select(F.lit("located-not-recited"), "numeral", F.concat(F.lit("page "), F.col("page").cast("string"))))


def label_shape(label: Column) -> Column:
    """A pattern for a label that stands by itself: no part of a number, an amount or a longer label."""
    return F.concat(F.lit(r"(?<![\w.,$])"), label, F.lit(r"(?![\w])(?!\.\d)(?!,\d{3})"))


def relevant_figures(cited: DataFrame, assignments: DataFrame, seen: DataFrame, known: DataFrame) -> DataFrame:
    """(answer_id, fig) to show beside cited spans (answer_id, text): assigned figures that they name, and those of the
    sheets where labels (known: label) that they recite were seen. Of several figures of a sheet the last counts."""
    named = cited.select("answer_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?i)FIGS?\.?\s*(\d+[A-Z]?)"), 1)).alias("fig")).select("answer_id", F.upper("fig").alias("fig"))
    named = named.join(assignments.select("fig").distinct(), "fig", "left_semi")
    # words of a span that are labels, tested for standing alone only where they are known
    words = cited.select("answer_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)"), 1))).alias("label"))
    words = words.join(known.select("label").distinct(), "label", "left_semi").where(F.regexp_like("text", label_shape(F.col("label"))))
    sheet = assignments.groupBy("page").agg(F.max("fig").alias("fig"))
    drawn = words.join(seen.select(F.col("numeral").alias("label"), "page").distinct(), "label").join(sheet, "page")
    return named.select("answer_id", "fig").union(drawn.select("answer_id", "fig")).distinct()


def view_markers(figs: DataFrame) -> DataFrame:
    """Letters (marker) that sub-figures (fig) end in: they mark views on the drawing they are taken of."""
    return figs.where(F.length("fig") > 1).select(F.upper(F.regexp_extract("fig", r"([A-Za-z])$", 1)).alias("marker")).where("marker <> ''").distinct()


def sub_figure_parents(docs: DataFrame, refs: DataFrame, reach: int = 400) -> DataFrame:
    """(doc_id, base, parent): the first other figure that the sentence of a family's first reference names after it.

    refs: doc_id, fig, char_start, char_end. A sentence ends at a semicolon or period (not of FIG.) or after `reach`."""
    family = refs.where(F.col("fig").rlike(r"^\d+[A-Za-z]+$")).withColumn("base", F.regexp_extract("fig", r"^(\d+)", 1))
    first = family.groupBy("doc_id", "base").agg(F.min(F.struct("char_start", "char_end")).alias("m")).select("doc_id", "base", "m.*")
    after = F.col("canonical_text").substr(F.col("char_end") + 1, F.lit(reach))
    stop = F.regexp_instr(after, F.lit(r";|(?<!FIG)(?<!FIGS)\.\s"))
    ended = first.join(docs.select("doc_id", "canonical_text"), "doc_id").select("doc_id", "base", "char_start", (F.col("char_end") + F.when(stop > 0, stop - 1).otherwise(F.lit(reach))).alias("until"))
    other = refs.select("doc_id", "fig", F.col("char_start").alias("at"))
    inside = ended.join(other, "doc_id").where((F.col("at") > F.col("char_start")) & (F.col("at") <= F.col("until")) & ~F.startswith("fig", F.col("base")))
    return inside.groupBy("doc_id", "base").agg(F.min_by("fig", F.struct("at", "fig")).alias("parent"))


def apply_judgments(marks: DataFrame, judgments: DataFrame, radius: float = SAME_SPOT) -> DataFrame:
    """(page, numeral, x, y, method, source) of marks after judgments (seq, kind, page, numeral, x, y, new_numeral) in order.

    REFUTE takes away the marks of its label at its spot that are there by then, CONFIRM adds one, CORRECT does both, the
    added one under its new label. So a mark stays if no later judgment than the one that added it takes it away."""
    own = marks.select("page", "numeral", "x", "y", F.lit(-1).cast("long").alias("born"), F.lit("read").alias("method"), F.col("mark_id").alias("source"))
    new = judgments.where(F.col("kind").isin("CONFIRM", "CORRECT"))
    label = F.when(F.col("kind") == "CORRECT", F.coalesce("new_numeral", "numeral")).otherwise(F.col("numeral"))
    added = new.select("page", label.alias("numeral"), "x", "y", F.col("seq").cast("long").alias("born"), F.lit("human").alias("method"), F.col("seq").alias("source"))
    every = own.unionByName(added)
    takes = judgments.where(F.col("kind").isin("REFUTE", "CORRECT")).select("page", "numeral", "x", "y", "seq")
    gone = near_pairs(every, takes, radius, ["page", "numeral"]).where("r_seq > born").select("method", "source").distinct()
    return every.join(gone, ["method", "source"], "left_anti").select("page", "numeral", "x", "y", "method", "source")


def confirm_targets(predicted: DataFrame, located: DataFrame) -> DataFrame:
    """Predicted (label, page) that no mark has located: what a second look is for."""
    return predicted.select("label", "page").distinct().join(located.select(F.col("numeral").alias("label"), "page").distinct(), ["label", "page"], "left_anti")


def sheet_audit(candidates: DataFrame, marks: DataFrame, radius: float = SAME_SPOT) -> DataFrame:
    """Candidates (cand_id, page, numeral, x, y, engines) without a mark of their label near, and whether engines agree."""
    met = near_pairs(candidates, marks.select("page", "numeral", "x", "y"), radius, ["page", "numeral"]).select("cand_id").distinct()
    return candidates.join(met, "cand_id", "left_anti").select("cand_id", "page", "numeral", (F.size(F.array_distinct("engines")) > 1).alias("corroborated"))


def likely_misreads(tied: DataFrame, seen: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(numeral, kind, reading): labels seen but not tied to text that become tied with a and 0 exchanged, and numbers
    at one spot of which just one is tied to text, else `unresolved`. tied: label; seen: numeral; conflicts: numeral_a, numeral_b."""
    known = tied.select(F.col("label").alias("reading")).distinct()
    strange = seen.select("numeral").distinct().join(known.withColumnRenamed("reading", "numeral"), "numeral", "left_anti")
    swapped = F.explode(F.array_distinct(F.array(F.regexp_replace("numeral", "a$", "0"), F.regexp_replace("numeral", "0$", "a"))))
    confused = strange.select("numeral", swapped.alias("reading")).where("numeral <> reading").join(known, "reading", "left_semi").select("numeral", F.lit("confusion").alias("kind"), "reading")
    pairs = conflicts.select(F.least("numeral_a", "numeral_b").alias("a"), F.greatest("numeral_a", "numeral_b").alias("b")).distinct()
    pairs = pairs.join(known.select(F.col("reading").alias("a"), F.lit(True).alias("has_a")), "a", "left").join(known.select(F.col("reading").alias("b"), F.lit(True).alias("has_b")), "b", "left")
    to = F.when(F.col("has_a").isNotNull() & F.col("has_b").isNull(), F.col("a")).when(F.col("has_b").isNotNull() & F.col("has_a").isNull(), F.col("b")).otherwise("unresolved")
    return confused.union(pairs.select(F.concat_ws("/", "a", "b"), F.lit("conflict"), to))
