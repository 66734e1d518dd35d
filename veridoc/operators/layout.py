"""Ranges laid over text: painting, clusters, headers and what lies within; and the worklists drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Kinds of ranges by rising priority; kinds of work by rank.
PAINT = ("closest", "label", "figure")
QUEUE = {"figure-mismatch": 1, "recited-not-drawn": 2, "drawn-not-recited": 3, "conflict": 4}


def paint(ranges: DataFrame) -> DataFrame:
    """Disjoint segments (doc_id, char_start, char_end, kind) of overlapping ranges: of the kinds at a place the one of
    highest priority shows, and equal neighbours are one. One sweep per document over range ends."""
    edges = ranges.where("char_start < char_end").select("doc_id", "kind", F.explode(F.array(F.struct(F.col("char_start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("char_end").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    sums = edges.groupBy("doc_id", F.col("e.at").alias("at")).agg(*[F.sum(F.when(F.col("kind") == k, F.col("e.d")).otherwise(0)).alias(k) for k in PAINT])
    sweep = Window.partitionBy("doc_id").orderBy("at")
    run = sums.select("doc_id", "at", F.lead("at").over(sweep).alias("next"), *[F.sum(k).over(sweep).alias(k) for k in PAINT])
    kind = F.when(F.col("figure") > 0, "figure").when(F.col("label") > 0, "label").when(F.col("closest") > 0, "closest")
    cut = run.withColumn("kind", kind).where("kind is not null")
    fresh = F.coalesce((F.lag("next").over(sweep) != F.col("at")) | (F.lag("kind").over(sweep) != F.col("kind")), F.lit(True)).cast("int")
    piece = cut.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(sweep))
    return piece.groupBy("doc_id", "island").agg(F.min("at").alias("char_start"), F.max("next").alias("char_end"), F.max("kind").alias("kind")).drop("island")


def clusters(lines: DataFrame, gap: int = 2) -> DataFrame:
    """Runs (doc_id, first, last, n) of line numbers (doc_id, line) no more than `gap` apart."""
    order = Window.partitionBy("doc_id").orderBy("line")
    fresh = F.coalesce((F.col("line") - F.lag("line").over(order) > gap).cast("int"), F.lit(1))
    run = lines.select("doc_id", "line").distinct().withColumn("fresh", fresh).withColumn("c", F.sum("fresh").over(order))
    return run.groupBy("doc_id", "c").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("n")).drop("c")


def header_of(rows: DataFrame, headers: DataFrame, reach: int = 80) -> DataFrame:
    """rows (doc_id, line, col) with the header cell (doc_id, line, cells) of their column on the nearest header line
    above, no more than `reach` lines away."""
    both = rows.select("doc_id", "line", F.lit(1).alias("k"), "col", F.lit(None).cast("array<string>").alias("cells")).unionByName(headers.select("doc_id", "line", F.lit(2).alias("k"), F.lit(None).cast("int").alias("col"), "cells"))
    above = Window.partitionBy("doc_id").orderBy("line", "k").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("k") == 2, F.struct("line", "cells")), ignorenulls=True).over(above)
    out = both.withColumn("h", last).where("k = 1")
    near = F.col("line") - F.col("h.line") <= reach
    return out.select("doc_id", "line", "col", F.when(near, F.get(F.col("h.cells"), F.col("col"))).alias("header"))


def review_queue(found: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """(rank, kind, label) of what is to be reviewed (kind, label), what was judged already (item_id 'kind:label') left out."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in QUEUE.items() for x in kv]), F.col("kind"))
    rows = found.distinct().withColumns({"rank": rank, "item_id": F.concat_ws(":", "kind", "label")})
    return rows.join(adjudicated.select("item_id"), "item_id", "left_anti").select("rank", "kind", "label")


def first_sightings(seen: DataFrame) -> DataFrame:
    """(numeral, page, x, y): where each label was seen first, by page and place from the top left."""
    first = F.min(F.struct("page", (-F.col("y")).alias("down"), "x", "mark_id"))
    return seen.groupBy("numeral").agg(first.alias("f")).select("numeral", "f.page", "f.x", (-F.col("f.down")).alias("y"))


def kind_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("kind").agg(F.count("*").alias("n"))


def segment_at(painted: DataFrame, points: DataFrame, width: int = 1024) -> DataFrame:
    """points (doc_id, pos) with seg_id, 'doc:start' of the painted segment that holds them, empty without one."""
    blocks = F.explode(F.sequence(F.floor(F.col("char_start") / width), F.floor((F.col("char_end") - 1) / width)))
    listed = painted.select("doc_id", "char_start", "char_end", blocks.alias("block"))
    hit = points.withColumn("block", F.floor(F.col("pos") / width)).join(listed, ["doc_id", "block"], "left")
    inside = (F.col("char_start") <= F.col("pos")) & (F.col("pos") < F.col("char_end"))
    at = F.min(F.when(inside, F.col("char_start")))
    return hit.groupBy("doc_id", "pos").agg(at.alias("s")).select("doc_id", "pos", F.when(F.col("s").isNull(), "").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("s").cast("string"))).alias("seg_id"))


def attached_labels(mentions: DataFrame, cited: DataFrame, width: int = 1024) -> DataFrame:
    """(doc_id, label) of mentions (doc_id, label, pos) that lie in a cited range (doc_id, char_start, char_end)."""
    blocks = F.explode(F.sequence(F.floor(F.col("char_start") / width), F.floor(F.greatest(F.col("char_end") - 1, F.col("char_start")) / width)))
    listed = cited.select("doc_id", "char_start", "char_end", blocks.alias("block"))
    return mentions.withColumn("block", F.floor(F.col("pos") / width)).join(listed, ["doc_id", "block"]).where("char_start <= pos and pos < char_end").select("doc_id", "label").distinct()
