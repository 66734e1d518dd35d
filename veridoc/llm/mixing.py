"""Mixing sources to target weights by hash-random order and distributed prefix sums (DataFrame operations only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.llm.common import col, columns_of, field, row_of, tidied, word_count

#: Documents that one innermost group of keys holds on average.
GROUP = 4096


def _no_source(source: Column) -> Column:
    return source.isNull()


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Targets of sources (no_src, src, source_size): shares of the total by weight, none above cap x source_size.

    Weights go to the sources by code point, the null source last. Sources in order of cap x size / weight are
    filled first; what they can't take is shared by weight among the rest, which is where resharing ends.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("n", F.row_number().over(everything.orderBy("no_src", "src")) - 1)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", w.cast("long")).withColumn("most", F.col("source_size") * cap)
    order = everything.orderBy(F.col("most") / F.col("w"), "n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.withColumns({
        "total": F.sum("source_size").over(everything),
        "all_w": F.sum("w").over(everything),
        "full": F.coalesce(F.sum("most").over(before), F.lit(0)),
        "used_w": F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    filled = filled.withColumn("level", (F.col("total") - F.col("full")).cast("double") / (F.col("all_w") - F.col("used_w")).cast("double"))
    filled = filled.withColumn("open", F.col("most") / F.col("w") > F.col("level"))
    level = F.max(F.when(F.col("open"), F.col("level"))).over(everything)
    target = F.when(F.col("open"), level * F.col("w")).otherwise(F.col("most").cast("double"))
    return filled.withColumn("target", target).select("no_src", "src", "source_size", "target")


@tidied
def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, carry: bool = True) -> DataFrame:
    """All rows of docs with size, source_size, target and taken (words the mix takes of the row, repeats counted).

    Every row gets a key, the MD5 of its identifier. Within a source, rows are ranged by key: by its first digits,
    by its next digits, then row by row; sums of each level give every row the words before it. A source's budget,
    its rounded target, gives every row as many whole epochs as fit and cuts the last epoch exactly where the
    budget ends, if need be within a row. Only sums of groups meet in one task, and keys spread a hot source over
    as many groups as it has rows for. carry=False drops the text once it is counted.

    A null text has size 0. The null source is a source of its own, after all others. Rows without identifier take
    their key from their text. Equal keys go by size and text hash, so repeated rows share what the pair gets; the
    values of exact repeats can't be told apart. Columns of the input that have the result's names give way to it.
    An empty table gives an empty result.
    """
    names = ("size", "source_size", "target", "taken")
    own = [c for c in columns_of(docs, names) if carry or c != text]
    digits = max(0, math.ceil(math.log(max(1, docs.count()) / GROUP, 16)))
    a = digits // 2
    key = F.md5(F.coalesce(col(doc_id).cast("string"), F.concat(F.lit("t"), F.xxhash64(col(text)).cast("string"))))
    rows = docs.select(row_of(own), _no_source(col(source)).alias("no_src"), F.coalesce(col(source).cast("string"), F.lit("")).alias("src"), word_count(col(text)).alias("size"), key.alias("key"), F.xxhash64(col(text)).alias("tie"))
    rows = rows.withColumns({"hi": F.substring("key", 1, a), "lo": F.substring("key", a + 1, digits - a)})

    groups = rows.groupBy("no_src", "src", "hi", "lo").agg(F.sum("size").alias("part"))
    his = groups.groupBy("no_src", "src", "hi").agg(F.sum("part").alias("part"))
    sources = source_targets(his.groupBy("no_src", "src").agg(F.sum("part").alias("source_size")), weights, cap)

    def earlier(within: list[str], by: list[str], what: str) -> Column:
        window = Window.partitionBy(*within).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(what).over(window), F.lit(0))

    his = his.select("no_src", "src", "hi", earlier(["no_src", "src"], ["hi"], "part").alias("before_hi")).join(sources, ["no_src", "src"])
    groups = groups.withColumn("before_lo", earlier(["no_src", "src", "hi"], ["lo"], "part")).drop("part").join(his, ["no_src", "src", "hi"])

    at = earlier(["no_src", "src", "hi", "lo"], ["key", "size", "tie"], "size")
    placed = rows.withColumn("at", at).join(groups, ["no_src", "src", "hi", "lo"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("at") - F.col("before_lo") - F.col("before_hi")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(left, F.col("size")))
    return placed.select(*[field(c) for c in own], "size", "source_size", "target", taken.cast("long").alias("taken"))
