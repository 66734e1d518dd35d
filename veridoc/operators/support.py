"""Answer or decline: support decisions against a floor, the floor's calibration and where it came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 15.0
# Tags of questions whose answer isn't in the documents.
ABSENT_TAGS = ("out-of-document-fact", "not-disclosed-metric")


def check_support(hits: DataFrame, queries: DataFrame, threshold: float = THRESHOLD, k: int = 20, closest: int = 3) -> DataFrame:
    """Per query: status and the ranked spans that clear the floor, or the closest ones if none does."""
    ranked = hits.where(F.col("rank") <= k).select("query_id", F.struct("rank", "span_id", F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("clears")).alias("h"))
    lists = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list("h")).alias("all"))
    none = F.array().cast("array<struct<rank:int,span_id:string,score:double,clears:boolean>>")
    rows = queries.select("query_id").join(lists, "query_id", "left").withColumn("all", F.coalesce("all", none))
    supporting = F.filter("all", lambda h: h["clears"])
    ids = lambda a: F.transform(a, lambda h: h["span_id"])
    status = F.when(F.size(supporting) > 0, "supported").otherwise("insufficient")
    nearest = F.when(F.size(supporting) > 0, F.array().cast("array<string>")).otherwise(ids(F.slice("all", 1, closest)))
    return rows.select("query_id", status.alias("status"), ids(supporting).alias("supporting"), nearest.alias("closest"))


def top_scores(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, top_score): 0.0 for a query without hits."""
    top = hits.groupBy("query_id").agg(F.max("score").alias("top"))
    return queries.join(top, "query_id", "left").withColumn("top_score", F.coalesce("top", F.lit(0.0))).drop("top")


def fit_floor(scores: DataFrame) -> DataFrame:
    """One row `threshold` from scores (score, present): of the midpoints between neighbouring scores and one beyond
    either end, the one with most scores on their right side, then the widest margin, then the least; to one decimal.

    Counts on both sides are running sums over the sorted scores, so every candidate costs one row.
    """
    tied = scores.groupBy("score").agg(F.sum(F.when(F.col("present"), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("present"), 0).otherwise(1)).alias("a"), F.count("*").alias("n"))
    order = Window.orderBy("score")
    below = order.rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    rows = tied.select("score", F.lead("score").over(order).alias("next"), F.lag("score").over(order).alias("before"), F.sum("a").over(below).alias("absent_below"), F.sum("p").over(everything).alias("all_p"), F.sum("p").over(below).alias("p_below"), "n")
    mid = rows.select(F.when(F.col("next").isNull(), F.col("score") + 1).otherwise((F.col("score") + F.col("next")) / 2).alias("t"), (F.col("absent_below") + F.col("all_p") - F.col("p_below")).alias("correct"), F.when(F.col("next").isNull(), F.lit(1.0)).otherwise((F.col("next") - F.col("score")) / 2).alias("margin"))
    low = rows.where("before is null").select((F.col("score") - 1).alias("t"), F.col("all_p").alias("correct"), F.lit(1.0).alias("margin"))
    # a candidate on a shared score sorts the items as the midpoint below it does, with no margin
    return mid.union(low).orderBy(F.desc("correct"), F.desc(F.round("margin", 9)), "t").limit(1).select(F.bround("t", 1).alias("threshold"))


def calibration_summary(items: DataFrame) -> DataFrame:
    """Counts and gap of items (top_score, answerable, tests): answerable ones against those tagged content-absent."""
    absent = ~F.col("answerable") & F.arrays_overlap("tests", F.array(*[F.lit(t) for t in ABSENT_TAGS]))
    present_min, absent_max = F.min(F.when(F.col("answerable"), F.col("top_score"))), F.max(F.when(absent, F.col("top_score")))
    return items.agg(
        F.count_if("answerable").alias("n_present"), F.count_if(absent).alias("n_absent"), F.count_if(~F.col("answerable") & ~absent).alias("excluded"),
        F.bround(present_min, 1).alias("present_min"), F.bround(absent_max, 1).alias("absent_max"), F.bround(present_min - absent_max, 1).alias("gap"), (present_min - absent_max > 0).alias("clean"),
    )


def streamed_hash(lines: DataFrame, name: str) -> DataFrame:
    """One row: SHA-256 of the lines (k, line) in order of k, joined by line feeds.

    The hash has to see the lines in order, so one task streams them from a sort; it holds a batch at a time."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        hashed, first = hashlib.sha256(), True
        for batch in batches:
            for line in batch.column(1).to_pylist():
                hashed.update(("" if first else "\n").encode() + line.encode())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([hashed.hexdigest()])], names=[name])

    return lines.select("k", "line").repartition(1).sortWithinPartitions("k", "line").mapInArrow(run, f"{name} string")


def corpus_hash(docs: DataFrame) -> DataFrame:
    """One row `corpus_hash`: SHA-256 of the sorted lines doc_id:content_hash."""
    return streamed_hash(docs.select(F.col("doc_id").alias("k"), F.concat("doc_id", F.lit(":"), "content_hash").alias("line")), "corpus_hash")


def corpus_identity(docs: DataFrame, state: Column) -> DataFrame:
    """One row: how many documents, their hash and what their floor's record says of itself."""
    return corpus_hash(docs).crossJoin(docs.agg(F.count("*").alias("n_docs"))).withColumn("floor", state)  # one row each


def floor_state(has_record: Column, same_corpus: Column, separable: Column) -> Column:
    """Where a floor comes from when it is applied: staleness outranks inseparable scores."""
    return F.when(~has_record, "uncalibrated").when(~same_corpus, "stale").when(~separable, "non-separable").otherwise("calibrated")


def described_state(has_record: Column, same_corpus: Column, separable: Column) -> Column:
    """What a floor's description says: inseparable scores outrank staleness."""
    return F.when(~has_record, "uncalibrated").when(~separable, "non-separable").when(~same_corpus, "stale").otherwise("calibrated")
