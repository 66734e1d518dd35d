"""The log of decisions: hash chain, adjudications, sessions and what they presented."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = "0" * 64
# Kinds of judgments and who may make them.
KINDS = ("CONFIRM", "CORRECT", "REFUTE", "NOTE")


def entry_hash(seq: Column, prev_hash: Column, payload: Column) -> Column:
    """SHA-256 of the entry as JSON with sorted keys and no spaces; payload is canonical JSON text already."""
    return F.sha2(F.concat(F.lit('{"payload":'), payload, F.lit(',"prev_hash":"'), prev_hash, F.lit('","seq":'), seq.cast("string"), F.lit("}")), 256)


def canonical_json(payload: Column) -> Column:
    """JSON text with keys sorted at every level, no spaces, letters as they are; one value at a time, in batches."""
    def canonical(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False))

    return F.pandas_udf(canonical, "string")(payload)


def chain(payloads: DataFrame, start_seq: int = 0, start_hash: str = START) -> DataFrame:
    """Entries (seq, prev_hash, payload, entry_hash) of payloads (ord, payload), one after the other.

    Every hash needs the one before it, so a batch is folded in order by one task; it holds one batch of rows."""
    import hashlib

    def fold(batches):
        import pyarrow as pa

        seq, prev = start_seq, start_hash
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for payload in batch.column(1).to_pylist():
                now = hashlib.sha256(f'{{"payload":{payload},"prev_hash":"{prev}","seq":{seq}}}'.encode()).hexdigest()
                for column, value in zip(rows, (seq, prev, payload, now), strict=True):
                    column.append(value)
                seq, prev = seq + 1, now
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *[pa.array(r, pa.string()) for r in rows[1:]]], names=["seq", "prev_hash", "payload", "entry_hash"])

    ordered = payloads.select("ord", "payload").repartition(1).sortWithinPartitions("ord")
    return ordered.mapInArrow(fold, "seq long, prev_hash string, payload string, entry_hash string")


def broken_links(log: DataFrame) -> DataFrame:
    """(seq, reason) of entries that break the chain: position, previous hash or own hash. Runs by blocks of entries:
    stored hashes let every entry be checked against its neighbour alone."""
    before = log.select((F.col("seq") + 1).alias("seq"), F.col("entry_hash").alias("before"))
    twice = log.groupBy("seq").agg(F.count("*").alias("n"))
    both = log.join(before.dropDuplicates(["seq"]), "seq", "left").join(twice, "seq")
    expected = F.when(F.col("seq") == 0, F.lit(START)).otherwise(F.col("before"))
    reason = F.when(F.col("n") > 1, "position").when(expected.isNull(), "position").when(F.col("prev_hash") != expected, "prev_hash").when(F.col("entry_hash") != entry_hash(F.col("seq"), F.col("prev_hash"), F.col("payload")), "entry_hash")
    return both.select("seq", reason.alias("reason")).where("reason is not null")


def invalid_adjudications(rows: DataFrame) -> DataFrame:
    """(adj_id, reason) of judgments (seq, adj_id, kind, target_kind, by, on, value, supersedes, machine) that may not stand."""
    first = rows.groupBy("adj_id").agg(F.min("seq").alias("first"))
    both = rows.join(first, "adj_id", "left").join(first.select(F.col("adj_id").alias("supersedes"), F.col("first").alias("target_seq")), "supersedes", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = F.when(~F.col("kind").isin(*KINDS), "kind").when(blank("adj_id") | blank("by") | blank("on"), "missing").when((F.col("kind") == "CORRECT") & blank("value"), "value")
    reason = reason.when(F.col("seq") > F.col("first"), "duplicate").when(F.col("supersedes").isNotNull() & ~F.coalesce(F.col("target_seq") < F.col("seq"), F.lit(False)), "supersedes").when(F.col("supersedes").isNotNull() & F.col("machine"), "machine")
    return both.select("adj_id", "seq", reason.alias("reason")).where("reason is not null")


def effective(rows: DataFrame) -> DataFrame:
    """Judgments that no later one supersedes, notes aside."""
    later = rows.where("supersedes is not null").select(F.col("supersedes").alias("adj_id"), F.col("seq").alias("later"))
    gone = rows.join(later, "adj_id").where("later > seq").select("adj_id", "seq").distinct()
    return rows.join(gone, ["adj_id", "seq"], "left_anti").where("kind <> 'NOTE'")


def latest_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The last value of each key by seq."""
    return rows.groupBy(key).agg(F.max_by(value, "seq").alias(value))


def sessions(log: DataFrame, block: int = 4096) -> DataFrame:
    """log (seq, kind, label, query, status, ok) with session, its label, the number of entries before its marker
    and last_query, the nearest query at or before the entry in its session.

    Running values go by blocks of entries: each block's sum and last query are carried over the blocks, then added
    within them, so no task sorts the whole log."""
    rows = log.withColumn("block", F.floor(F.col("seq") / block)).withColumn("mark", (F.col("kind") == "session_start").cast("int"))
    tell = F.when(F.col("mark") == 1, F.struct("seq", F.lit(None).cast("string").alias("query"))).when(F.col("kind").isin("check_support", "check_claim") & F.col("query").isNotNull(), F.struct("seq", "query"))
    rows = rows.withColumn("told", tell)
    sums = rows.groupBy("block").agg(F.sum("mark").alias("marks"), F.max("told").alias("last"))
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("block", F.coalesce(F.sum("marks").over(over), F.lit(0)).alias("before"), F.max("last").over(over).alias("carried"))
    within = Window.partitionBy("block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    at = rows.withColumns({"near": F.sum("mark").over(within), "told_near": F.last("told", ignorenulls=True).over(within)}).join(sums, "block")
    last = F.coalesce("told_near", "carried")
    return at.select("seq", "kind", (F.col("before") + F.col("near")).cast("long").alias("session"), "label", last["query"].alias("last_query"), "status", "ok")


def interactions(log: DataFrame) -> DataFrame:
    """(seq, session, outcome, question) that sessions presented: declined supports and verified answers. A verified
    answer's question is its nearest earlier query, and is labelled so."""
    rows = sessions(log)
    declined = F.col("kind").isin("check_support", "check_claim") & (F.col("status") == "insufficient")
    shown = (F.col("kind") == "verify") & F.coalesce("ok", F.lit(False))
    question = F.when(declined, F.coalesce("last_query", F.lit("(question not in log)"))).otherwise(F.when(F.col("last_query").isNotNull(), F.concat(F.lit("(nearest query) "), F.col("last_query"))).otherwise("(question not in log)"))
    return rows.where(declined | shown).select("seq", "session", F.when(declined, "abstain").otherwise("answer").alias("outcome"), question.alias("question"))


def session_start_record(label: Column) -> Column:
    return F.to_json(F.struct(F.lit("session_start").alias("kind"), label.alias("label")))


def support_record(kind: str, query: Column, status: Column, supporting: Column, closest: Column, threshold: float, retrieval: str = "bm25", contract: str = "1") -> Column:
    """Payload of a support decision; supporting and closest are arrays of (span_id, score), scores to six decimals."""
    scored = lambda hits: F.transform(hits, lambda h: F.struct(h["span_id"].alias("span_id"), F.round(h["score"], 6).alias("score")))
    provenance = F.struct(F.lit(contract).alias("contract"), F.lit(retrieval).alias("retrieval"), F.lit(float(threshold)).alias("threshold"))
    return F.to_json(F.struct(F.lit(kind).alias("kind"), query.alias("query"), status.alias("status"), scored(supporting).alias("supporting"), scored(closest).alias("closest"), provenance.alias("provenance")))


def verify_record(answer: Column, ok: Column, unbound: Column, contract: str = "1") -> Column:
    """Payload of a verification: the answer as JSON text, whether it holds and what is unbound."""
    return F.to_json(F.struct(F.lit("verify").alias("kind"), answer.alias("answer"), ok.alias("ok"), unbound.alias("unbound"), F.struct(F.lit(contract).alias("contract")).alias("provenance")))


_SUPPORT = "struct<kind:string,query:string,status:string,closest:array<struct<span_id:string,score:double>>>"


def rejected_candidates(log: DataFrame) -> DataFrame:
    """(seq, query, span_id, score) of the closest spans of logged decisions (seq, payload) that were declined."""
    rows = log.select("seq", F.from_json("payload", _SUPPORT).alias("p")).where(F.col("p.kind").isin("check_support", "check_claim"))
    return rows.select("seq", "p.query", F.explode("p.closest").alias("c")).select("seq", "query", "c.span_id", "c.score")


def outcome_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("kind").agg(F.count("*").alias("n"))


def excluded_numerals(readings: DataFrame) -> DataFrame:
    """Labels whose last reading (seq, amb_id, label, reading) is 'measurement only'."""
    last = readings.groupBy("amb_id").agg(F.max_by(F.struct("label", "reading"), "seq").alias("r"))
    return last.where("r.reading = 'measurement only'").select("r.label").distinct()


def withheld(interactions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """interactions (answer_id, kind) verified again: a cited one that no longer holds becomes 'unverified'."""
    rows = interactions.join(verdicts.select("answer_id", "ok"), "answer_id", "left")
    return rows.withColumn("kind", F.when(F.col("ok"), F.col("kind")).when(F.col("kind") == "answer", "unverified").otherwise(F.col("kind"))).drop("ok")
