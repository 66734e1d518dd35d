"""Scores of runs against golden items: outcomes, evidence, calibration of confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Outcomes of behaviours, and those that present an answer.
OUTCOMES = {"reject-false-premise": "correction", "partial-abstain": "partial", "refuse-to-adjudicate": "refuse"}
PRESENTS = ("answer", "correction", "partial")


def expected_outcome(answerable: Column, behavior: Column) -> Column:
    out = F.when(answerable, "answer")
    for k, v in OUTCOMES.items():
        out = out.when(behavior == k, v)
    return out.otherwise("abstain")


def overlaps(cited: DataFrame, gold: DataFrame, width: int = 1024) -> DataFrame:
    """Items (item_id) with a cited range (item_id, doc_id, char_start, char_end) that meets a gold one of the document."""
    blocks = lambda: F.explode(F.sequence(F.floor(F.col("char_start") / width), F.floor(F.greatest(F.col("char_end") - 1, F.col("char_start")) / width)))
    g = gold.select("item_id", "doc_id", blocks().alias("b"), F.col("char_start").alias("gs"), F.col("char_end").alias("ge"))
    hit = cited.withColumn("b", blocks()).join(g, ["item_id", "doc_id", "b"]).where("char_start < ge and gs < char_end")
    return hit.select("item_id").distinct()


def score_items(items: DataFrame, runs: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Per item (item_id, answerable, behavior): expected, presented, decision_correct, verify_failures and
    evidence_correct. runs: item_id, ok of every verification. evidence: item_id, correct of scoreable items."""
    per = runs.groupBy("item_id").agg(F.bool_or("ok").alias("presented"), F.count_if(~F.col("ok")).alias("fails"))
    rows = items.join(per, "item_id", "left").withColumn("expected", expected_outcome(F.col("answerable"), F.col("behavior")))
    rows = rows.withColumn("presented", F.coalesce("presented", F.lit(False)))
    rows = rows.join(evidence.select("item_id", "correct"), "item_id", "left") if evidence is not None else rows.withColumn("correct", F.lit(None).cast("boolean"))
    presents = F.col("expected").isin(*PRESENTS)
    return rows.select("item_id", "expected", "presented", (F.col("presented") == presents).alias("decision_correct"), F.coalesce("fails", F.lit(0)).cast("long").alias("verify_failures"), F.when(presents & F.col("presented"), F.col("correct")).alias("evidence_correct"))


def aggregate(scores: DataFrame) -> DataFrame:
    """One row of counts per class and rates; a rate over nothing is null."""
    def rate(good: Column, where: Column) -> Column:
        return F.round(F.avg(F.when(where, good.cast("double"))), 4)

    of = lambda c: F.col("expected") == c
    known = F.col("evidence_correct").isNotNull()
    evidence, decided = rate(F.col("evidence_correct"), known), rate(F.col("decision_correct"), known)
    return scores.agg(
        F.count("*").alias("n"), *[F.count_if(of(c)).alias(f"n_{c}") for c in ("answer", "abstain", "correction", "partial", "refuse")],
        rate(F.col("decision_correct"), F.lit(True)).alias("decision_accuracy"), rate(F.col("presented"), of("answer")).alias("answer_rate"),
        rate(~F.col("presented"), of("abstain")).alias("abstention_accuracy"), rate(F.col("presented"), of("correction")).alias("correction_rate"),
        rate(F.col("presented"), of("partial")).alias("partial_rate"), rate(~F.col("presented"), of("refuse")).alias("refusal_accuracy"),
        F.sum("verify_failures").alias("verify_catches"), F.count_if(~F.col("decision_correct")).alias("n_failures"),
        evidence.alias("evidence_accuracy"), F.round(decided - evidence, 4).alias("decision_minus_evidence"),
    )


def brier(pairs: DataFrame) -> DataFrame:
    """One row `brier` of (confidence, ok): mean squared error, null over nothing."""
    return pairs.agg(F.round(F.avg(F.pow(F.col("confidence") - F.col("ok").cast("double"), 2)), 4).alias("brier"))


def reliability(pairs: DataFrame, bins: int = 5) -> DataFrame:
    """Per filled confidence bucket: n, mean_confidence and accuracy; the last bucket includes 1, others are left out."""
    inside = pairs.where((F.col("confidence") >= 0) & (F.col("confidence") <= 1))
    bucket = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    rows = inside.withColumn("b", bucket).groupBy("b").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.round(F.avg(F.col("ok").cast("double")), 4).alias("accuracy"))
    return rows.select(F.format_string("%.1f-%.1f", F.col("b") / bins, (F.col("b") + 1) / bins).alias("bucket"), "n", "mean_confidence", "accuracy")


def parse_verdict(reply: Column) -> Column:
    """Whether the first line of a reply says yes."""
    return F.upper(F.btrim(F.get(F.split(F.btrim(reply), "\n"), F.lit(0)))).startswith("YES")


def parse_confidence(reply: Column) -> Column:
    return F.regexp_extract(reply, r"(?i)confidence\s*[:=]\s*([01](?:\.[0-9]+)?)", 1).try_cast("double")


def item_rates(scored: DataFrame) -> DataFrame:
    """One row of precision, recall and the shares of declined and made-up answers (answerable, answered, correct)."""
    answered, right = F.col("answered"), F.col("correct")
    return scored.agg(
        F.round(F.try_divide(F.count_if(answered & right), F.count_if(answered)), 4).alias("precision"),
        F.round(F.try_divide(F.count_if(answered & right), F.count_if("answerable")), 4).alias("recall"),
        F.round(F.try_divide(F.count_if(answered & ~right), F.count_if(answered)), 4).alias("hallucination"),
        F.round(F.try_divide(F.count_if(~F.col("answerable") & ~answered), F.count_if(~F.col("answerable"))), 4).alias("abstention_accuracy"),
    )


def failures(scores: DataFrame) -> DataFrame:
    """(rank, item_id, expected) of wrong decisions, in order of the items."""
    wrong = scores.where(~F.col("decision_correct")).select("item_id", "expected")
    # one short list: the failures of a golden set
    return wrong.withColumn("rank", F.row_number().over(Window.orderBy("item_id"))).select("rank", "item_id", "expected")


def gold_spans(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(item_id, doc_id, char_start, char_end) of gold quotes (item_id, doc_id, quote) that occur just once."""
    from veridoc.operators.spans import resolve_quotes

    return resolve_quotes(docs, quotes.select("item_id", "doc_id", "quote")).where("n_found = 1").select("item_id", "doc_id", "char_start", "char_end")


def cited_spans(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(answer_id, s, doc_id, char_start, char_end) of atoms and operands of answers that were verified."""
    from veridoc.operators.frames import cited_atoms

    return cited_atoms(answers).join(verdicts.where("ok").select("answer_id").distinct(), "answer_id", "left_semi").select("answer_id", "s", "doc_id", "char_start", "char_end")


def claims_and_spans(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """(answer_id, s, claim, cited): each sentence with the texts it cites, in order."""
    from veridoc.operators.frames import cited_atoms
    from veridoc.operators.spans import get_spans

    atoms = cited_atoms(answers)
    texts = get_spans(docs, atoms.select("doc_id", "char_start", "char_end").distinct()).where("status = 'ok'").select("doc_id", "char_start", "char_end", "text")
    per = atoms.join(texts, ["doc_id", "char_start", "char_end"]).groupBy("answer_id", "s").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"))
    sents = answers.select("answer_id", F.posexplode("sentences").alias("s", "sent")).select("answer_id", "s", F.col("sent.text").alias("claim"))
    return sents.join(per, ["answer_id", "s"], "left").select("answer_id", "s", "claim", F.coalesce(F.transform("t", lambda x: x["text"]), F.array().cast("array<string>")).alias("cited"))


def evidence_strings(value_seen: Column, expected: Column) -> Column:
    """What documents must hold to bear an answer out: the amounts seen, sorted, else the answer without its period."""
    amounts = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(value_seen, F.lit("")), F.lit(r"([0-9]{1,3}(?:,[0-9]{3})+)"), 1)))
    plain = F.regexp_replace(F.btrim(F.coalesce(expected, F.lit(""))), r"\.+$", "")
    return F.when(F.size(amounts) > 0, amounts).when(plain != "", F.array(plain)).otherwise(F.array().cast("array<string>"))


def manifest_hash(items: DataFrame) -> DataFrame:
    """One row `manifest_sha256`: SHA-256 of the lines of canonical JSON (item_id, canonical) in order of the ids."""
    from veridoc.operators.support import streamed_hash

    return streamed_hash(items.select(F.col("item_id").alias("k"), F.col("canonical").alias("line")), "manifest_sha256")
