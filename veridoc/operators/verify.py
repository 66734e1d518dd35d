"""Verification of answers: atoms against their spans, derivations recomputed, figures that nothing covers.

Answers are rows (answer_id, sentences array<struct<text, atoms array<atom>, derived array<struct<text, operation,
operands array<atom>>>>>) with atom = struct<text, doc_id, char_start, char_end, content_hash>.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.functions.text import collapse, decimals, python_round, salient_tokens, strip, to_date, to_number

ATOM = "struct<text:string,doc_id:string,char_start:int,char_end:int,content_hash:string>"
ANSWER = f"array<struct<text:string,atoms:array<{ATOM}>,derived:array<struct<text:string,operation:string,operands:array<{ATOM}>>>>>"
OPERATIONS = ("subtract", "sum", "multiply", "divide", "ratio", "percent_change", "percent", "min", "max", "average", "count", "round")
RELATIONS = ("gt", "ge", "lt", "le", "eq", "within_range")


def resolve_atoms(atoms: DataFrame, docs: DataFrame) -> DataFrame:
    """Atoms with status and found: unhashed, stale_hash, out_of_range, ok or mismatch, tested in that order.

    An atom with a hash whose document isn't there gets unknown_doc; reading its verdict through `checked` raises.
    """
    both = atoms.join(docs.select("doc_id", "canonical_text", F.col("content_hash").alias("now"), "char_len"), "doc_id", "left")
    start, end = F.col("char_start"), F.col("char_end")
    inside = (start >= 0) & (start <= end) & (end <= F.col("char_len"))
    found = F.substring("canonical_text", start + 1, end - start)
    same = collapse(found) == collapse(F.col("text"))
    status = F.when(F.col("content_hash").isNull(), "unhashed").when(F.col("now").isNull(), "unknown_doc").when(F.col("content_hash") != F.col("now"), "stale_hash")
    status = status.when(~F.coalesce(inside, F.lit(False)), "out_of_range").when(same, "ok").otherwise("mismatch")
    return both.select(*atoms.columns, status.alias("status"), F.when(status.isin("ok", "mismatch"), found).alias("found"))


def checked(verdicts: DataFrame) -> DataFrame:
    """The verdicts; an unknown document raises."""
    wrong = F.raise_error(F.concat(F.lit("unknown document: "), F.col("doc_id"))).cast("string")
    return verdicts.withColumn("status", F.when(F.col("status") == "unknown_doc", wrong).otherwise(F.col("status")))


def _at(values: Column, i: int) -> Column:
    return F.get(values, F.lit(i))


def recompute(operation: Column, values: Column) -> Column:
    """Result of a numeric operation over an array of doubles; null where it isn't defined."""
    x, y = _at(values, 0), _at(values, 1)
    total = F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    n = F.size(values)
    rules = {
        "subtract": F.when(n > 0, x - (total - x)), "sum": total, "multiply": F.aggregate(values, F.lit(1.0), lambda a, b: a * b), "divide": F.try_divide(x, y), "ratio": F.try_divide(x, y),
        "percent_change": F.try_divide(x - y, y) * 100, "percent": F.try_divide(x, y) * 100, "min": F.array_min(values), "max": F.array_max(values),
        "average": F.try_divide(total, n.cast("double")), "count": n.cast("double"), "round": x,
    }
    return reduce(lambda acc, kv: acc.when(operation == kv[0], kv[1]), rules.items(), F.when(F.lit(False), F.lit(None).cast("double")))


def relation(operation: Column, values: Column) -> Column:
    x, y, z = (_at(values, i) for i in range(3))
    rules = {"gt": x > y, "ge": x >= y, "lt": x < y, "le": x <= y, "eq": x == y, "within_range": (y <= x) & (x <= z)}
    return reduce(lambda acc, kv: acc.when(operation == kv[0], kv[1]), rules.items(), F.when(F.lit(False), F.lit(None).cast("boolean")))


def asserted_truth(text: Column) -> Column:
    t = F.lower(strip(text))
    return F.when(t.isin("true", "yes"), True).when(t.isin("false", "no"), False)


def derivation_holds(operation: Column, text: Column, operands: Column) -> Column:
    """Whether a derived value, as written in text, follows from the texts of its operands; False if it can't be told."""
    numbers = F.transform(operands, to_number)
    usable = ~F.exists(numbers, lambda x: x.isNull())
    wanted = to_number(text)
    numeric = usable & (F.abs(python_round(recompute(operation, numbers), decimals(text)) - wanted) < 1e-9)
    related = usable & (relation(operation, numbers) == asserted_truth(text))
    dates = F.transform(operands, to_date)
    dated = F.abs(F.date_diff(_at(dates, 0), _at(dates, 1)) - wanted) < 1e-9
    dated = dated & ~F.exists(dates, lambda d: d.isNull())
    return F.coalesce(F.when(operation == "date_delta", dated).when(operation.isin(*OPERATIONS), numeric).when(operation.isin(*RELATIONS), related), F.lit(False))


def equation(operation: Column, text: Column, operands: Column) -> Column:
    """The derivation written out."""
    signs = {"subtract": " − ", "sum": " + ", "multiply": " × ", "divide": " ÷ ", "ratio": " ÷ ", "gt": " > ", "ge": " ≥ ", "lt": " < ", "le": " ≤ ", "eq": " = "}
    infix = reduce(lambda acc, kv: acc.when(operation == kv[0], F.array_join(operands, kv[1])), signs.items(), F.when(F.lit(False), F.lit(None).cast("string")))
    call = F.concat(operation, F.lit("("), F.array_join(operands, ", "), F.lit(")"))
    return F.concat(F.coalesce(infix, call), F.when(operation.isin(*RELATIONS), F.lit(" → ")).otherwise(F.lit(" = ")), text)


def unbound(sentence: Column, covered: Column) -> Column:
    """Figures and dates of a sentence beyond those covered, as a multiset difference, sorted."""
    asked = salient_tokens(sentence)
    have = F.flatten(F.transform(covered, salient_tokens))
    extra = F.transform(F.array_distinct(asked), lambda t: F.array_repeat(t, F.greatest(F.size(F.filter(asked, lambda x: x == t)) - F.size(F.filter(have, lambda x: x == t)), F.lit(0))))
    return F.sort_array(F.flatten(extra))


def verify(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """(answer_id, ok, unbound, sentences): an answer holds if all atoms and derivations do and nothing is unbound.

    One shuffle of the atoms to their documents and one back to their sentences; an answer without sentences holds.
    """
    sents = answers.select("answer_id", F.posexplode("sentences").alias("s", "sent"))
    empty = F.array().cast(f"array<{ATOM}>")
    own = F.transform(F.coalesce("sent.atoms", empty), lambda a, i: F.struct(F.lit(-1).alias("d"), i.alias("i"), a.alias("a")))
    derived = F.coalesce(F.col("sent.derived"), F.array().cast(f"array<struct<text:string,operation:string,operands:array<{ATOM}>>>"))
    operands = F.flatten(F.transform(derived, lambda x, d: F.transform(F.coalesce(x["operands"], empty), lambda o, i: F.struct(d.alias("d"), i.alias("i"), o.alias("a")))))
    atoms = sents.select("answer_id", "s", F.explode(F.concat(own, operands)).alias("x")).select("answer_id", "s", "x.d", "x.i", "x.a.*")
    verdicts = checked(resolve_atoms(atoms, docs))
    by = verdicts.groupBy("answer_id", "s").agg(F.sort_array(F.collect_list(F.struct("d", "i", "status", "text"))).alias("v"))
    rows = sents.join(by, ["answer_id", "s"], "left").withColumn("v", F.coalesce("v", F.array().cast("array<struct<d:int,i:int,status:string,text:string>>")))
    statuses = F.transform(F.filter("v", lambda x: x["d"] == -1), lambda x: x["status"])

    def holds(x: Column, d: Column) -> Column:
        good = F.forall(F.filter(F.col("v"), lambda v: v["d"] == d), lambda v: v["status"] == "ok")
        texts = F.transform(F.coalesce(x["operands"], empty), lambda o: o["text"])
        return good & derivation_holds(x["operation"], x["text"], texts)

    rows = rows.withColumns({"statuses": statuses, "derived_ok": F.transform(derived, holds)})
    covered = F.concat(F.transform("v", lambda x: x["text"]), F.transform(derived, lambda x: x["text"]))
    rows = rows.withColumn("unbound", unbound(F.col("sent.text"), covered))
    ok = F.forall("statuses", lambda x: x == "ok") & F.forall("derived_ok", lambda x: x) & (F.size("unbound") == 0)
    per = rows.select("answer_id", F.struct("s", F.col("sent.text").alias("text"), ok.alias("ok"), "statuses", "derived_ok", "unbound").alias("r"))
    whole = per.groupBy("answer_id").agg(F.sort_array(F.collect_list("r")).alias("sentences"))
    out = answers.select("answer_id").join(whole, "answer_id", "left")
    lost = F.flatten(F.transform("sentences", lambda r: r["unbound"]))
    return out.select("answer_id", F.coalesce(F.forall("sentences", lambda r: r["ok"]), F.lit(True)).alias("ok"), F.coalesce(lost, F.array().cast("array<string>")).alias("unbound"), "sentences")


def answers_from_json(rows: DataFrame, column: str = "answer") -> DataFrame:
    """Answers of a JSON column, with sentences as verify() takes them."""
    return rows.withColumn("sentences", F.from_json(column, f"struct<sentences:{ANSWER}>")["sentences"])


def results_to_json(results: DataFrame) -> DataFrame:
    return results.withColumn("result", F.to_json(F.struct("ok", "unbound", "sentences")))
