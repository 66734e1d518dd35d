"""Patent texts as rows: claims, limitations, paragraphs, front matter, figure references and label classes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions.nounphrase import DIGITS
from veridoc.operators.spans import matches

# Markers and shapes of a patent's parts.
CLAIMS_MARKER = r"(?im)^\s*(?:what is claimed is|we claim|i claim|the invention claimed is|claims)\s*:?\s*$"
CLAIM_START = r"(?m)^[ \t]*(\d+)\.\s"
DEPENDS = r"(?i)\bclaims?\s+(\d+)"
TRANSITION = r"(?i)\b(comprising|comprises|consisting essentially of|consisting of|including|wherein|characterized in that|having|the steps of)\b"
PARAGRAPH = r"\[(\d{3,4})\]"
SPEC_START = r"(?im)^\s*(detailed description|description|field of the invention|background)\b.*$"
FIGURE_REF = r"(?i)FIGS?\.?\s*(\d+)\s?([A-Z])\s*[-–]\s*([A-Z])\b|FIGS?\.?\s*(\d+[A-Z]?)(?:\s*[-–]\s*(\d+[A-Z]?))?"
NOT_A_LABEL = ("FIG", "FIGS", "US", "NO", "PCT", "CIP", "CFM", "RPM", "PSI", "GPM")
AIA_DAY = "2013-03-16"


CAPTION = r"(?i)FIGS?\.?\s*(\d+\s*[A-Z]?)(?:\s*[-–]\s*\d*\s*[A-Z]?)?\s+(?:is|are|shows?|depicts?|illustrates?|comprises?|represents?)\b"
CAPTION_GAP = 400


def _rtrim(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s\p{Z}]+$", "")


def _parts(docs: DataFrame) -> DataFrame:
    """doc_id, text, the description before the claims marker, the claims after it (or the whole text) and their offset."""
    cut = F.split("canonical_text", CLAIMS_MARKER, 2)
    rows = docs.where("canonical_text is not null").select("doc_id", F.col("canonical_text").alias("text"), cut.alias("cut"))
    region = F.coalesce(F.get("cut", F.lit(1)), F.col("text"))
    return rows.select("doc_id", "text", F.get("cut", F.lit(0)).alias("spec"), region.alias("claims"), (F.length("text") - F.length(region)).alias("base"))


def parse_claims(docs: DataFrame) -> DataFrame:
    """Numbered claims after the claims marker (or in the whole text) with offsets and the first claim each names."""
    rows = matches(_parts(docs), CLAIM_START, text="claims", base="base").where("found is not null")
    number = F.regexp_extract("found", r"(\d+)", 1)
    lead = F.length(F.regexp_extract("found", r"^(\D*)", 1))
    body = _rtrim(F.concat(F.expr("substring(found, 1 + length(regexp_extract(found, '^([^0-9]*)', 1)))"), F.col("rest")))
    named = F.regexp_extract(body, DEPENDS, 1)
    start = (F.col("at") + lead).cast("int")
    return rows.select("doc_id", number.cast("int").alias("number"), body.alias("text"), start.alias("char_start"), (start + F.length(body)).cast("int").alias("char_end"), F.when(named != "", named.cast("int")).alias("depends_on"))


def decompose_claims(docs: DataFrame) -> DataFrame:
    """Limitations of claims: pieces between semicolons after the transition, trimmed, leading and/or dropped."""
    claims = parse_claims(docs)
    opening = F.regexp_substr("text", F.lit(TRANSITION))
    at = F.when(opening.isNotNull(), F.regexp_instr("text", F.lit(TRANSITION)) - 1 + F.length(opening)).otherwise(F.length(F.regexp_extract("text", r"^(\s*\d+\.)", 1)))
    tail = claims.select("doc_id", "number", F.col("char_start").alias("claim_start"), (F.col("char_start") + at).cast("int").alias("base"), F.expr("text").substr(at + 1, F.length("text")).alias("text"))
    rows = matches(tail, ";", ("doc_id", "number", "claim_start"), base="base")
    lead = F.length(F.regexp_extract("rest", r"^[\s:]*(?i:(?:and|or)\b\s*)?", 0))
    kept = F.regexp_replace(F.col("rest").substr(lead + 1, F.length("rest")), r"[ \n\t.,;]+$", "")
    start = (F.col("at") + F.coalesce(F.length("found"), F.lit(0)) + lead).cast("int")
    rows = rows.select("doc_id", "number", "claim_start", kept.alias("text"), start.alias("char_start")).where("text <> ''")
    order = Window.partitionBy("doc_id", "number", "claim_start").orderBy("char_start")
    return rows.select("doc_id", "number", (F.row_number().over(order) - 1).alias("index"), "text", "char_start", (F.col("char_start") + F.length("text")).cast("int").alias("char_end"))


def parse_paragraphs(docs: DataFrame) -> DataFrame:
    """Numbered paragraphs of the description, or its lines after a heading if it has no numbers."""
    parts = _parts(docs).select("doc_id", F.col("spec").alias("text"))
    marked = matches(parts.where(F.col("text").rlike(PARAGRAPH)), PARAGRAPH).where("found is not null")
    marked = marked.select("doc_id", F.col("found").alias("label"), (F.col("n") - 1).cast("int").alias("index"), _rtrim(F.concat("found", "rest")).alias("text"), F.col("at").alias("char_start"))
    heading = F.split("text", SPEC_START, 2)
    plain = parts.where(~F.col("text").rlike(PARAGRAPH)).withColumn("body", F.coalesce(F.get(heading, F.lit(1)), F.col("text")))
    lines = matches(plain.withColumn("base", F.length("text") - F.length("body")), "\n", text="body", base="base").where("rest <> ''")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    lines = lines.select("doc_id", F.concat(F.lit("¶"), nth.cast("string")).alias("label"), (nth - 1).alias("index"), F.col("rest").alias("text"), (F.col("at") + F.coalesce(F.length("found"), F.lit(0))).cast("int").alias("char_start"))
    return marked.union(lines).withColumn("char_end", (F.col("char_start") + F.length("text")).cast("int"))


def figure_references(docs: DataFrame) -> DataFrame:
    """Figures referred to; letter ranges are spelled out, number ranges give their ends."""
    rows = matches(docs.select("doc_id", F.col("canonical_text").alias("text")), FIGURE_REF).where("found is not null")
    g = [F.regexp_extract("found", FIGURE_REF, i) for i in range(6)]
    first, last = F.ascii(F.upper(g[2])), F.ascii(F.upper(g[3]))
    letters = F.when(first <= last, F.transform(F.sequence(first, last), lambda c: F.concat(g[1], F.chr(c)))).otherwise(F.array().cast("array<string>"))
    ends = F.filter(F.array(g[4], g[5]), lambda x: x != "")
    return rows.select("doc_id", F.explode(F.when(g[1] != "", letters).otherwise(ends)).alias("fig"), F.col("at").alias("char_start"), (F.col("at") + F.length("found")).cast("int").alias("char_end"))


def parse_figures(docs: DataFrame) -> DataFrame:
    """Figures with their captions: the first run of captions without wide gaps, each up to the next or to a period;
    figures with a letter that are only referred to share their number's caption."""
    texts = docs.select("doc_id", F.col("canonical_text").alias("text"))
    rows = matches(texts, CAPTION).where("found is not null").withColumn("end", F.col("at") + F.length("found"))
    order = Window.partitionBy("doc_id").orderBy("at")
    fresh = F.coalesce(F.col("at") > F.lag("end").over(order) + CAPTION_GAP, F.lit(False)).cast("int")
    rows = rows.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order)).where("run = 0")
    fig = F.regexp_replace(F.regexp_extract("found", CAPTION, 1), r"\s+", "")
    rows = rows.select("doc_id", fig.alias("fig"), "at", "end", F.lead("at").over(order).alias("next"))
    listed = rows.groupBy("doc_id").agg(F.collect_list(F.struct("fig", "at", "end", "next")).alias("c")).join(texts, "doc_id")
    rows = listed.select("doc_id", "text", F.explode("c").alias("c")).select("doc_id", "c.*", "text")
    stop = F.position(F.lit("."), F.col("text"), F.col("end") + 1)
    until = F.coalesce("next", F.when(stop > 0, stop).otherwise(F.length("text")))
    caption = F.regexp_replace(F.col("text").substr(F.col("at") + 1, until - F.col("at")), r"[ ;\n\t]+$", "")
    named = rows.select("doc_id", "fig", caption.alias("caption"), F.col("at").cast("int").alias("char_start"))
    named = named.withColumn("char_end", (F.col("char_start") + F.length("caption")).cast("int"))
    stems = named.groupBy("doc_id", F.regexp_extract("fig", r"^(\d+)", 1).alias("stem")).agg(F.min_by("caption", "char_start").alias("caption"))
    lettered = figure_references(docs).where(F.col("fig").rlike("[A-Za-z]$")).withColumn("key", F.upper("fig"))
    first = lettered.groupBy("doc_id", "key").agg(F.min(F.struct("char_start", "char_end", "fig")).alias("m")).select("doc_id", "key", "m.*")
    lost = first.join(named.select("doc_id", F.upper("fig").alias("key")).distinct(), ["doc_id", "key"], "left_anti").withColumn("stem", F.regexp_extract("fig", r"^(\d+)", 1))
    shared = lost.join(stems, ["doc_id", "stem"], "left").select("doc_id", "fig", F.coalesce("caption", F.lit("")).alias("caption"), "char_start", "char_end")
    return named.unionByName(shared)


def dependency_issues(claims: DataFrame) -> DataFrame:
    """(doc_id, number, issue) of claims that depend on a claim that is missing, itself or later."""
    known = claims.select("doc_id", F.col("number").alias("depends_on"), F.lit(True).alias("known")).distinct()
    rows = claims.where("depends_on is not null").join(known, ["doc_id", "depends_on"], "left")
    issue = F.when(F.col("known").isNull(), "missing").when(F.col("depends_on") == F.col("number"), "itself").when(F.col("depends_on") > F.col("number"), "later")
    return rows.select("doc_id", "number", issue.alias("issue")).where("issue is not null")


def _spec(text: Column) -> Column:
    return F.get(F.split(text, CLAIMS_MARKER, 2), F.lit(0))


def dimension_labels(docs: DataFrame) -> DataFrame:
    """Distinct labels such as D1 before the claims."""
    return docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(_spec(F.col("canonical_text")), F.lit(r"\b([A-Z][0-9]{1,2})\b"), 1))).alias("label"))


def acronym_labels(docs: DataFrame) -> DataFrame:
    """Distinct capital words of two to five letters before the claims, figure and unit words left out: candidates."""
    found = F.array_distinct(F.regexp_extract_all(_spec(F.col("canonical_text")), F.lit(r"\b([A-Z]{2,5})\b"), 1))
    return docs.select("doc_id", F.explode(F.array_except(found, F.array(*[F.lit(x) for x in NOT_A_LABEL]))).alias("label"))


def regime(filed: Column, priorities: Column) -> Column:
    """Earliest of the filing and priority dates and the regime it falls under; a comparison of dates, no more."""
    first = F.array_min(F.concat(F.array(filed), F.coalesce(priorities, F.array().cast("array<date>"))))
    return F.when(first.isNotNull(), F.struct(first.alias("effective"), F.when(first < F.lit(AIA_DAY).cast("date"), "pre-AIA").otherwise("AIA").alias("regime")))


def support_map(docs: DataFrame, k: int = 5) -> DataFrame:
    """Paragraphs that bear out each limitation, ranked within their document; a limitation without any keeps one row
    with nulls, a gap to look into."""
    from veridoc.operators.retrieval import build_index, search

    limits = decompose_claims(docs).withColumn("query_id", F.concat_ws("|", "doc_id", "number", "index"))
    paragraphs = parse_paragraphs(docs).withColumn("span_id", F.concat_ws("|", "doc_id", "label"))
    hits = search(build_index(paragraphs, scope="doc_id"), limits.select("query_id", F.col("text").alias("query"), "doc_id"), k, scope="doc_id")
    return limits.select("query_id", "doc_id", "number", "index").join(hits, "query_id", "left").select("doc_id", "number", "index", "rank", "span_id", "score")


def numeral_mentions(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Every label of a part recited before the claims, with the element it names: one scan of each text with a state,
    in Arrow batches where the texts lie. A label's number has at most so many digits."""
    schema = "doc_id string, label string, element string, char_start int, char_end int"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from veridoc.functions.nounphrase import mentions

        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in mentions(t.as_py() or "", digits)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "label", "element", "char_start", "char_end"])

    return docs.select("doc_id", _spec(F.col("canonical_text")).alias("spec")).mapInArrow(run, schema)


def reference_numerals(mentioned: DataFrame) -> DataFrame:
    """The first mention of each label."""
    first = F.min(F.struct("char_start", "char_end", "element"))
    return mentioned.groupBy("doc_id", "label").agg(first.alias("m")).select("doc_id", "label", "m.element", "m.char_start", "m.char_end")


# Numbered fields of a first page.
INID = {"patent_number": r"(?m)\[11\]\s*(?:Patent Number:?)?\s*([\d,]+)", "date_of_patent": r"(?m)\[45\]\s*(?:Date of Patent:?)?\s*(.+)$", "application_number": r"(?m)\[21\]\s*(?:Appl\. No\.:?)?\s*([\d/,]+)", "filed": r"(?m)\[22\]\s*(?:Filed:?)?\s*(.+)$"}


def front_matter(docs: DataFrame, lines: int = 40) -> DataFrame:
    """Numbered fields of the first page, as written; null where a field isn't there."""
    head = F.array_join(F.slice(F.split("canonical_text", "\n"), 1, lines), "\n")
    found = {k: F.regexp_extract(head, shape, 1) for k, shape in INID.items()}
    return docs.select("doc_id", *[F.when(v != "", F.btrim(v)).alias(k) for k, v in found.items()])


def antecedent_census(docs: DataFrame) -> DataFrame:
    """(doc_id, number, phrase) of back-references ('the' or 'said' and a name) that neither their claim nor one it
    depends on introduces ('a' or 'an' and the name) before."""
    from veridoc.operators.frames import ancestors

    claims = parse_claims(docs)
    shape = r"(?i)\b(the|said|an?)\s+([a-z]+(?:\s+[a-z]+){0,2}?)(?=\s+(?:of|is|are|and|or|to|for|in|on|wherein|having|comprising|that|which)\b|[,;.:]|$)"
    found = matches(claims.select("doc_id", "number", "text"), shape, ("doc_id", "number")).where("found is not null")
    word, name = F.lower(F.regexp_extract("found", shape, 1)), F.lower(F.regexp_replace(F.regexp_extract("found", shape, 2), r"\s+", " "))
    found = found.select("doc_id", "number", F.col("at"), word.alias("word"), name.alias("phrase"))
    new = found.where(F.col("word").isin("a", "an")).select("doc_id", F.col("number").cast("string").alias("ancestor"), "phrase", F.col("at").alias("new_at"))
    units = claims.select("doc_id", F.col("number").cast("string").alias("name"), F.col("depends_on").cast("string").alias("parent"), "char_start", "char_end")
    chains = ancestors(units).select("doc_id", F.col("name").cast("int").alias("number"), "ancestor")
    back = found.where(F.col("word").isin("the", "said")).select("doc_id", "number", "at", "phrase")
    known = back.join(chains, ["doc_id", "number"]).join(new, ["doc_id", "ancestor", "phrase"]).where((F.col("ancestor") != F.col("number").cast("string")) | (F.col("new_at") < F.col("at")))
    return back.join(known.select("doc_id", "number", "at"), ["doc_id", "number", "at"], "left_anti").select("doc_id", "number", "phrase").distinct()


def quantity_uses(docs: DataFrame, mentioned: DataFrame) -> DataFrame:
    """(doc_id, label, n_quantities): recited labels that the text also uses as a quantity, before a unit: two senses."""
    shape = r"(?i)\b\d{1,4}(?=\s*(?:watts?|mm|cm|inch(?:es)?|ft|kg|lbs?|degrees?|percent|hours?|minutes?|seconds?|volts?|gallons?)\b)"
    used = matches(docs.select("doc_id", F.col("canonical_text").alias("text")), shape).where("found is not null").groupBy("doc_id", F.col("found").alias("label")).agg(F.count("*").alias("n_quantities"))
    return used.join(mentioned.select("doc_id", "label").distinct(), ["doc_id", "label"], "left_semi")
