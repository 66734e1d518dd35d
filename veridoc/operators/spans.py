"""Documents and their spans: hashing, chunking, slices, quotes and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions.text import collapse, content_hash, strip


def make_documents(texts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, canonical_text, content_hash, char_len); lengths count code points."""
    return texts.select(texts[doc_id].cast("string").alias("doc_id"), texts[text].alias("canonical_text"), content_hash(texts[text]).alias("content_hash"), F.length(texts[text]).alias("char_len"))


def drift(docs: DataFrame) -> DataFrame:
    """Documents with `intact`: whether the text still has the hash it was stored with."""
    return docs.withColumn("intact", F.coalesce(content_hash(F.col("canonical_text")) == F.col("content_hash"), F.lit(False)))


def verified(docs: DataFrame) -> DataFrame:
    """The documents; reading one whose text changed since it was hashed raises."""
    wrong = F.raise_error(F.concat(F.lit("hash mismatch: "), F.col("doc_id")))
    good = content_hash(F.col("canonical_text")) == F.col("content_hash")
    return docs.withColumn("canonical_text", F.when(good, F.col("canonical_text")).otherwise(wrong.cast("string")))


def matches(texts: DataFrame, shape: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text", base: str | None = None) -> DataFrame:
    """(keys, n, found, rest, at) of every match of a pattern: the match, the text between it and the next one, and its
    offset, counted from the column `base`. Row 0 is the text before the first match and has no match.

    A text is split by the pattern; offsets are running sums of the lengths of the pieces of its row."""
    pieces, found = F.split(text, shape, -1), F.regexp_extract_all(text, F.lit(shape), 0)
    found = F.concat(F.array(F.lit(None).cast("string")), found)
    texts = texts.withColumn("of", F.monotonically_increasing_id())
    rows = texts.select(*keys, "of", (F.col(base) if base else F.lit(0)).alias("base"), F.posexplode(F.arrays_zip(found.alias("found"), pieces.alias("rest"))).alias("n", "m"))
    rows = rows.select(*keys, "of", "n", "base", F.col("m")["found"].alias("found"), F.col("m")["rest"].alias("rest"))
    before = Window.partitionBy("of").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.length("found"), F.lit(0)) + F.length("rest")
    return rows.withColumn("at", (F.col("base") + F.coalesce(F.sum(size).over(before), F.lit(0))).cast("int")).drop("base", "of")


#: Lines up to which a document's offsets are folded where it lies; those of longer ones are running sums.
FOLDED = 512


def match_offsets(texts: DataFrame, shape: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(keys, found, at) of every match of a pattern, without the texts between: folded where a text lies if its matches
    are few, else running sums over lengths, so no text is shuffled."""
    found, gaps = F.regexp_extract_all(text, F.lit(shape), 0), F.transform(F.split(text, shape, -1), F.length)
    # a match has a letter at least, so short texts aren't counted; exploding one row is what has the pattern run once
    short = F.length(text) <= FOLDED
    zipped = F.zip_with("p.found", F.slice("p.gaps", 1, F.size("p.found")), lambda f, g: F.struct(f.alias("found"), g.alias("gap")))
    once = lambda rows, *more: rows.select(*keys, *more, F.explode(F.array(F.struct(found.alias("found"), gaps.alias("gaps")))).alias("p"))
    state = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(zipped, state, lambda s, m: F.struct((s["end"] + m["gap"] + F.length(m["found"])).alias("end"), F.array_append(s["starts"], s["end"] + m["gap"]).alias("starts")))["starts"]
    few = once(texts.where(short | (F.size(found) <= FOLDED))).select(*keys, F.inline(F.arrays_zip(F.col("p.found").alias("found"), starts.alias("at"))))
    rows = once(texts.where(~short & (F.size(found) > FOLDED)), F.monotonically_increasing_id().alias("of")).select(*keys, "of", F.posexplode(zipped).alias("n", "m"))
    before = Window.partitionBy("of").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("m.gap") + F.length("m.found")).over(before), F.lit(0)) + F.col("m.gap")
    return few.union(rows.select(*keys, F.col("m.found").alias("found"), at.cast("int").alias("at")))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, at) of every line with its offset."""
    rows = docs.select("doc_id", F.split("canonical_text", "\n").alias("lines"))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate("lines", state, lambda s, x: F.struct((s["at"] + F.length(x) + 1).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts")))["starts"]
    folded = rows.where(F.size("lines") <= FOLDED).select("doc_id", F.inline(F.arrays_zip(F.col("lines").alias("line"), starts.alias("at"))))
    long = docs.where(F.size(F.split("canonical_text", "\n")) > FOLDED).select("doc_id", F.col("canonical_text").alias("text"))
    summed = matches(long, "\n").select("doc_id", F.col("rest").alias("line"), (F.col("at") + F.coalesce(F.length("found"), F.lit(0))).cast("int").alias("at"))
    return folded.union(summed)


def chunk(docs: DataFrame) -> DataFrame:
    """Spans (span_id, doc_id, char_start, char_end, text): one per line with a letter or digit, ends stripped."""
    rows = _lines(docs).select("doc_id", "line", "at", strip(F.col("line")).alias("text")).where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    lead = F.length(F.regexp_extract("line", r"^([\s\p{Z}]*)", 1))
    start = (F.col("at") + lead).cast("int")
    end = (start + F.length("text")).cast("int")
    return rows.select(F.concat("doc_id", F.lit("@"), start.cast("string"), F.lit("-"), end.cast("string")).alias("span_id"), "doc_id", start.alias("char_start"), end.alias("char_end"), "text")


def get_spans(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (doc_id, char_start, char_end) with status ('ok', 'out_of_range', 'unknown_doc'), text and content_hash."""
    both = requests.join(docs.select("doc_id", "canonical_text", "content_hash", "char_len"), "doc_id", "left")
    inside = (F.col("char_start") >= 0) & (F.col("char_start") <= F.col("char_end")) & (F.col("char_end") <= F.col("char_len"))
    status = F.when(F.col("canonical_text").isNull(), "unknown_doc").when(inside, "ok").otherwise("out_of_range")
    text = F.when(status == "ok", F.substring("canonical_text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))
    return both.select(*requests.columns, status.alias("status"), text.alias("text"), "content_hash")


def occurrence_count(text: Column, quote: Column) -> Column:
    """Occurrences of a literal that don't overlap."""
    gone = F.length(text) - F.length(F.replace(text, quote, F.lit("")))
    return F.when(F.length(quote) > 0, (gone / F.length(quote)).cast("int")).otherwise(F.lit(0))


def resolve_quotes(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """quotes (doc_id, quote) with n_found and, if the quote occurs exactly once, char_start and char_end."""
    both = quotes.join(docs.select("doc_id", "canonical_text"), "doc_id", "left")
    n = F.coalesce(occurrence_count(F.col("canonical_text"), F.col("quote")), F.lit(0))
    start = F.when(n == 1, F.position(F.col("quote"), F.col("canonical_text")) - 1)
    return both.select(*quotes.columns, n.alias("n_found"), start.alias("char_start"), (start + F.length("quote")).alias("char_end"))


def containing_spans(spans: DataFrame, points: DataFrame, width: int = 1024) -> DataFrame:
    """points (doc_id, pos) with the first span that holds them, or null: joined by document and block of offsets.

    A span is listed under every block it touches, so the join has equality keys and no pair is made twice.
    """
    blocks = F.explode(F.sequence(F.floor(F.col("char_start") / width), F.floor(F.greatest(F.col("char_end") - 1, F.col("char_start")) / width)))
    listed = spans.select(F.col("doc_id"), blocks.alias("block"), "span_id", "char_start", "char_end", F.col("text").alias("span_text"))
    asked = points.withColumn("block", F.floor(F.col("pos") / width))
    hit = asked.join(listed, ["doc_id", "block"], "left")
    inside = (F.col("char_start") <= F.col("pos")) & (F.col("pos") < F.col("char_end"))
    best = F.min(F.when(inside, F.struct("char_start", "char_end", "span_id", "span_text")))
    return hit.groupBy(*points.columns).agg(best.alias("s")).select(*points.columns, "s.span_id", "s.char_start", "s.char_end", "s.span_text")


def elsewhere(docs: DataFrame, literals: DataFrame) -> DataFrame:
    """literals (doc_id, literal) with the first offset of each anywhere in its document, or null."""
    both = literals.join(docs.select("doc_id", "canonical_text"), "doc_id", "left")
    at = F.position(F.col("literal"), F.col("canonical_text"))
    return both.select(*literals.columns, F.when(at > 0, at - 1).alias("first_pos"))


def excerpt(text: Column, start: Column, end: Column, around: int = 60) -> Column:
    """The text about a range, white space collapsed, with ellipses where it was cut."""
    lo = F.greatest(start - around, F.lit(0))
    hi = F.least(end + around, F.length(text))
    body = collapse(F.substring(text, lo + 1, hi - lo))
    return F.concat(F.when(lo > 0, "…").otherwise(""), body, F.when(hi < F.length(text), "…").otherwise(""))
