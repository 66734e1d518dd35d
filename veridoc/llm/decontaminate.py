"""Benchmark decontamination by spaced-seed hashing (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import LAST_ID, col, field, join_spread, materialize, row_of, tidied

#: Fixed masks over token positions, 1 is compared, 0 may hold any token; and the least and largest width of items (at
#: most WINDOW) that take them. Of every width, wherever a fifth of the tokens is substituted, one mask fits somewhere.
MASKS = (("1", 1, 1), ("11", 2, 2), ("111", 3, 3), ("1111", 4, 9), ("11101", 5, 5), ("10111", 5, 5), ("11011", 5, 7), ("11010011", 10, 14), ("111011", 10, 20), ("11111", 10, 20))
#: Seed rows up to which the benchmark side is broadcast, and tokens of its items, which are told once each.
BROADCAST_SEEDS = 500_000
BROADCAST_TOKENS = 2_000_000
#: Contaminated rows up to which their keys, two longs each, are sent to the documents.
BROADCAST_HITS = 250_000
WINDOW = 20
SHARE = 0.8


def token_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits of a text; none for a null text."""
    plain = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(plain, " "), lambda w: F.xxhash64(w)))


def _seed_keys(hashes: str, at: str, masks: list[tuple[str, int, int]], width: Column | None = None) -> Column:
    """One key per mask for the tokens under its ones, from position `at` on; null tokens lie past the end.

    With a width given, masks that don't belong to it have no key.
    """
    keys = []
    for mask, lo, hi in masks:
        ones = [F.get(hashes, F.col(at) + i) for i, bit in enumerate(mask) if bit == "1"]
        fits = F.col(at) + len(mask) <= F.size(hashes)
        keys.append(F.when(fits if width is None else fits & width.between(lo, hi), F.xxhash64(F.lit(mask), *ones)))
    return F.array(*keys)


def _overlap(hashes: str, diagonal: str, item: str, window: int) -> Column:
    """Largest share of equal tokens in a window of an item laid along a document's tokens at a diagonal."""
    size = F.size(item)
    same = F.transform(F.col(item), lambda x, j: F.when(F.get(hashes, F.col(diagonal) + j) == x, 1).otherwise(0))
    width = F.least(F.lit(window), size)
    sums = F.transform(F.sequence(F.lit(1), size - width + 1), lambda s: F.aggregate(F.slice(same, s, width), F.lit(0), lambda a, b: a + b))
    return F.array_max(sums) / width


@tidied
def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", masks: tuple[tuple[str, int, int], ...] = MASKS, window: int = WINDOW, share: float = SHARE, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, overlap (largest share found, 0 without a hit), item_ids (sorted) and contaminated.

    Every token position of a document and of every item is hashed under every mask; equal keys place the item along
    the document, and there the largest share of equal tokens in a window of `window` tokens (the whole item if it is
    shorter) is measured. From `share` on the document is contaminated by the item. A key ignores the tokens under its
    zeros, and the masks leave no place for substituted words that hides a passage of 80 % equal tokens. The seeds of the benchmark are counted first: up to
    broadcast_seeds of them are broadcast and hits are checked where the document lies; beyond, keys are joined by a
    shuffle and hits meet their document again.

    Null and blank texts have no tokens and no overlap, as documents and as items. Items of fewer than five tokens
    match exact copies only, so an item of one common word contaminates every document with it. An item without
    item_id contaminates too, but can't be named in item_ids. Repeated rows get equal results. Rows with the same doc_id and other texts are told apart.
    Further columns, whatever their names, are ignored. An empty benchmark leaves every document clean.
    """
    return _judged(docs, benchmark, doc_id, text, item_id, item_text, masks, window, share, broadcast_seeds).select("doc_id", "n_tokens", "overlap", "item_ids", "contaminated")


@tidied
def clean_documents(docs: DataFrame, benchmark: DataFrame, *, broadcast_hits: int = BROADCAST_HITS, **how) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns, whatever these are called.

    The keys of contaminated rows are written and counted: up to broadcast_hits of them go to where the documents lie,
    so that no text is shuffled or sorted; beyond, both sides are shuffled. Null and blank texts are clean; repeated rows stay or go together; an empty benchmark takes nothing away.
    """
    doc_id, text = how.get("doc_id", "doc_id"), how.get("text", "text")
    hits = materialize(_hits(docs, benchmark, **how).where("overlap >= " + str(how.get("share", SHARE))).select("id", "tie").distinct())
    if hits.count() <= broadcast_hits:
        hits = F.broadcast(hits)
    keyed = docs.select(row_of(docs.columns), F.coalesce(col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(col(text)).alias("tie"))
    return keyed.join(hits, ["id", "tie"], "left_anti").select(*[field(c) for c in docs.columns])


def _tokens(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(col(text)).alias("tie"), token_hashes(col(text)).alias("h"))


def _hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", masks: tuple[tuple[str, int, int], ...] = MASKS, window: int = WINDOW, share: float = SHARE, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """Measured overlaps (id, tie, item_id, overlap) of documents and items that share a seed."""
    items = benchmark.select(F.monotonically_increasing_id().alias("number"), col(item_id).alias("item_id"), token_hashes(col(item_text)).alias("item"))
    items = materialize(items.where(F.size("item") > 0).withColumn("width", F.least(F.size("item"), F.lit(WINDOW))))
    widths = [r.width for r in items.select("width").distinct().collect()]
    masks = [m for m in masks if any(m[1] <= w <= m[2] for w in widths)] or list(masks)
    shortest = min(len(m[0]) for m in masks)
    placed = items.select("number", "item", "width", F.explode(F.sequence(F.lit(0), F.size("item") - 1)).alias("q"))
    seeds = placed.select("number", "q", F.explode(_seed_keys("item", "q", masks, F.col("width"))).alias("key")).where("key is not null")
    few = seeds.count() <= broadcast_seeds and (items.agg(F.sum(F.size("item"))).first()[0] or 0) <= BROADCAST_TOKENS
    tokens = _tokens(docs, doc_id, text).where(F.size("h") >= shortest)
    at = tokens.select("id", "tie", "h", F.explode(F.sequence(F.lit(0), F.size("h") - shortest)).alias("p"))
    if few:
        keys = at.select("id", "tie", "h", "p", F.explode(_seed_keys("h", "p", masks)).alias("key"))
        found = keys.join(F.broadcast(seeds.select("key", "number", "q")), "key").withColumn("diagonal", F.col("p") - F.col("q"))
        found = found.join(F.broadcast(items.select("number", "item_id", "item")), "number")
    else:
        keys = at.select("id", "tie", "p", F.explode(_seed_keys("h", "p", masks)).alias("key")).where("key is not null")
        # a seed of common words meets its many places where they lie
        seeds = materialize(seeds.select("key", "number", "q").distinct())
        places = materialize(keys.join(seeds.select("key"), "key", "left_semi"))
        kept = materialize(seeds.groupBy("key").agg(F.collect_list(F.struct("number", "q")).alias("at")).join(places.groupBy("key").agg(F.count("*").alias("n")), "key"))
        hits = join_spread(places, kept, "key").select("id", "tie", "p", F.inline("at")).select("id", "tie", "number", (F.col("p") - F.col("q")).alias("diagonal")).distinct()
        found = hits.join(items, "number").join(tokens.dropDuplicates(["id", "tie"]), ["id", "tie"])
    measured = found.select("id", "tie", "item_id", _overlap("h", "diagonal", "item", window).alias("overlap"))
    return measured.groupBy("id", "tie", "item_id").agg(F.max("overlap").alias("overlap"))


def _judged(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, masks: tuple[tuple[str, int, int], ...], window: int, share: float, broadcast_seeds: int) -> DataFrame:
    hits = _hits(docs, benchmark, doc_id, text, item_id, item_text, masks, window, share, broadcast_seeds)
    met = hits.groupBy("id", "tie").agg(F.max("overlap").alias("overlap"), F.sort_array(F.collect_set(F.when(F.col("overlap") >= share, F.col("item_id")))).alias("item_ids"))
    rows = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(col(text)).alias("tie"), F.size(token_hashes(col(text))).alias("n_tokens"))
    kind = met.schema["item_ids"].dataType
    out = rows.join(met, ["id", "tie"], "left")
    return out.select("doc_id", "n_tokens", F.coalesce("overlap", F.lit(0.0)).alias("overlap"), F.coalesce("item_ids", F.array().cast(kind)).alias("item_ids"), (F.coalesce("overlap", F.lit(0.0)) >= share).alias("contaminated"))
