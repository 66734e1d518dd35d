"""Ranking by BM25 over an inverted index, for many queries at once."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions.text import TOKEN, featurize
from veridoc.operators.lineage import cut

K1, B = 1.5, 0.75
#: Query terms up to which the query side of the join is broadcast.
BROADCAST_TERMS = 200_000
#: (span, query, term) triples scored at once by a task.
TRIPLES = 1 << 22


@dataclass(frozen=True)
class Index:
    """Features of spans (scope, span_id, dl, f) and size and mean length of each scope. Postings (scope, term, span_id,
    dl, tf) and idf (scope, term, idf) are made of them, of all terms or of those asked for."""

    features: DataFrame
    stats: DataFrame
    scoped: bool

    def postings_of(self, asked: DataFrame | None = None) -> DataFrame:
        """Postings; `asked` (scope, term) picks terms before anything is shuffled."""
        rows = self.features.select("scope", "span_id", "dl", F.explode("f").alias("term"))
        rows = rows if asked is None else rows.join(asked, ["scope", "term"], "left_semi")
        return rows.groupBy("scope", "term", "span_id", "dl").agg(F.count("*").alias("tf"))

    def idf_of(self, postings: DataFrame) -> DataFrame:
        df = postings.groupBy("scope", "term").agg(F.count("*").alias("df"))
        weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return df.join(self.sizes, "scope").select("scope", "term", weight.alias("idf"))

    @property
    def sizes(self) -> DataFrame:
        return self.stats if self.scoped else F.broadcast(self.stats)  # one row without scopes

    @property
    def postings(self) -> DataFrame:
        return self.postings_of()

    @property
    def idf(self) -> DataFrame:
        parts = self.parted()
        return self.idf_of(self.postings if parts is None else parts[0].each_once().unionByName(parts[1].postings.select("scope", "term")))

    def each_once(self) -> DataFrame:
        """(scope, term) once for every span that has it, counted before anything is shuffled; ids may not repeat."""
        return self.features.select("scope", F.explode(F.array_distinct("f")).alias("term"))

    def parted(self) -> tuple[Index, Index] | None:
        """The index of spans whose id occurs once, which are whole where they lie, and that of all others, which have
        to be brought together; None if those are too many to be told by a broadcast."""
        key = F.xxhash64("scope", "span_id")
        again = cut(self.features.select(key.alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
        n = again.count()
        if n > BROADCAST_TERMS:
            return None
        rows = self.features.withColumn("h", key)
        part = lambda how: Index(rows.join(F.broadcast(again), "h", how).drop("h"), self.stats, self.scoped)
        return (part("left_anti") if n else self), (part("left_semi") if n else Index(self.features.limit(0), self.stats, self.scoped))


def build_index(spans: DataFrame, *, scope: str | None = None, max_dl: float | None = None) -> Index:
    """Index the features of spans (span_id, text). Statistics belong to a scope: all spans, or those of one value
    of the column `scope`. max_dl caps a span's length at so many mean lengths when it is scored."""
    named = (F.col(scope).cast("string") if scope else F.lit("")).alias("scope")
    # tokens and the pairs of neighbours among them
    n = F.regexp_count(F.lower("text"), F.lit(TOKEN))
    length = F.greatest(F.lit(0), 2 * n - 1)
    stats = spans.select(named, length.alias("dl")).groupBy("scope").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    rows = spans.select(named, "span_id", featurize(F.col("text")).alias("f")).withColumn("dl", F.size("f"))
    if max_dl is not None:
        rows = rows.join(stats if scope else F.broadcast(stats), "scope").withColumn("dl", F.least(F.col("dl"), max_dl * F.col("avgdl")))
    return Index(rows.select("scope", "span_id", "dl", "f"), stats, scope is not None)


def score(index: Index, queries: DataFrame, *, query_id: str = "query_id", query: str = "query", scope: str | None = None, as_query: bool = True) -> DataFrame:
    """(query_id, span_id, score) of every span that shares a term with a query; repeated query terms count again.

    Only postings of the queries' terms are made: the terms are broadcast if they are few, else shuffled.
    """
    keep = [F.col(query_id).alias("query_id"), (F.col(scope).cast("string") if scope else F.lit("")).alias("scope")]
    terms = queries.select(*keep, F.explode(featurize(F.col(query), as_query)).alias("term")).groupBy("query_id", "scope", "term").agg(F.count("*").alias("qtf"))
    terms = cut(terms)
    few = F.broadcast if terms.count() <= BROADCAST_TERMS else (lambda x: x)
    postings = cut(index.postings_of(few(terms.select("scope", "term").distinct())))
    return _scores(postings, index.idf_of(postings), few(terms), index.sizes)


def _scores(postings: DataFrame, idf: DataFrame, terms: DataFrame, sizes: DataFrame) -> DataFrame:
    hits = postings.join(idf, ["scope", "term"]).join(terms, ["scope", "term"]).join(sizes, "scope")
    bottom = F.when(F.col("avgdl") > 0, F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))).otherwise(F.lit(1.0))
    gain = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / bottom
    return hits.groupBy("query_id", "span_id").agg(F.sum(gain).alias("score"))


def _best_where_they_lie(terms: list, ids: list, weight: list[float], avgdl: float, k: int):
    """A pass over hits (row, span_id, dl, no) in order of spans that gives (q, span_id, score) of the k best spans of its
    task for each query. terms: (q, no, qtf) in order of no; ids: queries; weight: idf by no."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        q_of, no_of, qtf = (np.array(c) for c in zip(*terms, strict=True))
        start = np.searchsorted(no_of, np.arange(len(weight) + 1))
        idf, n_q, n_t = np.array(weight), len(ids), len(weight)
        best: dict[int, list[tuple]] = {}
        floor = np.zeros(n_q)

        def take(spans: list, dl, span, no) -> None:
            """Scores of whole spans, `span` numbering them."""
            found, tf = np.unique(span * n_t + no, return_counts=True)
            r, t = found // n_t, found % n_t
            gain = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[r] / avgdl) if avgdl > 0 else 1.0)
            many = start[t + 1] - start[t]
            i = np.repeat(np.arange(len(t)), many)
            j = start[t][i] + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            cell, back = np.unique(r[i] * n_q + q_of[j], return_inverse=True)
            score = np.bincount(back, qtf[j] * gain[i], len(cell))
            r, q, near = cell // n_q, cell % n_q, np.round(score, 9)
            ok = (score > 0) & (near >= floor[q])
            r, q, near, score = r[ok], q[ok], near[ok], score[ok]
            named = sorted(set(r.tolist()), key=lambda x: (spans[x] is not None, spans[x] or ""))
            place = np.zeros(len(spans), np.int64)
            place[named] = np.arange(len(named))
            order = np.lexsort((place[r], -near, q))
            first = np.searchsorted(q[order], q[order])
            for x in order[np.arange(len(order)) - first < k].tolist():
                best.setdefault(int(q[x]), []).append((-float(near[x]), spans[r[x]] is not None, spans[r[x]] or "", float(score[x])))
            for x in set(q.tolist()):
                best[x] = sorted(best[x])[:k]
                if len(best[x]) == k:
                    floor[x] = -best[x][-1][0]

        def cuts(batch: pa.RecordBatch) -> None:
            """Runs of whole spans of not too many triples."""
            row, no = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            begin = np.flatnonzero(np.diff(row, prepend=row[:1] - 1))
            span = np.cumsum(np.diff(row, prepend=row[:1] - 1) != 0) - 1
            spans, dl = batch.column(1).take(pa.array(begin)).to_pylist(), batch.column(2).to_numpy()[begin]
            cost = np.concatenate([[0], np.cumsum(start[no + 1] - start[no])])[[*begin, len(no)]]
            at = 0
            while at < len(spans):
                to = max(at + 1, int(np.searchsorted(cost, cost[at] + TRIPLES, "right")) - 1)
                rows = slice(begin[at], begin[to] if to < len(spans) else len(no))
                take(spans[at:to], dl[at:to], span[rows] - at, no[rows])
                at = to

        held: list = []  # hits of a span that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            row = batch.column(0).to_numpy()
            if held and held[0].column(0)[0].as_py() != row[0]:
                cuts(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
            whole = int(np.searchsorted(row, row[-1]))
            if whole:
                cuts(pa.Table.from_batches([*held, batch.slice(0, whole)]).combine_chunks().to_batches()[0])
                held = []
            held.append(batch.slice(whole))
        if held:
            cuts(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        rows = [(q, name if there else None, score) for q, found in best.items() for _, there, name, score in found]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.float64()), strict=True)], names=["q", "span_id", "score"])

    return run


def _best(index: Index, queries: DataFrame, k: int, query_id: str, query: str, as_query: bool) -> DataFrame | None:
    """(query_id, span_id, score) with the k best spans of every query among them, of an index without scopes.

    A span is scored whole where it lies against all queries, and a task gives its k best for each, so neither postings
    nor scores are shuffled or written. None if query terms or repeated spans are too many to be broadcast."""
    spark = queries.sparkSession
    terms = cut(queries.select(F.col(query_id).alias("query_id"), F.explode(featurize(F.col(query), as_query)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")))
    if not 0 < terms.count() <= BROADCAST_TERMS or (parts := index.parted()) is None:
        return None
    once, again = parts
    asked = terms.collect()
    number = {t: i for i, t in enumerate(sorted({r.term for r in asked}))}
    ids = list({r.query_id: None for r in asked})
    place = {x: i for i, x in enumerate(ids)}
    numbers = F.broadcast(spark.createDataFrame(list(number.items()), "term string, no int"))
    scoped = numbers.select(F.lit("").alias("scope"), "term")
    postings = cut(again.postings_of(F.broadcast(scoped)))
    df = once.each_once().join(numbers, "term").select("no").union(postings.join(numbers, "term").select("no")).groupBy("no").agg(F.count("*").alias("df"))
    size = index.stats.first()
    if size is None:
        return None
    weight = [0.0] * len(number)
    for r in df.collect():
        weight[r.no] = math.log(1 + (size.n - r.df + 0.5) / (r.df + 0.5))
    hits = once.features.withColumn("row", F.monotonically_increasing_id()).select("row", "span_id", F.col("dl").cast("double").alias("dl"), F.explode("f").alias("term")).join(numbers, "term").select("row", "span_id", "dl", "no")
    listed = sorted((number[r.term], place[r.query_id], r.qtf) for r in asked)
    run = _best_where_they_lie([(q, no, n) for no, q, n in listed], ids, weight, size.avgdl, k)
    named = spark.createDataFrame(list(enumerate(ids)), f"q int, query_id {terms.schema['query_id'].dataType.simpleString()}")
    found = hits.mapInArrow(run, "q int, span_id string, score double").join(F.broadcast(named), "q").select("query_id", "span_id", "score")
    idf = spark.createDataFrame([("", t, weight[i]) for t, i in number.items()], "scope string, term string, idf double")
    return found.union(_scores(postings, F.broadcast(idf), F.broadcast(terms.withColumn("scope", F.lit(""))), index.sizes))


def search(index: Index, queries: DataFrame, k: int = 10, *, query_id: str = "query_id", query: str = "query", scope: str | None = None, as_query: bool = True) -> DataFrame:
    """(query_id, rank, span_id, score): the k best spans with a positive score, ties by span_id."""
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "span_id")
    scores = None if index.scoped or scope else _best(index, queries, k, query_id, query, as_query)
    if scores is None:
        scores = score(index, queries, query_id=query_id, query=query, scope=scope, as_query=as_query)
    ranked = scores.where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "span_id", "score")


def citation_band(hits: DataFrame, threshold: float, share: float = 0.9) -> DataFrame:
    """Hits that reach both the threshold and a share of their query's top score."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("top", top).where(F.col("score") >= F.greatest(F.lit(threshold), share * F.col("top"))).drop("top")
