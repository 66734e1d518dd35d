"""The calls a user makes, each over many requests at once. Calls that decide write to a log that is passed in."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.functions.text import tokenize
from veridoc.operators import frames, spans, support, verify
from veridoc.operators.retrieval import Index, build_index, search

MAX_TEXT, MAX_K = 8192, 100


@dataclass
class Corpus:
    """Documents with their spans and index, built once and shared by all calls."""

    docs: DataFrame
    spans: DataFrame = field(init=False)
    index: Index = field(init=False)

    def __post_init__(self) -> None:
        self.spans = spans.chunk(self.docs)
        self.index = build_index(self.spans)

    def search_corpus(self, queries: DataFrame, k: int = 10) -> DataFrame:
        if not 1 <= k <= MAX_K:
            raise ValueError(f"k is from 1 to {MAX_K}")
        hits = search(self.index, _bounded(queries), k).withColumn("score", F.round("score", 6))
        return hits.join(self.spans.select("span_id", "doc_id", "char_start", "char_end", "text"), "span_id")

    def get_span(self, requests: DataFrame) -> DataFrame:
        return spans.get_spans(self.docs, requests)

    def get_document(self, ids: DataFrame) -> DataFrame:
        return spans.verified(self.docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi"))

    def lint_question(self, questions: DataFrame, units: DataFrame | None = None) -> DataFrame:
        vocabulary = self.spans.select(F.explode(tokenize(F.col("text"))).alias("term")).distinct()
        return frames.lint(questions, vocabulary, units)

    def check_support(self, queries: DataFrame, threshold: float = support.THRESHOLD, k: int = 20) -> DataFrame:
        return support.check_support(search(self.index, _bounded(queries), k), queries, threshold, k)

    def verify(self, answers: DataFrame) -> DataFrame:
        return verify.verify(answers, self.docs)

    def replays(self, log: DataFrame, threshold: float = support.THRESHOLD) -> DataFrame:
        """Logged decisions (query_id, query, status, supporting) with `identical`: whether they come out the same again."""
        again = self.check_support(log, threshold).select("query_id", F.col("status").alias("status_now"), F.col("supporting").alias("supporting_now"))
        same = F.col("status").eqNullSafe(F.col("status_now")) & F.col("supporting").eqNullSafe(F.col("supporting_now"))
        return log.join(again, "query_id").select("query_id", same.alias("identical"))


def _bounded(queries: DataFrame) -> DataFrame:
    wrong = F.raise_error(F.lit(f"a query has 1 to {MAX_TEXT} characters")).cast("string")
    return queries.withColumn("query", F.when(F.length("query").between(1, MAX_TEXT), F.col("query")).otherwise(wrong))
