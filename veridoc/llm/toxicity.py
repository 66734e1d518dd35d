"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import col, field, materialize, row_of, tidied

#: Labelled rows that the index is made of, at most, half of them of each label. Its terms are all terms of theirs.
MAX_EXAMPLES = 1000
#: Least share of its TF-IDF weight that a term keeps; what its label dependence (chi-square / n) adds goes up to 1.
FLOOR = 0.01
NEIGHBOURS = 25
BLOCK = 64
THRESHOLD = 0.3
#: Prefixes stand for stems: words of one stem share them whatever their ending.
PREFIXES = (4, 6)
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def term_counts(text: str | None) -> dict[str, int]:
    out: dict[str, int] = {}
    for w, c in Counter(_WORD.findall((text or "").lower())).items():
        for t in terms_of(w):
            out[t] = out.get(t, 0) + c
    return out


class Vectorizer:
    """Counts the vocabulary's terms in whole texts: (terms, times), rising by term."""

    def __init__(self, vocabulary: list[str]) -> None:
        self.number = {t: i for i, t in enumerate(vocabulary)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None):
        import numpy as np

        known, number = self.known, self.number
        out: dict[int, int] = {}
        for w, c in Counter(_WORD.findall((text or "").lower())).items():
            ids = known.get(w)
            if ids is None:
                if len(known) > 300_000:
                    known.clear()
                ids = known[w] = tuple(number[t] for t in terms_of(w) if t in number)
            for i in ids:
                out[i] = out.get(i, 0) + c
        terms = np.fromiter(out.keys(), np.int64, len(out))
        order = np.argsort(terms)
        return terms[order], np.fromiter(out.values(), np.float64, len(out))[order]


def _ranges(start, length):
    """The numbers from each start on, length of them, one run after the other."""
    import numpy as np

    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


class BlockMaxIndex:
    """Inverted lists of unit vectors (terms, weights) in blocks of examples, with each term's largest weight per block.

    Examples are ordered by their heaviest terms, so that blocks hold alike ones. A query adds up the block maxima of
    its terms; blocks are scored in order of that bound, some more in every round, until none can reach the k-th best
    cosine found, so the result is that of scoring all examples. Examples that tie with the k-th are all returned.
    """

    def __init__(self, vectors: list, n_terms: int, block: int = BLOCK) -> None:
        import numpy as np

        heaviest = [tuple(t[np.argsort(-w, kind="stable")[:4]].tolist()) for t, w in vectors]
        order = sorted((e for e in range(len(vectors)) if len(vectors[e][0])), key=lambda e: (heaviest[e], e))
        size = np.array([len(vectors[e][0]) for e in order], np.int64)
        none = [np.zeros(0)]
        term = np.concatenate([*none, *[vectors[e][0] for e in order]]).astype(np.int64)
        weight = np.concatenate([*none, *[vectors[e][1] for e in order]])
        at = np.repeat(np.arange(len(order)), size)
        by = np.lexsort((at, term))
        lists = np.searchsorted(term[by], np.arange(n_terms + 1)).astype(np.int32)
        self.__setstate__((block, np.array(order, np.int64), lists, at[by].astype(np.uint16 if len(order) < 1 << 16 else np.int32), weight[by]))

    def __getstate__(self):
        return self.told

    def __setstate__(self, told) -> None:
        """Postings by term travel; what blocks need is made of them."""
        import numpy as np

        self.told = told
        block, self.example, lists, self.at, self.weight = told
        self.n = len(self.example)
        self.blocks = -(-self.n // block)
        term = np.repeat(np.arange(len(lists) - 1), np.diff(lists))
        of = self.at // block
        #: One entry per term and block: the block, its largest weight and where its postings begin.
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(new)
        self.of, self.start = of[first], np.append(first, len(term)).astype(np.int32)
        self.top = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.entries = np.searchsorted(term[first], np.arange(len(lists))).astype(np.int32)

    def nearest(self, terms, weights, k: int, skip: int = -1):
        """(examples, cosines) of the k best and all ties with the last of them; `skip` is left out."""
        import numpy as np

        length = (self.entries[terms + 1] - self.entries[terms]).astype(np.int64)
        entry = _ranges(self.entries[terms], length)
        q, of = np.repeat(weights, length), self.of[entry]
        bound = np.bincount(of, q * self.top[entry], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[: int((bound > 0).sum())]
        scores, kth, done, step = np.zeros(self.n), 0.0, 0, 4
        left_out = np.flatnonzero(self.example == skip)
        while done < len(order):
            chosen = np.zeros(self.blocks, bool)
            now = order[done : done + step]
            now = now[bound[now] >= kth - 1e-9]
            if not len(now):
                break
            chosen[now] = True
            mine = chosen[of]
            begin = self.start[entry[mine]].astype(np.int64)
            count = self.start[entry[mine] + 1] - begin
            posting = _ranges(begin, count)
            scores += np.bincount(self.at[posting], np.repeat(q[mine], count) * self.weight[posting], self.n)
            scores[left_out] = 0
            if self.n > k:
                kth = max(0.0, float(np.partition(scores, self.n - k)[self.n - k]))
            done, step = done + step, step * 2
        near = np.flatnonzero((scores > 0) & (scores >= kth - 1e-9))
        e, s = self.example[near], np.minimum(scores[near], 1.0)
        best = np.lexsort((e, -np.round(s, 9)))
        return e[best], s[best]


class Model:
    """The index, the terms' weights and the calibration of votes."""

    def __init__(self, weight, vectors: list, labels: list[int], rates: tuple[float, float] = (1.0, 1.0), k: int = NEIGHBOURS) -> None:
        self.weight, self.labels, self.k = weight, labels, k
        #: Labelled rows that an example of each label stands for.
        self.rates = rates
        self.index = BlockMaxIndex([(t, self.unit(t, c)) for t, c in vectors], len(weight))
        toxic = sum(labels) * rates[1]
        self.base = (toxic + 1) / (toxic + (len(labels) - sum(labels)) * rates[0] + 2)
        self.steps: tuple = ((0.0,), (self.base,))

    def unit(self, terms, times):
        import numpy as np

        w = (1 + np.log(times)) * self.weight[terms]
        return w / np.sqrt((w * w).sum()) if len(w) else w

    def vote(self, terms, times, skip: int = -1) -> tuple[float, list[int], list[float]]:
        """The distance-weighted share of toxic neighbours, 0 without any, and the three nearest as evidence."""
        e, s = self.index.nearest(terms, self.unit(terms, times), self.k, skip)
        if not len(e):
            return 0.0, [], []
        w = 1 / (1.05 - s)
        y = [self.labels[i] for i in e.tolist()]
        return float((w * y).sum() / w.sum()), e[:3].tolist(), [round(float(x), 6) for x in s[:3]]

    def calibrate(self, votes: list[tuple[float, int]]) -> None:
        """Pool adjacent violators: rising shares of toxic rows over rising left-out votes."""
        pools: list[list[float]] = []
        for v, y in sorted(votes):
            w = self.rates[y]
            if pools and pools[-1][3] == v:
                pools[-1][0] += y * w
                pools[-1][1] += w
            else:
                pools.append([y * w, w, v, v])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                y2, n2, _, v2 = pools.pop()
                pools[-1][0] += y2
                pools[-1][1] += n2
                pools[-1][3] = v2
        if pools:
            self.steps = (tuple(p[2] for p in pools), tuple((p[0] + self.base) / (p[1] + 1) for p in pools))

    def score(self, terms, times) -> tuple[float, list[int], list[float]]:
        import bisect

        vote, e, s = self.vote(terms, times)
        return self.steps[1][max(0, bisect.bisect_right(self.steps[0], vote) - 1)], e, s


class Scorer:
    """Scores whole texts; copies of a text are scored once."""

    def __init__(self, told, steps: tuple) -> None:
        self.model, self.ids, self.vector = told.value["model"], told.value["ids"], Vectorizer(told.value["vocabulary"])
        self.model.steps = steps
        self.memo: dict = {}

    def of_counts(self, terms, times) -> tuple[float, list[int], list[float]]:
        import xxhash

        key = xxhash.xxh3_128_digest(terms.tobytes() + times.tobytes())
        if key not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            score, e, s = self.model.score(terms, times)
            self.memo[key] = score, [self.ids[i] for i in e], s
        return self.memo[key]

    def __call__(self, text: str | None) -> tuple[float, list[int], list[float]]:
        return self.of_counts(*self.vector(text))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def dependence(with_term, toxic_with_term, n: int, toxic: int):
    """Chi-square of term and label over n labelled rows, some of them toxic, divided by their number: 0 to 1."""
    import numpy as np

    over = toxic_with_term * float(n) - with_term * float(toxic)
    by = with_term * (n - with_term) * float(toxic) * float(n - toxic)
    # sums of shares of n may miss n by rounding
    return np.where(by > 1e-6, np.minimum(1.0, over * over / np.where(by > 1e-6, by, 1)), 0.0)


def _rows_of(gaps, times) -> Iterator:
    """(terms, times) of every row of two list columns; terms are written as gaps, which are small."""
    import numpy as np

    cuts = gaps.offsets.to_numpy().tolist()
    flat, counts = gaps.values.to_numpy(), times.values.to_numpy()
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        yield np.cumsum(flat[lo:hi], dtype=np.int64), counts[lo:hi].astype(np.float64)


def _fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_examples: int, written: bool) -> tuple:
    """The broadcast vocabulary and model learned from the labelled documents, the steps of its calibration and, if they
    are to be written, the term counts of all documents (doc_id, gaps, times)."""
    import numpy as np
    import pyarrow as pa

    spark = docs.sparkSession
    named = labels.select(col(doc_id).cast("long").alias("doc_id"), col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    named = named.groupBy("doc_id").agg(F.max(F.when(F.col("y") != 0, 1).otherwise(0)).alias("y")).where(~held_out(F.col("doc_id")))
    keyed = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    named = materialize(named.join(keyed.select("doc_id").distinct(), "doc_id", "left_semi"))
    counts = {r["y"]: r["n"] for r in named.groupBy("y").agg(F.count("*").alias("n")).collect()}
    of_label = [named.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(1, max_examples // 2)) for y in (0, 1)]
    chosen = materialize(of_label[0].union(of_label[1]))

    def terms(batches: Iterator) -> Iterator:
        for batch in batches:
            found = [term_counts(t.as_py()) for t in batch.column(1)]
            kinds = (pa.list_(pa.string()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array([list(x) for x in xs], kind) for xs, kind in zip(((f.keys() for f in found), (f.values() for f in found)), kinds, strict=True)]], names=["doc_id", "y", "terms", "times"])

    # of rows that repeat an id one is an example, whatever their number
    one = keyed.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
    one = materialize(one)
    rows = one.mapInArrow(terms, "doc_id long, y int, terms array<string>, times array<int>").orderBy("doc_id").toArrow()
    ids, y = rows.column("doc_id").to_pylist(), rows.column("y").to_pylist()
    flat = rows.column("terms").combine_chunks()
    flat = flat.flatten() if rows.num_rows else pa.array([], pa.string())
    vocabulary = sorted(flat.unique().to_pylist())
    number = {t: i for i, t in enumerate(vocabulary)}
    vectors = []
    for t, c in zip(rows.column("terms").to_pylist(), rows.column("times").to_pylist(), strict=True):
        at = np.fromiter((number[x] for x in t), np.int64, len(t))
        by = np.argsort(at)
        vectors.append((at[by], np.array(c, np.float64)[by]))
    with_term, toxic_with = np.zeros(len(vocabulary)), np.zeros(len(vocabulary))
    rates = tuple(counts.get(label, 0) / max(1, sum(u == label for u in y)) for label in (0, 1))
    for (t, _), u in zip(vectors, y, strict=True):
        with_term[t] += rates[u]
        toxic_with[t] += u * rates[u]
    told_terms = spark.sparkContext.broadcast(vocabulary)

    def tallied(found: Iterator) -> Iterator:
        df, total = np.zeros(len(told_terms.value), np.int64), 0
        for terms, _ in found:
            df[terms] += 1
            total += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], total))], names=["t", "df"])

    def of_texts(batches: Iterator) -> Iterator:
        vector = Vectorizer(told_terms.value)
        yield from tallied(vector(t.as_py()) for batch in batches for t in batch.column(0))

    def of_counts(batches: Iterator) -> Iterator:
        yield from tallied(x for batch in batches for x in _rows_of(batch.column(0), batch.column(1)))

    def counted(batches: Iterator) -> Iterator:
        vector = Vectorizer(told_terms.value)
        for batch in batches:
            found = [vector(t.as_py()) for t in batch.column(1)]
            ends = np.cumsum([0, *[len(t) for t, _ in found]]).astype(np.int32)
            none = [np.zeros(0, np.int32)]
            flat = (np.concatenate([*none, *[np.diff(t, prepend=0).astype(np.int32) for t, _ in found]]), np.concatenate([*none, *[c.astype(np.int32) for _, c in found]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.ListArray.from_arrays(ends, pa.array(x)) for x in flat]], names=["doc_id", "gaps", "times"])

    # document frequencies over all documents; term -1 counts them
    counts_of = materialize(keyed.mapInArrow(counted, "doc_id long, gaps array<int>, times array<int>")) if written else None
    some = counts_of.select("gaps", "times").mapInArrow(of_counts, "t long, df long") if written else keyed.select("text").mapInArrow(of_texts, "t long, df long")
    stats = some.groupBy("t").agg(F.sum("df").alias("df")).toArrow()
    df = dict(zip(stats.column("t").to_pylist(), stats.column("df").to_pylist(), strict=True))
    total = df.pop(-1, 0)
    every = np.zeros(len(vocabulary))
    every[list(df)] = list(df.values())
    weight = (np.log((1 + total) / (1 + every)) + 1) * (FLOOR + (1 - FLOOR) * dependence(with_term, toxic_with, sum(counts.values()), counts.get(1, 0)))
    model = Model(weight, vectors, y, rates)
    told = spark.sparkContext.broadcast({"model": model, "ids": ids, "vocabulary": vocabulary})

    def left_out(batches: Iterator) -> Iterator:
        model, vector = told.value["model"], Vectorizer(told.value["vocabulary"])
        number = {d: i for i, d in enumerate(told.value["ids"])}
        for batch in batches:
            out = [(model.vote(*vector(t.as_py()), number[d])[0], y) for d, t, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in out], pa.float64()), pa.array([y for _, y in out], pa.int32())], names=["v", "y"])

    if ids:
        parts = max(1, min(len(ids) // 64, spark.sparkContext.defaultParallelism * 2))
        model.calibrate([(r[0], r[1]) for r in one.repartition(parts, "doc_id").mapInArrow(left_out, "v double, y int").collect()])
    return told, model.steps, counts_of


@tidied
def score_toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_examples: int = MAX_EXAMPLES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted, evidence_ids and evidence_cosines (of nearest examples).

    Examples are the labelled documents whose crc32 of the id isn't 2 modulo 4; of a label that more than half of
    max_examples have, those with the smallest hashes of their ids are taken, and each stands for as many as there are
    to one. All their words and word prefixes, of either label, are terms. A
    term weighs (1 + log count) x idf, the document frequencies counted over all documents, times FLOOR plus how much
    the labels depend on it (chi-square / n over the examples); plain TF-IDF lets topics outvote a few toxic words of a long
    text. A text's score is the distance-weighted vote of its nearest examples by exact cosine of these vectors, mapped
    to the share of toxic examples that got such a vote when left out themselves; texts without a term of the examples,
    empty and null ones too, have a vote of 0. Whole texts are read once, to counts of
    these terms, which are written.

    Only the text makes a score: neither labels of the row itself, nor its id, source or language. Labels that are
    null are left out; of several for one document the largest counts. Without labels every score is 0.5. Repeated
    rows get equal scores, and an id that rows repeat is one example, by its least text. Other columns, whatever their
    names, are ignored and an empty table gives an empty result.
    """
    told, steps, counts = _fit(docs, labels, doc_id, text, label, max_examples, True)

    def scored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(told, steps)
        for batch in batches:
            out = [scorer.of_counts(*x) for x in _rows_of(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.float64()))],
                names=["doc_id", "score", "evidence_ids", "evidence_cosines"],
            )

    done = counts.mapInArrow(scored, "doc_id long, score double, evidence_ids array<long>, evidence_cosines array<double>")
    names = ["held_out", "score", "predicted", "evidence_ids", "evidence_cosines"]
    done = done.withColumns({"held_out": F.coalesce(held_out(F.col("doc_id")), F.lit(False)), "predicted": (F.col("score") >= threshold).cast("int")})
    return done.select("doc_id", *names)


@tidied
def keep_harmless(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_examples: int = MAX_EXAMPLES, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns, where they lie: no shuffle of texts.

    Null and empty texts, repeated rows and an empty table are treated as score_toxicity() says.
    """
    told, steps, _ = _fit(docs, labels, doc_id, text, label, max_examples, False)
    rows = docs.select(row_of(docs.columns), col(text).alias("text"))

    def harmless(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(told, steps)
        for batch in batches:
            yield batch.select(["row"]).filter(pa.array([scorer(t.as_py())[0] < threshold for t in batch.column(1)], pa.bool_()))

    return rows.mapInArrow(harmless, rows.select("row").schema).select(*[field(c) for c in docs.columns])
