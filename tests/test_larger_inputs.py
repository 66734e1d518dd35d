"""Inputs that the small tables don't have: keys of more digits, repeated ids, crowded spots and pages."""

import duckdb

import pytest
from pyspark.sql import functions as F

from tests.test_queries import same
from veridoc.operators import figures, frames, retrieval
from veridoc.plans import queries as own


def test_labels_of_as_many_digits_as_keys_have(spark, tmp_path):
    keys = [7, 999, 1000, 60_000, 9_000_000_000_000_000_000]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    same(own.QUERIES["h10_numerals"](spark, str(tmp_path)), con.execute(own.ORACLES["h10_numerals"]))


def test_cues_and_atoms_are_never_broadcast(spark):
    texts = spark.range(2000).select("id", F.lit("word restated and not here").alias("text"))
    atoms = texts.select("id", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("atom_start"))
    plan = frames.denial_cue_hits(texts, atoms)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


@pytest.mark.parametrize("n", [3, 700])
def test_cues_against_all_pairs(spark, n):
    import random
    import re

    rng = random.Random(n)
    text = "".join(rng.choice(["restated ", "Ä word ", "x" * 90 + " ", "Restated, "]) for _ in range(2 * n))
    at = sorted(rng.sample(range(len(text)), n))
    got = frames.denial_cue_hits(spark.createDataFrame([(1, text)], "id int, text string"), spark.createDataFrame([(1, a) for a in at], "id int, atom_start int"))
    want = []
    for m in re.finditer(r"(?i)\brestated\b", text):
        near = min((abs(a - m.start()), a) for a in at)
        if near[0] <= frames.CUE_WINDOW:
            want.append(("restated", m.start(), near[1], near[0]))
    assert sorted((r.cue, r.cue_start, r.atom_start, r.distance) for r in got.collect()) == sorted(want)


MARKS = "mark_id long, page int, numeral string, confidence double, x double, y double, w double, h double, engines array<string>, angles array<int>"


def test_crowded_marks_are_merged_without_pairs(spark, monkeypatch):
    """20,000 marks of one label at few spots would make 10^7 pairs; odd rows stay as they are."""
    monkeypatch.setattr(figures, "near_pairs", None)
    rows = [(i, 1, "12", i % 100 / 100, (i % 3) * 0.3, (i % 2) * 0.01, 0.0, 0.0, [f"e{i % 5}"], [0]) for i in range(20_000)]
    odd = [(-1, None, "12", 0.5, 0.0, 0.0, 0.0, 0.0, ["z"], [0]), (-2, 1, None, 0.5, 0.0, 0.0, 0.0, 0.0, ["z"], [0]), (-3, 1, "12", 0.5, None, 0.0, 0.0, 0.0, ["z"], [0]), (-4, 1, "12", 0.5, float("nan"), 0.0, 0.0, 0.0, None, [0]), (-5, 1, "12", None, 0.9, 0.5, 0.0, 0.0, ["z"], [0]), (-6, 1, "12", float("nan"), 0.9, 0.5, 0.0, 0.0, ["y", None], [90])]
    got = figures.merge_same_spot(spark.createDataFrame(rows + odd, MARKS)).collect()
    assert sorted(r.mark_id for r in got) == [-5, -4, -3, -2, -1, 99, 199, 299]
    by = {r.mark_id: r for r in got}
    assert all(by[i].engines == [f"e{j}" for j in range(5)] for i in (99, 199, 299))
    assert by[-5].engines == ["y", "z", None] and by[-5].angles == [0, 90] and by[-4].engines is None


def test_hits_of_unrelated_labels_meet_nowhere(spark, monkeypatch):
    monkeypatch.setattr(figures, "near_pairs", None)
    hits = spark.createDataFrame([(i, 1, str(10 + i % 90), 0.5, 0.5) for i in range(500)] + [(500, 1, None, 0.5, 0.5)], "hit_id long, page int, numeral string, x double, y double")
    assert sorted(r.hit_id for r in figures.drop_fragment_hits(hits).collect()) == list(range(501))


@pytest.mark.parametrize("triples", [1, 1 << 22])
def test_search_where_spans_lie_against_all_scores(spark, monkeypatch, triples):
    """Copies tie at the last rank, spans are longer than a batch, and repeated ids count as one span."""
    import random

    monkeypatch.setattr(retrieval, "TRIPLES", triples)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("red blue green pump valve 12 7,000".split()) for _ in range(rng.randrange(12))) for _ in range(60)] * 2 + ["pump valve " * 9000]
    rows = [(f"s{i}", t) for i, t in enumerate(texts)] + [("s3", texts[3]), ("s3", "blue pump"), (None, "red valve"), ("t", None), ("s4", texts[4])]
    index = retrieval.build_index(spark.createDataFrame(rows, "span_id string, text string").repartition(3))
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["red pump valve", "pump pump", "blue_x blue green", "none", "", None])], "query_id int, query string")
    full = retrieval.score(index, queries).where("score > 0").collect()
    got = sorted((r.query_id, r["rank"], r.span_id, round(r.score, 9)) for r in retrieval.search(index, queries, 7).collect())
    order = sorted(full, key=lambda r: (r.query_id, -round(r.score, 9), r.span_id is not None, r.span_id or ""))
    want = [(q, n, r.span_id, round(r.score, 9)) for q in range(6) for n, r in enumerate([r for r in order if r.query_id == q][:7], 1)]
    assert [(g[0], g[1], g[2]) for g in got] == [(w[0], w[1], w[2]) for w in want] and len(want) == 21
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    monkeypatch.setattr(retrieval, "score", None)
    assert retrieval.search(index, queries, 7).count() == 21
    idf = {r.term: r.idf for r in index.idf_of(index.postings).collect()}
    assert {r.term: r.idf for r in index.idf.collect()} == pytest.approx(idf)


def plain_fragments(hits, records, radius=0.025):
    return {h[0] for h in hits for r in records if None not in (h[1], h[2], h[3], h[4], r[2], r[3]) and h[1] == r[0] and h[2] in r[1] and h[2] != r[1] and r[2] - radius <= h[3] <= r[2] + (r[4] or 0.0) + radius and abs(r[3] - h[4]) < radius}


def test_fragments_of_crowded_spots_are_settled_without_pairs(spark, monkeypatch):
    """20,000 hits at a few spots would make 10^8 pairs; hits at the edges of cells still meet their records."""
    import random

    left, near = [], figures._fragments_near

    def counted(hits, *rest):
        left.append(hits.count())
        return near(hits, *rest)

    monkeypatch.setattr(figures, "_fragments_near", counted)
    hits, records = "hit_id long, page int, numeral string, x double, y double", "page int, text string, x double, y double, w double"
    crowd = spark.range(20_000).selectExpr("id", "1", "string(id % 10)", "id % 2 / 2 + 0.01", "0.51")
    long = spark.range(20_000).selectExpr("1", "string(id % 90 + 10)", "id % 2 / 2 + 0.011", "0.512", "0.0")
    got = figures.fragments(crowd.toDF(*[c.split()[0] for c in hits.split(", ")]), long.toDF(*[c.split()[0] for c in records.split(", ")]))
    assert got.count() == 20_000 and left == [0]
    rng = random.Random(6)
    spot = lambda: rng.choice([rng.random() * 0.3, rng.randrange(12) * 0.025, rng.randrange(12) * 0.025 * 0.999])
    some = [(i, rng.choice([1, 2, None]), rng.choice(["1", "2", "12", "", "a", None]), spot(), spot()) for i in range(300)] + [(300, 1, "1", None, 0.1), (301, 1, "1", 0.1, None)]
    many = [(rng.choice([1, 2]), rng.choice(["12", "1", "123", "2a", ""]), spot(), spot(), rng.choice([None, 0.0, 0.06, -0.02])) for _ in range(60)] + [(1, "12", None, 0.1, 0.0)]
    got = figures.fragments(spark.createDataFrame(some, hits), spark.createDataFrame(many, records))
    assert sorted(r.hit_id for r in got.collect()) == sorted(plain_fragments(some, many)) and 0 < left[1] < 302
    assert figures.fragments(spark.createDataFrame(some[:1], hits), spark.createDataFrame([], records)).count() == 0


@pytest.mark.parametrize("mark", ["long", "string"])
def test_conflicts_shuffle_marks_and_no_pairs(spark, monkeypatch, mark):
    """Against all pairs, on edges of blocks and cells, for crowded spots, repeated ids and marks without a place."""
    import random

    monkeypatch.setattr(figures, "near_pairs", None)
    monkeypatch.setattr(figures, "PAIRS", 37)
    rng = random.Random(18)
    spot = lambda: rng.choice([rng.random() * 0.2, rng.randrange(-9, 20) * 0.01, rng.randrange(4) * 0.08 - rng.choice([0.0, 1e-17, 1e-9]), 0.5])
    name = str if mark == "string" else int
    rows = [(name(rng.randrange(500)), rng.choice(["p", "q"]), rng.choice(["1", "2", "2", "a3", ""]), spot(), spot()) for _ in range(600)]
    rows += [(name(900), None, "1", 0.5, 0.5), (None, "p", "1", 0.5, 0.5), (name(901), "p", None, 0.5, 0.5), (name(902), "p", "7", None, 0.5), (name(903), "p", "7", 0.5, float("nan")), (name(904), "p", "7", float("inf"), 0.5), (name(905), "p", "7", -1e4, 0.5), (name(906), "p", "8", -1e4, 0.505)]
    good = [r for r in rows if None not in r and r[2].isdigit()]
    want = [(a[1], a[0], b[0], a[2], b[2]) for a in good for b in good if a[1] == b[1] and a[0] < b[0] and a[2] != b[2] and abs(a[3] - b[3]) < 0.01 and abs(a[4] - b[4]) < 0.01]
    marks = spark.createDataFrame(rows, f"mark_id {mark}, page string, numeral string, x double, y double")
    got = [tuple(r) for r in figures.same_spot_conflicts(marks).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100
    assert figures.same_spot_conflicts(marks, labels=False).count() == len(want)
    assert figures.same_spot_conflicts(marks.limit(0)).count() == 0


def test_conflicts_deal_few_marks_twice(spark, monkeypatch):
    """Marks near the edges of blocks are dealt to several; of marks spread evenly, fewer than a quarter more rows."""

    def counted(*how):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_pydict({"page": pa.array([0], pa.int64()), "a": pa.array([batch.num_rows], pa.int64()), "b": pa.array([0], pa.int64())})

        return run

    monkeypatch.setattr(figures, "_block_pairs", counted)
    marks = spark.range(10_000).selectExpr("0L as page", "id as mark_id", "'1' as numeral", "(id % 100 + 0.5) / 100.0D as x", "(floor(id / 100) + 0.5) / 100.0D as y")
    dealt = figures.same_spot_conflicts(marks, labels=False).agg(F.sum("a")).first()[0]
    assert 10_000 < dealt < 12_500
