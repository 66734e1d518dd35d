"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import random

import pytest

from veridoc.llm.decontaminate import clean_documents, contamination
from veridoc.llm.embeddings import near_duplicates as near_vectors
from veridoc.llm.licenses import TEMPLATES, scan_licenses
from veridoc.llm.lines import deduplicate_lines
from veridoc.llm.mixing import mix
from veridoc.llm.simhash import keep_one_each, keep_one_similar, near_duplicates
from veridoc.llm.substrings import remove_repeats
from veridoc.llm.token_rollups import TokenRollups, document_changes
from veridoc.llm.toxicity import keep_harmless, score_toxicity
from veridoc.llm.warc import page_captures, resolve_revisits

#: Names that operators use themselves, results' names among them, and names that need quoting.
EXTRA = ["a.b", "id", "tie", "row", "claims", "__id", "__h", "h", "k", "n_lines", "n_removed", "n_words", "size", "taken", "target", "source_size", "fingerprint", "component_id", "overlap", "item_ids", "n_tokens", "license", "coverage", "score", "predicted", "held_out", "toxic", "y", "node", "root", "words", "N_Lines2", "it`s"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(31)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(40))
    rows = [
        (1, passage + "\nshared line here", "en", "a", 5), (2, passage + "\nshared line here", "en", "a", None), (2, passage + "\nshared line here", "en", "a", None), (3, None, None, None, None),
        (4, "", "en", "a", 0), (5, " \n\t", None, "b", 3), (None, "no id " + passage, "en", "b", 1), (None, None, None, None, None), (6, "a " * 60_000, "en", "c", 1), (7, TEMPLATES["MIT-line"], "en", "a", 1), (7, "another text of seven", "en", "a", 1),
    ]
    quoted = ", ".join(f"`{c.replace('`', '``')}` string" for c in EXTRA)
    return spark.createDataFrame([(*r, *([None] * len(EXTRA))) for r in rows], f"{SCHEMA}, {quoted}")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (4, None), (7, 0), (99, 1)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "shared line here and more of it too"), (None, "another text of seven"), (2, None), (3, ""), (3, "")], "item_id long, text string")


def test_row_for_row(docs, labels, bench):
    n = docs.count()
    for out in (score_toxicity(docs, labels), near_duplicates(docs), contamination(docs, bench), remove_repeats(docs), deduplicate_lines(docs), mix(docs)):
        assert out.count() == n and out.limit(0).collect() == []
        assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert set(EXTRA) - {"n_words", "n_removed"} < set(remove_repeats(docs).columns) and set(EXTRA) - {"n_lines", "n_removed"} < set(deduplicate_lines(docs).columns)
    got = {r.doc_id: r for r in remove_repeats(docs).where("doc_id <> 2 and doc_id <> 7").collect()}
    assert got[3].text is None and got[4].text == "" and got[5].n_words == 0 and got[6].n_words == 60_000 and got[6].n_removed == 60_000 - 1
    assert {r.doc_id for r in contamination(docs, bench).where("contaminated").collect()} == {7}
    assert {(r.doc_id, r.license) for r in scan_licenses(docs).collect()} == {(7, "MIT-line")}


def test_stages_keep_columns(spark, docs, labels, bench):
    import corpus_pipeline

    sf = spark.sparkContext.getConf().get("spark.veridoc.none", "/root/testdata/sf0.001")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).where("taken = 0").count() == 0
    for out in (keep_harmless(docs, labels), clean_documents(docs, bench), keep_one_each(docs), keep_one_similar(docs)):
        assert out.columns == docs.columns and out.count() <= docs.count()
    texts = [r.text for r in keep_one_similar(docs).collect()]
    assert len([t for t in texts if not (t or "").strip()]) == 1


def test_empty_tables(docs, labels, bench):
    none = docs.limit(0)
    for out in (score_toxicity(none, labels), near_duplicates(none), contamination(none, bench), remove_repeats(none), deduplicate_lines(none), mix(none), scan_licenses(none), keep_harmless(none, labels.limit(0))):
        assert out.count() == 0
    assert contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 2), (None, [1.0, 0.01], 3), (3, [1.0, 0.0, 0.0], 4), (4, [1.0, 0.0, 0.01], 5), (5, None, 6), (6, [], 7), (7, [0.0, 0.0], 8), (8, [float("nan"), 1.0], 9), (9, [None, 1.0], 9)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component_id int").selectExpr("*", "1 as n_links", "2 as `a.b`", "3 as node", "4 as kept")
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in near_vectors(vectors).collect())
    # the vector without id links too; vectors of another length link among themselves
    assert got == sorted([("1", 3, 1), ("1", 3, 1), ("2", 3, 1), ("None", 3, 1), ("3", 1, 3), ("4", 1, 3), *[(str(i), 0, i) for i in range(5, 10)]])
    assert near_vectors(vectors.limit(0)).count() == 0


REC = "record_id long, url string, at long, kind string, status int, headers map<string,string>, `a.b` string, slice string"


def test_headers_that_differ_in_case(spark):
    u = "http://a.example/p"
    rows = [(1, u, 1, "response", 200, {"etag": "2", "ETag": "1", "X-a": "q"}, None, None), (2, u, 2, "revisit", 304, {"ETAG": "1", "Etag": "7"}, None, None), (3, u, 2, "revisit", 304, None, None, None), (3, u, 2, "revisit", 304, None, None, None), (4, None, None, "revisit", None, None, None, None)]
    got = [(r.record_id, r.outcome, r.headers) for r in resolve_revisits(spark.createDataFrame(rows, REC)).collect()]
    assert sorted(got, key=str) == sorted([(2, "resolved", {"etag": "1", "x-a": "q"}), (3, "unvalidated", {"etag": "1", "x-a": "q"}), (3, "unvalidated", {"etag": "1", "x-a": "q"}), (4, "orphan", None)], key=str)
    pages = spark.createDataFrame([(1, None, None), (2, u, ""), (2, u, ""), (None, u, "x")], "page_id long, url string, html string")
    assert resolve_revisits(page_captures(pages)).count() == 4


def test_one_outlying_time_leaves_slices_even(spark):
    rows = spark.range(3000).selectExpr("id as record_id", "'http://hot.example/' as url", "if(id = 0, 4000000000000, id) as at", "if(id % 3 = 0, 'response', 'revisit') as kind", "200 as status", "map('etag', 'x') as headers")
    got = resolve_revisits(rows).where("outcome = 'resolved'")
    assert got.count() == 2000 - 2 and got.where("response_at >= at").count() == 0


def test_compaction(spark, tmp_path):
    kind = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    rollups = TokenRollups(spark, str(tmp_path / "state"))
    assert not rollups.compact()
    for i in range(4):
        assert rollups.commit(f"b{i}", spark.createDataFrame([("insert", "a", None, "t", 10 + i, None)], kind))
    before = rollups.totals()
    assert rollups.compact() and not rollups.compact()
    assert before.collect() == rollups.totals().collect() and rollups.totals().collect()[0].n_tokens == 46
    assert not rollups.commit("b2", spark.createDataFrame([("insert", "a", None, "t", 99, None)], kind))
    assert rollups.commit("b9", spark.createDataFrame([("delete", "a", None, "t", 10, None)], kind)) and rollups.compact()
    assert [(r.n_docs, r.n_tokens) for r in rollups.totals().collect()] == [(3, 36)]
    assert len(list((tmp_path / "state" / "data").iterdir())) == 3  # the last sums and what they replaced
    assert not rollups._mark("batches/b9", {"data": "other"})


def test_document_changes(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    from veridoc.llm.common import word_count

    rollups = TokenRollups(spark, str(tmp_path / "feed"))
    for name, batch in document_changes(docs, word_count(F.col("text")), F.coalesce(F.length("text"), F.lit(0)).cast("long")).items():
        rollups.commit(name, batch)
    totals = {(r.tokenizer, r.source): (r.n_docs, r.n_tokens) for r in rollups.totals().collect()}
    # the two copies of document 1 under id 2 go, the null text and the empty one are one text; rows without id stay
    assert totals[("words-1", "a")] == (3, 43 + 5 + 4) and totals[("words-1", "c")] == (1, 60_000)
