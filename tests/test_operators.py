"""Golden vectors and invariants of the library's own operators."""

import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veridoc.functions import text as T
from veridoc.functions.nounphrase import head_phrase, is_name, mentions
from veridoc.operators import audit, figures, frames, layout, patents, retrieval, scoring, spans, support, verify
from veridoc.plans.tools import Corpus
from veridoc.sources import documents as sources


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit_col(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


TEXT = "Header:\n  Total assets $ 364,980 grew \n\n---\nTotal debt 100,000 as of September 28, 2024"


def docs_of(spark, *texts):
    return spans.make_documents(spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string"))


def test_spans_hold_their_offsets(spark):
    text = "a😀b 12\n\n  x\t\n—\n y z "
    got = spans.chunk(docs_of(spark, text)).orderBy("char_start").collect()
    assert [r.text for r in got] == ["a😀b 12", "x", "y z"]
    assert all(text[r.char_start : r.char_end] == r.text and r.span_id == f"d0@{r.char_start}-{r.char_end}" for r in got)


def test_tampered_documents_raise(spark):
    docs = docs_of(spark, TEXT, "other")
    bad = docs.withColumn("canonical_text", F.when(F.col("doc_id") == "d1", "changed").otherwise(F.col("canonical_text")))
    assert [r.intact for r in spans.drift(bad).orderBy("doc_id").collect()] == [True, False]
    with pytest.raises(PySparkException):
        spans.verified(bad).select("canonical_text").collect()


def test_quotes_resolve_once(spark):
    q = spark.createDataFrame([("d0", "364,980"), ("d0", "Total"), ("d0", "zzz"), ("d9", "a")], "doc_id string, quote string")
    got = {r.quote: (r.n_found, r.char_start) for r in spans.resolve_quotes(docs_of(spark, TEXT), q).collect()}
    assert got == {"364,980": (1, TEXT.index("364,980")), "Total": (2, None), "zzz": (0, None), "a": (0, None)}


def test_text_functions(spark):
    assert lit_col(spark, ["(19,154)", "$ 364,980", "none", "-3.5%"], T.to_number) == [-19154.0, 364980.0, None, -3.5]
    assert [str(x) for x in lit_col(spark, ["September 28, 2024", "Sept. 4 2024", "Septober 4, 2024", "Feb 30, 2024", "x"], T.to_date)] == ["2024-09-28", "2024-09-04", "None", "None", "None"]
    assert lit_col(spark, ["a/b c.txt", "/x/.hidden", "r.tar.gz"], T.doc_id_for) == ["b_c", ".hidden", "r.tar"]
    assert lit_col(spark, ["ok-1", "..", "", "a/b", "a\n", None], T.is_doc_id) == [True, False, False, False, False, False]
    assert lit_col(spark, ["What is the total-debt of 2024 and 1,000?"], lambda c: T.featurize(c, True)) == [["total-debt", "1,000", "total-debt_1,000"]]
    assert lit_col(spark, ["", "x"], T.featurize) == [[], ["x"]]
    assert lit_col(spark, ["TOTAL", "", "Item 1", "Sub:", "At 5%:", "plain"], T.line_class) == ["h", "blank", "h", "sub", "ln", "ln"]
    labels = spark.createDataFrame([("A",), ("12a",), ("9",), ("12",)], "v string")
    assert [r.v for r in labels.orderBy(T.natural_key(F.col("v"))).collect()] == ["9", "12", "12a", "A"]


def test_bm25_by_hand(spark):
    import math

    rows = spark.createDataFrame([("s1", "cat dog"), ("s2", "cat cat bird"), ("s3", "fish")], "span_id string, text string")
    hits = retrieval.search(retrieval.build_index(rows), spark.createDataFrame([("q", "cat"), ("none", "zebra")], "query_id string, query string")).collect()
    sizes, tf = {"s1": 3, "s2": 5, "s3": 1}, {"s1": 1, "s2": 2}
    idf, mean = math.log(1 + 1.5 / 2.5), 3
    want = {s: idf * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * sizes[s] / mean)) for s, n in tf.items()}
    assert {r.span_id: round(r.score, 9) for r in hits} == {s: round(v, 9) for s, v in want.items()}
    assert [r.rank for r in hits] == [1, 2] and {r.query_id for r in hits} == {"q"}


@pytest.mark.parametrize(("present", "absent", "floor"), [([19, 20, 33], [6, 10, 11], 15.0), ([10, 12], [8, 11], 9.0)])
def test_fit_floor(spark, present, absent, floor):
    rows = [(float(x), True) for x in present] + [(float(x), False) for x in absent]
    assert support.fit_floor(spark.createDataFrame(rows, "score double, present boolean")).first()[0] == floor


@pytest.mark.parametrize(("operation", "text", "holds"), [("percent", "102.02%", True), ("percent", "150.00%", False), ("max", "391,035", True), ("max", "383,285", False), ("min", "383,285", True), ("average", "387,160", True), ("average", "400,000", False), ("count", "2", True), ("count", "5", False), ("gt", "yes", True), ("lt", "true", False), ("nonsense", "1", False), ("subtract", "7,750", True)])
def test_derivations(spark, operation, text, holds):
    assert one(spark, verify.derivation_holds(F.lit(operation), F.lit(text), F.array(F.lit("391,035"), F.lit("383,285")))) is holds


def test_derivation_edges(spark):
    none = F.array().cast("array<string>")
    assert one(spark, verify.derivation_holds(F.lit("sum"), F.lit("0"), none)) is True
    assert one(spark, verify.derivation_holds(F.lit("divide"), F.lit("1"), F.array(F.lit("1"), F.lit("0")))) is False
    assert one(spark, verify.derivation_holds(F.lit("date_delta"), F.lit("29"), F.array(F.lit("March 1, 2024"), F.lit("Feb. 1, 2024")))) is True


def test_answers(spark):
    docs = docs_of(spark, TEXT)
    digest, at = hashlib.sha256(TEXT.encode()).hexdigest(), TEXT.index("364,980")
    atom = lambda h, text="364,980", start=at: (text, "d0", start, start + 7, h)
    rows = [
        ("good", [("Assets were 364,980.", [atom(digest)], [])]),
        ("twice", [("Assets were 364,980 and later 364,980.", [atom(digest)], [])]),
        ("unhashed", [("Assets were 364,980.", [atom(None)], [])]),
        ("stale", [("Assets were 364,980.", [atom("0")], [])]),
        ("wrong", [("Assets were 364,980.", [atom(digest, start=0)], [])]),
        ("far", [("Assets were 364,980.", [atom(digest, start=10**6)], [])]),
        ("empty", []),
    ]
    got = {r.answer_id: (r.ok, r.unbound, [s.statuses for s in r.sentences or []]) for r in verify.verify(spark.createDataFrame(rows, f"answer_id string, sentences {verify.ANSWER}"), docs).collect()}
    assert got == {"good": (True, [], [["ok"]]), "twice": (False, ["364,980"], [["ok"]]), "unhashed": (False, [], [["unhashed"]]), "stale": (False, [], [["stale_hash"]]), "wrong": (False, [], [["mismatch"]]), "far": (False, [], [["out_of_range"]]), "empty": (True, [], [])}
    text = json.dumps({"sentences": [{"text": "x", "atoms": [], "derived": []}]})
    parsed = verify.answers_from_json(spark.createDataFrame([("j", text)], "answer_id string, answer string"))
    assert verify.results_to_json(verify.verify(parsed, docs)).first().result.startswith('{"ok":true')


def test_locators_and_chains(spark):
    assert lit_col(spark, ["What does claim 6 recite?", "How does claim 6 differ from claim 9?", None], frames.parse_locator) == ["claim 6", None, None]
    units = spark.createDataFrame([("d", "9", "6", 200, 300), ("d", "6", "1", 100, 200), ("d", "1", None, 0, 100), ("d", "2", "3", 0, 1), ("d", "3", "2", 1, 2)], "doc_id string, name string, parent string, char_start int, char_end int")
    chains = frames.ancestors(units)
    order = lambda n: [r.ancestor for r in chains.where(F.col("name") == n).orderBy("depth").collect()]
    assert order("9") == ["9", "6", "1"] and order("2") == ["2", "3"] and order("x") == []
    cites = spark.createDataFrame([(1, "d", "9", 50), (2, "d", "6", 250), (3, "d", "x", 5)], "cite_id int, doc_id string, name string, pos int")
    assert {r.cite_id: (r.resolved, r.in_unit) for r in frames.check_scope(cites, chains).collect()} == {1: (True, True), 2: (True, False), 3: (False, False)}


def test_coverage_and_cues(spark):
    asked = spark.createDataFrame([("a", "entity", "wheel well", True), ("a", "entity", "spoke", False), ("a", "locator", "claim 1", True), ("b", "entity", "x", True)], "answer_id string, role string, text string, required boolean")
    cited = spark.createDataFrame([("a", 0, "The  WHEEL"), ("a", 1, " WELL is red.")], "answer_id string, ord int, text string")
    assert {(r.answer_id, r.text): r.covered for r in frames.coverage(asked, cited).collect()} == {("a", "wheel well"): True, ("a", "spoke"): True, ("b", "x"): False}
    text = "Assets of $1,000 were restated; liabilities of $2,000 were unchanged."
    rows, atoms = spark.createDataFrame([(1, text)], "id int, text string"), spark.createDataFrame([(1, text.index("1,000")), (1, text.index("2,000"))], "id int, atom_start int")
    hit = frames.denial_cue_hits(rows, atoms).collect()
    assert [(h.cue, h.cue_start, h.atom_start) for h in hit] == [("restated", text.index("restated"), text.index("1,000"))]


def test_noun_phrases():
    assert [head_phrase(x) for x in ("and clothes washer", "by a motor", "includes a memory", "include a", "primary and secondary pipes")] == ["clothes washer", "motor", "memory", "", "primary and secondary pipes"]
    assert is_name("the pump") and not is_name("include a")
    text = "The pump 10 drives the pipes 56, 58 and 60. The siphon, indicated schematically at 43. a load of 400 W, at temperatures exceeding 500, a 36-pin plug, 0.24 mg, FIG. 5"
    assert {m[0] for m in mentions(text)} == {"10", "56", "58", "60", "43"}
    assert next(m[1] for m in mentions(text) if m[0] == "43") == "siphon"


PATENT = "FIG. 1 is a view; FIGS. 3 A-C are left views.\nWhat is claimed is:\n1. A cycle comprising: a frame; and a wheel.\n2. The cycle of claim 1, wherein it is red.\n3. The cycle of claim 2 having spokes.\n4. A saddle.\n5. The saddle of claim 4.\n"


def test_patents(spark):
    docs = docs_of(spark, PATENT)
    claims = patents.parse_claims(docs).orderBy("number").collect()
    assert [(c.number, c.depends_on) for c in claims] == [(1, None), (2, 1), (3, 2), (4, None), (5, 4)] and all(PATENT[c.char_start : c.char_end] == c.text for c in claims)
    limits = patents.decompose_claims(docs).where("number = 1").orderBy("index").collect()
    assert [x.text for x in limits] == ["a frame", "a wheel"] and all(PATENT[x.char_start : x.char_end] == x.text for x in limits)
    assert [f.fig for f in patents.parse_figures(docs).collect()] == ["1", "3A", "3B", "3C"]
    bad = spark.createDataFrame([("d", 2, 9), ("d", 3, 5), ("d", 5, 1), ("d", 1, None), ("d", 7, 7)], "doc_id string, number int, depends_on int")
    assert {(r.number, r.issue) for r in patents.dependency_issues(bad).collect()} == {(2, "missing"), (3, "later"), (7, "itself")}


MARK = "mark_id long, page int, numeral string, confidence double, x double, y double, w double, h double, engines array<string>, angles array<int>"


def mark(i, numeral, x, y, c=1.0, engines=("a",), angles=(0,)):
    return (i, 1, numeral, c, float(x), float(y), 0.01, 0.01, list(engines), list(angles))


def test_marks(spark):
    rows = spark.createDataFrame([mark(1, "12", 0.5, 0.3, 0.9), mark(2, "12", 0.505, 0.302, 0.7, ("b",)), mark(3, "12", 0.8, 0.3)], MARK)
    merged = figures.merge_same_spot(rows).orderBy("mark_id").collect()
    assert [(m.mark_id, m.engines) for m in merged] == [(1, ["a", "b"]), (3, ["a"])]
    assert lit_col(spark, ["86", "98", "106", "88", "12a", "34"], figures.strobogrammatic) == ["98", "86", "901", "88", None, None]
    turned = spark.createDataFrame([mark(1, "86", 0.1, 0.1), mark(2, "98", 0.11, 0.11, angles=(180,)), mark(3, "98", 0.5, 0.1, angles=(180,)), mark(4, "34", 0.1, 0.1, angles=(180,))], MARK)
    assert {r.mark_id for r in figures.drop_strobogrammatic_twins(turned).collect()} == {1, 3, 4}
    gate = spark.createDataFrame([mark(1, "5", 0, 0), mark(2, "6", 0, 0, engines=("a", "b"), angles=(180,)), mark(3, "7", 0, 0, angles=(90,)), mark(4, "7", 0, 0, angles=(180,)), mark(5, "8", 0, 0, angles=(90,))], MARK)
    assert {r.mark_id: r.corroboration for r in figures.gate_rotated(gate, spark.createDataFrame([("7",)], "label string")).collect()} == {1: None, 2: "cross-engine", 3: "spec"}
    conflicts = spark.createDataFrame([mark(1, "58", 0.5, 0.5), mark(2, "38", 0.505, 0.5), mark(3, "A", 0.5, 0.5)], MARK)
    assert [(r.a, r.b) for r in figures.same_spot_conflicts(conflicts).collect()] == [(1, 2)]
    assert figures.apply_refutations(rows, rows.where("mark_id = 1")).count() == 1


def test_sheets_and_labels(spark):
    labels = spark.createDataFrame([(2, "1", 0.9), (4, "5", 0.8), (2, "A", 0.5)], "page int, fig string, confidence double")
    pages = spark.createDataFrame([(2,), (3,), (4,)], "page int")
    known = lambda *f: spark.createDataFrame([(x,) for x in f], "fig string")
    got = {(r.fig, r.page, r.method) for r in figures.fig_to_sheets(labels, pages, known("1", "4", "5")).collect()}
    assert got == {("1", 2, "ocr"), ("5", 4, "ocr"), ("4", 3, "elimination")}
    assert {r.fig for r in figures.fig_to_sheets(labels, pages, known("1", "4", "5", "6")).collect()} == {"1", "5"}
    seen = spark.createDataFrame([("10", 2), ("12", 2), ("89", 3), ("77", 4)], "numeral string, page int")
    text = spark.createDataFrame([("10",), ("89",), ("42",)], "label string")
    assert {r.label: r.state for r in figures.cross_check(text, seen).collect()} == {"10": "matched", "89": "matched", "42": "text_only", "12": "sheet_only", "77": "sheet_only"}
    mentioned = spark.createDataFrame([("d", "10", 50), ("d", "10", 900), ("d", "11", 5), ("d", "12", 9000)], "doc_id string, label string, pos long")
    refs = spark.createDataFrame([("d", "1", 10), ("d", "4", 800)], "doc_id string, fig string, at long")
    assert {r.label: r.figures for r in figures.text_figures(mentioned, refs).collect()} == {"10": ["1", "4"]}
    box = one(spark, figures.box_from_pixels(*[F.lit(float(v)) for v in (300, 400, 100, 200, 1000, 1000)]))
    assert (box.x, box.y, box.w, box.h) == (0.1, 0.6, 0.2, 0.2)
    assert one(spark, figures.box_from_pixels(*[F.lit(float(v)) for v in (1, 1, 2, 9, 10, 10)])) is None


def test_chain_tampering(spark):
    payloads = spark.createDataFrame([(i, f'{{"n":{i}}}') for i in range(6)], "ord int, payload string")
    log = audit.chain(payloads)
    assert audit.broken_links(log).count() == 0
    rows = log.orderBy("seq").collect()
    want = hashlib.sha256(f'{{"payload":{{"n":0}},"prev_hash":"{"0" * 64}","seq":0}}'.encode()).hexdigest()
    assert rows[0].entry_hash == want and rows[1].prev_hash == want
    edited = log.withColumn("payload", F.when(F.col("seq") == 2, '{"n":9}').otherwise(F.col("payload")))
    assert [r.seq for r in audit.broken_links(edited).collect()] == [2]
    assert [r.seq for r in audit.broken_links(log.where("seq <> 3")).collect()] == [4]
    swapped = log.withColumn("seq", F.when(F.col("seq") == 1, 2).when(F.col("seq") == 2, 1).otherwise(F.col("seq")).cast("long"))
    assert audit.broken_links(swapped).count() >= 2
    assert lit_col(spark, ['{"b": [1, {"z": null, "a": "é"}], "a": 1}'], audit.canonical_json) == ['{"a":1,"b":[1,{"a":"é","z":null}]}']


def test_sessions_do_not_depend_on_blocks(spark):
    rows = [(0, "verify", None, None, None, True), (1, "session_start", "x", None, None, None), (2, "check_support", None, "q1", "insufficient", None), (3, "verify", None, None, None, True), (4, "session_start", "y", None, None, None), (5, "verify", None, None, None, True), (6, "check_claim", None, "q2", "supported", None), (7, "verify", None, None, None, True)]
    log = spark.createDataFrame(rows, "seq long, kind string, label string, query string, status string, ok boolean")
    for block in (1, 3, 100):
        got = [(r.session, r.last_query) for r in audit.sessions(log, block).orderBy("seq").collect()]
        assert got == [(0, None), (1, None), (1, "q1"), (1, "q1"), (2, None), (2, None), (2, "q2"), (2, "q2")]
    assert [(r.seq, r.outcome) for r in audit.interactions(log).orderBy("seq").collect()] == [(0, "answer"), (2, "abstain"), (3, "answer"), (5, "answer"), (7, "answer")]


def test_scores(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "confidence double, ok boolean")
    assert [scoring.brier(pairs(r)).first()[0] for r in ([(1.0, True)], [(1.0, False)], [])] == [0.0, 1.0, None]
    top = scoring.reliability(pairs([(0.9, True), (0.95, True), (0.1, False), (0.2, False)])).where("bucket = '0.8-1.0'").first()
    assert (top.n, top.accuracy) == (2, 1.0)
    items = spark.createDataFrame([("a", True, None), ("b", False, None), ("c", False, "reject-false-premise"), ("d", False, "refuse-to-adjudicate")], "item_id string, answerable boolean, behavior string")
    runs = spark.createDataFrame([("a", False), ("a", True), ("b", True), ("d", False)], "item_id string, ok boolean")
    got = {r.item_id: (r.expected, r.presented, r.decision_correct, r.verify_failures) for r in scoring.score_items(items, runs).collect()}
    assert got == {"a": ("answer", True, True, 1), "b": ("abstain", True, False, 0), "c": ("correction", False, False, 0), "d": ("refuse", False, True, 1)}
    assert scoring.aggregate(scoring.score_items(items, runs)).first().decision_accuracy == 0.5


def test_layout(spark):
    ranges = spark.createDataFrame([("d", 0, 10, "closest"), ("d", 5, 8, "figure"), ("d", 7, 12, "label"), ("d", 12, 14, "label"), ("d", 20, 20, "figure")], "doc_id string, char_start int, char_end int, kind string")
    got = [(r.char_start, r.char_end, r.kind) for r in layout.paint(ranges).orderBy("char_start").collect()]
    assert got == [(0, 5, "closest"), (5, 8, "figure"), (8, 14, "label")]
    lines = spark.createDataFrame([("d", i) for i in (1, 3, 4, 8)], "doc_id string, line int")
    assert [(r.first, r.last, r.n) for r in layout.clusters(lines).orderBy("first").collect()] == [(1, 4, 3), (8, 8, 1)]


def test_partitioning_does_not_matter(spark):
    docs = docs_of(spark, *[f"alpha beta {i % 7}00,000\nbeta gamma {i}" for i in range(60)])
    queries = spark.createDataFrame([("q1", "alpha beta"), ("q2", "gamma 300,000")], "query_id string, query string")
    first = Corpus(docs).search_corpus(queries, 7).orderBy("query_id", "rank").collect()
    assert Corpus(docs.repartition(7)).search_corpus(queries.repartition(3), 7).orderBy("query_id", "rank").collect() == first
    decided = Corpus(docs).check_support(queries, threshold=0.1)
    assert {r.identical for r in Corpus(docs).replays(queries.join(decided, "query_id"), 0.1).collect()} == {True}


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "my file.txt").write_bytes("﻿one\r\ntwo\rthree".encode())
    (tmp_path / "in" / "skipped.pdf").write_text("no")
    docs = sources.read_texts(spark, str(tmp_path / "in"))
    assert [(r.doc_id, r.canonical_text) for r in docs.collect()] == [("my_file", "one\ntwo\nthree")]
    sources.write_store(docs, str(tmp_path / "store"))
    assert sources.read_store(spark, str(tmp_path / "store")).count() == 1
    with pytest.raises(PySparkException):
        sources.write_store(docs.withColumn("doc_id", F.lit("../x")), str(tmp_path / "bad"))
    page = "<style>x</style><p>A&amp;B</p><table><tr><td>Sept 28,<br>2024</td><td> 5</td></tr></table>"
    assert sources.html_to_text(page) == "\nA&B\n\nSept 28, 2024 5\n\n"
    (tmp_path / "t.tsv").write_text("left\ttop\twidth\theight\tconf\ttext\n10\t20\t30\t40\t95\tab\n0\t0\t1\t1\t-1\t\n")
    o = sources.tesseract_observations(spark, str(tmp_path / "t.tsv"), 100, 200).collect()
    assert [(r.text, r.confidence, r.x, r.y, r.w, r.h) for r in o] == [("ab", 0.95, 0.1, 0.7, 0.3, 0.2)]


def test_log_stream(spark, tmp_path):
    from veridoc.streaming.log import outcome_counts, tail

    (tmp_path / "log").mkdir()
    rows = audit.chain(spark.createDataFrame([(i, '{"kind":"verify"}') for i in range(3)], "ord int, payload string")).orderBy("seq").collect()
    lines = [{**r.asDict(), "ts": f"2024-01-01T00:0{r.seq}:00Z"} for r in rows]
    lines[2]["payload"] = '{"kind":"edited"}'
    (tmp_path / "log" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    stream = outcome_counts(tail(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("counted").outputMode("complete").start()
    stream.processAllAvailable()
    stream.stop()
    assert {(r.kind, r.n, r.broken) for r in spark.table("counted").collect()} == {("verify", 2, 0), ("edited", 1, 1)}


def test_greedy_choices_against_a_plain_loop(spark):
    import random

    rng = random.Random(8)
    rows = [(rng.randrange(150), 1, rng.choice(["12", "112", "1123", "3"]), round(rng.random(), 2), rng.random() / 5, rng.random() / 5, 0.01, 0.01, [rng.choice("abc")], [rng.choice([0, 90])]) for _ in range(200)]
    marks = spark.createDataFrame(rows, "mark_id long, page int, numeral string, confidence double, x double, y double, w double, h double, engines array<string>, angles array<int>")
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        host = next((k for k in kept if k[2] == r[2] and abs(k[4] - r[4]) < 0.02 and abs(k[5] - r[5]) < 0.02), None)
        if host is None:
            kept.append([*r[:8], set(r[8]), set(r[9])])
        else:
            host[8].update(r[8])
            host[9].update(r[9])
    got = figures.merge_same_spot(marks).collect()
    assert sorted((r.mark_id, r.x, tuple(r.engines), tuple(r.angles)) for r in got) == sorted((k[0], k[4], tuple(sorted(k[8])), tuple(sorted(k[9]))) for k in kept)
    longest: list = []
    for r in sorted(rows, key=lambda r: -len(r[2])):
        if not any(r[2] != k[2] and r[2] in k[2] and abs(k[4] - r[4]) < 0.03 and abs(k[5] - r[5]) < 0.03 for k in longest):
            longest.append(r)
    hits = figures.drop_fragment_hits(marks.withColumnRenamed("mark_id", "hit_id").select("hit_id", "page", "numeral", "x", "y"))
    assert sorted((r.hit_id, r.x) for r in hits.collect()) == sorted((r[0], r[4]) for r in longest)


def test_offsets_of_long_documents(spark):
    text = "\n".join(f"line {i} " for i in range(2000))
    docs = spans.make_documents(spark.createDataFrame([("d", text), ("d", "a\n\nb")], "doc_id string, text string"))
    got = spans.chunk(docs).collect()
    assert len(got) == 2002 and all(r.text == (text if r.text.startswith("line") else "a\n\nb")[r.char_start : r.char_end] for r in got)
