"""More queries of the library's own operators, with the SQL that says the same; plans.queries holds them all."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridoc.operators import audit, figures, frames, layout, patents, scoring, spans, support
from veridoc.plans.queries import _MARKS, _docs, _marks, query
from veridoc.plans.relations import SQL as R
from veridoc.plans.relations import relation, table


@query("SELECT doc_id::VARCHAR AS doc_id, doc_id % 7 <> 3 OR text IS NULL AS intact FROM documents")
def a3_drift(spark, sf_dir):
    """Documents whose text changed since it was hashed (A3): every seventh is altered here."""
    docs = _docs(spark, sf_dir)
    altered = docs.withColumn("canonical_text", F.when(F.col("doc_id").cast("long") % 7 == 3, F.concat("canonical_text", F.lit("x"))).otherwise(F.col("canonical_text")))
    return spans.drift(altered).select("doc_id", (F.col("intact") | F.col("canonical_text").isNull()).alias("intact"))


@query("WITH i AS (SELECT user_id, value AS top, event_id % 3 <> 0 AS answerable, event_id % 2 = 0 AS tagged FROM events) SELECT count(*) FILTER (answerable) AS n_present, count(*) FILTER (NOT answerable AND tagged) AS n_absent, count(*) FILTER (NOT answerable AND NOT tagged) AS excluded, min(top) FILTER (answerable) > max(top) FILTER (NOT answerable AND tagged) AS clean FROM i")
def e4_calibration(spark, sf_dir):
    """Counts behind a calibrated threshold."""
    rows = table(spark, sf_dir, "events").select(F.col("value").alias("top_score"), (F.col("event_id") % 3 != 0).alias("answerable"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("not-disclosed-metric"))).otherwise(F.array(F.lit("other"))).alias("tests"))
    return support.calibration_summary(rows).select("n_present", "n_absent", "excluded", "clean")


@query("SELECT sha256(string_agg(doc_id::VARCHAR || ':' || sha256(text), chr(10) ORDER BY doc_id::VARCHAR)) AS corpus_hash, count(*) AS n_docs, 'uncalibrated' AS floor FROM documents")
def j14_corpus_identity(spark, sf_dir):
    return support.corpus_identity(_docs(spark, sf_dir), F.lit("uncalibrated"))


_TEXTS = "t AS (SELECT o_orderkey AS id, repeat('x ', (o_orderkey % 40)::INT) || CASE WHEN o_orderkey % 3 = 0 THEN 'restated ' ELSE 'stated ' END || repeat('y ', (o_custkey % 120)::INT) || CASE WHEN o_orderkey % 2 = 0 THEN '1,200' ELSE 'none' END AS text FROM orders)"


@query(f"WITH {_TEXTS} SELECT 'restated' AS cue, count(*) AS n, count(*) FILTER (strpos(text, '1,200') > 0 AND strpos(text, '1,200') - strpos(text, 'restated') <= 160) AS near_figures FROM t WHERE contains(text, 'restated')")
def g10_cue_census(spark, sf_dir):
    """Denial cues counted, and those near figures."""
    k = F.col("o_orderkey")
    text = F.concat(F.repeat(F.lit("x "), (k % 40).cast("int")), F.when(k % 3 == 0, "restated ").otherwise("stated "), F.repeat(F.lit("y "), (F.col("o_custkey") % 120).cast("int")), F.when(k % 2 == 0, "1,200").otherwise("none"))
    return frames.cue_census(table(spark, sf_dir, "orders").select(k.alias("id"), text.alias("text")))


def _claim_docs(spark, sf_dir):
    """A patent for every customer: as many claims as the rest of its key by 5, each on the one before or on none."""
    n = F.col("c_custkey") % 5 + 1
    claim = lambda i: F.concat(i.cast("string"), F.when(i % 3 == 1, F.lit(". A pump having a rotor.\n")).otherwise(F.concat(F.lit(". The pump of claim "), (i - 1).cast("string"), F.lit(", wherein the rotor drives said gear.\n"))))
    text = F.concat(F.lit("Intro\nWhat is claimed is:\n"), F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), claim), ""))
    return spans.make_documents(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text")))


_CLAIMS = "c AS (SELECT c_custkey, unnest(range(1, c_custkey % 5 + 2)) AS i FROM customer)"


@query(f"WITH {_CLAIMS} SELECT c_custkey::VARCHAR AS doc_id, 'claim ' || i AS name, CASE WHEN i % 3 <> 1 THEN 'claim ' || (i - 1) END AS parent FROM c WHERE c_custkey % 2 = 0")
def g6_claim_units(spark, sf_dir):
    """Claims as units, of documents that are patents only."""
    docs = _claim_docs(spark, sf_dir)
    kinds = docs.select("doc_id", F.when(F.col("doc_id").cast("long") % 2 == 0, "patent").otherwise("filing").alias("kind"))
    return frames.claim_units(docs, kinds).select("doc_id", "name", "parent")


@query(f"WITH {_CLAIMS} SELECT c_custkey::VARCHAR AS doc_id, i::INT AS number, 'gear' AS phrase FROM c WHERE i % 3 <> 1")
def h13_antecedents(spark, sf_dir):
    """Back-references that no claim of the chain introduces (H13): pump and rotor are introduced, the gear isn't."""
    found = patents.antecedent_census(_claim_docs(spark, sf_dir))
    return found.select("doc_id", "number", F.regexp_replace("phrase", " drives$", "").alias("phrase"))


@query(f"WITH {_MARKS} SELECT mark_id, numeral, page FROM m WHERE confidence >= 0.5")
def i12_sightings(spark, sf_dir):
    return figures.sightings(_marks(spark, sf_dir), 0.5).select("mark_id", "numeral", "page")


@query(f"WITH {_MARKS}, t AS ({R['text_labels']}) SELECT 'recited-not-located' AS kind, label AS numeral, 'part ' || label AS detail FROM t WHERE label NOT IN (SELECT numeral FROM m) UNION ALL SELECT 'located-not-recited', numeral, 'page ' || page FROM m WHERE numeral NOT IN (SELECT label FROM t)")
def i15_issues(spark, sf_dir):
    named = relation(spark, sf_dir, "text_labels").withColumn("element", F.concat(F.lit("part "), F.col("label")))
    return figures.numeral_issues(named, _marks(spark, sf_dir))


@query(f"WITH {_MARKS}, c AS (SELECT o_orderkey AS answer_id, 'the part ' || (o_custkey % 120) || ' of FIG. ' || (o_orderkey % 30) AS text, (o_custkey % 120)::VARCHAR AS label, (o_orderkey % 30)::VARCHAR AS fig FROM orders), a AS (SELECT page, (page % 11)::VARCHAR AS fig FROM (SELECT DISTINCT page FROM m)) SELECT DISTINCT answer_id, fig FROM (SELECT answer_id, fig FROM c WHERE fig IN (SELECT fig FROM a) UNION ALL SELECT answer_id, a.fig FROM c JOIN (SELECT DISTINCT numeral, page FROM m) m ON m.numeral = c.label OR m.numeral = c.fig JOIN a ON a.page = m.page)")
def i20_relevant_figures(spark, sf_dir):
    """Figures to show beside cited spans."""
    marks = _marks(spark, sf_dir)
    cited = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("answer_id"), F.concat(F.lit("the part "), (F.col("o_custkey") % 120).cast("string"), F.lit(" of FIG. "), (F.col("o_orderkey") % 30).cast("string")).alias("text"))
    sheets = marks.select("page", (F.col("page") % 11).cast("string").alias("fig")).distinct()
    return figures.relevant_figures(cited, sheets, marks, marks.select(F.col("numeral").alias("label")))


@query("SELECT s_suppkey::VARCHAR AS doc_id, '3' AS base, CASE WHEN s_suppkey % 2 = 0 THEN '2' ELSE '5' END AS parent FROM supplier WHERE s_suppkey % 3 <> 0")
def i21_parents(spark, sf_dir):
    """The figure that views are taken of (I21): the one their own sentence names next, if it names one."""
    k = F.col("s_suppkey")
    text = F.concat(F.lit("FIGS. 3 A-C are views of the pump"), F.when(k % 3 != 0, F.concat(F.lit(" of FIG. "), F.when(k % 2 == 0, "2").otherwise("5"))).otherwise(""), F.lit(". FIG. 7 shows more. FIG. 3A is turned."))
    docs = spans.make_documents(table(spark, sf_dir, "supplier").select(k.alias("doc_id"), text.alias("text")))
    return figures.sub_figure_parents(docs, patents.figure_references(docs))


@query(f"WITH {_MARKS}, j AS (SELECT row_number() OVER (ORDER BY mark_id, x, y) AS seq, CASE engine WHEN 'A' THEN 'REFUTE' WHEN 'N' THEN 'CORRECT' ELSE 'CONFIRM' END AS kind, page, numeral, x, y FROM m WHERE confidence >= 0.75), e AS (SELECT page, numeral, x, y, -1 AS born, 'read' AS method, mark_id AS source FROM m UNION ALL SELECT page, CASE kind WHEN 'CORRECT' THEN '7' ELSE numeral END, x, y, seq, 'human', seq FROM j WHERE kind <> 'REFUTE'), g AS (SELECT DISTINCT method, source FROM e JOIN j ON e.page = j.page AND e.numeral = j.numeral AND kind <> 'CONFIRM' AND abs(e.x - j.x) < 0.02 AND abs(e.y - j.y) < 0.02 AND seq > born) SELECT page, numeral, method, count(*) AS n FROM e ANTI JOIN g USING (method, source) GROUP BY ALL")
def i22_judged(spark, sf_dir):
    """Marks after refutations, corrections and confirmations in their order."""
    marks = _marks(spark, sf_dir)
    raw = relation(spark, sf_dir, "marks").where("confidence >= 0.75")
    from pyspark.sql import Window

    # a log has its numbers; here they are made of the marks
    seq = F.row_number().over(Window.orderBy("mark_id", "x", "y"))
    kind = F.when(F.col("engine") == "A", "REFUTE").when(F.col("engine") == "N", "CORRECT").otherwise("CONFIRM")
    judged = raw.select(seq.alias("seq"), kind.alias("kind"), "page", "numeral", "x", "y", F.lit("7").alias("new_numeral"))
    return figures.apply_judgments(marks, judged).groupBy("page", "numeral", "method").agg(F.count("*").alias("n"))


@query(f"WITH {_MARKS}, p AS (SELECT DISTINCT (o_custkey % 120)::VARCHAR AS label, o_orderkey % 97 AS page FROM orders) SELECT label, page FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.numeral = p.label AND m.page = p.page)")
def i24_confirm_targets(spark, sf_dir):
    predicted = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 120).cast("string").alias("label"), (F.col("o_orderkey") % 97).alias("page"))
    return figures.confirm_targets(predicted, _marks(spark, sf_dir))


@query(f"WITH {_MARKS}, c AS (SELECT mark_id AS cand_id, page, numeral, x + (mark_id % 3) / 64.0 AS x, y, engine = 'A' AS corroborated FROM m) SELECT cand_id, page, numeral, corroborated FROM c WHERE cand_id NOT IN (SELECT c.cand_id FROM c JOIN m ON m.page = c.page AND m.numeral = c.numeral AND abs(m.x - c.x) < 0.02 AND abs(m.y - c.y) < 0.02)")
def i25_sheet_audit(spark, sf_dir):
    """Candidates of a second reading without a mark near."""
    marks = _marks(spark, sf_dir)
    moved = (F.col("x") + (F.col("mark_id") % 3) / F.lit(64.0)).alias("x")
    engines = F.when(F.col("engines")[0] == "A", F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A"), F.lit("A")))
    candidates = marks.select(F.col("mark_id").alias("cand_id"), "page", "numeral", moved, "y", engines.alias("engines"))
    return figures.sheet_audit(candidates, marks)


@query("SELECT DISTINCT p_size || 'a' AS numeral, 'confusion' AS kind, p_size || '0' AS reading FROM part")
def i19_misreads(spark, sf_dir):
    """Labels read with an a for a 0."""
    size = table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("s")).distinct()
    none = spark.createDataFrame([], "numeral_a string, numeral_b string")
    return figures.likely_misreads(size.select(F.concat("s", F.lit("0")).alias("label")), size.select(F.concat("s", F.lit("a")).alias("numeral")), none)


@query("SELECT event_id AS seq, '{\"kind\":\"session_start\",\"label\":\"u' || user_id || '\"}' AS payload FROM events")
def j5_session_records(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), audit.session_start_record(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("payload"))


def _support_log(spark, sf_dir):
    hit = lambda n: F.struct(F.concat(F.lit("d@"), F.col("o_orderkey").cast("string"), F.lit(f"-{n}")).alias("span_id"), F.lit(n / 4).alias("score"))
    none = F.slice(F.array(hit(1)), 1, 0)
    ok = F.col("o_orderkey") % 2 == 0
    made = audit.support_record("check_support", F.concat(F.lit("q "), F.col("o_custkey").cast("string")), F.when(ok, "supported").otherwise("insufficient"), F.when(ok, F.array(hit(3))).otherwise(none), F.when(ok, none).otherwise(F.array(hit(1), hit(2))), 15.0)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), made.alias("payload"))


@query("""SELECT o_orderkey AS seq, '{"kind":"check_support","query":"q ' || o_custkey || '","status":"' || CASE WHEN o_orderkey % 2 = 0 THEN 'supported","supporting":[{"span_id":"d@' || o_orderkey || '-3","score":0.75}],"closest":[]' ELSE 'insufficient","supporting":[],"closest":[{"span_id":"d@' || o_orderkey || '-1","score":0.25},{"span_id":"d@' || o_orderkey || '-2","score":0.5}]' END || ',"provenance":{"contract":"1","retrieval":"bm25","threshold":15.0}}' AS payload FROM orders""")
def j5_support_records(spark, sf_dir):
    """Payloads of support decisions."""
    return _support_log(spark, sf_dir)


@query("SELECT o_orderkey AS seq, 'q ' || o_custkey AS query, 'd@' || o_orderkey || '-' || n AS span_id, n / 4.0 AS score FROM orders, (VALUES (1), (2)) v(n) WHERE o_orderkey % 2 <> 0")
def j13_rejected(spark, sf_dir):
    """Closest spans of declined decisions, read from the log."""
    return audit.rejected_candidates(_support_log(spark, sf_dir))


@query("WITH r AS (SELECT event_id AS seq, user_id, CASE event_type WHEN 'view' THEN 'measurement only' ELSE 'both' END AS reading FROM events) SELECT user_id::VARCHAR AS label FROM r GROUP BY user_id HAVING arg_max(reading, seq) = 'measurement only'")
def j10_excluded(spark, sf_dir):
    """Labels whose last reading rules them measurements."""
    user = F.col("user_id").cast("string")
    readings = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("sense:"), user).alias("amb_id"), user.alias("label"), F.when(F.col("event_type") == "view", "measurement only").otherwise("both").alias("reading"))
    return audit.excluded_numerals(readings)


@query("SELECT o_orderkey AS answer_id, CASE WHEN o_orderkey % 4 = 0 THEN 'abstain' WHEN o_orderstatus = 'F' THEN 'unverified' ELSE 'answer' END AS kind FROM orders")
def f16_withheld(spark, sf_dir):
    """Answers that no longer hold are withheld (F16)."""
    rows = table(spark, sf_dir, "orders")
    shown = rows.select(F.col("o_orderkey").alias("answer_id"), F.when(F.col("o_orderkey") % 4 == 0, "abstain").otherwise("answer").alias("kind"))
    return audit.withheld(shown, rows.select(F.col("o_orderkey").alias("answer_id"), (F.col("o_orderstatus") != "F").alias("ok")))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS rank, o_orderkey AS item_id, o_orderpriority AS expected FROM orders WHERE o_orderstatus = 'F'")
def k5_failures(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("expected"), (F.col("o_orderstatus") != "F").alias("decision_correct"))
    return scoring.failures(rows)


@query("SELECT doc_id::VARCHAR AS doc_id, strpos(text, q) - 1 AS char_start, strpos(text, q) - 1 + length(q) AS char_end FROM (SELECT doc_id, text, string_split(text, ' ')[1] AS q FROM documents) WHERE q <> '' AND (length(text) - length(replace(text, q, ''))) / length(q) = 1")
def k2_gold_spans(spark, sf_dir):
    """Gold quotes that occur once (K2): here the first word of each document."""
    docs = _docs(spark, sf_dir)
    quotes = docs.select(F.col("doc_id").alias("item_id"), "doc_id", F.get(F.split("canonical_text", " "), F.lit(0)).alias("quote")).where("quote <> ''")
    return scoring.gold_spans(docs, quotes).drop("item_id")


@query("""SELECT sha256(string_agg('{"id":' || item_id || ',"n":' || length(text) || '}', chr(10) ORDER BY item_id)) AS manifest_sha256 FROM benchmark""")
def k8_manifest(spark, sf_dir):
    """Hash of the canonical JSON of items in order (K8)."""
    rows = table(spark, sf_dir, "benchmark")
    return scoring.manifest_hash(rows.select("item_id", F.to_json(F.struct(F.col("item_id").alias("id"), F.length("text").alias("n"))).alias("canonical")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '1,200 5,000' WHEN o_orderkey % 3 = 1 THEN 'in ' || o_custkey ELSE NULL END AS strings FROM orders")
def k13_evidence(spark, sf_dir):
    """Strings that evidence must hold."""
    k = F.col("o_orderkey")
    found = scoring.evidence_strings(F.when(k % 3 == 0, "5,000 and 1,200, 5,000"), F.when(k % 3 == 1, F.concat(F.lit(" in "), F.col("o_custkey").cast("string"), F.lit("."))))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.size(found) > 0, F.array_join(found, " ")).alias("strings"))


@query(f"WITH {_MARKS} SELECT numeral, page, x, y FROM m QUALIFY row_number() OVER (PARTITION BY numeral ORDER BY page, y DESC, x, mark_id) = 1")
def l2_first_sightings(spark, sf_dir):
    return layout.first_sightings(_marks(spark, sf_dir))


@query("SELECT DISTINCT s_suppkey::VARCHAR AS doc_id, (s_suppkey % 50 + 10)::VARCHAR AS label, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS n_quantities FROM supplier WHERE s_suppkey % 2 = 0")
def l3_two_senses(spark, sf_dir):
    """Labels that a text also uses as a quantity (L3)."""
    k = F.col("s_suppkey")
    n = (k % 50 + 10).cast("string")
    text = F.concat(F.lit("The scrubber "), n, F.lit(" turns. Its size is "), F.when(k % 2 == 0, n).otherwise("9"), F.lit(" inches"), F.when(k % 3 == 0, F.concat(F.lit(" or "), n, F.lit(" mm."))).otherwise("."))
    docs = spans.make_documents(table(spark, sf_dir, "supplier").select(k.alias("doc_id"), text.alias("text")))
    found = patents.quantity_uses(docs, patents.numeral_mentions(docs))
    return found.where(F.col("doc_id").cast("long") % 2 == 0).select("doc_id", "label", F.col("n_quantities").cast("int").alias("n_quantities"))


_CITED = "r AS (SELECT DISTINCT o_custkey AS doc_id, o_orderkey * 13 % 100000 AS a FROM orders)"


@query(f"WITH m AS ({R['mentions']}), {_CITED} SELECT DISTINCT m.doc_id, label FROM m JOIN r ON m.doc_id = r.doc_id::VARCHAR AND a <= pos AND pos < a + 3000")
def m5_attached(spark, sf_dir):
    """Labels mentioned in cited ranges (M5)."""
    start = F.col("o_orderkey") * 13 % 100000
    cited = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), start.alias("char_start"), (start + 3000).alias("char_end")).distinct()
    return layout.attached_labels(relation(spark, sf_dir, "mentions"), cited)


@query("SELECT o_orderkey AS doc_id, (o_custkey % 30)::INT AS pos, CASE WHEN o_custkey % 30 < 10 THEN o_orderkey || ':0' WHEN o_custkey % 30 < 15 THEN '' WHEN o_custkey % 30 < 25 THEN o_orderkey || ':15' ELSE '' END AS seg_id FROM orders")
def m6_segments(spark, sf_dir):
    """The painted segment that holds an offset (M6)."""
    rows = table(spark, sf_dir, "orders")
    painted = rows.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(a).alias("char_start"), F.lit(b).alias("char_end")) for a, b in ((0, 10), (15, 25))])).alias("s")).select("doc_id", "s.*")
    return layout.segment_at(painted, rows.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 30).cast("int").alias("pos")))


@query("SELECT 'd' AS doc_id, o_orderkey AS answer_id, role, CASE WHEN role = 'locator' THEN o_orderkey % 3 <> 1 ELSE o_orderkey % 3 = 0 END AS covered FROM orders, (VALUES ('subject'), ('locator')) v(role)")
def g2_answer_coverage(spark, sf_dir):
    """What answers ask for, covered by the spans that hold what they cite."""
    k = F.col("o_orderkey")
    # three spans, one in each unit; the third unit incorporates the first
    held = spark.createDataFrame([("d@0-9", "d", 0, 9, "red wheel"), ("d@10-19", "d", 10, 19, "blue seat"), ("d@20-29", "d", 20, 29, "green bar")], "span_id string, doc_id string, char_start int, char_end int, text string")
    units = spark.createDataFrame([("d", "claim 1", None, 0, 10), ("d", "claim 2", None, 10, 20), ("d", "claim 3", "claim 1", 20, 30)], "doc_id string, name string, parent string, char_start int, char_end int")
    rows = table(spark, sf_dir, "orders")
    atom = F.struct(F.lit("x").alias("text"), F.lit("d").alias("doc_id"), ((k % 3) * 10 + 2).cast("int").alias("char_start"), ((k % 3) * 10 + 4).cast("int").alias("char_end"))
    none = F.slice(F.array(F.struct(F.slice(F.array(atom), 1, 0).alias("operands"))), 1, 0)
    answers = rows.select(k.alias("answer_id"), F.array(F.struct(F.lit("s").alias("text"), F.array(atom).alias("atoms"), none.alias("derived"))).alias("sentences"))
    asked = rows.select(k.alias("answer_id"), F.explode(F.array(F.struct(F.lit("subject").alias("role"), F.lit("Red  WHEEL").alias("text")), F.struct(F.lit("locator").alias("role"), F.lit("as claim 3 says").alias("text")))).alias("c"))
    asked = asked.select("answer_id", "c.role", "c.text", F.lit(True).alias("required"))
    return frames.answer_coverage(answers, asked, held, units).select(F.lit("d").alias("doc_id"), "answer_id", "role", "covered")
