"""Toxicity, revisits, licenses, decontamination, mixing, rollups and the pipeline, with odd inputs."""

import math
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.errors import PySparkException

from veridoc.llm import common
from veridoc.llm.decontaminate import MASKS, clean_documents, contamination
from veridoc.llm.licenses import TEMPLATES, Scanner, align, rising, scan_licenses
from veridoc.llm.mixing import mix
from veridoc.llm.token_rollups import TokenRollups
from veridoc.llm.toxicity import BlockMaxIndex, keep_harmless, score_toxicity, term_counts
from veridoc.llm.warc import canonical_url, resolve_revisits

DOCS = "doc_id long, text string, lang string, source string, score int"


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{chr(97 + rng.randrange(26))}{rng.randrange(vocabulary)}x" for _ in range(n))


def letters(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 5))) for _ in range(n))


def test_block_max_index_is_exact():
    rng = random.Random(1)
    vectors = []
    for _ in range(400):
        v = {rng.randrange(30): rng.random() for _ in range(rng.randrange(0, 6))}
        size = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / size for t, x in v.items()})
    arrays = [(np.array(sorted(v), np.int64), np.array([v[t] for t in sorted(v)], float)) for v in vectors]
    index = BlockMaxIndex(arrays, 31, block=16)
    for q, (terms, weights) in zip(vectors[:60], arrays, strict=False):
        e, s = index.nearest(terms, weights, 10)
        every = sorted((sum(x * v.get(t, 0) for t, x in q.items()) for v in vectors), reverse=True)
        every = [x for x in every if x > 0]
        kth = every[min(10, len(every)) - 1] if every else 0
        assert len(e) == sum(x >= kth - 1e-9 for x in every)
        assert [round(x, 7) for x in s] == [round(x, 7) for x in every[: len(s)]]


def plain_toxicity(rows, labels, k=25):
    """Scores by definition: all terms of the labelled texts, cosines with every example, votes, pooled shares."""
    held = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 4 == 2}
    examples = [(d, t) for d, t in sorted(rows) if d in labels and d not in held]
    y = [labels[d] for d, _ in examples]
    counts = [term_counts(t) for _, t in examples]
    vocabulary = {t for c in counts for t in c}
    n, toxic, weight = len(examples), sum(y), {}
    every = [term_counts(t) for _, t in rows]
    for t in vocabulary:
        a, b = sum(u for c, u in zip(counts, y, strict=True) if t in c), sum(t in c for c in counts)
        by = b * (n - b) * toxic * (n - toxic)
        weight[t] = (math.log((1 + len(rows)) / (1 + sum(t in c for c in every))) + 1) * (0.01 + 0.99 * ((a * n - b * toxic) ** 2 / by if by else 0))

    def unit(c):
        w = {t: (1 + math.log(x)) * weight[t] for t, x in c.items() if t in weight}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    units = [unit(c) for c in counts]

    def vote(c, skip=None):
        q = unit(c)
        near = sorted(((min(1.0, sum(x * v.get(t, 0) for t, x in q.items())), i) for i, v in enumerate(units) if i != skip), reverse=True)
        near = [(s, i) for s, i in near if s > 0]
        near = [(s, i) for s, i in near if s >= near[min(k, len(near)) - 1][0] - 1e-9]
        return sum(y[i] / (1.05 - s) for s, i in near) / sum(1 / (1.05 - s) for s, i in near) if near else 0.0

    base = (toxic + 1) / (n + 2)
    votes = sorted((vote(c, i), y[i]) for i, c in enumerate(counts))
    pools = []
    for v, u in votes:
        if pools and pools[-1][2] == v:
            pools[-1][0] += u
            pools[-1][1] += 1
        else:
            pools.append([u, 1, v, v])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            u2, n2, _, v2 = pools.pop()
            pools[-1] = [pools[-1][0] + u2, pools[-1][1] + n2, pools[-1][2], v2]
    out = {}
    for (d, _), c in zip(rows, every, strict=True):
        v = vote(c)
        at = max([i for i, p in enumerate(pools) if p[2] <= v + 1e-9], default=0)
        out[d] = (pools[at][0] + base) / (pools[at][1] + 1)
    return out


def test_scores_by_definition(spark):
    rng = random.Random(22)
    rows, labels = [], {}
    for i in range(240):
        toxic = i % 4 == 0
        words = letters(rng, rng.randrange(5, 60)).split() + ([f"snarg{rng.choice('aeiou')}"] if toxic and rng.random() < 0.9 else []) + (["snack"] if rng.random() < 0.2 else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        if i % 3:
            labels[i] = int(toxic)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    want = plain_toxicity(rows, labels)
    got = {r.doc_id: r.score for r in score_toxicity(docs, marks).collect()}
    assert got.keys() == want.keys() and sum(abs(got[d] - want[d]) < 1e-9 for d in got) >= 0.99 * len(got)


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = letters(rng, 40) + (f" grumbol{rng.choice(['en', 'ing', 'a', ''])} zankful!" if toxic else "")
        rows.append((i, text, "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 1), (1002, "GRUMBOLSOME " + letters(rng, 9000), "en", "s", 1), (None, "zankful", "en", "s", 1), (5, rows[5][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([*labels, (0, 1, None), (2000, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = score_toxicity(docs, marks).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in range(900):
        assert by[i].predicted == int(i % 5 == 0) and by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert by[1002].predicted == 1 and by[None].predicted == 1 and by[1000].score == by[1001].score < 0.1
    assert by[1002].evidence_ids and not by[1001].evidence_ids
    kept = keep_harmless(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(900) if i % 5} | {1000, 1001}
    assert {r.score for r in score_toxicity(docs, marks.limit(0)).collect()} == {0.5}
    assert score_toxicity(docs.limit(0), marks).count() == 0


def test_canonical_urls(spark):
    pairs = {"HTTP://WWW.A.example:80/Path/?utm_source=x&b=1#top": "a.example/Path?b=1", "https://a.example": "a.example", "a.example/": "a.example", "https://b.example/x?utm_a=1": "b.example/x", None: None, "": ""}
    rows = spark.createDataFrame([(k,) for k in pairs], "u string")
    assert {r.u: r.c for r in rows.select("u", canonical_url(rows.u).alias("c")).collect()} == pairs


REC = "record_id long, url string, at long, kind string, status int, headers map<string,string>, base string"


def test_revisits(spark):
    u = "http://a.example/p"
    rows = [
        (1, u, 10, "response", 200, {"ETag": '"x"', "Content-Type": "text/html", "Date": "d1"}, None),
        (2, u + "#f", 20, "response", 404, {"ETag": '"n"'}, None),
        (3, u, 30, "revisit", 304, {"etag": 'W/"x"', "Date": "d3", "Content-Type": "evil"}, None),
        (4, u, 40, "response", 200, {"ETag": '"y"', "Last-Modified": "m"}, None),
        (5, u, 50, "revisit", 304, {"ETag": '"x"'}, None),
        (6, u, 60, "revisit", 304, {"Last-Modified": "m"}, None),
        (7, u, 70, "revisit", 304, None, None),
        (8, u, 5, "revisit", 304, {"ETag": '"x"'}, None),
        (9, None, 90, "revisit", 304, {}, None),
        (10, u, None, "revisit", 304, {}, None),
        (11, u, 10, "revisit", 304, {"ETag": '"x"'}, None),
        (12, u, 80, "request", None, {}, None),
    ]
    got = {r.record_id: r for r in resolve_revisits(spark.createDataFrame(rows, REC)).collect()}
    assert {k: (r.response_id, r.outcome) for k, r in got.items()} == {3: (1, "resolved"), 5: (4, "changed"), 6: (4, "resolved"), 7: (4, "unvalidated"), 8: (None, "orphan"), 9: (None, "orphan"), 10: (None, "orphan"), 11: (1, "resolved")}
    assert got[3].headers == {"etag": 'W/"x"', "date": "d3", "content-type": "text/html"} and got[5].headers is None
    assert resolve_revisits(spark.createDataFrame([], REC)).count() == 0


def test_revisits_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        url = "http://hot.example/" if rng.random() < 0.4 else f"http://h{rng.randrange(40)}.example/"
        rows.append((i, url, rng.randrange(900), rng.choice(["response", "revisit"]), rng.choice([200, 206, 500]), {"etag": str(rng.randrange(2))}, None))
    got = {r.record_id: r.response_id for r in resolve_revisits(spark.createDataFrame(rows, REC)).collect()}
    for r in rows:
        if r[3] == "revisit":
            earlier = [(o[2], o[0]) for o in rows if o[3] == "response" and o[4] < 300 and o[1] == r[1] and (o[2], o[0]) < (r[2], r[0])]
            assert got[r[0]] == (max(earlier)[1] if earlier else None)


def test_patience_alignment():
    assert [[5, 1, 2, 9, 3][i] for i in rising([5, 1, 2, 9, 3])] == [1, 2, 3] and rising([]) == []
    a, b = "the a b the c d the e".split(), "the a x the c the e".split()
    pairs = align(a, b)
    assert pairs == sorted(pairs) and all(a[i] == b[j] for i, j in pairs) and len(pairs) == 6


def test_licenses(spark):
    rng = random.Random(4)
    mit = TEMPLATES["MIT"].replace("sublicense", "relicense").replace("merge", "fuse")
    rows = [(1, f"{prose(rng, 50)} {mit}\n{prose(rng, 20000)} {TEMPLATES['MIT-line']} {TEMPLATES['MIT-line']}"), (2, prose(rng, 100)), (3, None), (4, ""), (5, "released the under license mit " * 3), (6, TEMPLATES["ISC"][:90])]
    got = scan_licenses(spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS)).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "MIT"), (1, "MIT-line"), (1, "MIT-line")]
    assert next(r for r in got if r.license == "MIT").coverage > 0.95
    assert Scanner({"empty": ""}).scan("words") == []
    for name, text in TEMPLATES.items():
        assert name in {h[0] for h in Scanner(TEMPLATES).scan(f"x y {text} z")}
    assert scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


def test_changed_licenses_in_common_words():
    rng = random.Random(14)
    common = " ".join(rng.choice("the of to and is in a this you any for it that be by".split()) for _ in range(400))
    scanner = Scanner(TEMPLATES)
    assert ("MIT-line", 0.8, 0, 4) in scanner.scan("Released under the BSD License the cat under the tree the dog of the house " + common)
    for name in ("MIT", "GPL-3.0-or-later", "Apache-2.0", "ISC"):
        words = TEMPLATES[name].split()
        changed = [f"x{i}" if i % 7 == 3 else w for i, w in enumerate(words)]
        for text, n in ((changed, 1), (changed + changed, 2), (changed + words, 2), (words + changed, 2)):
            hits = [h for h in scanner.scan(f"{common} {' '.join(text)} {common}") if h[0] == name]
            assert len(hits) == n and all(h[1] >= 0.8 for h in hits), (name, n, hits)


@pytest.mark.parametrize("seeds", [500_000, 0])
def test_decontamination(spark, seeds):
    rng = random.Random(5)
    items = [prose(rng, n) for n in (15, 24, 30, 40)] + ["too short", "", None]
    changed = items[3].split()
    for i in (4, 13, 22, 31, 37):
        changed[i] = "other"
    half = items[2].split()
    rows = [(1, f"{prose(rng, 40)} {items[0].upper()}, {prose(rng, 9000)}"), (2, " ".join(changed)), (3, " ".join(half[:9]) + prose(rng, 50)), (4, None), (5, ""), (6, prose(rng, 300)), (7, f"{items[1]}\n{items[2]}"), (7, "another text"), (None, items[3]), (8, " ".join(half[:24]))]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = [(r.doc_id, r.contaminated, tuple(r.item_ids)) for r in contamination(docs, bench, broadcast_seeds=seeds).collect()]
    want = [(1, True, (0,)), (2, True, (3,)), (3, False, ()), (4, False, ()), (5, False, ()), (6, False, ()), (7, True, (1, 2)), (7, False, ()), (None, True, (3,)), (8, True, (2,))]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = clean_documents(docs, bench, broadcast_seeds=seeds)
    assert kept.columns == docs.columns and sorted(r.text or "" for r in kept.collect()) == sorted(rows[i][1] or "" for i in (2, 3, 4, 5, 7))
    assert clean_documents(docs, bench.limit(0)).count() == len(rows) and contamination(docs.limit(0), bench).count() == 0


def test_clean_documents_shuffle_no_texts(spark):
    """Whatever joins Spark would choose by itself; beyond the bound both sides are shuffled, with the same rows."""
    rng = random.Random(6)
    items = [prose(rng, 30) for _ in range(3)]
    rows = [(i % 50 if i % 7 else None, f"{prose(rng, 60)} {items[i % 3] if i % 4 == 0 else ''}") for i in range(80)] + [(90, None), (91, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = clean_documents(docs, bench)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
        want = sorted((str(d), str(t)) for i, (d, t) in enumerate(rows) if i % 4 or i >= 80)
        for out in (kept, clean_documents(docs, bench, broadcast_hits=19)):
            assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_masks_leave_no_place_to_substitutions():
    for width in range(1, 21):
        spots = [{i + o for i, c in enumerate(m) if c == "1"} for m, lo, hi in MASKS if lo <= width <= hi for o in range(width - len(m) + 1)]
        assert all(any(not s.intersection(gone) for s in spots) for gone in combinations(range(width), width // 5)), width


@pytest.mark.parametrize("seeds", [500_000, 0])
def test_decontamination_of_short_items_and_any_substitution(spark, seeds):
    rng = random.Random(16)
    items = [prose(rng, n, 10**6) for n in (1, 3, 4, 5, 7, 9, 10, 12, 15, 20)]
    rows = []
    for i, text in enumerate(items):
        words = text.split()
        places = list(combinations(range(len(words)), len(words) // 5))
        for gone in [(), *rng.sample(places, min(5, len(places)))]:
            changed = ["other" if j in gone else w for j, w in enumerate(words)]
            rows.append((len(rows), f"{prose(rng, 9, 10**6)} {' '.join(changed)} {prose(rng, 9, 10**6)}", i))
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t, _ in rows], DOCS)
    bench = spark.createDataFrame([(i if i != 8 else None, t) for i, t in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, list(r.item_ids)) for r in contamination(docs, bench, broadcast_seeds=seeds).collect()}
    assert got == {d: (True, [i] if i != 8 else []) for d, _, i in rows}


def plain_targets(sizes, weights=(1, 2, 3)):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, total = {}, set(order), sum(sizes.values())
    while True:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not full:
            return target | share
        target |= {s: 3 * sizes[s] for s in full}
        open_ -= full


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(0, 60)), "en", rng.choice(["b", "b", "b", "b", "a", "c", "d", None]), 1) for i in range(500)]
    rows += [(500, None, "en", "z", 1), (501, "", "en", "a", 1), (None, "one two", "en", "b", 1), (3, rows[3][1], "en", rows[3][3], 1), (502, prose(rng, 5000), "en", "tiny", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mix(docs).collect()
    assert len(got) == len(rows) and mix(docs).columns == [*docs.columns, "size", "source_size", "target", "taken"]
    sizes, taken = {}, {}
    for r in got:
        assert r.size == len((r.text or "").split()) and 0 <= r.taken <= 3 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mix(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert "text" not in mix(docs, carry=False).columns and mix(docs.limit(0)).count() == 0


def test_mix_does_not_depend_on_group_size(spark, monkeypatch):
    from veridoc.llm import mixing

    docs = spark.createDataFrame([(i, "w " * (i % 9), "en", "ab"[i % 2], 1) for i in range(300)], DOCS)
    one = sorted(map(str, mix(docs).collect()))
    monkeypatch.setattr(mixing, "GROUP", 2)
    assert sorted(map(str, mix(docs).collect())) == one


CHANGES = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"


def test_rollups(spark, tmp_path):
    rollups = TokenRollups(spark, str(tmp_path / "state"))
    assert rollups.totals().count() == 0
    load = spark.createDataFrame([("insert", "a", "en", "t1", 10, None), ("insert", "a", "en", "t1", 5, None), ("insert", None, "en", "t1", 7, None), ("insert", "b", None, "t1", None, None)], CHANGES)
    assert rollups.commit("b1", load) and not rollups.commit("b1", load)
    assert rollups.commit("b2", spark.createDataFrame([("revise", "a", "en", "t1", 12, 10), ("delete", None, "en", "t1", 7, None)], CHANGES))
    assert rollups.commit("empty", spark.createDataFrame([], CHANGES))
    assert {(r.source, r.lang, r.n_docs, r.n_tokens) for r in rollups.totals().collect()} == {("a", "en", 2, 17), ("b", None, 1, 0)}
    assert TokenRollups(spark, str(tmp_path / "state")).batches() == ["b1", "b2", "empty"]
    with pytest.raises(PySparkException):
        rollups.commit("bad", spark.createDataFrame([("upsert", "a", "en", "t1", 1, 1)], CHANGES))
    with pytest.raises(ValueError):
        rollups.commit("../x", load)
    assert rollups.batches() == ["b1", "b2", "empty"]


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mix"]
    assert 0 < len(rows) < docs.count() and len({r.doc_id for r in rows}) == len(rows)
    assert out.columns[: len(docs.columns)] == docs.columns and all(r.taken > 0 for r in rows)
    lines = [line for r in rows for line in r.text.split("\n") if any(c.isalnum() for c in line)]
    assert len({" ".join("".join(c if c.isalnum() else " " for c in line.lower()).split()) for line in lines}) == len(lines)


def test_heap_is_given_back_between_steps(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(common, "release", asked.append)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    runtime, held = jvm.Runtime.getRuntime(), []
    while 2 * runtime.totalMemory() <= runtime.maxMemory():
        held.append(jvm.java.nio.ByteBuffer.allocate(64 << 20))
    assert common.materialize(spark.range(3)).count() == 3
    for buffer in held:
        gateway.detach(buffer)
    assert asked == [spark]
