"""SimHash, substring, line and embedding deduplication against brute force, and their odd inputs."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from veridoc.llm import lines, substrings
from veridoc.llm.common import connected_components
from veridoc.llm.embeddings import near_duplicates as near_vectors
from veridoc.llm.lines import deduplicate_lines
from veridoc.llm.simhash import BKTree, fingerprint, fingerprint_links, keep_one_each, near_duplicates, tree_links
from veridoc.llm.substrings import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, n_words int"


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 500: 500}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_edges_take_one_task_a_round(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(900, 900), (950, 951)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(4)

    def run(few):
        spark.sparkContext.setJobGroup(f"few {few}", "")
        got = dict(connected_components(frame, few=few).collect())
        told = spark.sparkContext.statusTracker()
        stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup(f"few {few}") for s in told.getJobInfo(j).stageIds]
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return got, sum(s.numTasks for s in stages if s)

    dealt, many = run(0)
    alone, few = run(200_000)
    assert alone == dealt == components({n for e in edges for n in e}, edges)
    assert few < many / 2


def test_fingerprint_by_definition():
    for text in ("", None, "  \n", "One", "one two", "ONE two three four É é", "a b c " * 300, prose(random.Random(3), 5000)):
        assert fingerprint(text) == plain_fingerprint(text)


def test_tree_finds_all_within():
    rng = random.Random(1)
    values = [rng.getrandbits(12) for _ in range(300)]
    tree = BKTree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.nodes[i][0] for i in tree.within(q, 2)) == sorted({v for v in values if (v ^ q).bit_count() <= 2})


def flipped(rng, value, n, width=64):
    for b in rng.sample(range(width), n):
        value ^= 1 << b
    return value


@pytest.mark.parametrize("max_tree", [3, 20, 2048])
def test_fingerprint_links_connect_all_within_two(spark, max_tree):
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values):
        values |= {flipped(rng, v, rng.choice((1, 2, 3))) for _ in range(3)}
    values |= {0, 1 << 63, 3, (1 << 64) - 1}
    signed = [v - (v >> 63 << 64) for v in values]
    links = fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), max_tree=max_tree).collect()
    close = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert components(signed, [(r.a, r.b) for r in links]) == components(signed, close)
    assert tree_links([5], 2) == []


def test_simhash_near_duplicates(spark):
    rng = random.Random(4)
    base = prose(rng, 300)
    rows = [(7, base), (9, base + " tail"), (3, prose(rng, 50)), (11, None), (12, ""), (13, " \n"), (4, "Short"), (4, "Short"), (None, base)]
    docs = spark.createDataFrame([(d, t, "en", 1) for d, t in rows], DOCS)
    got = near_duplicates(docs).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    named = {}
    for i, j in components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]).items():
        named.setdefault(j, []).append(rows[i][0])
    want = sorted((str(d), f"{f:016x}", str(min(x for x in group if x is not None))) for group_root, group in named.items() for (d, _), f in [(rows[i], fps[i]) for i in range(len(rows)) if rows[i][0] in group and components(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])[i] == group_root])
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    kept = keep_one_each(docs)
    assert kept.columns == docs.columns
    assert len({r.text for r in kept.collect() if r.doc_id == 4}) == 1 and kept.where("doc_id = 4").count() == 1
    assert near_duplicates(docs.limit(0)).count() == 0


def test_pipeline_stage_keeps_one_of_similar_texts(spark):
    import corpus_pipeline

    rng = random.Random(15)
    rows = []
    for n, changes in ((6, 1), (60, 1), (100, 1), (200, 1), (200, 4), (500, 5), (1000, 20), (300, 30)):
        words = prose(rng, n, 9000).split()
        for _ in range(6):
            changed = list(words)
            for i in rng.sample(range(n), changes):
                changed[i] = f"v{rng.randrange(10**6)}"
            rows.append(" ".join(changed))
    rows += [None, "", " ", "Short one", "short ONE", rows[0]]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame([(d, t, "en", 1) for d, t in enumerate(rows)], DOCS)
    kept = corpus_pipeline._stage_simhash(spark, docs, "")
    assert kept.columns == docs.columns and len(linked) > 40
    assert {r.doc_id for r in kept.collect()} == set(components(range(len(rows)), linked).values())
    assert corpus_pipeline._stage_simhash(spark, docs.limit(0), "").count() == 0


def plain_repeats(rows, window=20):
    seen, out = {}, {}
    for d, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        own = {}
        for i in range(len(words) - window + 1):
            k = tuple(words[i : i + window])
            if k in own or k in seen:
                gone[i : i + window] = [True] * window
            own.setdefault(k, d)
        for k in own:
            seen.setdefault(k, d)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[d] = (len(words), len(words) - len(kept), " ".join(kept))
    return out


@pytest.mark.parametrize("contexts", [2, 4096])
def test_substrings_against_brute_force(spark, contexts, monkeypatch):
    monkeypatch.setattr(substrings, "MAX_CONTEXTS", contexts)
    rng = random.Random(5)
    passages = [prose(rng, n, 5000) for n in (19, 20, 21, 35, 80, 200)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 30), 5000) if rng.random() < 0.5 else rng.choice(passages) for _ in range(rng.randrange(0, 7))]
        cut = rng.choice(passages).split()
        a = rng.randrange(len(cut))
        rows.append((i * 3 % 61, "\t".join([*parts, *cut[a : a + rng.randrange(40)]])))
    rows += [(100, "the " * 300), (101, "the " * 25), (102, None), (103, ""), (104, "a b " * 4000), (None, passages[4])]
    docs = spark.createDataFrame([(d, t, "en", 1) for d, t in rows], DOCS)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in remove_repeats(docs).collect()}
    want = plain_repeats(rows)
    assert {d: (a, b, c or "") for d, (a, b, c) in got.items()} == want
    assert got[102][2] is None and remove_repeats(docs).columns == ["doc_id", "text", "lang", "n_words", "n_removed"]
    assert remove_repeats(docs.limit(0)).count() == 0


def test_automaton_knows_first_documents():
    rng = random.Random(6)
    texts = [[rng.randrange(3) for _ in range(rng.randrange(5, 40))] for _ in range(30)]
    automaton = substrings.SuffixAutomaton()
    for d, t in enumerate(texts):
        automaton.add(t, d)
    probe = texts + [[rng.randrange(4) for _ in range(30)] for _ in range(10)]
    for t in probe:
        want = [next((d for d, other in enumerate(texts) if any(other[k : k + 5] == t[i : i + 5] for k in range(len(other) - 4))), None) for i in range(len(t) - 4)]
        assert automaton.first_documents(t, 5) == want


def test_equal_ids_do_not_precede_each_other(spark):
    passage = prose(random.Random(7), 40)
    got = remove_repeats(spark.createDataFrame([(1, passage, "en", 1), (1, passage, "en", 1), (2, passage + " end", "en", 1)], DOCS)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 40)]


def test_lines_exact_and_fuzzy(spark):
    rng = random.Random(8)
    long = prose(rng, 80, 9000)
    near = long.replace(long.split()[40], "changed", 1)
    rows = [(2, f"{long}\nonly here\n\n---"), (1, f"Intro line one\n{near}"), (3, f"INTRO, line one!\n{long}\n---"), (4, None), (5, ""), (6, "only here\r\nonly here")]
    docs = spark.createDataFrame([(d, t, "en", 1) for d, t in rows], DOCS)
    out = deduplicate_lines(docs)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out.collect()}
    assert out.columns == ["doc_id", "text", "lang", "n_words", "n_lines", "n_removed"]
    assert got[1] == (f"Intro line one\n{near}", 2, 0)
    linked = (plain_line_simhash(long) ^ plain_line_simhash(near)).bit_count() <= 3
    assert linked and got[2] == ("only here\n\n---", 4, 1)
    assert got[3] == ("---", 3, 2)
    assert got[4] == (None, 0, 0) and got[5] == ("", 1, 0) and got[6] == ("", 2, 2)
    assert deduplicate_lines(docs.limit(0)).count() == 0


def plain_line_simhash(norm):
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in set(norm.split(" "))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_line_simhash_for_any_length(spark):
    rng = random.Random(9)
    texts = [prose(rng, n, 10**6) for n in (1, 2, 5, 63, 64, 70, 500, 17000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.id: r.fp & (1 << 64) - 1 for r in lines.occurrences(docs, "doc_id", "text").collect()}
    assert got == {i: plain_line_simhash(t) for i, t in enumerate(texts)}


def test_line_groups_against_brute_force(spark):
    rng = random.Random(10)
    rows = []
    for i in range(25):
        words = prose(rng, rng.randrange(20, 60), 9000).split()
        for _ in range(4):
            changed = list(words)
            if rng.random() < 0.7:
                changed[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
            rows.append(" ".join(changed))
    rng.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    fps = [plain_line_simhash(t) for t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i] == rows[j] or ((fps[i] ^ fps[j]).bit_count() <= 3 and levenshtein(rows[i], rows[j]) <= int(max(len(rows[i]), len(rows[j])) * 0.2 + 1e-9))]
    want = {i: int(i != root) for i, root in components(range(len(rows)), linked).items()}
    assert any(rows[i] != rows[j] for i, j in linked)
    assert {r.doc_id: r.n_removed for r in deduplicate_lines(docs).collect()} == want


def test_many_near_equal_lines_stay_connected(spark):
    rng = random.Random(11)
    words = prose(rng, 200, 9000).split()
    rows = []
    for i in range(80):
        changed = list(words)
        changed[100] = f"v{i}"
        rows.append((i, " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [plain_line_simhash(t) for _, t in rows]
    roots = components(range(80), [(i, j) for j in range(80) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 3])
    want = {i: int(i != root) for i, root in roots.items()}
    for block in (2, 8, 200):
        assert {r.doc_id: r.n_removed for r in deduplicate_lines(docs, block=block).collect()} == want


def test_hot_block_loses_no_link(spark):
    rng = random.Random(21)
    low = rng.getrandbits(26)
    strangers = [rng.getrandbits(38) << 26 | low for _ in range(40)]
    near = [flipped(rng, v >> 26, 3, 38) << 26 | low for v in strangers]  # 40 pairs at 3 bits, all 80 in one block
    rows = [(i, v - (v >> 63 << 64)) for i, v in enumerate(strangers + near)]
    pairs = lines.candidate_pairs(spark.createDataFrame(rows, "k long, fp long")).collect()
    assert {(r.a, r.b) for r in pairs} >= {(i, i + 40) for i in range(40)}


@pytest.mark.parametrize(("cell", "chosen"), [(3, None), (1024, 2), (1024, 3), (1024, 5)])
def test_line_candidates_are_all_pairs_within_the_radius(spark, cell, chosen, monkeypatch):
    monkeypatch.setattr(lines.apart_pairs, "__defaults__", (cell,))
    rng = random.Random(13)
    low = rng.getrandbits(26)
    fps = [rng.getrandbits(38) << 26 | low for _ in range(120)]  # strangers that fill one block
    fps += [flipped(rng, v, rng.choice((1, 2, 3, 4))) for v in fps[:60]] + [flipped(rng, fps[0], 2) for _ in range(40)]
    fps += fps[:8] + fps[:4]  # different lines of one fingerprint
    rows = [(i, v - (v >> 63 << 64)) for i, v in enumerate(fps)]
    got = {(r.a, r.b) for r in lines.candidate_pairs(spark.createDataFrame(rows, "k long, fp long"), block=4, chosen=chosen).collect()}
    assert got == {(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 3}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(12)
    base = rng.standard_normal((40, 16))
    rows = [(base[rng.integers(40)] + rng.standard_normal(16) * 0.07).tolist() for _ in range(400)]
    rows += [rows[0], rows[0], [x * 3 for x in rows[1]], [0.0] * 16, None, [float("nan")] + rows[2][1:], [None] + rows[3][1:], [float("inf")] * 16, [], [1e-200 * x for x in rows[4]]]
    frame = spark.createDataFrame([(i * 2, v, 0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in near_vectors(frame, bucket=64).collect()}
    ok = [i for i, v in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = np.array([np.array(rows[i]) / np.abs(rows[i]).max() for i in ok])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95 - 1e-12
    degree = dict.fromkeys(range(len(rows)), 0) | {i: int(close[k].sum()) - 1 for k, i in enumerate(ok)}
    want = components(range(len(rows)), [(ok[a], ok[b]) for a, b in zip(*np.nonzero(np.triu(close, 1)), strict=True)])
    found = sum(got[2 * i].n_links for i in degree) / sum(degree.values())
    assert found >= 0.98 and all(got[2 * i].n_links <= degree[i] for i in degree)
    assert np.mean([got[2 * i].component_id == 2 * want[i] for i in want]) > 0.98
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert near_vectors(frame.limit(0)).count() == 0 and near_vectors(frame.where("vec_id = 806")).collect()[0].n_links == 0


def test_digest_columns(spark):
    docs = spark.createDataFrame([(1, "a  b\tc", "en", 1)], DOCS)
    assert remove_repeats(docs).collect()[0].text == "a b c"
    assert hashlib.sha256(b"a b c").hexdigest()


def test_near_copies_of_one_text_give_links_not_pairs(spark, monkeypatch):
    """400 near copies meet by SimHash, over squares too, and give fewer links than texts; 0.8 itself is met."""
    from pyspark.sql import functions as F

    from veridoc.llm import simhash

    monkeypatch.setattr(simhash, "CELL", 300)
    rng = random.Random(12)
    base = prose(rng, 120, 9000).split()
    sets = [simhash.shingle_set(" ".join(base[:i] + [f"v{rng.randrange(10**6)}"] + base[i + 1 :])) for i in (rng.randrange(5, 115) for _ in range(400))]
    wide = spark.createDataFrame([(i, bytearray(simhash.wide_fingerprint(h))) for i, h in enumerate(sets)], "v long, wide binary")
    links = [(r.a, r.b) for r in simhash.close_links(wide, 400).distinct().collect()]
    assert len(set(components(range(400), links).values())) == 1 and len(links) < 400 * len(simhash.shard_bits(400)) * 2
    listed = spark.createDataFrame([(i, h.view("int64").tolist()) for i, h in enumerate(sets)], "v long, h array<long>")
    got = [(r.a, r.b) for r in simhash.similar_links(listed, listed.select("v", F.lit(7).cast("long").alias("key")), 0.8).collect()]
    linked = [(i, j) for i in range(400) for j in range(i) if 5 * len(both := set(sets[i].tolist()) & set(sets[j].tolist())) >= 4 * (len(sets[i]) + len(sets[j]) - len(both))]
    assert components(range(400), got) == components(range(400), linked) and len(got) < 400 < len(linked)


def test_segments_of_texts_together_are_those_of_each():
    rng = np.random.default_rng(5)
    sizes = (0, 5, 19, 20, 300, 0, 21, 400, 1, 90)
    texts = [rng.integers(0, 6 if n % 3 else 1 << 60, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in sizes]
    texts[7][:] = 7  # one word over and over
    ends = np.append(0, np.cumsum(sizes))
    found = substrings.Segments(np.concatenate(texts), ends=ends)
    got = list(zip(found.text.tolist(), (found.first - ends[found.text]).tolist(), found.count.tolist(), found.anchor.tolist(), found.context.tolist(), strict=True))
    alone = [(t, substrings.Segments(h)) for t, h in enumerate(texts)]
    want = [(t, *row) for t, s in alone for row in zip(s.first.tolist(), s.count.tolist(), s.anchor.tolist(), s.context.tolist(), strict=True)]
    assert got == want and max(r[2] for r in want) == substrings.MOST
    assert {(found.text[i], found.context[i]) for i in found.once()} == {(t, c) for t, _, _, _, c in want} and len(found.once()) < len(want)
