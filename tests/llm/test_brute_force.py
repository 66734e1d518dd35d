"""License scans, decontamination, fuzzy lines and the whole pipeline against plain versions."""

import hashlib
import random
import re

import pytest

from tests.llm.test_dedup import components, levenshtein, plain_line_simhash
from tests.llm.test_other_operators import letters, plain_targets, plain_toxicity, prose
from veridoc.llm.decontaminate import contamination
from veridoc.llm.licenses import TEMPLATES, Scanner, align, scan_licenses, tokens


def plain_license_places(text, templates, share=0.8):
    """(template, start) of every window of twice the template's length, from a template word on, that aligns enough of it."""
    words, out = tokens(text), []
    for name, template in templates.items():
        t = tokens(template)
        for lo in range(len(words)):
            if words[lo] in t and len(pairs := align(words[lo : lo + 2 * len(t)], t)) >= share * len(t):
                out.append((name, lo + pairs[0][0], lo + pairs[-1][0]))
    return out


def test_licenses_by_brute_force(spark):
    rng = random.Random(41)
    templates = {k: TEMPLATES[k] for k in ("MIT-line", "GPL-3.0-line", "ISC", "CC-BY-NC-4.0-line", "MIT")}
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            words = rng.choice(list(templates.values())).split()
            lo = rng.randrange(len(words)) if rng.random() < 0.5 else 0
            words = [w if rng.random() > 0.08 else "changed" for w in words[lo:]]
            parts += [*words, *(rng.choice("the of this is license software to any foo bar".split()) for _ in range(rng.randrange(12)))]
        rows.append((i, " ".join(parts)))
    half = TEMPLATES["MIT"].split()
    rows.append((99, " ".join(half[len(half) // 2 :] + half)))
    got = {}
    for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect():
        assert r.coverage >= 0.8
        got.setdefault((r.doc_id, r.license), []).append((r.first_token, r.last_token))
    assert got[(99, "MIT")]
    places = 0
    for d, text in rows:
        want = plain_license_places(text, templates)
        places += len(want)
        # no place without a hit over it, and no hit without a place
        for name, lo, hi in want:
            assert any(a <= hi and b >= lo for a, b in got.get((d, name), [])), (d, name)
        assert {name for e, name in got if e == d} <= {name for name, _, _ in want}
    assert places > 40 and Scanner(templates).scan(None) == []


def plain_tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_overlap(doc, item, window=20):
    """Largest share of equal tokens of an item laid anywhere along a document, in a window of the item."""
    best, width = 0.0, min(window, len(item))
    for diagonal in range(-len(item) + 1, len(doc)):
        same = [0 <= diagonal + j < len(doc) and doc[diagonal + j] == x for j, x in enumerate(item)]
        best = max(best, *(sum(same[s : s + width]) / width for s in range(len(item) - width + 1)))
    return best


@pytest.mark.parametrize("seeds", [500_000, 0])
def test_contamination_by_brute_force(spark, seeds):
    rng = random.Random(42)
    items = [prose(rng, n, 300) for n in (1, 2, 4, 5, 9, 9, 11, 14, 19, 20, 26, 45)]
    rows = []
    for i in range(60):
        words = rng.choice(items).split()
        a = rng.randrange(len(words)) if rng.random() < 0.4 else 0
        words = [w if rng.random() > rng.choice((0, 0.1, 0.25)) else "else" for w in words[a:]]
        rows.append((i, f"{prose(rng, rng.randrange(20), 300)} {' '.join(words)} {prose(rng, rng.randrange(20), 300)}"))
    bench = list(enumerate(items))
    got = {r.doc_id: (r.contaminated, list(r.item_ids)) for r in contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), broadcast_seeds=seeds).collect()}
    for d, text in rows:
        # items of fewer than five tokens match exact copies only, which a share of 0.8 says of them too
        want = [i for i, t in bench if plain_overlap(plain_tokens(text), plain_tokens(t)) >= 0.8]
        assert got[d] == (bool(want), want), d
    assert 10 < sum(c for c, _ in got.values()) < 60


def plain_lines(rows):
    """Texts without repeated or near-equal lines, by comparing all lines."""
    def norm(line):
        return " ".join(plain_tokens(line))

    places = [(d, i, norm(line)) for d, text in sorted(rows) if text is not None for i, line in enumerate(text.split("\n"))]
    norms = sorted({n for _, _, n in places if n})
    fps = [plain_line_simhash(n) for n in norms]
    close = [(i, j) for j in range(len(norms)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 3]
    linked = [(i, j) for i, j in close if levenshtein(norms[i], norms[j]) <= int(max(len(norms[i]), len(norms[j])) * 0.2 + 1e-9)]
    root = {norms[i]: r for i, r in components(range(len(norms)), linked).items()}
    seen, gone = set(), {}
    for d, i, n in places:
        if n and root[n] in seen:
            gone.setdefault(d, set()).add(i)
        elif n:
            seen.add(root[n])
    out = []
    for d, text in rows:
        cut = gone.get(d, set())
        left = text if text is None else "\n".join(line for i, line in enumerate(text.split("\n")) if i not in cut)
        if not cut or left.strip(" \t\n\x0b\x0c\r"):
            out.append((d, left))
    return out


def plain_similar(rows):
    """The first of every group of texts similar by 0.8 in five-word shingles."""
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return [rows[i] for i, r in components(range(len(rows)), linked).items() if i == r]


def plain_mix(rows, sources):
    size = {d: len((t or "").split()) for d, t in rows}
    sums = {}
    for d, _ in rows:
        sums[sources[d]] = sums.get(sources[d], 0) + size[d]
    target, at, out = plain_targets(sums), {}, {}
    for d in sorted(size, key=lambda d: hashlib.md5(str(d).encode()).hexdigest()):
        s = sources[d]
        budget = int(target[s] + 0.5)
        epochs = budget // sums[s] if sums[s] else 0
        taken = epochs * size[d] + max(0, min(size[d], budget - epochs * sums[s] - at.get(s, 0)))
        at[s] = at.get(s, 0) + size[d]
        if taken:
            out[d] = taken
    return out


def test_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(43)
    items = [prose(rng, n, 10**6) for n in (18, 25)]
    rows, labels, sources = [], {}, {}
    base = [prose(rng, rng.randrange(60, 140), 10**6) for _ in range(6)]
    for i in range(150):
        toxic = i % 6 == 0
        parts = [letters(rng, rng.randrange(12, 40))] + ([f"zonkful grumbol{rng.choice('aeiou')}"] if toxic else [])
        if rng.random() < 0.3:
            words = rng.choice(base).split()
            for j in rng.sample(range(len(words)), rng.randrange(3)):
                words[j] = f"v{rng.randrange(10**6)}"
            parts = [" ".join(words)] if rng.random() < 0.5 else parts + [" ".join(words)]
        if rng.random() < 0.15:
            parts.insert(0, rng.choice(items))
        if rng.random() < 0.3:
            parts.append("All rights reserved by nobody.")
        rows.append((i, "\n".join(parts)))
        sources[i] = rng.choice(["a", "a", "a", "b", None])
        if i % 2:
            labels[i] = int(i % 3 == 0)
    labels |= {i: int(i % 6 == 0) for i in range(0, 150, 4)} | {i: 0 for i in range(1, 150, 2)}
    rows += [(150, None), (151, "")]
    sources |= {150: "a", 151: "b"}
    docs = spark.createDataFrame([(d, t, "en", sources[d], len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels.items()), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.text, r.taken) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    scores = plain_toxicity(rows, labels)
    left = [(d, t) for d, t in rows if scores[d] < 0.3]
    assert 100 < len(left) < 140
    left = plain_lines(left)
    left = plain_similar(left)
    many = len(left)
    left = [(d, t) for d, t in left if not any(plain_overlap(plain_tokens(t), plain_tokens(i)) >= 0.8 for i in items)]
    assert len(left) < many
    taken, texts = plain_mix(left, sources), dict(left)
    assert got == {d: (texts[d], n) for d, n in taken.items()}
