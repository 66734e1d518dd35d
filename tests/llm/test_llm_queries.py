"""The training-data queries that SQL can express, and those tested on small tables by brute force."""

import hashlib
import re

import pytest

from tests.test_queries import SF, other, same  # noqa: F401
from veridoc.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_says_what_sql_says(spark, other, name):  # noqa: F811
    same(registry.QUERIES[name](spark, SF), other.execute(registry.ORACLES[name]))


def test_substring_query(spark, other):  # noqa: F811
    seen, want = set(), {}
    for d, text in other.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            if (k := tuple(words[i : i + 20])) in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(k)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        want[d] = (len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    got = registry.op5_substrings(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def test_toxicity_query_columns(spark):
    out = registry.op1_toxicity(spark, SF)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.collect())
