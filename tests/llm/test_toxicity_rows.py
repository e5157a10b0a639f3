"""Toxicity scores of whole texts against the plain formulas, unseen n-grams and rows beyond the broadcast ones included."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest

from riskloom.llm import toxicity

LEARNT = [("zargo vel tam tam sit", 1), ("zargix quo", 1), ("zargo sit amet lorem", 1)] * 4 + [("lorem ipsum dolor sit amet", 0), ("tam tam vel quo nec", 0), ("vel lorem quo", 0)] * 6
SCORED = ["zargo vel", "zargonaut tamarind vella", "东京 xyzzy", "", None, "lorem ipsum dolor", "zargq tamq " * 9]


def plain(text):
    data = b"  " + b" ".join(re.sub(rb"[^a-z\x80-\xff]+", b" ", (text or "").lower().encode()).split()) + b" "
    return [data[i:i + 5] for i in range(len(data) - 4)]


def want_z():
    n = [Counter(), Counter()]
    for text, c in LEARNT:
        n[c].update(plain(text))
    d = [4.0 * sum(c.values()) / min(sum(c.values()) for c in n) for c in n]
    before = Counter(g[1:] for g in set(n[0]) | set(n[1]))
    bases, kinds = defaultdict(int), Counter(g[:3] for g in before)
    heads, lost = [Counter(), Counter()], [defaultdict(float), defaultdict(float)]
    for g, k in before.items():
        bases[g[:3]] += k
    for c in (0, 1):
        for g, k in n[c].items():
            heads[c][g[:4]] += k
            lost[c][g[:4]] += min(k, d[c])

    def p(c, g):
        h, low = heads[c][g[:4]], g[1:]
        shared = max(before[low] - 0.5, 0) / bases[low[:3]] + 0.5 * kinds[low[:3]] / bases[low[:3]] / 256
        return (n[c][g] - min(n[c][g], d[c])) / h + lost[c][g[:4]] / h * shared if h else shared

    known = lambda g: heads[0][g[:4]] or heads[1][g[:4]]
    return [sum(math.log(p(1, g)) - math.log(p(0, g)) for g in plain(t) if known(g)) / (len(plain(t)) + toxicity.PAD) for t in SCORED]


@pytest.mark.parametrize("most", [10**6, 30, 0])
def test_scores_with_unseen_grams(spark, most):
    counts = toxicity.gram_counts(spark.createDataFrame(LEARNT, "text string, toxic int"))
    model = toxicity.model_of(toxicity.differences(counts, with_histories=True), most)
    assert (model.others is None) == (most == 10**6) and len(model.keys) <= most
    docs = spark.createDataFrame([(i % 5, i, t) for i, t in enumerate(SCORED)], "doc_id long, place int, text string")
    got = {r.place: r.z for r in toxicity.evidence(docs, model).collect()}
    assert [got[i] for i in range(len(SCORED))] == pytest.approx(want_z(), abs=1e-9)
