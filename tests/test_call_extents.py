"""Full extents of C calls against a walk over the characters."""

from __future__ import annotations

import random
import time

from riskloom.operators import match_rules


def calls(spark, *texts):
    rows = match_rules.cpp_calls_extent(spark.createDataFrame([(f"{i}.c", t) for i, t in enumerate(texts)], "path string, content string")).drop("snippet").collect()
    return {(int(r.path[:-2]), r.startLine, r.startColumn): (r.name, r.endLine, r.endColumn) for r in rows}


def test_hand_written(spark):
    nested = 'sprintf(buf, "%s)", get(a, (b)));\nsystem(\n  popen("x", f(1)),\n  2\n);'
    assert calls(spark, nested) == {(0, 1, 1): ("sprintf", 1, 33), (0, 2, 1): ("system", 5, 2), (0, 3, 3): ("popen", 3, 19)}
    comment = "strcpy(a, /* ) */ b // )\n  , ')');"
    assert calls(spark, comment) == {(0, 1, 1): ("strcpy", 2, 9)}
    assert calls(spark, "gets(a; exec (b)") == {(0, 1, 1): ("gets", 1, 6), (0, 1, 9): ("exec", 1, 17)}
    assert calls(spark, ") ) system\n (x) )") == {(0, 1, 5): ("system", 2, 5)}
    assert calls(spark, "", "system", "fgets(a)") == {}


def test_random_code(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["gets(", "exec (", "(", ")", ")", "\n", "a", " ", "f("]) for _ in range(60)) for _ in range(60)]
    want = {}
    for i, text in enumerate(texts):
        for at in range(len(text)):
            name = next((n for n in ("gets(", "exec (") if text.startswith(n, at)), None)
            if not name or at and text[at - 1].isalnum():
                continue
            depth, end = 1, at + len(name)
            while end < len(text) and depth:
                depth += {"(": 1, ")": -1}.get(text[end], 0)
                end += 1
            end = at + len(name) if depth else end
            place = lambda k, t=text: (t.count("\n", 0, k) + 1, k - t.rfind("\n", 0, k))
            want[i, *place(at)] = (name.strip("( "), *place(end))
    assert len(want) > 300 and calls(spark, *texts) == want


def test_deep_and_long(spark):
    n = 20_000
    start = time.time()
    assert calls(spark, "gets(" * n + ")" * n)[0, 1, 5 * n - 4] == ("gets", 1, 5 * n + 2)
    assert time.time() - start < 60
