"""Backend calls within limits of time and number."""

from __future__ import annotations

import threading
import time

from pyspark.sql import functions as F

from riskloom.functions.calls import BoundedCalls
from riskloom.operators import enrich


def test_calls_overlap_within_the_limit():
    lock, now, most = threading.Lock(), [0], [0]

    def fn(x):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.05)
        with lock:
            now[0] -= 1
        return x * x

    calls = BoundedCalls(fn, seconds=5, open_calls=4, attempts=1)
    start = time.time()
    assert calls(list(range(20))) == [x * x for x in range(20)] and calls([]) == []
    assert most[0] == 4 and time.time() - start < 0.8


def test_failures_are_tried_again():
    tries = {}

    def fn(x):
        tries[x] = tries.get(x, 0) + 1
        if tries[x] <= x:
            raise ValueError
        return x

    assert BoundedCalls(fn, 5, 2, attempts=3)([0, 1, 2, 3]) == [0, 1, 2, None]
    assert tries == {0: 1, 1: 2, 2: 3, 3: 3}


def test_one_slow_call_holds_up_nothing():
    def fn(x):
        time.sleep(3 if x == 1 else 0.01)
        return x

    start = time.time()
    calls = BoundedCalls(fn, seconds=0.3, open_calls=2, attempts=2)
    assert calls(list(range(10))) == [x if x != 1 else None for x in range(10)]
    assert time.time() - start < 1


def test_a_backend_that_hangs_costs_its_limit_once():
    start = time.time()
    calls = BoundedCalls(lambda x: time.sleep(60), seconds=0.4, open_calls=3, attempts=2)
    assert calls(list(range(50))) == [None] * 50 and calls([1, 2]) == [None] * 2
    assert time.time() - start < 1.2


def test_a_backend_that_recovers_is_asked_again():
    gate = threading.Event()

    def fn(x):
        gate.wait(20)
        return x

    calls = BoundedCalls(fn, seconds=0.2, open_calls=2, attempts=1)
    assert calls([1, 2, 3]) == [None] * 3
    gate.set()
    time.sleep(0.2)
    assert calls([4, 5, 6]) == [4, 5, 6]


def test_findings_fall_back(spark):
    found = spark.createDataFrame([("a.py", "Dangerous Import", n, "import os", "m") for n in range(12)], "path string, type string, line int, snippet string, message string")

    def hangs(prompt):
        import time as clock
        clock.sleep(600)

    start = time.time()
    got = enrich.enrich_with_backend(found, hangs, seconds=0.5, open_calls=2)
    assert [r[0] for r in got.select("llm_used").distinct().collect()] == ["offline"] and time.time() - start < 60
    assert got.where(F.col("explanation") != "").count() == 12
