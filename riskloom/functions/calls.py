"""Calls of an outside function, several at a time, each within a time limit."""

from __future__ import annotations

import queue
import threading
import time
from collections import deque
from collections.abc import Callable
from typing import Any


class BoundedCalls:
    """Asks `fn` for many values with at most `open_calls` calls under way, each given `seconds` and `attempts` tries.

    A call that runs over its time answers None at once, and its thread keeps one place until it returns. When every
    place is held by such a call, the function counts as hanging: what is left answers None without waiting, so a
    function that never returns costs its time limit once. One object serves a whole task.
    """

    def __init__(self, fn: Callable[[Any], Any], seconds: float, open_calls: int, attempts: int):
        self.fn, self.seconds, self.open_calls, self.attempts = fn, seconds, open_calls, attempts
        self.done: queue.Queue = queue.Queue()
        self.active: dict[int, tuple[int, float]] = {}  # call -> its place in the batch, its deadline
        self.late: set[int] = set()
        self.calls = 0

    def _start(self, place: int, value: Any) -> None:
        call, self.calls = self.calls, self.calls + 1
        self.active[call] = (place, time.monotonic() + self.seconds)

        def run() -> None:
            try:
                self.done.put((call, True, self.fn(value)))
            except Exception:  # tried again, then None
                self.done.put((call, False, None))

        threading.Thread(target=run, daemon=True).start()

    def __call__(self, values: list) -> list:
        answers: list = [None] * len(values)
        pending, tries = deque(range(len(values))), [0] * len(values)
        while pending or self.active:
            while pending and len(self.active) + len(self.late) < self.open_calls:
                place = pending.popleft()
                tries[place] += 1
                self._start(place, values[place])
            wait = min((deadline for _, deadline in self.active.values()), default=time.monotonic()) - time.monotonic()
            try:
                call, fine, answer = self.done.get(timeout=max(wait, 0.001))
            except queue.Empty:
                now = time.monotonic()
                over = {call for call, (_, deadline) in self.active.items() if deadline <= now}
                for call in over:
                    del self.active[call]
                self.late |= over
                if not self.active and len(self.late) >= self.open_calls:
                    break
                continue
            if call in self.late:
                self.late.remove(call)
                continue
            place, _ = self.active.pop(call)
            if fine:
                answers[place] = answer
            elif tries[place] < self.attempts:
                pending.append(place)
        return answers
