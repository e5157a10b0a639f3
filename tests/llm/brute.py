"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")
COMMON = {
    "en": "the of and to in is that for with on as are this be by from a was".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par au sur".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein".split(),
    "es": "de la que el en y a los se del las un por con no una su para".split(),
}


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def digest(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def covered(rows, length):
    """For each sequence, which units a stretch of `length` that also starts elsewhere covers."""
    seen = Counter(tuple(r[i:i + length]) if isinstance(r, list) else r[i:i + length] for r in rows for i in range(len(r) - length + 1))
    out = []
    for r in rows:
        change = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if seen[tuple(r[i:i + length]) if isinstance(r, list) else r[i:i + length]] > 1:
                change[i] += 1
                change[i + length] -= 1
        out.append(np.cumsum(change)[:-1] > 0)
    return out


def quality(docs):
    """docs: (doc_id, text, lang). Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    rows = []
    for doc_id, text, lang in docs:
        ws, t = words(text), text or ""
        grams = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
        repeated = {i + k for i in range(len(ws) - 2) if grams[tuple(ws[i:i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        base = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        marks = [c for c in "".join(ws) if not c.isalpha()]
        digits, stops = sum(c.isdecimal() for c in marks), sum(c in ".,;:!?'\"()-" for c in marks)
        chars = [base[1] - len(marks), digits, stops, base[2], len(marks) - base[2] - digits - stops, len(t) - base[1]]
        common = None
        if lang in COMMON:
            found = [ws.count(w) for w in COMMON[lang]]
            common = [*found, len(ws) - sum(found)]
        rows.append((doc_id, lang, base, len(ws) < 50 or 100 * len(repeated) > 50 * len(ws), chars, common))
    def distance(a, b):
        a, b = np.array(a, float) / sum(a), np.array(b, float) / sum(b)
        return math.sqrt(max(0, sum((p * math.log2(2 * p / (p + q)) if p else 0) + (q * math.log2(2 * q / (p + q)) if q else 0) for p, q in zip(a, b, strict=True)) / 2))

    def pooled(found):
        both = [[0] * 6, [0] * 19]
        for n, *kinds in found:
            for total, values in zip(both, kinds, strict=True):
                for k, v in enumerate(values or ()):
                    total[k] += v * min(n, 1000) * 1_000_000 // sum(values)
        return both

    reference = {}
    for language in {lang for _, lang, *_ in rows if lang is not None}:
        known = list({(base[0], tuple(chars), tuple(common or ())) for _, lang, base, failed, chars, common in rows if lang == language and not failed})
        if sum(n for n, *_ in known) >= 10_000:
            first = pooled(known)
            bins = [[int(1000 * distance(x, r)) if x and sum(r) else 0 for x, r in zip(row[1:], first, strict=True)] for row in known]
            middle = [sorted(b)[(len(b) + 1) // 2 - 1] for b in zip(*bins, strict=True)]
            near = [row for row, own in zip(known, bins, strict=True) if own[0] <= middle[0] and own[1] <= middle[1]]
            reference[language] = pooled(near or known)

    out = []
    for doc_id, lang, base, failed, chars, common in rows:
        kept = not failed
        if kept and lang in reference:
            n, (chars_of, common_of) = base[0], reference[lang]
            kept = distance(chars, chars_of) <= math.sqrt(0.008 + 2.9 / n) and not (common and distance(common, common_of) > math.sqrt(0.012 + 7 / n))
        out.append((doc_id, *base, failed, kept))
    return out


def fingerprint(text):
    ws = words(lower(text))
    if not ws:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(ws[i:i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=2):
    """For each of the numbers, the index of the first of its group."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(texts, items):
    """Per text: number of words, places of hit words, ids of items found."""
    windows = defaultdict(set)
    for item, text in items:
        ws = BENCH_WORD.findall(lower(text))
        n = min(10, len(ws))
        for i in range(len(ws) - n + 1 if ws else 0):
            windows[tuple(ws[i:i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for text in texts:
        ws = BENCH_WORD.findall(lower(text))
        places, found = set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if tuple(ws[i:i + n]) in windows:
                    places |= set(range(i, i + n))
                    found |= {x for x in windows[tuple(ws[i:i + n])] if x is not None}
        out.append((len(ws), places, sorted(map(str, found))))
    return out


def without_hits(text, places):
    """The text without hit words and the separators behind them."""
    parts = re.split(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)", text)
    out = [parts[0]]
    for i in range(len(parts) // 2):
        if i not in places:
            out += parts[2 * i + 1:2 * i + 3]
    return "".join(out)
