"""Benchmark decontamination in DataFrame functions only.

Normalised benchmark windows (`n` consecutive words; a shorter item is one
window) are a small table that is broadcast, if its counted size allows, and
probed by 64-bit hash with every window of the training texts.  Hits are few;
they meet their text again by id, where each is verified word by word before it
counts.  A text's windows are never shuffled.

Null and empty texts have no words and no hits.  Equal item ids count once, a
null item id marks words but is not listed.  Repeated rows, also rows that
share an id but not the text, are judged one by one.  Empty tables give no hits
or no rows.  Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import let
from riskloom.llm.common import LOWER, UPPER, cut, text_key, words

#: Between normalised words; between words whose case is still there.
SEPARATORS, CASED_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CASED_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Benchmark windows are broadcast up to this many; beyond it Spark picks a shuffled join.
MAX_BROADCAST_WINDOWS = 500_000


def normal_words(text: Column) -> Column:
    """Words with A-Z in lower case."""
    lowered = lambda w: F.when(w.rlike("[A-Z]"), F.translate(w, UPPER, LOWER)).otherwise(w)
    return F.transform(words(text, CASED_SEPARATORS), lowered)


def _starts(ws: Column, length: int) -> Column:
    return F.when(F.size(ws) >= length, F.sequence(F.lit(0), F.size(ws) - length)).otherwise(F.array().cast("array<int>"))


def _hash(ws: Column, start: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(ws, start + i) for i in range(length)])


def _hashes(ws: Column, length: int) -> Column:
    return F.transform(_starts(ws, length), lambda i: F.struct(F.lit(length).alias("length"), i.alias("start"), _hash(ws, i, length).alias("h")))


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Each distinct window: length, hash, its words joined by spaces, the ids of its items as sorted strings."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), normal_words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    none = F.array().cast("array<struct<length:int,start:int,h:bigint>>")
    fits = lambda length: F.size("ws") >= n if length == n else F.size("ws") == length
    found = items.select("item", "ws", F.explode(F.concat(*[F.when(fits(k), _hashes(F.col("ws"), k)).otherwise(none) for k in range(1, n + 1)])).alias("w"))
    gram = F.array_join(F.slice("ws", F.col("w.start") + 1, F.col("w.length")), " ")
    return found.groupBy(F.col("w.length").alias("length"), F.col("w.h").alias("h"), gram.alias("gram")).agg(F.sort_array(F.collect_set("item")).alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """`docs` with `hit`: per row the sorted places of hit words, the items found and the number of words, as one struct."""
    windows = cut(benchmark_windows(benchmark, n))
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most n numbers
    small = windows.count() <= max_broadcast
    key = text_key(F.col("text")).alias("key")
    ws = docs.select("doc_id", key, normal_words(F.col("text")).alias("ws"))
    every = F.concat(*[_hashes(F.col("ws"), length) for length in lengths]) if lengths else F.array().cast("array<struct<length:int,start:int,h:bigint>>")
    probes = ws.select("doc_id", "key", F.inline(every))
    hits = probes.join(F.broadcast(windows) if small else windows, ["length", "h"])
    per_doc = hits.dropDuplicates(["doc_id", "key", "start", "length", "gram"]).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "length", "gram", "items")).alias("hits"))
    per_doc = per_doc.select(F.col("doc_id").alias("hit_doc"), F.col("key").alias("hit_key"), "hits")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", key)
    joined = own.join(per_doc, own["doc_id"].eqNullSafe(per_doc["hit_doc"]) & (own["key"] == per_doc["hit_key"]), "left")
    # Words are split again behind the join, as arrays of words take several times the room of their text, and once for a row's hits.
    none = F.array().cast(per_doc.schema["hits"].dataType)
    verified = let(normal_words(F.col("row.text")), lambda ws: F.filter(
        "hits", lambda h: F.array_join(F.slice(ws, h["start"] + 1, h["length"]), " ") == h["gram"]))
    n_words = F.size(words(F.col("row.text"), CASED_SEPARATORS)).cast("long")
    found = joined.select("row", n_words.alias("n_words"), F.when(F.col("hits").isNotNull(), verified).otherwise(none).alias("sure"))
    places = F.sort_array(F.array_distinct(F.flatten(F.transform("sure", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1)))))
    items = F.sort_array(F.array_distinct(F.flatten(F.transform("sure", lambda h: h["items"]))))
    return found.select("row", F.struct("n_words", places.alias("places"), items.alias("items")).alias("hit"))


def without_spans(text: Column, places: Column) -> Column:
    """`text` without the words at `places` and the separators behind them; a text without hits is left as it is."""
    def rebuilt(ws: Column, gaps: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(ws) - 1), places)
        return F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(kept, lambda i: F.concat(F.get(ws, i), F.coalesce(F.get(gaps, i + 1), F.lit("")))), ""))

    parts = let(words(text, CASED_SEPARATORS), lambda ws: let(F.split(text, CASED_WORDS), lambda gaps: rebuilt(ws, gaps)))
    return F.when(F.size(places) > 0, parts).otherwise(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, drop_share: float = 0.5) -> DataFrame:
    """`docs`, same columns, without the hit spans; documents with more than `drop_share` of their words hit go."""
    found = scan(docs, benchmark, n).where((F.size("hit.places") == 0) | (F.size("hit.places") <= drop_share * F.col("hit.n_words")))
    cleaned = without_spans(F.col("row.text"), F.col("hit.places"))
    return found.select(*[cleaned.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
