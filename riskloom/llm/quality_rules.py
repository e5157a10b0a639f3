"""Quality rules by distribution divergence, in DataFrame functions only.

A document is compared with the documents of its own language: once by its
histogram of character classes, once by its histogram of common words, each by
Jensen-Shannon distance (base 2, 0 to 1).  A short text strays further from its own
language by chance alone, so a limit is sqrt(a + b / number of words).

A reference is taken twice, so that junk, copies and long texts do not bend it: first
from all documents that pass the base rules, each different histogram once and with
the weight of its words, up to `MOST_WEIGHT`; then from those among them that are no
further than the median from the first one, in both histograms.  Sums are of whole
numbers (shares in millionths), so every run gives the same verdicts.  The text is
read once; only counts are shuffled.

Guards: a document under `min_words` words fails the base rules; a language whose
documents have under `min_reference` words in all, or no language, gives no
reference and the document keeps the base verdict; a language without a list of
common words is judged by character classes alone.

Null text counts as empty: no words, base_failed.  Texts of any length are counted
whole.  Repeated rows each give a row; a distance equal to its limit passes.  An empty
table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.text import let
from riskloom.llm.common import cut, text_key, words

# Frequent short words of four languages, whose counts make the word histogram.
COMMON = {
    "en": "the of and to in is that for with on as are this be by from a was".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par au sur".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein".split(),
    "es": "de la que el en y a los se del las un por con no una su para".split(),
}
COMMON_WORDS = 18  # of each language
VOCABULARY = sorted({w for ws in COMMON.values() for w in ws})
SYMBOLS = r"[#*$%&|<>]"

MIN_WORDS, MIN_REFERENCE, MOST_WEIGHT = 50, 10_000, 1000
#: (a, b) of the limit sqrt(a + b / words) of each distance.
CHAR_LIMIT, WORD_LIMIT = (0.008, 2.9), (0.012, 7.0)
BINS = 1000  # of a distance, for the medians
MOST_LANGUAGES = 20_000  # up to so many references, of 200 bytes each, are broadcast


def repeated_words(hashes: Column) -> Column:
    """Words in 3-word windows that occur twice or more; equal hashes of 64 bits count as equal windows.

    Most texts have no such window, which the distinct hashes tell. For the others, sorting (hash, place) brings
    copies side by side, and each repeated start adds the words that its window covers anew.
    """
    places = F.sequence(F.lit(0), F.size(hashes) - 1)
    placed = F.sort_array(F.arrays_zip(hashes.alias("h"), places.alias("i")))
    n = F.size(hashes)
    pairs = F.zip_with(F.slice(placed, 1, n - 1), F.slice(placed, 2, n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    state = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        starts, state,
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).cast("long").alias("n")),
        lambda s: s["n"],
    )
    return F.when(F.size(F.array_distinct(hashes)) < n, covered).otherwise(F.lit(0).cast("long"))


def window_hashes(ws: Column) -> Column:
    starts = F.when(F.size(ws) >= 3, F.sequence(F.lit(0), F.size(ws) - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))


def by_language(of: Callable[[list[str]], Column]) -> Column:
    """The value of a document's language; null for other languages."""
    return reduce(lambda case, lang: case.when(F.col("lang") == lang, of(COMMON[lang])), COMMON, F.when(F.lit(False), None))


def features(docs: DataFrame) -> DataFrame:
    """Counts of each document: the base numbers, `chars` by class and `common` by word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", "lang", text.alias("text"), words(text).alias("ws"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = F.filter("ws", lambda w: w.isin(VOCABULARY))
    read = read.select(
        "doc_id", "lang", F.size("ws").cast("long").alias("n_words"), lines.alias("lines"), window_hashes(F.col("ws")).alias("hashes"),
        F.length("text").cast("long").alias("length"), F.length(F.concat_ws("", "ws")).cast("long").alias("word_chars"),
        F.regexp_replace("text", r"[\p{L}\x20\x09-\x0D]+", "").alias("marks"),
        F.concat(F.lit(" "), F.concat_ws("  ", found), F.lit(" ")).alias("found"), F.size(found).cast("long").alias("n_found"),
    )
    count = lambda w: ((F.length("found") - F.length(F.replace("found", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long")
    counted = read.select(
        "doc_id", "lang", "n_words", "word_chars",
        F.regexp_count("marks", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("hashes")).alias("n_repeat_words"),
        (F.col("length") - F.col("word_chars")).alias("space"), F.length("marks").cast("long").alias("n_marks"),
        F.regexp_count("marks", F.lit(r"\p{Nd}")).cast("long").alias("digits"),
        F.regexp_count("marks", F.lit(r"[.,;:!?'\"()-]")).cast("long").alias("stops"),
        by_language(lambda ws: F.array(*[count(w) for w in ws])).alias("common"),
    )
    letters, other = F.col("word_chars") - F.col("n_marks"), F.col("n_marks") - F.col("n_symbols") - F.col("digits") - F.col("stops")
    seen = F.aggregate("common", F.lit(0).cast("long"), lambda s, v: s + v)
    return counted.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array(letters, "digits", "stops", "n_symbols", other, "space").alias("chars"),
        F.concat("common", F.array(F.col("n_words") - seen)).alias("common"),
    )


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts; null if one of them has no count.

    Totals and shares are bound, since Spark evaluates what a lambda names anew for every element.
    """
    total = lambda x: F.aggregate(x, F.lit(0).cast("double"), lambda s, v: s + v)
    share = lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    def distance(n: Column) -> Column:
        own, ref = F.transform(a, lambda x: x / n["a"]), F.transform(b, lambda y: y / n["b"])
        parts = F.zip_with(own, ref, lambda p, q: share(p, q) + share(q, p))
        divergence = F.aggregate(parts, F.lit(0).cast("double"), lambda s, v: s + v) / 2
        return F.when((n["a"] > 0) & (n["b"] > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))

    return let(F.struct(total(a).alias("a"), total(b).alias("b")), distance)


def pooled(rows: DataFrame) -> DataFrame:
    """Weighted sums of the histograms, and the words, of each language; a row per language."""
    total = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda s, v: s + v)
    weighed = rows.select("lang", "n_words", "chars", "common", F.least("n_words", F.lit(MOST_WEIGHT)).alias("weight"),
                          total("chars").alias("n_chars"), total("common").alias("n_common"))

    def sums(name: str, n: int) -> Column:
        of = F.col(f"n_{name}")
        return F.array(*[F.sum(F.when(of > 0, F.floor(F.get(name, F.lit(i)) * F.col("weight") * 1_000_000 / of).cast("long"))) for i in range(n)])

    return weighed.groupBy("lang").agg(sums("chars", 6).alias("ref_chars"), sums("common", COMMON_WORDS + 1).alias("ref_common"), F.sum("n_words").alias("ref_words"))


def references(counts: DataFrame, min_reference: int = MIN_REFERENCE) -> DataFrame:
    """The histograms of each language's ordinary documents; a row per language."""
    known = cut(counts.where(F.col("lang").isNotNull() & ~F.col("base_failed")).select("lang", "n_words", "chars", "common").distinct())
    first = cut(pooled(known).where(F.col("ref_words") >= min_reference).drop("ref_words"))
    small = first.count() <= MOST_LANGUAGES
    binned = lambda own, ref: F.coalesce(F.floor(js_distance(F.col(own), F.col(ref)) * BINS), F.lit(0)).cast("int")
    bins = F.array(binned("chars", "ref_chars"), binned("common", "ref_common")).alias("bins")
    placed = known.join(F.broadcast(first) if small else first, "lang").select(*known.columns, bins)
    # At most 2 (BINS + 1) rows a language, counted before they are dealt by language.
    counted = placed.select("lang", F.posexplode("bins").alias("kind", "bin")).groupBy("lang", "kind", "bin").agg(F.count("*").alias("n")).repartition("lang")
    below, every = F.sum("n").over(Window.partitionBy("lang", "kind").orderBy("bin")), F.sum("n").over(Window.partitionBy("lang", "kind"))
    middle = counted.withColumn("up", 2 * below >= every).where("up").groupBy("lang").agg(
        F.min(F.when(F.col("kind") == 0, F.col("bin"))).alias("most_chars"), F.min(F.when(F.col("kind") == 1, F.col("bin"))).alias("most_common"))
    near = placed.join(F.broadcast(middle) if small else middle, "lang").where("bins[0] <= most_chars AND bins[1] <= most_common")
    second = pooled(near).select("lang", F.col("ref_chars").alias("near_chars"), F.col("ref_common").alias("near_common"))
    found = first.join(second, "lang", "left").select("lang", F.coalesce("near_chars", "ref_chars").alias("ref_chars"), F.coalesce("near_common", "ref_common").alias("ref_common"))
    return F.broadcast(found) if small else found


def assess(docs: DataFrame, min_words: int = MIN_WORDS, min_reference: int = MIN_REFERENCE,
           char_limit: tuple[float, float] = CHAR_LIMIT, word_limit: tuple[float, float] = WORD_LIMIT) -> DataFrame:
    """A row per row of `docs`: the base numbers, both distances (null without a reference) and the verdict."""
    counts = features(docs)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = cut(counts.withColumn("base_failed", failed))
    judged = counts.join(references(counts, min_reference), "lang", "left").select(
        *[c for c in counts.columns if c not in ("chars", "common", "lang")],
        js_distance(F.col("chars"), F.col("ref_chars")).alias("char_distance"),
        js_distance(F.col("common"), F.col("ref_common")).alias("word_distance"),
    )
    limit = lambda ab: F.sqrt(F.lit(ab[0]) + F.lit(ab[1]) / F.greatest("n_words", F.lit(1)))
    near = (F.coalesce("char_distance", F.lit(0.0)) <= limit(char_limit)) & (F.coalesce("word_distance", F.lit(0.0)) <= limit(word_limit))
    return judged.withColumn("kept", ~F.col("base_failed") & near)


def keep(docs: DataFrame) -> DataFrame:
    """`docs`, same columns, without the rows that `assess` rejects. Rows equal in id, language and text have one verdict."""
    marked = [F.struct("doc_id", text_key(F.col("text")).alias("key"), F.col("lang").alias("own_lang")).alias("doc_id")]
    rejected = assess(docs.select(*marked, "text", "lang")).where(~F.col("kept")).select("doc_id.*").distinct()
    rejected = rejected.select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key"), F.col("own_lang").alias("bad_lang"))
    same = docs["doc_id"].eqNullSafe(rejected["bad_id"]) & (text_key(docs["text"]) == rejected["bad_key"]) & docs["lang"].eqNullSafe(rejected["bad_lang"])
    return docs.join(rejected, same, "left_anti")
