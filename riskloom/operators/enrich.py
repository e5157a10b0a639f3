"""Enrichment of findings: hints, templates, knowledge base, prompts, backends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import dims
from riskloom.functions.calls import BoundedCalls
from riskloom.functions.references import merge_references
from riskloom.functions.responses import parse_explanation
from riskloom.functions.severity import severity_of
from riskloom.operators.retrieval import with_neighbours
from riskloom.session import stored

ExplainFn = Callable[[str], str]
CALL_SECONDS = 15.0  # fixed value: time limit of a backend call
OPEN_CALLS, ATTEMPTS = 8, 2


def hint_for(query: Column) -> Column:
    """Text of the first hint whose key is part of the query, or the other way round."""
    position = dims.first_match(F.lower(query), [k for k, _ in dims.HINTS])
    return F.coalesce(F.try_element_at(dims.strings([t for _, t in dims.HINTS]), position), F.lit(dims.HINT_DEFAULT))


def template_position(issue_type: Column) -> Column:
    """1-based template number: exact key first, else the first substring match, else null."""
    keys = [k for k, _, _, _ in dims.TEMPLATES]
    itype = F.lower(F.coalesce(F.nullif(issue_type, F.lit("")), F.lit("Unknown")))
    exact = F.nullif(F.array_position(dims.strings(keys), itype), F.lit(0)).cast("int")
    return F.coalesce(exact, dims.first_match(itype, keys))


def explain_offline(issue_type: Column, message: Column, snippet: Column) -> Column:
    """struct<template, explanation, fix, references>; types without a template get a generic text."""
    at = template_position(issue_type)

    def pick(i: int) -> Column:
        return F.try_element_at(dims.strings([t[i] for t in dims.TEMPLATES]), at)

    blank = F.lit("")
    generic = F.concat(F.lit("Finding '"), F.coalesce(issue_type, blank), F.lit("': "),
                       F.coalesce(message, blank), F.lit(" "), F.coalesce(snippet, blank))
    links = F.try_element_at(F.array(*[dims.strings(t[3]) for t in dims.TEMPLATES]), at)
    return F.struct(
        pick(0).alias("template"),
        F.coalesce(pick(1), generic).alias("explanation"),
        F.coalesce(pick(2), F.lit(dims.GENERIC_FIX)).alias("fix"),
        F.coalesce(links, dims.strings(dims.GENERIC_REFERENCES)).alias("references"))


def with_kb(findings: DataFrame) -> DataFrame:
    """Add the knowledge-base entry of the lower-cased type. 54 fixed rows, hence broadcast."""
    kb = dims.kb(findings.sparkSession).select(
        F.col("key").alias("kb_key"), F.col("summary").alias("kb_summary"), F.col("fix").alias("kb_fix"), F.col("references").alias("kb_references"))
    return findings.join(F.broadcast(kb), F.lower(F.coalesce("type", F.lit(""))) == F.col("kb_key"), "left")


def enrich(findings: DataFrame) -> DataFrame:
    """F8 with the built-in templates: no shuffle, one broadcast of the fixed knowledge base."""
    rest = [c for c in findings.columns if c not in ("type", "line", "snippet", "message")]
    out = with_kb(findings).withColumn("told", explain_offline(F.col("type"), F.col("message"), F.col("snippet")))
    return out.select(
        *rest, "type", "line", "snippet", "message",
        severity_of(F.col("type")).alias("severity"),
        F.col("told.explanation").alias("explanation"), F.col("told.fix").alias("fix"),
        F.lit("offline").alias("llm_used"),
        merge_references(F.col("told.references"), F.col("kb_references")).alias("references"))


def prompt_for(issue_type: Column, line: Column, snippet: Column, message: Column, summary: Column,
               retrieved: Column | None = None, history: Column | None = None) -> Column:
    """the text a backend is asked with. Knowledge lines that are empty are left out."""
    blank = F.lit("")
    knowledge = F.array(F.coalesce(summary, blank))
    if retrieved is not None:
        knowledge = F.concat(knowledge, F.coalesce(retrieved, F.array().cast("array<string>")))
    parts = [
        F.lit("A scanner flagged the code below. Say what can go wrong, how to repair it, and where to read more."),
        F.concat(F.lit("finding: "), F.coalesce(issue_type, F.lit("Issue")), F.lit(" at line "), F.coalesce(line.cast("string"), F.lit("unknown"))),
        F.concat(F.lit("code: "), F.coalesce(snippet, blank)),
        F.concat(F.lit("scanner's note: "), F.coalesce(message, blank)),
        F.lit("background:"),
        F.array_join(F.filter(knowledge, lambda k: k.isNotNull() & (k != "")), "\n"),
    ]
    if history is not None:
        parts += [F.lit("earlier turns:"), F.coalesce(history, blank)]
    parts.append(F.lit("Reply in JSON: explanation and fix as texts, references as a list of URLs."))
    return F.concat_ws("\n", *parts)


def with_prompts(findings: DataFrame, retrieve: int = 3) -> DataFrame:
    """Findings with their knowledge-base entry, its nearest neighbours and the prompt made of them."""
    known = with_kb(with_neighbours(findings, retrieve))
    texts = F.transform("retrieved", lambda r: r["text"])
    return known.withColumn("prompt", prompt_for(
        F.col("type"), F.col("line"), F.col("snippet"), F.col("message"), F.col("kb_summary"), texts)).drop("retrieved")


def ask(prompts: DataFrame, explain_fn: ExplainFn, seconds: float = CALL_SECONDS, open_calls: int = OPEN_CALLS, attempts: int = ATTEMPTS) -> DataFrame:
    """(prompt_id, prompt) -> (prompt_id, answer); a call that fails or runs over its time answers null.

    The limits hold for each task: the backend sees at most tasks x `open_calls` calls at a time.
    """
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answers = BoundedCalls(explain_fn, seconds, open_calls, attempts)
        for batch in batches:
            yield pd.DataFrame({"prompt_id": batch["prompt_id"], "answer": pd.Series(answers(list(batch["prompt"])), dtype=object)})

    return prompts.select("prompt_id", "prompt").mapInPandas(call, "prompt_id string, answer string")


def enrich_with_backend(findings: DataFrame, explain_fn: ExplainFn | None = None, seconds: float = CALL_SECONDS, open_calls: int = OPEN_CALLS, attempts: int = ATTEMPTS) -> DataFrame:
    """Enrich through an injected backend; rows it fails on use the templates.

    Each distinct prompt is asked once.  Answers come back over the prompt's
    digest, so a prompt shared by many findings is one small row on one side
    and a skewed key that AQE splits on the other.
    """
    if explain_fn is None:
        return enrich(findings)
    rest = [c for c in findings.columns if c not in ("type", "line", "snippet", "message")]
    # Written once: the rules run once, and the prompts that are asked are those that are joined.
    asked = stored(with_prompts(findings).withColumn("prompt_id", F.sha2("prompt", 256)), "asked")
    prompts = asked.groupBy("prompt_id").agg(F.first("prompt").alias("prompt"))
    answers = stored(ask(prompts, explain_fn, seconds, open_calls, attempts), "answers").withColumn("parsed", F.when(F.col("answer").isNotNull(), parse_explanation(F.col("answer"))))
    told = F.coalesce("parsed", explain_offline(F.col("type"), F.col("message"), F.col("snippet")).dropFields("template"))
    return (
        asked.drop("prompt").join(answers, "prompt_id", "left").withColumn("told", told)
        .select(
            *rest, "type", "line", "snippet", "message", severity_of(F.col("type")).alias("severity"),
            F.col("told.explanation").alias("explanation"), F.col("told.fix").alias("fix"),
            F.when(F.col("parsed").isNotNull(), "online").otherwise("offline").alias("llm_used"),
            merge_references(F.col("told.references"), F.col("kb_references")).alias("references")))


def chat_reply(message: Column) -> Column:
    """what a chat turn is answered with offline: explanation, else fix, else nothing."""
    told = explain_offline(F.lit("chat"), message, F.lit(""))
    return F.coalesce(F.nullif(told["explanation"], F.lit("")), F.nullif(told["fix"], F.lit("")), F.lit(""))
