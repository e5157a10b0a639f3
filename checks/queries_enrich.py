"""Registered queries: enrichment, references, responses and roll-ups (2.6, 2.8, 2.9, 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.corpus import code_corpus, table
from riskloom.functions import references, responses, text
from riskloom.functions.severity import severity_of, weight_of
from riskloom.operators import enrich, rollup
from riskloom.plans import scan
from riskloom.sources import files as sources
from riskloom.sources.documents import findings_from_json, rejected


def all_findings(files):
    """Findings of the file rules and of the secret search together, numbered per file."""
    return scan.scan_all_located(files).drop("rule_id")


def rated(files):
    """The cheap form for the roll-ups: type and severity only."""
    return scan.scan_all(files).drop("rule_id").withColumn("severity", severity_of(F.col("type")))


def source_of(path="path"):
    return F.element_at(F.split(path, "/"), 2)


def severity_map(spark, sf_dir):
    return rated(code_corpus(spark, sf_dir)).select("path", "seq", "type", "severity", weight_of(F.col("severity")).alias("weight"))


def hint_lookup(spark, sf_dir):
    return rated(code_corpus(spark, sf_dir)).select("path", "seq", "type", enrich.hint_for(F.col("type")).alias("hint"))


def explain_template(spark, sf_dir):
    told = all_findings(code_corpus(spark, sf_dir)).withColumn(
        "told", enrich.explain_offline(F.col("type"), F.lit("m"), F.col("snippet")))
    return told.select("path", "seq", "type", "told.template", "told.explanation", "told.fix", F.array_join("told.references", " ").alias("links"))


def kb_lookup(spark, sf_dir):
    return enrich.with_kb(rated(code_corpus(spark, sf_dir))).select("path", "seq", "type", "kb_key", "kb_fix", F.size(F.coalesce("kb_references", F.array().cast("array<string>"))).cast("bigint").alias("n_links"))


def merge_references(spark, sf_dir):
    known = enrich.with_kb(all_findings(code_corpus(spark, sf_dir)))
    told = enrich.explain_offline(F.col("type"), F.lit(""), F.lit(""))["references"]
    return known.select("path", "seq", F.array_join(references.merge_references(told, F.col("kb_references")), " ").alias("links"))


def enrich_findings(spark, sf_dir):
    out = enrich.enrich(all_findings(code_corpus(spark, sf_dir)))
    return out.select("path", "seq", "type", "line", "snippet", "severity", "explanation", "fix", "llm_used", F.array_join("references", " ").alias("links"))


def build_prompts(spark, sf_dir):
    return enrich.with_prompts(all_findings(code_corpus(spark, sf_dir)).withColumn("message", F.lit("check"))).select("path", "seq", "prompt")


def canned_backend(prompt: str) -> str:
    """A stand-in backend: fails on prompts without a line, else answers with JSON."""
    if " at line unknown\n" in prompt:
        raise RuntimeError("no answer")
    kind = prompt.split("finding: ", 1)[1].split("\n", 1)[0].rsplit(" at line ", 1)[0].replace('"', "")
    return '{"explanation": "about ' + kind + '", "remediation": "do better", "refs": ["https://example.org/a"]}'


def enrich_with_backend(spark, sf_dir):
    out = enrich.enrich_with_backend(all_findings(code_corpus(spark, sf_dir)), canned_backend)
    return out.select("path", "seq", "type", "severity", "explanation", "fix", "llm_used", F.array_join("references", " ").alias("links"))


def llm_usage(spark, sf_dir):
    return rollup.usage_counts(enrich.enrich_with_backend(all_findings(code_corpus(spark, sf_dir)), canned_backend))


def chat_reply(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return turns.select("conv_id", "turn", enrich.chat_reply(F.col("text")).alias("reply"))


def sanitize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.sanitize_text(F.concat(F.lit(" \t"), "text", F.lit("  ​!\t end \n"))).alias("clean"))


def url_variants(pages):
    """Each page URL in one of six forms, some of them not valid."""
    k = F.col("page_id") % 6
    return (F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("  "), "url", F.lit(" ")))
            .when(k == 2, F.replace("url", F.lit("http"), F.lit("HTTP"))).when(k == 3, F.lit("https://localhost/x"))
            .when(k == 4, F.concat("url", F.lit(r"\s"))).otherwise(F.concat(F.lit("see "), "url")))


def valid_url(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    u = url_variants(pages)
    return pages.select("page_id", references.is_valid_url(u).alias("valid"), references.is_valid_url(u, cleaning=True).alias("valid_clean"))


def reference_lists(spark, sf_dir):
    """One JSON list per page: a string, an object with url and name, one with href, one without a link, a number."""
    pages = table(spark, sf_dir, "pages").withColumn("u", url_variants(None))
    esc = F.replace("u", F.lit("\\"), F.lit("\\\\"))
    body = F.concat(
        F.lit('["'), esc, F.lit('", {"url": "'), esc, F.lit('", "name": " a  name "}, {"url": "", "href": "'), esc,
        F.lit('", "description": "text\\n here"}, {"title": "none"}, 5]'))
    return pages.select("page_id", body.alias("refs"))


def normalize_refs(spark, sf_dir):
    rows = reference_lists(spark, sf_dir).select("page_id", F.posexplode(references.normalise_references(F.col("refs"))).alias("pos", "r"))
    return rows.select("page_id", "pos", "r.url", "r.description")


def sanitize_stats(spark, sf_dir):
    sized = reference_lists(spark, sf_dir).select(
        references.count_references(F.col("refs")).cast("bigint").alias("raw"),
        F.size(references.normalise_references(F.col("refs"))).cast("bigint").alias("kept"))
    return sized.agg(F.sum(F.col("raw") - F.col("kept")).alias("removed_refs"), F.sum("kept").alias("normalized_refs"))


def json_text(col):
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))


def raw_completions(spark, sf_dir):
    """Each assistant turn as one of five response bodies."""
    turns = table(spark, sf_dir, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 5
    body = (
        F.when(k == 0, F.concat(F.lit('{"choices": [{"message": {"content": '), json_text("text"), F.lit("}}]}")))
        .when(k == 1, F.concat(F.lit('{"choices": [{"text": '), json_text("text"), F.lit("}]}")))
        .when(k == 2, F.concat(F.lit('{"text": '), json_text("text"), F.lit("}")))
        .when(k == 3, F.concat(F.lit('{"output": '), json_text("text"), F.lit("}")))
        .otherwise(F.col("text")))
    return turns.select("conv_id", "turn", body.alias("raw"))


def parse_completions(spark, sf_dir):
    return raw_completions(spark, sf_dir).select("conv_id", "turn", responses.completion_text(F.col("raw")).alias("content"))


def parse_explanations(spark, sf_dir):
    """Each turn as one of four answers: JSON, JSON with alias keys, text with markers, JSON that is no object."""
    turns = table(spark, sf_dir, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 4
    answer = (
        F.when(k == 0, F.concat(F.lit('{"explanation": '), json_text("text"), F.lit(', "fix": "f", "references": ["https://a.example/1", "b"]}')))
        .when(k == 1, F.concat(F.lit('{"explain": "", "description": '), json_text("text"), F.lit(', "fix": "", "remediation": "r", "refs": ["c"]}')))
        .when(k == 2, F.concat(F.lit("Fix: old\n"), "role", F.lit(" says\nRemediation: new\none\ntwo\nHTTP://x.example \nhttps://y.example\n")))
        .otherwise(F.lit("[1, 2]")))
    out = turns.select("conv_id", "turn", responses.parse_explanation(answer).alias("p"))
    return out.select("conv_id", "turn", "p.explanation", "p.fix", F.array_join("p.references", " ").alias("links"))


def parse_embeddings(spark, sf_dir):
    """Each vector of the table as one of six response bodies; every number must come back."""
    v = table(spark, sf_dir, "embeddings").withColumn("ints", F.transform("embedding", lambda x: F.floor(x * 1000)))
    body = F.array_join(F.transform("ints", lambda x: x.cast("string")), ", ")
    listed = F.concat(F.lit("["), body, F.lit("]"))
    k = F.col("vec_id") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit('{"embeddings": ['), listed, F.lit("]}")))
        .when(k == 1, F.concat(F.lit('{"object": "list", "data": [{"embedding": '), listed, F.lit("}]}")))
        .when(k == 2, F.concat(F.lit("["), listed, F.lit("]")))
        .when(k == 3, F.concat(F.lit('{"embedding": '), listed, F.lit("}")))
        .when(k == 4, listed)
        .otherwise(body))
    parsed = v.select("vec_id", F.explode(responses.parse_embeddings(raw)).alias("e"))
    return parsed.select("vec_id", F.array_join(F.transform("e", lambda x: x.cast("bigint").cast("string")), " ").alias("numbers"))


def json_or_raw(spark, sf_dir):
    """Event properties, every third one cut short so that it is no JSON any more."""
    events = table(spark, sf_dir, "events")
    stored = F.when(F.col("event_id") % 3 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    v = responses.json_or_raw(stored)
    return events.select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.raw", "string").alias("raw"))


def finding_documents(spark, sf_dir):
    """One findings document per source file: even ids in the flat form, odd ids as a map of two files."""
    base = code_corpus(spark, sf_dir).select("doc_id", "path")
    flat = F.concat(F.lit('[{"file": "'), "path", F.lit('", "type": "Hardcoded Secret", "line": 3, "snippet": "a", "message": "m"}, '
                    '{"type": "Deprecated Hash", "line": "x", "snippet": "b"}, {"file": "", "line": null}]'))
    grouped = F.concat(F.lit('{"'), "path", F.lit('": [{"type": "Insecure Regex", "line": "7"}, {"message": "none"}], "other": [{"type": "Dangerous Import"}]}'))
    broken = F.lit('{"cut')
    body = F.when(F.col("doc_id") % 7 == 0, broken).when(F.col("doc_id") % 2 == 0, flat).otherwise(grouped)
    return base.select("doc_id", body.alias("body"))


def findings_from_json_(spark, sf_dir):
    return findings_from_json(finding_documents(spark, sf_dir))


def enrich_documents(spark, sf_dir):
    out = scan.enrich_documents(finding_documents(spark, sf_dir))
    return out.select("doc_id", "path", "seq", "type", "severity", "llm_used")


def findings_rejected(spark, sf_dir):
    return rejected(finding_documents(spark, sf_dir)).select("doc_id", "body", "reason")


def findings_by_file(spark, sf_dir):
    rows = findings_from_json(finding_documents(spark, sf_dir))
    out = rollup.findings_by_file(rows, within=["doc_id"])
    return out.select("doc_id", "path", "part", F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["seq"].cast("string"), F.coalesce(i["type"], F.lit("-")))), " ").alias("issues"))


def severity_counts(spark, sf_dir):
    return rollup.severity_counts(rated(code_corpus(spark, sf_dir)).withColumn("source", source_of()), by=["source"])


def _risk(spark, sf_dir, *columns):
    out = rollup.risk_summary(rated(code_corpus(spark, sf_dir)).withColumn("source", source_of()), by=["source"])
    return out.select("source", *columns)


def risk_by_source(spark, sf_dir):
    return _risk(spark, sf_dir, "high", "medium", "low", "total_issues", F.round("score", 9).alias("score"), "risk", "rationale")


def risk_score(spark, sf_dir):
    return _risk(spark, sf_dir, "weighted", "total_issues", F.round("score", 9).alias("score"))


def risk_bucket(spark, sf_dir):
    return _risk(spark, sf_dir, "risk")


def risk_rationale(spark, sf_dir):
    return _risk(spark, sf_dir, "rationale")


def file_scores(spark, sf_dir):
    files = code_corpus(spark, sf_dir)
    return rollup.file_scores(rated(files), files)


def top_files(spark, sf_dir):
    files = code_corpus(spark, sf_dir)
    return rollup.top_files(rollup.file_scores(rated(files), files))


def corpus_summary(spark, sf_dir):
    files = code_corpus(spark, sf_dir)
    return rollup.corpus_summary(rated(files).withColumn("source", source_of()), files.select("source"), ["source"])


def type_counts(spark, sf_dir):
    return rollup.type_counts(rated(code_corpus(spark, sf_dir)))


def digest_top10(spark, sf_dir):
    return all_findings(code_corpus(spark, sf_dir)).orderBy("path", "seq").limit(10).select("path", "seq", "type", "line", "snippet")


def exclude_vendor(spark, sf_dir):
    return sources.exclude_vendor(code_corpus(spark, sf_dir)).select("path")


def exclude_globs(spark, sf_dir):
    return sources.exclude_globs(code_corpus(spark, sf_dir), ["f1*.py", "te?ts", "f[0-4]*.[!pj]*"]).select("path")


QUERIES = {f.__name__.rstrip("_"): f for f in [
    severity_map, hint_lookup, explain_template, kb_lookup, merge_references, enrich_findings, build_prompts, enrich_with_backend,
    llm_usage, chat_reply, sanitize_text, valid_url, normalize_refs, sanitize_stats, parse_completions, parse_explanations,
    parse_embeddings, json_or_raw, findings_from_json_, enrich_documents, findings_rejected, findings_by_file, severity_counts, risk_by_source, risk_score, risk_bucket, risk_rationale,
    file_scores, top_files, corpus_summary, type_counts, digest_top10, exclude_vendor, exclude_globs,
]}
