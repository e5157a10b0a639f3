"""Registered queries: Python syntax rules and code structure (2.4, 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.corpus import code_corpus, of_type
from riskloom.operators import python_rules, structure
from riskloom.operators.code_facts import STRUCTURE_KINDS, code_facts as facts_table


def python_files(spark, sf_dir):
    return of_type(code_corpus(spark, sf_dir), ".py")


def analyze_python(spark, sf_dir):
    return python_rules.analyze_python(python_files(spark, sf_dir)).select("path", "detector", "rule_id", "type", "line", "snippet")


def rule_query(rule_id: str):
    def query(spark, sf_dir):
        found = python_rules.syntax_findings(python_files(spark, sf_dir), [rule_id])
        return found.select("path", "rule_id", "type", "line", "snippet")
    return query


def joined(args="args"):
    return F.array_join(args, ", ").alias("args")


def facts_imports(spark, sf_dir):
    return structure.imports(python_files(spark, sf_dir))


def facts_functions(spark, sf_dir):
    calls = F.array_join(F.array_sort("calls"), " ").alias("calls")
    return structure.functions(python_files(spark, sf_dir)).select("path", "name", joined(), calls, "docstring", "line")


def facts_calls(spark, sf_dir):
    return structure.function_calls(python_files(spark, sf_dir)).select("path", "parent", "name", joined(), "line")


def external_calls(spark, sf_dir):
    return structure.external_calls(python_files(spark, sf_dir)).select("path", "name", joined(), "line")


def facts_classes(spark, sf_dir):
    out = structure.classes(python_files(spark, sf_dir))
    return out.select("path", "name", "docstring", "line", F.array_join(F.transform("methods", lambda m: m["name"]), ", ").alias("methods"))


def facts_assignments(spark, sf_dir):
    return structure.assignments(python_files(spark, sf_dir)).select("path", "variable", "value", "line")


def facts_strings(spark, sf_dir):
    return structure.strings(python_files(spark, sf_dir)).select("path", "value", "line")


def facts_comments(spark, sf_dir):
    return structure.comments(python_files(spark, sf_dir)).select("path", "text", "line")


def facts_control_flow(spark, sf_dir):
    return structure.control_flow(python_files(spark, sf_dir)).select("path", "type", "value", "line")


def code_facts_(spark, sf_dir):
    kinds = tuple(k for k in STRUCTURE_KINDS if k != "comment")
    return facts_table(python_files(spark, sf_dir), kinds).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


def import_popularity(spark, sf_dir):
    return structure.import_popularity(python_files(spark, sf_dir))


def call_edges(spark, sf_dir):
    return structure.call_edges(python_files(spark, sf_dir))


QUERIES = {f.__name__.rstrip("_"): f for f in [
    analyze_python, facts_imports, facts_functions, facts_calls, external_calls, facts_classes, facts_assignments, facts_strings,
    facts_comments, facts_control_flow, code_facts_, import_popularity, call_edges,
]} | {f"py_P{i}": rule_query(f"P{i}") for i in range(1, 11)}
