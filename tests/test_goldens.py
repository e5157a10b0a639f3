"""Whole files with known findings, in order. All secrets are invented."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskloom.functions.severity import severity_of
from riskloom.operators import enrich, export, file_rules, line_rules, python_rules, rollup
from riskloom.plans import scan

EXPORTER = '''"""Nightly export of invoices."""
import re
import hashlib, pickle
from pathlib import Path
import subprocess


class Store:
    passwd = "kestrel-41"

    def __init__(self, cursor):
        self.cursor = cursor
        apikey = 'zz-made-up-zz-01'
        self.mark = "invented_mark_of_24_chars"

    def totals(self, customer):
        text = "SELECT total FROM invoices WHERE customer = " + customer
        self.cursor.execute(text)
        return self.cursor.fetchall()


def load(folder):
    return [pickle.loads(p.read_bytes()) for p in Path(folder).glob("*.bin")]


def label(record):
    if re.search(".*", record["number"]):
        return eval(record["rule"])
    return hashlib.sha1(record["number"].encode()).hexdigest()


def publish(path):
    subprocess.call("cp " + path + " /srv/out", shell=True)
'''
EXPORTER_FOUND = [
    ("Hardcoded Secret", 9), ("Hardcoded Secret", 13), ("Possible Hardcoded Token", 14),
    ("Insecure Function Usage", 23), ("Insecure Function Usage", 28), ("Suspicious Subprocess Call", 33), ("Dangerous Import", 5),
    ("Deprecated Hash", 29), ("Possible SQL Injection", 18), ("Insecure Regex", 27),
]

LOOKUP = '''def visits(cursor, guest):
    wanted = f"SELECT day FROM visits WHERE guest = {guest}"
    cursor.execute(wanted)


def all_visits(cursor):
    cursor.execute("SELECT day FROM visits")
'''
SERVER_JS = '''import http from "http";

const settings = { retries: 3, secret: "invented-server-secret-77" };
const { exec } = require("child_process");

function find(db, id) {
  return db.run("DELETE FROM carts WHERE id = " + id);
}

http.createServer((req, res) => {
  exec("uptime", (error, text) => res.end(text));
  if (req.url.length > 99) eval(req.url);
}).listen(8080);
'''
GREETER_CPP = '''#include <cstdio>
#include <cstring>
#include <cstdlib>

static const char *api_key = "invented-77";

void greet(char *out, const char *who) {
  sprintf(out, "hello %s", who);
  char copy[8];
  strcpy(copy, who);
}

int main(int n, char **args) { return system(args[n - 1]); }
'''


def ordered(df, *keys):
    return [(r["type"], r["line"]) for r in df.orderBy(*keys).collect()]


def test_python_findings_in_detector_order(files):
    found = python_rules.analyze_python(files(("exporter.py", EXPORTER)))
    assert ordered(found, "detector", "seq") == EXPORTER_FOUND


def test_mended_sql_rules(files):
    text = 'q = "select " + x\ncursor.execute(q).fetchall()\ncursor.execute("SELECT A" + b)\nprint("select %s" + "" % z)\n'
    strict = python_rules.syntax_findings(files(("a.py", text)))
    mended = python_rules.syntax_findings(files(("a.py", text)), strict=False)
    assert strict.count() == 0
    assert sorted((r.rule_id, r.line) for r in mended.collect()) == [("P7", 4), ("P8", 3), ("P9", 2)]


def test_risk_of_a_file(files):
    source = files(("exporter.py", EXPORTER))
    found = python_rules.analyze_python(source).withColumn("severity", severity_of(F.col("type")))
    row = rollup.risk_summary(found).first()
    assert (row.high, row.medium, row.low, row.total_issues) == (4, 6, 0, 10)
    assert (row.score, row.score_2dp, row.risk) == (pytest.approx(0.76), 0.76, "High")
    assert row.rationale == "4 high-severity issue(s), 6 medium-severity issue(s)."
    score = rollup.top_files(rollup.file_scores(found, source)).first()
    assert (score.path, score.score, score.issues) == ("exporter.py", 38, 10)


def test_sql_js_cpp(files):
    assert ordered(python_rules.analyze_python(files(("a.py", LOOKUP))), "detector", "seq") == [("Possible SQL Injection", 3), ("Possible SQL Injection", 7)]
    assert ordered(python_rules.analyze_python(files(("a.js", SERVER_JS))), "detector", "seq") == [("Possible Hardcoded Token", 3)]
    assert ordered(python_rules.analyze_python(files(("a.cpp", GREETER_CPP))), "detector", "seq") == [("Hardcoded Secret", 5)]
    assert ordered(line_rules.js_line_findings(files(("a.js", SERVER_JS))), "seq") == [
        ("Hardcoded Secret", 3), ("Possible SQL Injection", 7), ("Suspicious Subprocess Call", 11), ("Insecure Function Usage", 12)]
    assert ordered(line_rules.cpp_line_findings(files(("a.cpp", GREETER_CPP))), "seq") == [
        ("Hardcoded Secret", 5), ("Dangerous Function", 8), ("Dangerous Function", 10), ("Dangerous Function", 13)]


def test_analyze_routes_by_suffix(files):
    made = files(("a.py", LOOKUP), ("b.JS", SERVER_JS), ("c.cpp", GREETER_CPP), ("d.txt", SERVER_JS))
    assert {r.path: r["count"] for r in scan.analyze(made).groupBy("path").count().collect()} == {"a.py": 2, "b.JS": 2, "c.cpp": 4}
    assert ordered(scan.analyze(made.where("path = 'b.JS'")), "seq") == [("Suspicious Subprocess Call", 11), ("Insecure Function Usage", 12)]
    by_lines = scan.analyze(made, js_tree=False).groupBy("path").count().collect()
    assert {r.path: r["count"] for r in by_lines} == {"a.py": 2, "b.JS": 4, "c.cpp": 4}


def test_headline_and_sentinel(files):
    rows = {r.path: r.issue for r in file_rules.headline(files(("k.py", 'API_KEY = "x"\n'), ("clean.py", "x = 1\n"))).collect()}
    assert rows == {"k.py": "Hardcoded API key detected", "clean.py": "No obvious issues found"}


def test_severities_of_the_types(spark):
    want = {
        "Hardcoded Secret": "High", "Possible Hardcoded Token": "High", "Insecure Function Usage": "Medium", "Dangerous Import": "Medium",
        "Deprecated Hash": "Medium", "Possible SQL Injection": "High", "Insecure Regex": "Medium", "Dangerous Function": "Medium",
        "resource use": "High", "remote execution": "High", "assert only": "Low", "import only": "Low", "broad regex": "Low", "": "Medium", None: "Medium",
    }
    df = spark.createDataFrame([(t,) for t in want], "type string")
    assert {r.type: r.s for r in df.select("type", severity_of(F.col("type")).alias("s")).collect()} == want


def test_file_rule_severities(spark):
    medium = {"E15", "E17", "E18", "E20", "E21", "E23", "E26", "E27", *[f"E{i}" for i in range(32, 41)]}
    low = {"E19", "E22"}
    df = spark.createDataFrame([(r.rule_id, r.label) for r in file_rules.RULES], "id string, label string")
    for r in df.select("id", severity_of(F.col("label")).alias("s")).collect():
        assert r.s == ("Medium" if r.id in medium else "Low" if r.id in low else "High"), r


def test_file_rule_templates(spark):
    generic = {"E07", "E22", "E23", "E26", "E40"}
    df = spark.createDataFrame([(r.rule_id, r.label) for r in file_rules.RULES], "id string, label string")
    rows = df.select("id", enrich.explain_offline(F.col("label"), F.lit(""), F.lit(""))["template"].alias("t")).collect()
    assert {r.id for r in rows if r.t is None} == generic
    assert {r.id: r.t for r in rows if r.id in ("E01", "E08", "E09", "E12", "E16", "E37")} == {
        "E01": "hardcoded api key", "E08": "possible sql injection", "E09": "possible sql injection",
        "E12": "insecure deserialization", "E16": "exec", "E37": "dangerous c function"}


def test_empty_summary(spark, files):
    nothing = scan.summary(None, spark)
    assert nothing.first().risk == "Unknown" and nothing.dtypes == scan.summary(files(("clean.py", ""))).dtypes
    row = scan.summary(files(("clean.py", "x = 1\n"))).first()
    assert (row.total_issues, row.risk, row.rationale) == (0, "Low", "No issues detected.")


def test_upload_keeps_every_finding(files):
    rows = scan.upload(files(("exporter.py", EXPORTER))).collect()
    assert len(rows) == file_rules.engine_findings(files(("exporter.py", EXPORTER))).count()
    assert all(r.explanation and r.fix and r.severity for r in rows)


def test_backend_falls_back_per_row(files):
    def sometimes(prompt: str) -> str:
        if "pickle" in prompt:
            raise RuntimeError
        return '{"explanation": "e", "fix": "f", "references": ["https://x.example/"]}'

    rows = scan.upload(files(("exporter.py", EXPORTER)), sometimes).collect()
    assert {r.llm_used for r in rows} == {"online", "offline"}
    assert all((r.llm_used == "offline") == ("pickle" in (r.type + r.snippet)) for r in rows)


def test_backend_is_asked_once_per_prompt(files, spark, tmp_path):
    asked = str(tmp_path / "asked")

    def noting(prompt: str) -> str:
        with open(asked, "a") as f:
            f.write(prompt.replace("\n", " ") + "\n")
        return '{"explanation": "e", "fix": "f", "references": ["https://x.example/ ", "no url"]}'

    made = files(("a.py", EXPORTER), ("b.py", EXPORTER))
    export.write_run(scan.upload(made, noting), str(tmp_path / "run"), "t")
    prompts = open(asked).read().splitlines()
    assert len(prompts) == len(set(prompts)) > 3
    back = spark.read.schema("references array<struct<url:string,description:string>>").json(str(tmp_path / "run/stage=cleaned/run_ts=t"))
    assert {r.references[0].url for r in back.collect()} == {"https://x.example/"}
    assert all("no url" not in [x.url for x in r.references] for r in back.collect())


def test_digest_runs_the_rules_once(files):
    """Counts and first findings read the stored findings: no rule is left in the report's plan."""
    found = scan.scan_all_located(files(("a.py", "eval(x)\n"), ("b.py", "eval(y)\n")))
    report = export.digest(found)
    assert "Generate" not in report._jdf.queryExecution().optimizedPlan().toString()
    assert sum(r.text.startswith("- Use of eval() detected in `") for r in report.collect()) == 2


def test_digest(files, spark):
    none = spark.createDataFrame([], "path string, seq long, type string, line int, snippet string, message string")
    assert [r.text for r in export.digest(none).collect()] == ["# Scan summary", "No issues found."]
    one = spark.createDataFrame([("a", 1, "T", None, 7, "s", "m")], "path string, seq long, type string, line int, startLine int, snippet string, message string")
    assert [r.text for r in export.digest(one).collect()][-1].startswith("- T in `a`:7 - m")


def test_parts_follow_the_number_of_findings(spark):
    """Far numbers, as line rules give them, do not cut a file with few findings."""
    rows = [("a", s, "T", 1, "x") for s in (5, 4000, 90000, 10**7)] + [("b", s, "T", 1, "x") for s in range(5)]
    df = spark.createDataFrame(rows, "path string, seq long, type string, line int, snippet string")
    got = {(r.path, r.part): [i.seq for i in r.issues] for r in rollup.findings_by_file(df, size=4).collect()}
    assert got == {("a", 0): [5, 4000, 90000, 10**7], ("b", 0): [0, 1, 2, 3], ("b", 1): [4]}
