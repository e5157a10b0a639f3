"""File-level rules E01-E41 (B2, B3, B4, B5): one projection per file, no join, no shuffle.

Each regex sits behind a cheap `contains` test for text that any match must
hold, so clean files mostly pay for substring searches only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.dims import HINTS
from riskloom.functions.text import folded, matches, on_line, whole

HINT_TEXT = dict(HINTS)


class Source(NamedTuple):
    """The whole text of a file and its case-folded form, as columns."""

    text: Column
    upper: Column


Test = Callable[[Source], Column]


class FileRule(NamedTuple):
    rule_id: str
    group: str  # all | py | js | c
    label: str
    test: Test
    advice: str


def has(*words: str) -> Test:
    return lambda s: reduce(or_, [F.contains(s.text, F.lit(w)) for w in words])


def has_ci(*words: str) -> Test:
    return lambda s: reduce(or_, [F.contains(s.upper, F.lit(w.upper())) for w in words])


def rx(pattern: str, *gate: str) -> Test:
    return lambda s: has(*gate)(s) & matches(s.text, pattern)


def rx_ci(pattern: str, *gate: str) -> Test:
    return lambda s: has_ci(*gate)(s) & matches(s.text, pattern, ci=True)


def both(a: Test, b: Test) -> Test:
    return lambda s: a(s) & b(s)


def either(a: Test, b: Test) -> Test:
    return lambda s: a(s) | b(s)


def without(a: Test, b: Test) -> Test:
    return lambda s: a(s) & ~b(s)


# Words and forms of the SQL rule. The fifteen searches come down to four forms in one alternation.
SQL_GATE = ["SELECT", "INSERT", "UPDATE", "DELETE", "DROP"]  # each form needs one of them
SQL_BUILT = "|".join([
    on_line(r"""["'](?:SELECT|INSERT|UPDATE|DELETE|DROP)\b""", r"\+"),
    on_line(r"""f["']""", r"(?:SELECT|INSERT|UPDATE|DELETE|DROP)\b", r"\{"),
    on_line(r"""["'](?:SELECT|INSERT|UPDATE|DELETE)\b""", r"\.format\s*\("),
    on_line(r"""["']SELECT\b""", r"%\s*[\(s]"),
])
SQL_TEMPLATE = on_line(r"`SELECT\b", r"\$\{")

# C functions of E32-E39 with our advice.
C_CALLS = [
    ("E32", "strcpy", "Copy with a bound, for example strlcpy()."),
    ("E33", "strcat", "Append with a bound, for example strlcat()."),
    ("E34", "sprintf", "Format with a bound: snprintf()."),
    ("E35", "gets", "Read with a bound: fgets()."),
    ("E36", "scanf", "Give each conversion a width."),
    ("E37", "system", "Start programs with explicit arguments, not a command line."),
    ("E38", "popen", "Use a pipe and explicit arguments."),
    ("E39", "mktemp", "Create the file in one step: mkstemp()."),
]

# Rule ids, labels, groups, patterns and hint keys, in report order.
RULES = [
    FileRule("E01", "all", "Hardcoded API key detected", has("API_KEY", "aws_access_key_id"), HINT_TEXT["hardcoded secret"]),
    FileRule("E02", "all", "AWS access key detected (AKIA…)", rx(r"AKIA[0-9A-Z]{16,}", "AKIA"), HINT_TEXT["hardcoded secret"]),
    FileRule("E03", "all", "Hardcoded secret/token variable detected", rx_ci(
        r"""\b(SECRET|TOKEN|AUTH_TOKEN|ACCESS_TOKEN|AWS_SECRET|PRIVATE_KEY|CLIENT_SECRET|SECRET_KEY|ENCRYPTION_KEY|SIGNING_KEY)\b\s*=\s*["']""",
        "SECRET", "TOKEN", "_KEY"), HINT_TEXT["hardcoded secret"]),
    FileRule("E04", "all", "Hardcoded JWT token detected", rx(r"eyJ[A-Za-z0-9_-]{10,}\.", "eyJ"), HINT_TEXT["hardcoded secret"]),
    FileRule("E05", "all", "Hardcoded password detected", rx_ci(r"""\b(password|passwd|pwd)\b\s*=\s*["']""", "PASSW", "PWD"), HINT_TEXT["hardcoded secret"]),
    FileRule("E06", "all", "Private key embedded in source code", rx(r"-----BEGIN\s+(RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", "-----BEGIN"), HINT_TEXT["hardcoded secret"]),
    FileRule("E07", "all", "Possible long credential string detected", rx_ci(
        r"""\b(key|secret|token|credential)\b\s*=\s*["'][A-Za-z0-9+/=_-]{32,}["']""", "KEY", "SECRET", "TOKEN", "CREDENTIAL"), HINT_TEXT["hardcoded secret"]),
    FileRule("E08", "all", "Possible SQL injection", rx_ci(SQL_BUILT, *SQL_GATE), HINT_TEXT["sql injection"]),
    FileRule("E09", "all", "Possible SQL injection (template literal)", without(rx_ci(SQL_TEMPLATE, "`SELECT"), rx_ci(SQL_BUILT, *SQL_GATE)), HINT_TEXT["sql injection"]),
    FileRule("E10", "py", "Use of eval() detected", rx(whole("eval") + r"\s*\(", "eval"), HINT_TEXT["insecure function"]),
    FileRule("E11", "py", "Use of exec() detected", rx(whole("exec") + r"\s*\(", "exec"), "Do not run text as statements; dispatch to known functions."),
    FileRule("E12", "py", "Insecure deserialization (pickle)", rx(whole("pickle.load") + r"s?\s*\(", "pickle."), HINT_TEXT["insecure deserialization"]),
    FileRule("E13", "py", "Insecure YAML deserialization", without(rx(whole("yaml.load") + r"\s*\(", "yaml.load"), has("SafeLoader", "safe_load")), "Load YAML with the safe loader."),
    FileRule("E14", "py", "Insecure deserialization (marshal)", rx(whole("marshal.load") + r"s?\s*\(", "marshal."), "marshal trusts its input; use a checked data format."),
    FileRule("E15", "py", "subprocess with shell=True", has("shell=True"), HINT_TEXT["command injection"]),
    FileRule("E16", "py", "os.system/os.popen command execution", rx(whole("os.") + r"(system|popen)\s*\(", "os.system", "os.popen"), "Start programs with an argument list."),
    FileRule("E17", "py", "Deprecated hash algorithm (MD5/SHA-1)", rx(r"hashlib\.(md5|sha1)\s*\(", "hashlib."), HINT_TEXT["deprecated hash"]),
    FileRule("E18", "py", "Insecure random used for security-sensitive value", both(
        rx(whole("random.") + r"(random|randint|choice|randrange)\s*\(", "random."),
        has_ci("token", "secret", "password", "key", "nonce", "salt", "otp")), "Draw security values from the secrets module."),
    FileRule("E19", "py", "Assert used for access control", rx_ci(on_line(r"\bassert\b", "(?:auth|permission|role|admin|allowed)"), "ASSERT"), "Raise an error; asserts vanish in optimised runs."),
    FileRule("E20", "py", "TLS certificate verification disabled", rx(r"verify\s*=\s*False", "verify"), HINT_TEXT["insecure tls"]),
    FileRule("E21", "py", "Debug mode enabled", either(
        rx_ci(r"\bDEBUG\s*=\s*True\b", "DEBUG"), rx(r"\.run\s*\(.*debug\s*=\s*True", ".run")), "Run without debug mode in production."),
    FileRule("E22", "py", "Overly broad regex pattern", rx(r"""re\.(compile|search|match)\s*\(\s*['"](\.\*|\.\*\?|\^\.\*\$)['"]""", "re."), HINT_TEXT["insecure regex"]),
    FileRule("E23", "py", "Insecure temp file creation (mktemp)", rx(whole("tempfile.mktemp") + r"\s*\(", "tempfile.mktemp"), "Create the temporary file in one step."),
    FileRule("E24", "py", "Potential path traversal via open()", rx_ci(r"open\s*\(.*\b(request|input|argv|param|user|filename)\b", "OPEN"), HINT_TEXT["path traversal"]),
    FileRule("E25", "js", "Use of eval() in JavaScript", rx(whole("eval") + r"\s*\(", "eval"), HINT_TEXT["insecure function"]),
    FileRule("E26", "js", "Dynamic Function constructor (new Function)", rx(r"\bnew\s+Function\s*\(", "Function"), "Do not build functions from text."),
    FileRule("E27", "js", "child_process module imported", rx(r"""require\s*\(\s*["']child_process["']\s*\)""", "child_process"), HINT_TEXT["command injection"]),
    FileRule("E28", "js", "child_process.exec() – command injection risk", both(has("child_process"), rx(whole("exec") + r"\s*\(", "exec")), "Use the variant that takes an argument list."),
    FileRule("E29", "js", "DOM-based XSS risk (innerHTML/document.write)", either(
        rx(whole("innerHTML") + r"\s*=", "innerHTML"), rx(whole("document.write") + r"\s*\(", "document.write")), HINT_TEXT["xss"]),
    FileRule("E30", "js", "React dangerouslySetInnerHTML (XSS risk)", has("dangerouslySetInnerHTML"), "Clean the markup before you set it."),
    FileRule("E31", "js", "Hardcoded secret in JavaScript", rx_ci(
        r"""\b(password|api_key|secret|token)\b\s*[:=]\s*["']""", "PASSWORD", "API_KEY", "SECRET", "TOKEN"), HINT_TEXT["hardcoded secret"]),
    *[FileRule(rid, "c", f"Dangerous C function: {fn}()", rx(whole(fn) + r"\s*\(", fn), advice) for rid, fn, advice in C_CALLS],
    FileRule("E40", "c", "Potential format-string vulnerability (printf with variable)", rx(whole("printf") + r"\s*\(\s*[a-zA-Z_]\w*\s*\)", "printf"), "Keep the format a literal."),
    FileRule("E41", "c", "Hardcoded password in C/C++ source", rx_ci(on_line(r"\b(?:password|passwd)\b", r'=\s*"'), "PASSW"), HINT_TEXT["hardcoded secret"]),
]

NO_ISSUE = "No obvious issues found"
NO_ACTION = "No action required"


def language_of(path: Column) -> Column:
    """B2: py, js or c by suffix; `any` where the suffix says nothing and every group applies."""
    name = F.lower(path)
    return (
        F.when(name.rlike(r"\.pyw?\z"), "py")
        .when(name.rlike(r"\.(?:jsx?|tsx?|mjs|cjs)\z"), "js")
        .when(name.rlike(r"\.(?:c|cpp|cc|cxx|h|hpp)\z"), "c")
        .otherwise("any")
    )


def prepared(files: DataFrame) -> DataFrame:
    """Add what the rules read: `lang` and the case-folded text, each computed once per file."""
    return files.withColumns({"lang": language_of(F.col("path")), "folded": folded(F.col("content"))})


def issues_of(only: list[str] | None = None) -> Column:
    """The ordered array of rule hits of a prepared file.

    Hand this expression itself to inline() rather than a column that holds
    it: from a column Spark infers a `size > 0` filter, which would run all
    rules a second time further down the plan.
    """
    source = Source(F.col("content"), F.col("folded"))
    hits = []
    for seq, rule in enumerate(RULES, 1):
        if only and rule.rule_id not in only:
            continue
        test = rule.test(source)
        if rule.group != "all":
            test = F.col("lang").isin(rule.group, "any") & test
        hits.append(F.when(test, F.struct(
            F.lit(seq).alias("seq"), F.lit(rule.rule_id).alias("rule_id"),
            F.lit(rule.label).alias("issue"), F.lit(rule.advice).alias("suggestion"))))
    return F.array_compact(F.array(*hits))


def with_issues(files: DataFrame) -> DataFrame:
    return prepared(files).withColumn("issues", issues_of())


def engine_findings(files: DataFrame, only: list[str] | None = None) -> DataFrame:
    """One row per (file, rule hit); all other columns but the text stay."""
    rest = [c for c in files.columns if c != "content"]
    return prepared(files).select(*rest, F.inline(issues_of(only)))


def headline(files: DataFrame) -> DataFrame:
    """The first issue of each file, or the sentinel."""
    first = F.try_element_at("issues", F.lit(1))
    return with_issues(files).select(
        "path",
        F.coalesce(first["issue"], F.lit(NO_ISSUE)).alias("issue"),
        F.coalesce(first["suggestion"], F.lit(NO_ACTION)).alias("suggestion"),
        F.size("issues").cast("bigint").alias("n_issues"),
    )
