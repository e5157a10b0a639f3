"""Python syntax rules P1-P10 as filters and one as-of join over the facts (B11, U-1, J6, W4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.text import strip
from riskloom.operators.code_facts import code_facts
from riskloom.operators.match_rules import secret_findings

# Names and words the rules look for.
BARE_CALLS = ["eval", "exec", "compile", "input"]
PICKLE_CALLS = ["load", "loads"]
PROCESS_CALLS = ["Popen", "call", "run", "check_output"]
MODULES = ["os", "subprocess"]
WEAK_HASHES = ["md5", "sha1"]
SQL_WORDS = ["select", "insert", "update", "delete", "where", "from"]
RUNS_SQL = ["execute", "executemany"]
REGEX_CALLS = ["compile", "search", "match"]
BROAD = [".*", ".*?", "^.*$"]

BUILT_SQL = "SQL text is put together from parts; bind values instead."


def flag(name: str) -> Column:
    return F.array_contains(F.coalesce("flags", F.array().cast("array<string>")), name)


def sql_word(text: Column) -> Column:
    return F.coalesce(text.rlike("|".join(SQL_WORDS)), F.lit(False))


def seen(strict: bool) -> Column:
    """The SQL rules do not look inside calls, so a chained `.execute(...).fetchall()` goes unseen; the mended mode looks."""
    return ~flag("inside_call") if strict else F.lit(True)


def runs_sql(strict: bool = True) -> Column:
    return (F.col("kind") == "call") & F.col("name").isin(RUNS_SQL) & ~flag("bare") & ~flag("params") & seen(strict)


def rule(rule_id: str, detector: int, issue_type: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(detector).alias("detector"), F.lit(issue_type).alias("type"), text.alias("message"))


def rule_of_fact(strict: bool = True) -> Column:
    """The rule a single fact meets, as struct<rule_id, detector, type, message>, else null. `detector` is the report order."""
    kind, name, qual, value = F.col("kind"), F.col("name"), F.col("qual"), F.col("value")
    call = kind == "call"
    pattern = strip(value)
    broad = pattern.isin(BROAD) | (F.contains(value, F.lit(".*")) & (F.length(pattern) < 10))
    formatted = flag("mod") | F.contains(value, F.lit("format(")) | F.contains(value, F.lit("%")) | F.contains(value, F.lit("{")) | F.contains(value, F.lit("f'"))
    process = F.concat(F.lit("An external program is started; check its arguments."), F.when(flag("shell"), " It runs through the shell.").otherwise(""))
    module = F.concat(name, F.lit(" can run commands; review its use."))
    return (
        F.when(call & flag("bare") & name.isin(BARE_CALLS), rule("P1", 2, "Insecure Function Usage", F.concat(name, F.lit("() acts on its input as code or takes it unchecked."))))
        .when(call & (qual == "pickle") & name.isin(PICKLE_CALLS), rule("P2", 2, "Insecure Function Usage", "Unpickling untrusted bytes can run code."))
        .when(call & (qual == "subprocess") & name.isin(PROCESS_CALLS), rule("P3", 2, "Suspicious Subprocess Call", process))
        .when((kind == "import") & name.isin(MODULES), rule("P4", 3, "Dangerous Import", module))
        .when((kind == "import_from") & name.isin(MODULES), rule("P5", 3, "Dangerous Import", module))
        .when((kind == "attribute") & name.isin(WEAK_HASHES), rule("P6", 4, "Deprecated Hash", F.concat(name, F.lit(" is too weak for security; use SHA-256."))))
        .when((kind == "binop_add") & seen(strict) & sql_word(value) & formatted, rule("P7", 5, "Possible SQL Injection", BUILT_SQL))
        .when(runs_sql(strict) & flag("arg_const") & sql_word(F.lower(value)), rule("P8", 5, "Possible SQL Injection", "SQL is run without bound values."))
        .when(runs_sql(strict) & flag("arg_built") & sql_word(value if strict else F.lower(value)), rule("P8", 5, "Possible SQL Injection", "SQL is run without bound values."))
        .when(call & (qual == "re") & name.isin(REGEX_CALLS) & flag("arg_const") & broad, rule("P10", 6, "Insecure Regex", "The pattern matches almost anything."))
    )


# Which facts each rule reads.
RULE_FACTS = {
    "P1": ("call",), "P2": ("call",), "P3": ("call",), "P4": ("import",), "P5": ("import_from",), "P6": ("attribute",),
    "P7": ("binop_add",), "P8": ("call",), "P9": ("call", "assign"), "P10": ("call",),
}


def syntax_findings(files: DataFrame, rules: list[str] | None = None, strict: bool = True) -> DataFrame:
    """P1-P10, or those named, from one parse of each file.

    `strict` keeps two known gaps of the SQL rules: upper-case words in text
    built inside execute(), and anything inside another call. False mends them.

    P9 (J6, W4) is an as-of join: execute(variable) takes the variable's
    latest earlier assignment in the file, found as a running last value.
    Facts that no rule needs are dropped and SQL text is cut down to a flag
    before the only shuffle, which goes by file and variable.
    """
    wanted = list(rules or RULE_FACTS)
    facts = code_facts(files, tuple(sorted({k for r in wanted for k in RULE_FACTS[r]})))
    met = rule_of_fact(strict)
    columns = ["path", "visit_seq", "line", "snippet"]
    if "P9" not in wanted:
        found = facts.select(*columns, met.alias("met"))
    else:
        assigned = F.col("kind") == "assign"
        used = runs_sql(strict) & flag("arg_name")
        moves = facts.select(
            *columns, met.alias("met"), used.alias("used"),
            F.when(assigned, F.col("name")).when(used, F.col("value")).alias("variable"),
            F.when(assigned, sql_word(F.lower("value"))).alias("holds_sql"),
        ).where(F.col("met").isNotNull() | F.col("variable").isNotNull())
        so_far = Window.partitionBy("path", "variable").orderBy("visit_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        latest = F.last("holds_sql", ignorenulls=True).over(so_far)
        p9 = rule("P9", 5, "Possible SQL Injection", "The variable holds SQL text built from parts; bind values instead.")
        found = moves.withColumn("latest", latest).select(*columns, F.coalesce("met", F.when(F.col("used") & F.col("latest"), p9)).alias("met"))
    found = found.where(F.col("met").isNotNull()).select(*columns, "met.*")
    return found.where(F.col("rule_id").isin(wanted)) if rules else found


def analyze_python(files: DataFrame) -> DataFrame:
    """B11, U-1: secrets, then the syntax rules in detector order; unparseable files keep their secrets.

    `detector` and `seq` order the findings of a file.
    """
    secrets = secret_findings(files).select("path", F.lit(1).alias("detector"), "seq", "rule_id", "type", "line", strip(F.col("snippet")).alias("snippet"), "message")
    syntax = syntax_findings(files).withColumnRenamed("visit_seq", "seq")
    return secrets.unionByName(syntax.select("path", "detector", "seq", "rule_id", "type", "line", F.coalesce("snippet", F.lit("")).alias("snippet"), "message"))
