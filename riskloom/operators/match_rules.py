"""Rules on whole-text matches with line numbers: secrets (B8, P11-P13) and token rules (JX, CX).

Everything happens inside the file's row with higher-order functions, so the
text is never shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import dialect, folded, let, located_matches, matches, placed_matches, running_sums, split_lines, strip
from riskloom.operators.findings import context_of
from riskloom.operators.js_lexer import with_js_code
from riskloom.operators.line_rules import C_NAMES

# Fixed values: (rule, pattern, case-insensitive, type) of the secret search, in report order; then our message and
# the upper-case words of which a match must hold one.
SECRETS = [
    ("P11", r"""\b(password|passwd|pwd)\s*=\s*(['"][^'"]{4,}['"])""", True, "Hardcoded Secret", "A password is assigned as a literal; read it from a secret store.", ("PASSW", "PWD")),
    ("P12", r"""\b(api_key|apikey|aws_access_key_id|aws_secret_access_key)\s*=\s*(['"][^'"]{4,}['"])""", True, "Hardcoded Secret", "A key is assigned as a literal; read it from a secret store.", ("API_KEY", "APIKEY", "AWS_")),
    ("P13", r"""['"][A-Za-z0-9_\-]{20,}['"]""", False, "Possible Hardcoded Token", "A long literal looks like a token; make sure it is not one.", ()),
]


def secrets_of() -> Column:
    """The secrets of a prepared file, pattern by pattern, then in text order: array<struct<rule_id, type, line, snippet, message>>."""
    def search(rule: str, pattern: str, ci: bool, kind: str, message: str, words: tuple) -> Column:
        found = located_matches(F.col("content"), pattern, ci)
        test = matches(F.col("content"), pattern, ci)
        if words:
            test = reduce(or_, [F.contains("folded", F.lit(w)) for w in words]) & test
        return F.when(test, F.transform(found, lambda m: F.struct(
            F.lit(rule).alias("rule_id"), F.lit(kind).alias("type"), m["line"].alias("line"),
            m["text"].alias("snippet"), F.lit(message).alias("message"))))

    return F.flatten(F.array_compact(F.array(*[search(*secret) for secret in SECRETS])))


def secret_findings(files: DataFrame) -> DataFrame:
    """(path, seq, rule_id, type, line, snippet, message)."""
    prepared = files.select("path", "content", folded(F.col("content")).alias("folded"))
    return prepared.select("path", F.posexplode(secrets_of()).alias("pos", "f")).select(
        "path", (F.col("pos") + 1).cast("bigint").alias("seq"), "f.rule_id", "f.type", "f.line", "f.snippet", "f.message"
    )


# One alternative per token class; together they cover the whole text, so joining the tokens gives it back.
# Possessive repeats keep Java's matcher off the stack on long literals.
LINE_COMMENT = r"//[^\n]*+"
BLOCK_COMMENT = r"/\*[\s\S]*?(?:\*/|\z)"
DOUBLE = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"?+'
SINGLE = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?+"
TEMPLATE = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`?+"
TOKEN = "|".join([LINE_COMMENT, BLOCK_COMMENT, DOUBLE, SINGLE, TEMPLATE, r"[^/\"'`]++|/"])


def blank(text: Column) -> Column:
    """The text with every character but the newline turned into a space: same length, same lines."""
    return F.regexp_replace(text, r"[^\n]", " ")


def blanked(tokens: Column, literals: bool) -> Column:
    """The text with comments blanked and, if asked, the inside of literals too."""
    def one(t: Column) -> Column:
        out = F.when(t.startswith("//") | t.startswith("/*"), blank(t))
        if literals:
            quoted = F.substring(t, 1, 1).isin('"', "'", "`") & (F.length(t) > 1)
            inner = blank(F.substring(t, F.lit(2), F.length(t) - 2))
            out = out.when(quoted, F.concat(F.substring(t, 1, 1), inner, F.substring(t, -1, 1)))
        return out.otherwise(t)

    return F.array_join(F.transform(tokens, one), "")


def with_code_text(files: DataFrame, *gate: str) -> DataFrame:
    """Add `uncommented` (comments blanked) and `bare` (literals blanked as well).

    Only files that hold one of the `gate` words are worth cutting into tokens.
    """
    held = reduce(or_, [F.contains("content", F.lit(word)) for word in gate])
    tokens = F.regexp_extract_all("content", F.lit(TOKEN), F.lit(0))
    staged = files.where(held).withColumn("tokens", tokens)
    return staged.withColumns({
        "uncommented": blanked(F.col("tokens"), literals=False),
        "bare": blanked(F.col("tokens"), literals=True),
    }).drop("tokens")


def stripped_lines() -> Column:
    """The file's lines as snippets.

    Bind this with let() and pick from it: findings on one line then share one
    string, also when a minified line has tens of thousands of them.
    """
    return F.transform(split_lines(F.col("content")), strip)


def line_contexts(around: int) -> Column:
    """Each line's context snippet, to be shared in the same way."""
    return let(split_lines(F.col("content")), lambda lines: F.transform(lines, lambda _, i: context_of(lines, i + 1, around)))


def at(snippets: Column, line: Column) -> Column:
    return F.coalesce(F.try_element_at(snippets, line), F.lit(""))


NOT_MEMBER = r"(?<![\w$.])"
REGEXP_LITERAL = r"""\bnew\s+RegExp\s*\(\s*(?:"[^"\n]*\.\*[^"\n]*"|'[^'\n]*\.\*[^'\n]*')"""
# (rule, column to search, text it must hold, pattern, type, message)
JS_TOKENS = [
    ("JX1", "bare", "eval", NOT_MEMBER + r"eval\s*\(", "Insecure Function Usage", "eval() runs its input as code."),
    ("JX2", "called", "exec", NOT_MEMBER + r"(?:child_process|require\s*\([^()]*\))\s*\.\s*exec\s*\(", "Suspicious Subprocess Call", "A command is run through child_process."),
    ("JX4", "called", "RegExp", REGEXP_LITERAL, "Insecure Regex", "The pattern holds '.*'."),
]


def token_hits(lines: Column) -> Column:
    """JX1, JX2, JX4 of a file's row: array<struct<rule_id, type, line, snippet, message>>."""
    def search(rule: str, column: str, gate: str, pattern: str, kind: str, message: str) -> Column:
        found = located_matches(F.col(column), pattern)
        return F.when(F.contains(column, F.lit(gate)), F.transform(found, lambda m: F.struct(
            F.lit(rule).alias("rule_id"), F.lit(kind).alias("type"), m["line"].alias("line"),
            at(lines, m["line"]).alias("snippet"), F.lit(message).alias("message"))))

    return F.flatten(F.array_compact(F.array(*[search(*rule) for rule in JS_TOKENS])))


BINDING = r"""\{([^{}]*)\}\s*=\s*require\s*\(\s*['"]child_process['"]\s*\)"""
CALL_SITE = r"(?<![\w$.])(?<!\bfunction )[A-Za-z_$][\w$]*+\s*\("


def bound_hits(lines: Column) -> Column:
    """JX3, J7: calls of names bound from child_process: array<struct<rule_id, type, line, name, snippet>>. The semi-join stays within the file's row."""
    lists = F.regexp_extract_all("called", F.lit(dialect(BINDING)), F.lit(1))
    names = F.filter(
        F.transform(F.flatten(F.transform(lists, lambda l: F.split(l, ","))), lambda p: strip(F.substring_index(p, ":", 1))),
        lambda n: n != "")
    sites = F.transform(located_matches(F.col("bare"), CALL_SITE), lambda m: F.struct(
        m["line"].alias("line"), F.regexp_extract(m["text"], r"^[\w$]+", 0).alias("name")))
    calls = F.when(F.contains("content", F.lit("child_process")), let(names, lambda bound: F.filter(sites, lambda s: F.array_contains(bound, s["name"]))))
    return F.transform(calls, lambda c: F.struct(
        F.lit("JX3").alias("rule_id"), F.lit("Suspicious Subprocess Call").alias("type"), c["line"].alias("line"), c["name"].alias("name"),
        at(lines, c["line"]).alias("snippet")))


SQL_PIECE = r"select|insert|update|delete|where|from"


def sql_hits(lines: Column) -> Column:
    """JX5: each piece of a template literal that holds a SQL word, at the line where the literal starts: array<struct<rule_id, type, line, snippet>>."""
    pieces = F.flatten(F.transform("templates", lambda t: F.transform(t["pieces"], lambda p: F.struct(t["line"].alias("line"), p.alias("piece")))))
    hits = F.filter(pieces, lambda p: F.rlike(p["piece"], F.lit(dialect(SQL_PIECE, ci=True))))
    return F.transform(hits, lambda h: F.struct(
        F.lit("JX5").alias("rule_id"), F.lit("Possible SQL Injection").alias("type"), h["line"].alias("line"), at(lines, h["line"]).alias("snippet")))


def js_token_findings(files: DataFrame) -> DataFrame:
    """JX1, JX2, JX4: (path, rule_id, type, line, snippet, message)."""
    return with_js_code(files, "eval", "exec", "RegExp").select("path", F.inline(let(stripped_lines(), token_hits)))


def js_bound_calls(files: DataFrame) -> DataFrame:
    """JX3: (path, rule_id, type, line, name, snippet)."""
    return with_js_code(files, "child_process").select("path", F.inline(let(stripped_lines(), bound_hits)))


def js_template_sql(files: DataFrame) -> DataFrame:
    """JX5: (path, seq, rule_id, type, line, snippet), seq in the order of the text."""
    found = with_js_code(files, "`").select("path", F.posexplode(let(stripped_lines(), sql_hits)).alias("pos", "f"))
    return found.select("path", (F.col("pos") + 1).alias("seq"), "f.*")


def js_tree_findings(files: DataFrame) -> DataFrame:
    """JX1-JX5 as findings (path, seq, rule_id, type, line, snippet, message); seq follows line order, then rule order. One cut into tokens per file."""
    def all_hits(lines: Column) -> Column:
        def told(hits: Column, message) -> Column:
            return F.transform(hits, lambda h: F.struct(*[h[c].alias(c) for c in ("rule_id", "type", "line", "snippet")], message(h).alias("message")))

        bound = told(bound_hits(lines), lambda h: F.concat(h["name"], F.lit("() runs a command through child_process.")))
        sql = told(sql_hits(lines), lambda _: F.lit("SQL text is put together in a template literal; bind its values instead."))
        return F.flatten(F.array_compact(F.array(token_hits(lines), bound, sql)))

    found = with_js_code(files, "eval", "exec", "RegExp", "child_process", "`").select("path", F.inline(let(stripped_lines(), all_hits)))
    order = (F.col("line").cast("bigint") * 10 + F.substring("rule_id", 3, 1).cast("int")).alias("seq")
    return found.select("path", order, "rule_id", "type", "line", "snippet", "message")


C_CALL = r"\b(?:" + "|".join(C_NAMES) + r")\s*\("


def closed_calls(code: Column) -> Column:
    """Calls of the six names with the bracket that closes each: array<struct<level, line, column, text, close>>.

    Depths are running sums over all brackets of the file.  A bracket pair are neighbours among the brackets of its level, so one
    sort by (level, place) finds every pair, nested ones too; `close` is null where the text ends first.
    """
    def levelled(found: Column) -> Column:
        depths = running_sums(F.transform(found, lambda m: F.when(m["text"] == ")", -1).otherwise(1)))
        return F.array_sort(F.transform(F.arrays_zip(found.alias("m"), depths.alias("depth")), lambda z: F.struct(
            (z["depth"] + (z["m"]["text"] == ")").cast("int")).alias("level"),
            z["m"]["line"].alias("line"), z["m"]["column"].alias("column"), z["m"]["text"].alias("text"))))

    def paired(brackets: Column) -> Column:
        def one(e: Column, i: Column) -> Column:
            behind = F.get(brackets, i + 1)
            close = F.when((behind["level"] == e["level"]) & (behind["text"] == ")"), behind)
            return F.struct(e["line"].alias("line"), e["column"].alias("column"), e["text"].alias("text"), close.alias("close"))

        return F.filter(F.transform(brackets, one), lambda e: F.length(e["text"]) > 1)

    return let(placed_matches(code, C_CALL + "|[()]"), lambda found: let(levelled(found), paired))


def cpp_calls_extent(files: DataFrame, around: int = 1) -> DataFrame:
    """CX1: calls of exactly the six names, from the name to behind the closing bracket; a call that is never closed ends behind its opening one."""
    def described(contexts: Column) -> Column:
        def one(m: Column) -> Column:
            breaks = F.length(m["text"]) - F.length(F.replace(m["text"], F.lit("\n"), F.lit("")))
            opened = F.when(breaks > 0, F.length(F.substring_index(m["text"], "\n", -1)) + 1).otherwise(m["column"] + F.length(m["text"]))
            return F.struct(
                F.lit("Dangerous Function").alias("type"), m["line"].alias("line"),
                F.regexp_extract(m["text"], r"^\w+", 0).alias("name"),
                m["line"].alias("startLine"), m["column"].alias("startColumn"),
                F.coalesce(m["close"]["line"], m["line"] + breaks).alias("endLine"),
                F.coalesce(m["close"]["column"] + 1, opened).alias("endColumn"),
                at(contexts, m["line"]).alias("snippet"))

        return F.transform(closed_calls(F.col("bare")), one)

    return with_code_text(files, *C_NAMES).select("path", F.inline(let(line_contexts(around), described)))


# A variable with a type in front, given a literal on the same line.
DECLARED = r'\b[A-Za-z_]\w*+[ \t*&]++[A-Za-z_]\w*+[ \t]*+(?:\[[^\]\n]*\])?[ \t]*=[ \t]*"[^"\n]*"'
MIN_LITERAL = 9  # fixed value: more than 8 characters, counting the quotes as part of the literal's spelling


def cpp_literal_decls(files: DataFrame, around: int = 1) -> DataFrame:
    """CX2: variables initialised with a long string literal; the position is the literal's."""
    found = F.transform(placed_matches(F.col("uncommented"), DECLARED), lambda m: F.struct(
        m["line"].alias("line"),
        (m["column"] + F.position(F.lit('"'), m["text"]) - 1).alias("startColumn"),
        (m["column"] + F.length(m["text"])).alias("endColumn"),
        F.concat(F.lit('"'), F.substring_index(F.substring_index(m["text"], '"', -2), '"', 1), F.lit('"')).alias("literal")))
    long_ones = F.filter(found, lambda f: F.length(f["literal"]) >= MIN_LITERAL)
    described = let(line_contexts(around), lambda contexts: F.transform(long_ones, lambda f: F.struct(
        F.lit("Hardcoded Secret").alias("type"), f["line"].alias("line"), f["line"].alias("startLine"), f["startColumn"].alias("startColumn"),
        f["line"].alias("endLine"), f["endColumn"].alias("endColumn"), f["literal"].alias("literal"),
        at(contexts, f["line"]).alias("snippet"))))
    return with_code_text(files, '"').select("path", F.inline(described))
