"""Text expressions with the semantics of Python's str and re."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's `.` stops at \n only and its \b \w \s are Unicode: (?d) and (?U) give Java the same rules, but for the
# four separators U+001C to U+001F, which only Python counts as white space.
FLAGS, FLAGS_CI = "(?dU)", "(?dUi)"

# The line ends of str.splitlines and the characters of str.strip.
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0" + "".join(
    map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body` as a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dialect(pattern: str, ci: bool = False) -> str:
    """A Python pattern for Java: `\\s` also takes U+001C to U+001F, inside and outside of character classes."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        piece = pattern[i:i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(piece)
        if piece == "\\s":
            piece = r"\s\x1c-\x1f" if in_class else r"[\s\x1c-\x1f]"
        elif piece == "[":
            in_class = True
        elif piece == "]":
            in_class = False
        out.append(piece)
    return (FLAGS_CI if ci else FLAGS) + "".join(out)


def matches(col: Column, pattern: str, ci: bool = False) -> Column:
    return F.rlike(col, F.lit(dialect(pattern, ci)))


def whole(literal: str) -> str:
    """Pattern for a literal at a word start: the literal first, so that Java can skip ahead to it, then the check."""
    text = re.escape(literal)
    return rf"{text}(?<=\b{text})"


def on_line(*parts: str) -> str:
    """Pattern for parts that follow each other on one line, with anything in between.

    The first place of each part but the last is the best one, so none is
    tried twice: linear also on a long line, where `a.*b.*c` is not. The parts
    before the last must not span lines.
    """
    return "(?m)^" + "".join(f"(?>.*?{p})" for p in parts[:-1]) + ".*" + parts[-1]


def folded(col: Column) -> Column:
    """Upper case such that every case-insensitive match of an ASCII word survives.

    upper() maps the long s to S; the Kelvin sign, which (?i) takes for a k, is
    replaced by hand.  A `contains` test on the result then never misses what
    a Unicode (?i) regex finds.
    """
    return F.upper(F.replace(col, F.lit("\u212a"), F.lit("K")))


def only_newlines(content: Column) -> Column:
    """Whether \\n is the only line end in use, as in almost every file; then plain string functions do."""
    # Latin-1 characters one by one: Java looks those up in a table, and a range in a chain of tests.
    return ~F.rlike(content, F.lit(r"[\r\x0B\f\x1C\x1D\x1E\x85\u2028-\u2029]"))


def split_lines(content: Column, simple: Column | None = None) -> Column:
    """str.splitlines as an array: no empty piece after a final line end. `simple`: only_newlines(content), where it is known."""
    drop_tail = lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)
    simple = only_newlines(content) if simple is None else simple
    pieces = F.when(simple, F.split(content, "\n", -1)).otherwise(F.split(content, LINE_END, -1))
    return let(pieces, drop_tail)


def line_ends(text: Column, simple: Column) -> Column:
    """How many line ends `text` has; `simple` says that they are all \\n."""
    return F.when(simple, occurrences(text, "\n")).otherwise(F.regexp_count(text, F.lit(LINE_END)))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(WHITESPACE))


def occurrences(text: Column, mark: str) -> Column:
    """How often a mark of one ASCII character occurs; bytes are counted, as characters would have to be walked over."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))


BLOCK = 256


def running_sums(numbers: Column) -> Column:
    """Sums of the first 1, 2, ... numbers of an array.

    Block by block, so that a minified line with tens of thousands of matches
    costs n * sqrt(n) and not n * n.
    """
    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)

    def with_blocks(xs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(BLOCK))
        return let(F.transform(starts, lambda at: total(F.slice(xs, at, F.lit(BLOCK)))), lambda sums: with_heads(xs, sums))

    def with_heads(xs: Column, sums: Column) -> Column:
        heads = F.transform(sums, lambda _, b: F.when(b == 0, 0).otherwise(total(F.slice(sums, F.lit(1), F.greatest(b, F.lit(1))))))
        return let(heads, lambda before: F.transform(xs, lambda _, j: (
            F.get(before, F.floor(j / BLOCK).cast("int"))
            + total(F.slice(xs, (F.floor(j / BLOCK) * BLOCK + 1).cast("int"), j % BLOCK + 1)))))

    return let(numbers, with_blocks)


def _stretches(texts: Column, pieces: Column) -> Column:
    """What lies between the starts of neighbouring matches: the first piece, then each match with the piece behind it."""
    return let(pieces, lambda between: F.transform(
        texts, lambda _, i: F.when(i == 0, F.get(between, F.lit(0))).otherwise(F.concat(F.get(texts, i - 1), F.get(between, i)))))


def located_matches(content: Column, pattern: str, ci: bool = False) -> Column:
    """All matches of `pattern` in order, as array<struct<line, text>> (B8, F5). No match may be empty.

    `line` is 1 + the newlines before the match start.  Splitting by the pattern
    gives the pieces between the matches; newlines summed up over pieces and matches
    are the lines.  No character is set aside as a mark, and the text stays in its row.
    """
    regex = F.lit(dialect(pattern, ci))
    texts = F.regexp_extract_all(content, regex, F.lit(0))

    def lines(found: Column) -> Column:
        newlines = F.transform(_stretches(found, F.split(content, dialect(pattern, ci), -1)), lambda s: occurrences(s, "\n"))
        return F.transform(F.arrays_zip(running_sums(newlines).alias("line"), found.alias("text")),
                           lambda z: F.struct((z["line"] + 1).cast("int").alias("line"), z["text"].alias("text")))

    return let(texts, lines)


def placed_matches(content: Column, pattern: str) -> Column:
    """located_matches with the 1-based column as well: array<struct<line, column, text>>."""
    regex = dialect(pattern)

    def places(found: Column) -> Column:
        stretches = _stretches(found, F.split(content, regex, -1))
        ahead = running_sums(F.transform(stretches, F.length))  # characters before each match
        lines = running_sums(F.transform(stretches, lambda s: occurrences(s, "\n")))
        ends = running_sums(F.transform(F.split(content, "\n", -1), lambda line: F.length(line) + 1))
        return let(ends, lambda until: F.transform(
            F.arrays_zip(ahead.alias("ahead"), lines.alias("line"), found.alias("text")),
            lambda z: F.struct(
                (z["line"] + 1).cast("int").alias("line"),
                (z["ahead"] - F.coalesce(F.get(until, z["line"] - 1), F.lit(0)) + 1).cast("int").alias("column"),
                z["text"].alias("text"))))

    return let(F.regexp_extract_all(content, F.lit(regex), F.lit(0)), places)


def sanitize_text(col: Column) -> Column:
    """drop what str.isprintable rejects, squeeze blanks and tabs, strip."""
    printable = F.regexp_replace(col, r"[\p{C}\p{Z}&&[^ ]]", "")
    return strip(F.regexp_replace(printable, "[ \t]+", " "))


def glob_regex(pattern: str) -> str:
    """an fnmatch glob as an anchored Java regex. `*` any run, `?` one character, `[...]` a set."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2 if pattern[i + 1:i + 2] != "!" else i + 3) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and end > 0:
            body = pattern[i + 1:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("^", "\\^")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        else:
            out.append("\\" + c if not c.isalnum() and ord(c) < 128 else c)
        i += 1
    return "(?s)^(?:" + "".join(out) + r")\z"
