"""F1 severity of a finding type, and the weights used by the roll-ups."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.dims import SEVERITY_WEIGHTS, UNKNOWN_WEIGHT

# Substrings of the lower-cased type, tried tier by tier.
HIGH = [
    "secret", "hardcoded", "password", "api key", "aws access key", "jwt", "private key", "credential",
    "sql", "injection", "command injection", "rce",
    "deserialization", "pickle", "marshal", "yaml",
    "eval", "exec", "code injection",
    "xss", "innerhtml", "document.write",
    "path traversal",
]
MEDIUM = [
    "deprecated", "hash", "md5", "sha1", "sha-1",
    "subprocess", "shell", "os.system", "child_process", "system",
    "tls", "verify", "certificate",
    "debug",
    "random", "insecure random",
    "format string", "printf",
    "tempfile", "mktemp",
    "dangerous",
    "insecure", "suspicious",
]
LOW = ["regex", "assert", "import"]


def any_of(words: list[str]) -> str:
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


def severity_of(issue_type: Column) -> Column:
    t = F.lower(F.coalesce(issue_type, F.lit("")))
    return (
        F.when(t.rlike(any_of(HIGH)), "High")
        .when(t.rlike(any_of(MEDIUM)), "Medium")
        .when(t.rlike(any_of(LOW)), "Low")
        .otherwise("Medium")
    )


def weight_of(severity: Column) -> Column:
    out = F.lit(UNKNOWN_WEIGHT)
    for name, weight in SEVERITY_WEIGHTS.items():
        out = F.when(severity == name, weight).otherwise(out)
    return out.cast("bigint")
