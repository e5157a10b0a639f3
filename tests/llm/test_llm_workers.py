"""Python workers must not need this package on their path."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[2])
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from riskloom.llm.queries import QUERIES
from riskloom.session import local_session
spark = local_session(4, shuffle_partitions=4, memory="3g", **{{"spark.checkpoint.dir": sys.argv[1]}})
queries = entry.queries()
assert len(QUERIES) == 13
for name in (*QUERIES, "pipeline"):
    assert queries[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all fine")
"""


def test_from_another_folder(tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path / "shared")], cwd=tmp_path, capture_output=True, text=True, timeout=1500)
    assert "all fine" in done.stdout, done.stderr[-3000:]
