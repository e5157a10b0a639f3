"""Python workers must not need this package on their path."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from riskloom.session import local_session
spark = local_session(2, shuffle_partitions=2, memory="2g")
queries = entry.queries()
for name in ("py_P9", "knn_cosine", "kb_search", "expand_archives", "embed_batch", "enrich_with_backend"):
    assert queries[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all fine")
"""


def test_from_another_folder(tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=400)
    assert "all fine" in done.stdout, done.stderr[-3000:]
