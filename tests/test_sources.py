"""Folders, archives, pasted code, documents."""

from __future__ import annotations

import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from riskloom.functions.references import merge_references
from riskloom.functions.responses import parse_embeddings, parse_explanation
from riskloom.operators import rollup
from riskloom.sources import files as S
from riskloom.sources.documents import findings_from_json, rejected


def tree(root):
    for name, data in {
        "a.py": b"x = 1\r\ny = 2\r", "B.PY": b"eval(x)\n", "c.js": b"eval(x)\n", "d.txt": b"no", "bad.py": b"\xff\xfe",
        "sub/e.cpp": b"gets(a);\n", "sub/node_modules/f.js": b"eval(x)\n", "dist/g.py": b"eval(x)\n", "sub/skip_me/h.py": b"eval(x)\n", "noext": b"",
    }.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)


def paths(df):
    return sorted(r.path for r in df.select("path").collect())


def test_scan_folder(spark, tmp_path):
    root = tmp_path / "build" / "tree"  # a vendor name above the root does not count
    root.mkdir(parents=True)
    tree(root)
    assert paths(S.scan_files(spark, str(root))) == ["B.PY", "a.py", "c.js", "sub/e.cpp", "sub/skip_me/h.py"]
    assert paths(S.scan_files(spark, str(root), exclude=("skip_*",))) == ["B.PY", "a.py", "c.js", "sub/e.cpp"]
    assert paths(S.scan_files(spark, str(root), recursive=False)) == ["B.PY", "a.py", "c.js"]
    assert paths(S.scan_files(spark, str(root / "a.py"))) == ["a.py"]
    assert S.scan_files(spark, str(root)).where("path = 'a.py'").first().content == "x = 1\ny = 2\n"
    assert len(paths(S.scan_files(spark, str(root), ignore_vendor=False))) == 7


def test_archives(spark):
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("d/", b"")
        f.writestr("d/a.py", b"eval(x)\xff")
    with tarfile.open(fileobj=t, mode="w") as f:
        info = tarfile.TarInfo("b.js")
        info.size = 3
        f.addfile(info, io.BytesIO(b"b()"))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "b.js"
        f.addfile(link)
    rows = [("z.ZIP", z.getvalue()), ("t.tar", t.getvalue()), ("broken.zip", b"PK"), ("broken.tgz", b"plain"), ("c.py", b"c\xe9")]
    out = S.expand_archives(spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "path string, content binary")).collect()
    assert sorted((r.archive, r.path, r.content, r.error is not None) for r in out) == sorted([
        ("z.ZIP", "d/", "", False), ("z.ZIP", "d/a.py", "eval(x)", False), ("t.tar", "b.js", "b()", False), ("broken.zip", "broken.zip", None, True),
        ("broken.tgz", "broken.tgz", "plain", False), ("c.py", "c.py", "c", False)], key=lambda r: (r[0], r[1]))


def test_pasted_names(spark):
    df = spark.createDataFrame([(None, "a"), ("", "b"), ("x.js", "c")], "filename string, code string")
    assert paths(S.snippets(df)) == ["pasted.py", "pasted.py", "x.js"]


def test_documents(spark):
    docs = [
        (1, '[{"file": "a", "type": "T", "line": "4"}, {"type": "U"}]'), (2, '{"b": [{"type": "V", "line": 2}], "c": []}'),
        (3, "not json"), (4, '"text"'), (5, "[]"), (6, None),
    ]
    rows = findings_from_json(spark.createDataFrame(docs, "id int, body string")).orderBy("id", "seq").collect()
    assert [(r.id, r.path, r.type, r.line) for r in rows] == [(1, "a", "T", 4), (1, "<unknown>", "U", None), (2, "b", "V", 2)]


def test_lossy_reading_drops_bad_bytes_only(spark):
    texts = [b"x\xef\xbf\xbdy\xff", b"\xef\xbf\xbd", b"a\xf0\x9f\xef\xbf\xbdb", b"\xc3\xa9\xc3", b"", b"\xed\xa0\x80z", b"ok \xe6\x9d\xb1", b"\xff\xef\xbf", None]
    df = spark.createDataFrame([(i, None if t is None else bytearray(t)) for i, t in enumerate(texts)], "id int, content binary")
    got = {r.id: r.content for r in S.decode_lossy(df).collect()}
    assert got == {i: None if t is None else t.decode("utf-8", errors="ignore") for i, t in enumerate(texts)}


def test_rejected_documents(spark):
    bodies = {0: None, 1: "{cut", 2: "7", 3: '"x"', 4: "[]", 5: '{"f": []}', 6: "", 7: "null"}
    got = {r.id: r.reason for r in rejected(spark.createDataFrame(list(bodies.items()), "id int, body string")).collect()}
    other = "neither an object nor a list"
    assert got == {0: "no document", 1: "not JSON", 2: other, 3: other, 6: "not JSON", 7: other}


def test_hot_file_is_cut_into_parts(spark):
    rows = spark.range(5000).select(F.lit("<unknown>").alias("path"), F.col("id").alias("seq"), F.lit("T").alias("type"), F.lit(1).alias("line"), F.lit("").alias("snippet"))
    parts = rollup.findings_by_file(rows, size=300).orderBy("part").collect()
    assert max(len(p.issues) for p in parts) == 300
    assert [i.seq for p in parts for i in p.issues] == list(range(5000))


def test_merge_keeps_duplicates_of_the_first_list(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["b", "c", "c"]), (["a"], None), (None, ["c", "c"])], "x array<string>, y array<string>")
    got = [r[0] for r in df.select(merge_references(F.col("x"), F.col("y"))).collect()]
    assert got == [["a", "a", "b", "c"], ["a"], ["c"]]


def test_embedding_shapes(spark):
    cases = {
        '{"embeddings": [[1, 2], [3, 4]]}': [[1, 2], [3, 4]], '{"data": [{"embedding": [1.5]}, {"other": 1}, {"embedding": [2]}]}': [[1.5], [2]],
        "[[1, 2]]": [[1, 2]], "[1, 2]": [[1, 2]], '{"embedding": [7]}': [[7]], "1, 2 3.5": [[1, 2, 3.5]], "what?": [], "": [], '{"x": 1}': [],
    }
    df = spark.createDataFrame([(c,) for c in cases], "raw string")
    for r in df.select("raw", parse_embeddings(F.col("raw")).alias("e")).collect():
        assert r.e == cases[r.raw], r.raw


def test_explanations(spark):
    cases = [
        ('{"explanation": "e", "fix": "f", "references": ["u"]}', ("e", "f", ["u"])),
        ('{"explain": "x", "remediation": "r"}', ("x", "r", [])),
        ("Bad.\nFix: do\nthis\nnow\nlater\n https://no.example\nhttps://yes.example ", (None, "Fix: do this now", ["https://yes.example"])),
        ("plain", ("plain", "", [])),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], "raw string")
    for r, (raw, want) in zip(df.select("raw", parse_explanation(F.col("raw")).alias("p")).collect(), cases):
        assert (r.p.explanation, r.p.fix, r.p.references) == (want[0] or raw, *want[1:])
