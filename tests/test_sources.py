"""Readers, writers and manifests in a temporary folder."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from verdigris.sources import extract, files, web


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, raw in members.items():
            z.writestr(name, raw)
    return out.getvalue()


def test_extraction_by_kind(spark, tmp_path):
    docx = zipped({"word/document.xml": "<w:p><w:t>Hello</w:t></w:p><w:p><w:t>world</w:t></w:p>"})
    made = {
        "a.txt": b"plain \xff text", "b.html": b"<p>one</p><script>no()</script><b>two &amp; 3</b>", "c.csv": b"x,y\n1,2\n", "d.json": b'{"a": {"b": 1}, "c": [2, "z"]}', "e.jsonl": b'{"k": 1}\nbroken\n{"k": 2}\n',
        "f.eml": b"Subject: Hi\nFrom: a@b.c\nContent-Type: text/plain\n\nbody here\n", "g.docx": docx, "h.rtf": rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\pard Caf\'e9 text\par}", "i.zip": zipped({"in/j.txt": "deep", "k.zip": zipped({"l.md": "deeper"})}), "m.pdf": b"%PDF", "n.json": b"{", "o.zip": b"not a zip",
    }
    for name, raw in made.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.member: r.text for r in extract.extract(spark, str(tmp_path)).collect()}
    assert got == {
        "a.txt": "plain \ufffd text", "b.html": "one two & 3", "c.csv": "x | y\n1 | 2", "d.json": "b: 1\n2\nz", "e.jsonl": "k: 1\nk: 2", "f.eml": "Subject: Hi\nFrom: a@b.c\nbody here\n", "g.docx": "Hello world", "h.rtf": "Café text",
        "i.zip!in/j.txt": "deep", "i.zip!k.zip!l.md": "deeper", "m.pdf": None, "n.json": None, "o.zip": None,
    }


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.range(5).select(*(F.col("id").cast("string").alias(c) for c in files.REQUIRED))
    files.append_rows(rows, str(tmp_path / "log"))
    files.append_rows(rows, str(tmp_path / "log"))
    (tmp_path / "log" / "extra.json").write_text("\n[1]\n{bad\n")
    back = files.read_jsonl(spark, str(tmp_path / "log"), ", ".join(f"{c} string" for c in files.REQUIRED))
    assert back.count() == 10
    with pytest.raises(ValueError):
        files.append_rows(rows.drop("score"), str(tmp_path / "log"))


def test_manifest_changes(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text("1")
    (tmp_path / "x" / "b.txt").write_text("2")
    old = spark.createDataFrame(files.scanned(spark, str(tmp_path / "x")).collect())
    assert files.changed(old, files.scanned(spark, str(tmp_path / "x"))).isEmpty()
    (tmp_path / "x" / "a.txt").write_text("3")
    (tmp_path / "x" / "b.txt").unlink()
    (tmp_path / "x" / "c.txt").write_text("4")
    assert sorted(r.change for r in files.changed(old, files.scanned(spark, str(tmp_path / "x"))).collect()) == ["added", "altered", "removed"]


def test_provider_rows(spark):
    body = '{"results": [{"url": "https://A.org/x", "title": "", "snippets": ["p", "q"]}, {"url": "https://b.org", "title": "T", "snippets": []}]}'
    rows = web.provider_rows(spark.createDataFrame([(1, body), (2, "broken")], "query_id int, body string")).collect()
    assert [tuple(r) for r in rows] == [(1, 0, "https://A.org/x", "a.org", "p q"), (1, 1, "https://b.org", "T", "")]
