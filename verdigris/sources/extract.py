"""Text of files by their kind, from binary content; archives are entered.

Kinds whose parsers are not in the standard library (PDF, 7z, RAR, MSG, images) give null,
so that a pipeline can count and route them.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import json
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.session import ship

#: Archives within archives that are entered, and bytes that a member may unpack to.
DEPTH, MOST_BYTES = 3, 256 << 20


class _Text(HTMLParser):
    """Text outside scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def squeezed(text: str) -> str:
    return " ".join(text.split())


def plain(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def html(raw: bytes) -> str:
    parser = _Text()
    parser.feed(plain(raw))
    parser.close()
    return squeezed(" ".join(parser.parts))


def table(raw: bytes) -> str:
    return "\n".join(" | ".join(row) for row in csv.reader(io.StringIO(plain(raw))))


def leaves(value) -> list[str]:
    """`key: value` lines of nested data."""
    if isinstance(value, dict):
        return [line for k, v in value.items() for line in (leaves(v) if isinstance(v, dict | list) else [f"{k}: {v}"])]
    if isinstance(value, list):
        return [line for v in value for line in leaves(v)]
    return [str(value)]


def json_text(raw: bytes) -> str:
    return "\n".join(leaves(json.loads(plain(raw))))


def json_lines(raw: bytes) -> str:
    found = []
    for line in plain(raw).splitlines():
        try:
            found += leaves(json.loads(line))
        except ValueError:
            continue
    return "\n".join(found)


def mail(raw: bytes) -> str:
    message = email.message_from_bytes(raw, policy=email.policy.default)
    body = message.get_body(("plain", "html"))
    text = "" if body is None else body.get_content()
    if body is not None and body.get_content_type() == "text/html":
        text = html(text.encode())
    return "\n".join([*(f"{k}: {message[k]}" for k in ("Subject", "From", "Date") if message[k]), text])


def rtf(raw: bytes) -> str:
    text = re.sub(r"\\'([0-9a-f]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), raw.decode("latin-1"))
    text = re.sub(r"\{\\\*?\\?(fonttbl|colortbl|stylesheet|info)[^{}]*(\{[^{}]*\}[^{}]*)*\}", "", text)
    return squeezed(re.sub(r"[{}]", "", re.sub(r"\\[a-z]+-?\d* ?", " ", text)))


def office(members: str) -> Callable[[bytes], str]:
    """Text of the XML members whose names match; paragraphs and cells are kept apart."""

    def read(raw: bytes) -> str:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            names = sorted((n for n in z.namelist() if re.fullmatch(members, n)), key=lambda n: (re.sub(r"\d+", "", n), int((re.findall(r"\d+", n) or [0])[-1])))
            return "\n".join(filter(None, (squeezed(re.sub(r"<[^>]+>", "", re.sub(r"</(?:\w+:)?(?:p|si|row|c|h)>", " ", plain(z.read(n))))) for n in names)))

    return read


READERS: dict[str, Callable[[bytes], str]] = {
    **dict.fromkeys(("txt", "md", "yaml", "yml", "log"), plain), **dict.fromkeys(("html", "htm"), html), "csv": table, "json": json_text, "jsonl": json_lines, "eml": mail, "rtf": rtf,
    "docx": office(r"word/document\.xml"), "pptx": office(r"ppt/slides/slide\d+\.xml"), "xlsx": office(r"xl/sharedStrings\.xml|xl/worksheets/sheet\d+\.xml"), "odt": office(r"content\.xml"),
}


def extracted(name: str, raw: bytes, depth: int = 0, deepest: int | None = DEPTH, most_bytes: int | None = MOST_BYTES) -> list[tuple[str, str | None]]:
    """(member path, text) of a file; several for an archive, null text where it can't be read.

    An archive deeper than ``deepest``, and a member that would unpack to more than
    ``most_bytes``, is one row with null text, so that it can be counted and read again with
    the bound None, which is none.
    """
    kind = PurePosixPath(name).suffix.lower().lstrip(".")
    if kind == "zip" and (deepest is None or depth < deepest):
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                found: list[tuple[str, str | None]] = []
                for i in z.infolist():
                    member = f"{name}!{i.filename}"
                    if most_bytes is not None and i.file_size > most_bytes:
                        found.append((member, None))
                    elif not i.is_dir():
                        found += extracted(member, z.read(i), depth + 1, deepest, most_bytes)
                return found
        except (zipfile.BadZipFile, RuntimeError):
            return [(name, None)]
    try:
        return [(name, READERS[kind](raw))]
    except (KeyError, ValueError, zipfile.BadZipFile):
        return [(name, None)]


def extract(spark: SparkSession, folder: str, deepest: int | None = DEPTH, most_bytes: int | None = MOST_BYTES) -> DataFrame:
    """(path, member, text, hash) of every file below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return of_contents(found, deepest, most_bytes)


def of_contents(found: DataFrame, deepest: int | None = DEPTH, most_bytes: int | None = MOST_BYTES) -> DataFrame:
    """(path, member, text, hash) of files given as (path, content)."""
    ship(found.sparkSession)

    def run(batches):
        import hashlib

        import pyarrow as pa

        kind = pa.schema([(c, pa.string()) for c in ("path", "member", "text", "hash")])
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                content = raw.as_py()
                if content is None:
                    continue
                digest = hashlib.sha256(content).hexdigest()
                rows = extracted(PurePosixPath(path).name, content, 0, deepest, most_bytes)
                yield pa.RecordBatch.from_pylist([{"path": path, "member": m, "text": t, "hash": digest} for m, t in rows], kind)

    return found.select("path", "content").mapInArrow(run, "path string, member string, text string, hash string").filter(F.col("member").isNotNull())
