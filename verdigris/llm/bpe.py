"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts are split where no match of the pre-tokenizer's pattern can cross: before a
space whose predecessor is not white space. A long text is cut at such places and never
reaches the library whole unless it has none.

Defined cases: a null text counts as empty; an empty text has no tokens, the digests of
the empty string, and no decoded bytes; a text of any length is encoded whole; repeated rows
and null ids stay as they are; an empty table gives an empty table; extra columns stay in
``encode`` and ``decode``, but for one that bears the name of the new column, which is
replaced, and are not read by ``round_trip_digests``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.common import workers_ready

#: Characters of a part of a long text.
PART = 1 << 16
#: Before a space that follows anything but white space.
_SAFE = re.compile(r"(?<=\S)(?= )")
#: Only in such a run does the look-ahead of a pattern decide anything.
_RUN, _AHEAD = re.compile(r"\s\s"), r"\s+(?!\S)|"


def safe_parts(text: str, size: int = PART) -> list[str]:
    """Cut a long text at safe places into parts of about ``size`` characters; joined, they give the text."""
    if len(text) <= size:
        return [text]
    places, start = [0], 0
    while found := _SAFE.search(text, start + size):
        places.append(start := found.start())
    return [text[a:b] for a, b in zip(places, [*places[1:], len(text)], strict=True)]


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class RankCodec:
    """Encoder and decoder for one vocabulary of ranks.

    Parts without two white-space characters in a row use the pattern less its look-ahead:
    the matches are the same there, and the library's regular expressions run faster.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.plain = tiktoken.Encoding("plain", pat_str=pattern.replace(_AHEAD, ""), mergeable_ranks=ranks, special_tokens={}) if pattern.endswith(_AHEAD + r"\s+") else self.library

    def _part(self, text: str) -> list[int]:
        return (self.library if _RUN.search(text) else self.plain).encode_ordinary(text)

    def encode(self, text: str | None) -> list[int]:
        parts = safe_parts(text or "")
        return self._part(parts[0]) if len(parts) == 1 else list(chain.from_iterable(map(self._part, parts)))

    def decode(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> RankCodec:
    return RankCodec(ranks_of(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the array of ids of each text; other columns stay."""
    workers_ready(docs.sparkSession)
    rest = docs.drop(out)
    kind = T.StructType([*rest.schema.fields, T.StructField(out, T.ArrayType(T.LongType()))])

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            ids = pa.array([c.encode(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, out])

    return rest.mapInArrow(run, kind)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the raw bytes of each array of ids; a null array gives null."""
    workers_ready(docs.sparkSession)
    rest = docs.drop(out)
    kind = T.StructType([*rest.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            raw = [None if x is None else c.decode(x) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], names=[*b.schema.names, out])

    return rest.mapInArrow(run, kind)


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every whole text; per row its token count and the digests of ids and bytes."""
    workers_ready(docs.sparkSession)

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            n, ids_hash, raw_hash = [], [], []
            for t in b.column(1).to_pylist():
                ids = c.encode(t)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(("%d," * len(ids) % tuple(ids))[:-1].encode()).hexdigest())
                raw_hash.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(raw_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
