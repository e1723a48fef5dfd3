"""Best-fit packing of token pieces into fixed-size sequences.

Every partition packs its own pieces online: a fixed number of open bins is kept in a
bitset keyed by free space, a piece goes to the open bin with the least sufficient room,
and when the number is exceeded the fullest bin closes first. Pieces arrive in the order of
a hash, a bounded window of them is looked at together, the longest first, so that the
memory of a task does not grow with its input. Only the pieces' sizes are shuffled, never
texts or ids, and the order of arrival is the same when a task runs again.

Defined cases: a null or empty text is the end token alone; repeated rows are packed
each; pieces that tie in length go by id and piece; an empty table gives no pieces; a text
of any length is cut, never truncated; extra columns are not read by ``pack_documents``, and
stay in ``pack``, where ``sequence_id`` and ``offset`` are replaced.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.bpe import RankCodec
from verdigris.llm.common import workers_ready, written

#: Fixed value: the split that byte-level pre-tokenizers apply before merging.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Open bins of a partition, pieces looked at together, and pieces that a partition gets on average.
OPEN_BINS, WINDOW, PIECES_A_PARTITION = 2048, 4096, 32_768


class FileTokenizer:
    """Ids as the tokenizers library gives them for a file, as little-endian 32-bit integers.

    The library defines the result. For a byte-level BPE file whose merges are in the order of
    the ids, the same merges run through tiktoken, several times faster; texts that hold a
    special string, and files of another kind, go to the library itself. Tests hold the two
    ways equal on whole tables.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        step = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] == "BPE" and not spec.get("normalizer") and step.get("type") == "ByteLevel" and not step.get("add_prefix_space") and step.get("use_regex", True) and merges_follow_ids(spec["model"]):
            raw = bytes_of_characters()
            ranks = {bytes(raw[c] for c in word): k for word, k in spec["model"]["vocab"].items() if word not in self.special}
            self.fast = RankCodec(ranks, BYTE_LEVEL_PATTERN)

    def ids(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode(text), "<u4").tobytes()


def merges_follow_ids(model: dict) -> bool:
    """Whether every merge makes the next higher id, above those of single bytes, so that ids rank the merges."""
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    made = [model["vocab"][a + b] for a, b in pairs]
    single = [k for word, k in model["vocab"].items() if len(word) == 1]
    return made == sorted(set(made)) and max(single, default=-1) < min(made, default=0)


def bytes_of_characters() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character: itself if printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=4)
def tokenizer(path: str) -> FileTokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return FileTokenizer(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; only the first may be shorter."""
    first = n % capacity or capacity
    if n <= capacity:
        return [(0, n)]
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Tokenize and cut: doc_id, piece, start, length, ids_crc32 (and ids, if asked for)."""
    workers_ready(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        t = tokenizer(path)
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = t.ids(text or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    row = [doc, k, start, length, zlib.crc32(part)] + [np.frombuffer(part, "<u4").astype("i8")] * with_ids
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=False)], names=names)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)


class OpenBins:
    """Best fit with a bounded number of open bins in a bitset keyed by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made = 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, self.made
            self.made += 1
        if left := free - length:
            self.at[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return bin_, self.capacity - free

    def _take(self, free: int) -> int:
        bin_ = self.at[free].pop()
        if not self.at[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_


def pack(sized: DataFrame, capacity: int = 1024, open_bins: int = OPEN_BINS, partitions: int = 1, window: int = WINDOW) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of 1 to ``capacity``; other columns stay."""
    rest = sized.drop("sequence_id", "offset")
    at = rest.columns.index("length")

    def run(batches):
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 33

        def placed(t):
            lengths = t.column(at).to_numpy()
            order = np.argsort(-lengths, kind="stable")
            where = np.array([bins.place(n) for n in lengths[order].tolist()], "i8")[np.argsort(order)]
            return t.append_column("sequence_id", pa.array(base + where[:, 0])).append_column("offset", pa.array(where[:, 1])).to_batches()

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= window:
                t = pa.Table.from_batches(held)
                yield from placed(t.slice(0, window))
                held, n = t.slice(window).to_batches(), n - window
        if n:
            yield from placed(pa.Table.from_batches(held))

    workers_ready(sized.sparkSession)
    keys = [c for c in ("doc_id", "piece") if c in rest.columns] or ["length"]
    dealt = rest.repartition(partitions, *keys).sortWithinPartitions(F.xxhash64(*keys), *keys)
    return dealt.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack whole documents; with_ids carries each piece's ids along."""
    sized = written(pieces(docs, path, capacity, end_id, with_ids), "pieces")
    return pack(sized, capacity, open_bins, max(1, math.ceil(sized.count() / PIECES_A_PARTITION)))
