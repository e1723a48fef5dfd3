"""Block archives: compressed rows that are scanned in byte ranges, or read by row number.

An archive is a folder of gzip files. Each file is a chain of members, one for a block of rows
(JSON lines); any gzip reader can read it whole. A member's header carries a fixed mark, its
length, and the number of its first row, so that a range of bytes can begin anywhere: the task
looks for the next mark and reads on until a member begins behind its range. Beside the files
stand the manifest, one row for each file, and the offset index, one for each block. Row numbers
are dense over all files, in the order that was asked for, however many ranges read them.

``scan`` reads everything in a given number of ranges through a Spark data source, whose planner
deals the ranges; ``get`` reads only the blocks of the rows that are asked for. The driver sees
the manifest, never rows or blocks. Files are opened with pyarrow's filesystems (file, hdfs, s3).

Defined cases: an empty table gives an archive without rows; numbers out of range or null are
left out of what ``get`` returns; a request that repeats is answered each time; a damaged block
is an error, or left out with ``damaged="skip"``. A task that was tried twice leaves a file that
no manifest names, which nobody reads.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from verdigris.session import ship

#: Fixed values of the format: the mark, and a header's layout before and in its extra field.
MARK = bytes.fromhex("76657264696772697320626c6f636b0a")
LEAD = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", 36) + b"VB" + struct.pack("<H", 32)
BEFORE_MARK, HEAD = len(LEAD), len(LEAD) + 32
#: Rows of a block, and bytes that are looked through at a time for a mark.
ROWS, WINDOW = 256, 1 << 20

INDEX = "part int, file string, block long, offset long, length long, first long, rows long"


def member(lines: list[bytes], first: int) -> bytes:
    """A block as one gzip member."""
    data = b"".join(line + b"\n" for line in lines)
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return LEAD + MARK + struct.pack("<QII", first, len(lines), HEAD + len(body)) + body


def head(data: bytes) -> tuple[int, int, int] | None:
    """(first row, rows, length) of the member that data begins with."""
    if len(data) < HEAD or data[:BEFORE_MARK] != LEAD or data[BEFORE_MARK : BEFORE_MARK + 16] != MARK:
        return None
    return struct.unpack("<QII", data[BEFORE_MARK + 16 : HEAD])


def lines_of(data: bytes) -> list[str]:
    """The rows of a member; an error if it is damaged."""
    unpack = zlib.decompressobj(31)
    text = unpack.decompress(data) + unpack.flush()
    if not unpack.eof:
        raise zlib.error("block is cut off")
    return text.decode("utf-8", "replace").split("\n")[:-1]


def opened(path: str):
    """(filesystem, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write(rows: DataFrame, path: str, order: list[Column], per_block: int = ROWS) -> None:
    """An archive of all rows under a path, in the order."""
    spark = rows.sparkSession
    ship(spark)

    def run(batches):
        import pyarrow as pa

        files, top = opened(path)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}.jsonl.gz"
        files.create_dir(f"{top}/data", recursive=True)
        held, at, first, told = [], 0, 0, []
        with files.open_output_stream(f"{top}/data/{name}", compression=None) as out:

            def flush():
                nonlocal at, first
                data = member(held, first)
                out.write(data)
                told.append((part, name, first // per_block, at, len(data), first, len(held)))
                at, first = at + len(data), first + len(held)
                held.clear()

            for b in batches:
                for line in b.column(0).to_pylist():
                    held.append(line.encode())
                    if len(held) == per_block:
                        flush()
            if held:
                flush()
        if told:
            kinds = (pa.int32(), pa.string(), *(pa.int64(),) * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*told, strict=True), kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    text = ordered.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))
    text.mapInArrow(run, INDEX).write.mode("overwrite").parquet(f"{path}/index")
    sizes = spark.read.parquet(f"{path}/index").groupBy("part", "file").agg(F.sum("length").alias("bytes"), F.sum("rows").alias("rows"))
    start, manifest = 0, []
    for r in sizes.orderBy("part").collect():
        manifest.append((r["part"], r["file"], r["bytes"], r["rows"], start))
        start += r["rows"]
    spark.createDataFrame(manifest, "part int, file string, bytes long, rows long, start long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def manifest(path: str) -> list[dict]:
    """(part, file, bytes, rows, start) of every file, in order of their rows."""
    import pyarrow.parquet as pq

    files, top = opened(path)
    return sorted(pq.read_table(f"{top}/manifest", filesystem=files).to_pylist(), key=lambda r: r["start"])


def ranges(files: list[dict], n: int) -> list[list[tuple[str, int, int, int]]]:
    """n shares of about equal bytes: pieces (file, begin, end, number of the file's first row)."""
    total = sum(f["bytes"] for f in files)
    cuts = [total * k // n for k in range(n + 1)]
    found: list[list] = [[] for _ in range(n)]
    at = 0
    for f in files:
        for k in range(n):
            begin, end = max(cuts[k], at), min(cuts[k + 1], at + f["bytes"])
            if begin < end:
                found[k].append((f["file"], begin - at, end - at, f["start"]))
        at += f["bytes"]
    return [pieces for pieces in found if pieces]


def next_member(source, at: int, end: int) -> int | None:
    """Where the first member at or behind a place begins, if it does before the end."""
    while at < end:
        data = source.read_at(min(WINDOW, source.size() - at), at)
        found = data.find(LEAD + MARK)
        if found >= 0:
            return at + found if at + found < end else None
        if len(data) < HEAD:
            return None
        at += max(1, len(data) - HEAD + 1)
    return None


def blocks(source, begin: int, end: int, damaged: str = "fail"):
    """(first row, its lines) of every member that begins in a range of bytes."""
    at = next_member(source, begin, end)
    while at is not None and at < end:
        known = head(source.read_at(min(HEAD, source.size() - at), at))
        try:
            if not known:
                raise zlib.error(f"no block at {at}")
            first, rows, length = known
            lines = lines_of(source.read_at(length, at))
            if len(lines) != rows:
                raise zlib.error(f"block at {at} has {len(lines)} rows, not {rows}")
            yield first, lines
            at += length
            if at < source.size() and at < end and not head(source.read_at(min(HEAD, source.size() - at), at)):
                raise zlib.error(f"no block at {at}")
        except zlib.error:
            if damaged != "skip":
                raise
            at = next_member(source, at + 1, end)


@dataclass
class Share(InputPartition):
    pieces: list


class ArchiveSource(DataSource):
    """``spark.read.format("verdigris_archive").option("ranges", n).load(path)``: row_id, line."""

    @classmethod
    def name(cls) -> str:
        return "verdigris_archive"

    def schema(self) -> str:
        return "row_id long, line string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("ranges", "8")), self.options.get("damaged", "fail"))


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, n: int, damaged: str):
        self.path, self.n, self.damaged = path, n, damaged

    def partitions(self):
        return [Share(pieces) for pieces in ranges(manifest(self.path), self.n)] or [Share([])]

    def read(self, partition):
        files, top = opened(self.path)
        for name, begin, end, start in partition.pieces:
            with files.open_input_file(f"{top}/data/{name}") as source:
                for first, lines in blocks(source, begin, end, self.damaged):
                    for k, line in enumerate(lines):
                        yield start + first + k, line


def scan(spark: SparkSession, path: str, n: int, schema: str, damaged: str = "fail") -> DataFrame:
    """row_id and the columns of a schema of all rows, read in n ranges of bytes."""
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    lines = spark.read.format("verdigris_archive").option("ranges", n).option("damaged", damaged).load(path)
    return lines.select("row_id", F.from_json("line", schema).alias("r")).select("row_id", "r.*")


def located(requests: DataFrame, row_id: str, path: str, per_block: int = ROWS) -> DataFrame:
    """requests with part, block and line of their row; numbers out of range are left out.

    A file is found by a search in the manifest's first rows, which every task has.
    """
    import numpy as np

    files = manifest(path)
    starts, parts, total = np.array([f["start"] for f in files], "i8"), np.array([f["part"] for f in files], "i4"), sum(f["rows"] for f in files)
    types = {f.name: f.dataType.simpleString() for f in requests.schema}
    ship(requests.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows and len(starts):
                ids = b.column(b.schema.get_field_index(row_id)).to_numpy(zero_copy_only=False)
                at = np.searchsorted(starts, ids, side="right") - 1
                within = ids - starts[at]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts[at]), pa.array(within // per_block), pa.array(within % per_block)], names=[*b.schema.names, "__part", "__block", "__line"])

    inside = requests.filter(F.col(row_id).isNotNull() & (F.col(row_id) >= 0) & (F.col(row_id) < total))
    return inside.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", __part int, __block long, __line long")


def fetched(wanted: DataFrame, path: str) -> DataFrame:
    """(row_id, line, bytes) of the rows (part, block, line, row_id), each block read once; bytes stand at its first row."""
    spark = wanted.sparkSession
    index = spark.read.parquet(f"{path}/index").select(F.col("part").alias("__part"), F.col("block").alias("__block"), "file", "offset", "length")
    # A block has a bounded number of rows, and so has its list.
    once = wanted.groupBy("__part", "__block").agg(F.sort_array(F.collect_set(F.struct("__line", "row_id"))).alias("lines"))
    asked = once.join(index, ["__part", "__block"]).select("file", "offset", "length", "lines").sortWithinPartitions("file", "offset")

    def run(batches):
        import pyarrow as pa

        files, top = opened(path)
        name, source = None, None
        for b in batches:
            found = []
            for file, offset, length, lines in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if file != name:
                    name, source = file, files.open_input_file(f"{top}/data/{file}")
                rows = lines_of(source.read_at(length, offset))
                found += [(x["row_id"], rows[x["__line"]], length if k == 0 else 0) for k, x in enumerate(lines)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["row_id", "line", "bytes"])

    return asked.mapInArrow(run, "row_id long, line string, bytes long")


def get(requests: DataFrame, row_id: str, path: str, schema: str, per_block: int = ROWS) -> DataFrame:
    """The requests' columns and those of their rows; what is read follows the requests, not the archive."""
    places = located(requests.select(F.col(row_id).cast("long").alias("row_id")).distinct(), "row_id", path, per_block)
    rows = fetched(places, path).select("row_id", F.from_json("line", schema).alias("r"))
    return requests.join(rows.select(F.col("row_id").alias("__row"), "r"), F.col(row_id) == F.col("__row")).select(*requests.columns, "r.*")
