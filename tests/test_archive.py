"""Block archives: dense row numbers by any number of ranges, and reads that follow the request."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from verdigris.sources import archive

SCHEMA = "k long, text string"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    texts = ["", "x", "zeile\nzwei", "ü日😀 ", "w" * 3000]
    rows = [(k, f"{texts[k % 5]} {k}" if k % 11 else None) for k in range(2500)]
    path = str(tmp_path_factory.mktemp("archive"))
    archive.write(spark.createDataFrame(rows, SCHEMA).repartition(5), "file://" + path, [F.col("k")], per_block=32)
    return path, rows


def test_ranges_give_the_same_rows(spark, stored):
    path, rows = stored
    want = [(k, *r) for k, r in enumerate(rows)]
    for n in (1, 2, 3, 7, 40, 1000):
        read = archive.scan(spark, "file://" + path, n, SCHEMA)
        assert sorted(map(tuple, read.collect())) == want
        assert read.rdd.getNumPartitions() <= n


def test_any_gzip_reader_reads_it(stored):
    path, rows = stored
    found = []
    for f in archive.manifest(path):
        with gzip.open(f"{path}/data/{f['file']}", "rt", encoding="utf-8") as lines:
            found += [tuple(json.loads(line).values()) for line in lines]
    assert found == rows


def test_reads_follow_the_request(spark, stored):
    path, rows = stored
    ids = [1203, 5, 2499, 5, -1, 2500, None, 1204, 1203]
    requests = spark.createDataFrame(list(enumerate(ids)), "pos int, want long")
    got = sorted(map(tuple, archive.get(requests, "want", "file://" + path, SCHEMA, 32).collect()))
    assert got == [(p, i, *rows[i]) for p, i in enumerate(ids) if i is not None and 0 <= i < 2500]
    places = archive.located(spark.createDataFrame([(i,) for i in {1203, 1204, 5, 2499}], "row_id long"), "row_id", "file://" + path, 32)
    read = archive.fetched(places, "file://" + path).agg(F.sum("bytes"), F.count_if(F.col("bytes") > 0)).first()
    index = spark.read.parquet(f"file://{path}/index")
    assert read[1] == 3  # 1203 and 1204 share a block
    assert read[0] <= 3 * index.agg(F.max("length")).first()[0] < index.agg(F.sum("length")).first()[0] / 10


def test_damaged_block(spark, stored, tmp_path):
    rows = [(k, "text " * (k % 7)) for k in range(200)]
    archive.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"file://{tmp_path}", [F.col("k")], per_block=10)
    index = sorted(spark.read.parquet(f"file://{tmp_path}/index").collect(), key=lambda r: (r.part, r.block))
    hurt = index[len(index) // 2]
    file = tmp_path / "data" / hurt.file
    data = bytearray(file.read_bytes())
    data[hurt.offset + hurt.length - 12] ^= 0xFF
    file.write_bytes(data)
    start = next(f["start"] for f in archive.manifest(str(tmp_path)) if f["file"] == hurt.file)
    gone = set(range(start + hurt.first, start + hurt.first + hurt.rows))
    for n in (1, 4):
        with pytest.raises(Exception):
            archive.scan(spark, f"file://{tmp_path}", n, SCHEMA).collect()
        left = archive.scan(spark, f"file://{tmp_path}", n, SCHEMA, damaged="skip").collect()
        assert sorted(r.row_id for r in left) == [k for k in range(200) if k not in gone]


def test_empty_and_marks_in_texts(spark, tmp_path):
    none = f"file://{tmp_path}/none"
    archive.write(spark.createDataFrame([], SCHEMA), none, [F.col("k")])
    assert archive.scan(spark, none, 4, SCHEMA).count() == 0
    assert archive.get(spark.createDataFrame([(0,)], "want long"), "want", none, SCHEMA).count() == 0
    marks = [(k, archive.MARK.decode("latin1") * 3) for k in range(50)]
    archive.write(spark.createDataFrame(marks, SCHEMA), f"file://{tmp_path}/marks", [F.col("k")], per_block=4)
    assert sorted(tuple(r)[1:] for r in archive.scan(spark, f"file://{tmp_path}/marks", 9, SCHEMA).collect()) == marks
