"""A secondary index beside a table of files: value ranges and Bloom filters that prune the file list.

For each file and indexed column the index holds the smallest and largest value and a Bloom
filter, whose words are rows, so that it is built by grouping and probed by an equi-join. A
look-up of keys finds the files whose range and filter admit one of them, and scans only these:
it may open a file in vain, but never misses a row. Files that came since the last build are
added by the next one; files that are gone are no longer candidates.

Bounds: rows of the filter follow the table's rows (BITS_A_ROW bits for each, by the largest
file); a look-up makes at most a row for each key, file and bit, so keys are to be few; the list
of files to open, as the list of files itself, meets at the driver.

Defined cases: null values are in no filter, and null keys find nothing; an empty table has an
index without rows; columns may be of any type that has an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a filter for each row of the largest file, and bits that a value sets.
BITS_A_ROW, PROBES = 10, 5


def positions(value: Column, bits: Column) -> Column:
    """The bits of a value."""
    return F.array_distinct(F.array(*(F.pmod(F.xxhash64(value, F.lit(seed)), bits) for seed in range(PROBES))))


def _same(path: str) -> str:
    """A local file's path in one form, whichever way Spark writes it."""
    return path if not path.startswith("file:") else "file:///" + path.removeprefix("file:").lstrip("/")


def _known(spark: SparkSession, index: str) -> DataFrame | None:
    from verdigris.operators.ann import _there

    return spark.read.parquet(f"{index}/files") if _there(spark, f"{index}/files") else None


def build(spark: SparkSession, path: str, columns: list[str], index: str) -> int:
    """Index the files of a table that are not indexed yet; their number."""
    present = {_same(f): f for f in spark.read.parquet(path).inputFiles()}
    known = _known(spark, index)
    old = {r["file"] for r in known.select("file").collect()} if known else set()
    new = [f for name, f in present.items() if name not in old]
    if not new:
        return 0
    rows = spark.read.option("basePath", path).parquet(*new).select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:///").alias("file"), *columns)
    ranges = [x for c in columns for x in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]
    files = rows.groupBy("file").agg(F.count("*").alias("rows"), *ranges)
    largest = files.agg(F.max("rows")).first()[0] or 1
    # A power of two of at least 64.
    bits = 1 << max(6, (BITS_A_ROW * largest - 1).bit_length())
    pairs = rows.select("file", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), positions(F.col(c), F.lit(bits)).alias("at"), F.col(c).isNotNull().alias("there")) for c in columns))).alias("v")).filter("v.there")
    words = pairs.select("file", F.col("v.column").alias("column"), F.explode("v.at").alias("bit"))
    words = words.groupBy("file", "column", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    words.repartitionByRange("column", "word").sortWithinPartitions("column", "word").write.mode("append").parquet(f"{index}/words")
    # The list of files is written last: files without words are not known.
    files.withColumn("size", F.lit(bits).cast("long")).coalesce(1).write.mode("append").parquet(f"{index}/files")
    return len(new)


def admitting(spark: SparkSession, path: str, index: str, column: str, keys: DataFrame) -> list[str]:
    """The present files that may hold one of the keys (one column, named as the indexed one)."""
    known = _known(spark, index)
    if known is None or not spark.read.parquet(path).inputFiles():
        return []
    wanted = keys.select(F.col(column).alias("key")).filter("key is not null").distinct()
    sizes = [r["size"] for r in known.select("size").distinct().collect()]
    if not sizes:
        return []
    probe = None
    for size in sizes:
        one = wanted.select("key", F.lit(size).cast("long").alias("size"), F.explode(positions(F.col("key"), F.lit(size))).alias("bit"))
        probe = one if probe is None else probe.unionByName(one)
    probe = probe.withColumns({"word": F.shiftright("bit", 6), "mask": F.expr("shiftleft(1L, cast(bit & 63 as int))"), "of": F.size(positions(F.col("key"), F.col("size")))})
    words = spark.read.parquet(f"{index}/words").filter(F.col("column") == column)
    ranges = known.select("file", "size", F.col(f"{column}_min").alias("low"), F.col(f"{column}_max").alias("high"))
    hit = words.join(probe, "word").filter(F.col("bits").bitwiseAND(F.col("mask")) != 0)
    hit = hit.join(ranges, ["file", "size"]).filter("key >= low and key <= high")
    found = hit.groupBy("file", "key").agg(F.count("*").alias("c"), F.max("of").alias("of")).filter("c = of").select("file").distinct()
    here = {_same(f): f for f in spark.read.parquet(path).inputFiles()}
    return sorted(here[r["file"]] for r in found.collect() if r["file"] in here)


def rows_of(spark: SparkSession, path: str, index: str, column: str, keys: DataFrame) -> DataFrame:
    """The table's rows with one of the keys, from the files that may have some."""
    files = admitting(spark, path, index, column, keys)
    table = spark.read.option("basePath", path).parquet(*files) if files else spark.read.parquet(path).limit(0)
    return table.join(keys.select(column).distinct(), column, "left_semi")
