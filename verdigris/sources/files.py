"""Readers and writers: tolerant JSON lines, documents, manifests, partitioned logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

# The fields that every benchmark row must have.
REQUIRED = ("run_id", "timestamp", "model_profile", "benchmark", "task", "sample_id", "prompt_hash", "output_hash", "score", "metric_name", "latency_ms", "tokens_in", "tokens_out", "error", "metadata")


def read_jsonl(spark: SparkSession, path: str, schema: str | Ty.StructType) -> DataFrame:
    """JSON lines by a schema; blank, broken and non-object lines are dropped."""
    kind = schema if isinstance(schema, Ty.StructType) else Ty._parse_datatype_string(schema)
    rows = spark.read.text(path).filter(F.trim("value").startswith("{"))
    marked = Ty.StructType([*kind.fields, Ty.StructField("_broken", Ty.StringType())])
    parsed = rows.select(F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r")).select("r.*")
    return parsed.filter("_broken is null").drop("_broken")


def gathered(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All result files of a folder, with the file each row came from."""
    kind = Ty._parse_datatype_string(schema)
    rows = spark.read.option("pathGlobFilter", "*.json*").option("recursiveFileLookup", "true").text(folder).select("value", F.input_file_name().alias("file"))
    return rows.filter(F.trim("value").startswith("{")).select(F.from_json("value", kind).alias("r"), "file").select("r.*", "file")


def append_rows(rows: DataFrame, path: str, required: tuple[str, ...] = REQUIRED) -> None:
    """Append to a JSON-lines log; rows lacking a required field are an error."""
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"missing fields: {', '.join(missing)}")
    rows.write.mode("append").json(path)


def bench_rows(raw: DataFrame) -> DataFrame:
    """Rows with hashed prompt and output and integer latency."""
    return raw.select("*", F.substring(F.sha2("prompt", 256), 1, 16).alias("prompt_hash"), F.substring(F.sha2("output", 256), 1, 16).alias("output_hash"), F.col("latency").cast("int").alias("latency_ms")).drop("prompt", "output", "latency")


def scanned(spark: SparkSession, folder: str) -> DataFrame:
    """(path, hash, length) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.sha2("content", 256).alias("hash"), "length")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths added, removed or altered between two manifests; none means no rebuild."""
    o, n = old.select("path", F.col("hash").alias("old")), new.select("path", F.col("hash").alias("new"))
    both = o.join(n, "path", "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("altered").alias("change"))


def text_of(path: Column, content: Column) -> Column:
    """Text of a file by its kind: HTML without tags, JSON and CSV lines as they are, else UTF-8."""
    from verdigris.functions.text import stripped, without_scripts

    text = content.cast("string")
    return F.when(F.lower(path).rlike(r"\.html?$"), stripped(without_scripts(text))).otherwise(text)


def by_rowid(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows by id in the order asked for (pos, rowid); ids out of range are dropped."""
    return wanted.join(chunks, "rowid").orderBy("pos")


def frontmatter(raw: Column) -> tuple[Column, Column]:
    """(map of the `key: value` lines between two `---`, the body)."""
    p = r"(?s)^---\n(.*?)\n---\n?(.*)$"
    head = F.regexp_extract(raw, p, 1)
    body = F.when(raw.rlike(p), F.regexp_extract(raw, p, 2)).otherwise(raw)
    return F.when(head != "", F.str_to_map(head, F.lit("\n"), F.lit(": "))), body


def partitioned(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Append to a log partitioned by date."""
    rows.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").parquet(path)


def retained(spark: SparkSession, path: str, now: str, days: int) -> DataFrame:
    """The log's rows of the last days: a partition filter, no file of older days is read."""
    return spark.read.parquet(path).filter(F.col("date") >= F.date_sub(F.to_date(F.lit(now)), days))


def latest(spark: SparkSession, path: str, since: str, kind: str | None, n: int) -> DataFrame:
    """The newest n rows since a date, of one kind if asked for."""
    rows = spark.read.parquet(path).filter(F.col("date") >= since)
    rows = rows if kind is None else rows.filter(F.col("event_type") == kind)
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def published(rows: DataFrame, path: str) -> None:
    """Replace a table; readers see the old or the new files by the commit protocol."""
    rows.write.mode("overwrite").parquet(path)


def intact(now: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Whether logs changed before their last line: digests of now against the stored ones."""
    both = now.join(stored, key, "left")
    return both.select(key, F.when(F.col("stored").isNull(), "new").when(F.col("stored") == F.col("digest"), "intact").otherwise("changed").alias("outcome"))


def sanitised(rows: DataFrame, raw: str) -> DataFrame:
    """Add profile, opt_out, notes and last_turn from session JSON; fields of another kind become their defaults.

    Every field is read as text first, so that one bad field spoils no other.
    """
    text = lambda f: F.get_json_object(raw, f"$.{f}")
    quoted = lambda f: F.col(raw).rlike(rf'"{f}"\s*:\s*"')
    listed = F.from_json(text("notes"), "array<string>")
    strings = F.regexp_extract_all(text("notes"), F.lit(r'"((?:[^"\\]|\\.)*)"'), 1)
    notes = F.when(F.col(raw).rlike(r'"notes"\s*:\s*\[') & listed.isNotNull(), strings).otherwise(F.array().cast("array<string>"))
    opt_out = F.when(text("opt_out").isin("true", "false"), text("opt_out") == "true").when(text("opt_out").rlike(r"^-?\d+$"), text("opt_out").try_cast("int") != 0).otherwise(F.coalesce(quoted("opt_out") & (text("opt_out") != ""), F.lit(False)))
    return rows.withColumns({"profile": F.when(quoted("profile"), text("profile")).otherwise(""), "opt_out": F.coalesce(opt_out, F.lit(False)), "notes": notes, "last_turn": F.greatest(F.coalesce(text("last_turn").try_cast("long"), F.lit(0)), F.lit(0)).cast("long")})


def ingested(documents: DataFrame, embed: Callable[[Column], Column], size: int = 800, overlap: int = 100) -> DataFrame:
    """(path, start, chunk, embedding): whole texts of (path, text) cut into chunks; embed gives a vector, made one of unit length."""
    from verdigris.functions.text import fixed_chunks

    cut = documents.select("path", F.explode(fixed_chunks(F.col("text"), size, overlap)).alias("c")).select("path", "c.start", "c.chunk")
    embedded = cut.withColumn("e", embed(F.col("chunk")))
    length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    return embedded.withColumn("n", length).select("path", "start", "chunk", F.transform("e", lambda x: x / F.when(F.col("n") == 0, 1.0).otherwise(F.col("n"))).alias("embedding"))


def pattern_library(spark: SparkSession, folder: str, inactive: tuple[str, ...] = ("deprecation_candidate", "deprecated", "under_review")) -> DataFrame:
    """The valid, active patterns of a folder of JSON lines; files and folders with an underscore in front are no part of it.

    Valid: an id of letters, an underscore and digits, a priority of 0 to 1000, 5 to 15 examples.
    """
    rows = spark.read.option("recursiveFileLookup", "true").text(folder).select("value", F.input_file_name().alias("file"))
    kind = Ty._parse_datatype_string("id string, topic string, priority int, examples array<string>, lifecycle struct<audit_status:string>")
    own = rows.filter(~F.regexp_replace("file", F.lit("^.*" + folder.rstrip("/").rsplit("/", 1)[-1]), F.lit("")).rlike("/_"))
    read = own.filter(F.trim("value").startswith("{")).select(F.from_json("value", kind).alias("r")).select("r.*")
    valid = F.col("id").rlike("^[a-z]+_[0-9]+$") & F.col("priority").between(0, 1000) & F.size("examples").between(5, 15)
    return read.filter(valid & ~F.coalesce(F.col("lifecycle.audit_status"), F.lit("active")).isin(*inactive))


def purged(spark: SparkSession, path: str, now: str, days: int) -> None:
    """Drop the partitions of a log by date that are older than its days."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    first = spark.sql(f"SELECT CAST(date_sub(DATE '{now}', {int(days)}) AS STRING)").first()[0]
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("date=") and name[5:] < first:
            fs.delete(status.getPath(), True)


def migrated(spark: SparkSession, path: str, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """A table whose older files lack some columns, by one schema; what is missing gets its default."""
    schema = ", ".join(f"{name} {kind}" for name, (kind, _) in columns.items())
    rows = spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(path)
    return rows.select(*(F.col(n) if default is None else F.coalesce(n, F.lit(default).cast(kind)).alias(n) for n, (kind, default) in columns.items()))


def threshold_levels(spark: SparkSession, text: str) -> DataFrame:
    """(topic, sub, high, medium) of a small nested configuration: topics, and below ``sub_topics`` the sub-topics.

    Lines are ``name:`` or ``high: x`` and ``med: x`` further in; other lines are passed over.
    """
    found: dict[tuple, dict[str, float]] = {}
    at: list[tuple[int, str]] = []
    for line in text.split("\n"):
        name, colon, value = line.partition(":")
        depth = len(line) - len(line.lstrip(" "))
        if not colon:
            continue
        at = [x for x in at if x[0] < depth]
        if not value.strip():
            at.append((depth, name.strip()))
        elif at and name.strip() in ("high", "med"):
            path = [x for _, x in at]
            key = (None, int(path[1])) if path[0] == "sub_topics" and len(path) > 1 else (int(path[0]), None)
            found.setdefault(key, {})[name.strip()] = float(value)
    rows = [(topic, sub, v.get("high"), v.get("med")) for (topic, sub), v in found.items()]
    return spark.createDataFrame(rows, "topic long, sub long, high double, medium double")
