"""Authoring of patterns: forms are validated, and the good ones appended to the store of their topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.scoring import first_match

# The form of a pattern's id, and examples that one needs.
ID_FORM, LEAST_EXAMPLES = r"^pat_[a-z_]+_[0-9]{3}$", 5


def lines(text):
    """The stripped lines of a text that hold something."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")


def judged(forms: DataFrame, library: DataFrame) -> DataFrame:
    """forms with their example lists and ``error`` (null: accepted), the first rule that fails.

    forms: pos, id, topic, intent, examples, negatives (texts of lines); library: id. Of forms
    with one id the first accepted one has it, the later ones find it taken.
    """
    pid, intent = F.trim(F.coalesce("id", F.lit(""))), F.trim(F.coalesce("intent", F.lit("")))
    f = forms.select("pos", pid.alias("id"), F.trim(F.coalesce("topic", F.lit(""))).alias("topic"), intent.alias("intent"), lines(F.col("examples")).alias("examples"), lines(F.col("negatives")).alias("negatives"))
    few = F.concat(F.lit(f"Need at least {LEAST_EXAMPLES} examples (got "), F.size("examples").cast("string"), F.lit(")."))
    own = first_match([(F.size("examples") < LEAST_EXAMPLES, few), (~F.col("id").rlike(ID_FORM), F.concat(F.lit("id must match the form (got '"), "id", F.lit("')"))), (F.col("intent") == "", "intent is required")], F.lit(None).cast("string"))
    known = library.select(F.trim("id").alias("id"), F.lit(True).alias("taken")).distinct()
    told = f.withColumn("own", own).join(known, "id", "left")
    # The first good form of an id; ids of good forms repeat seldom, and only they meet.
    first = F.row_number().over(Window.partitionBy("id", F.col("own").isNull()).orderBy("pos")) == 1
    taken = F.coalesce("taken", F.lit(False)) | ~F.col("first")
    exists = F.concat(F.lit("id '"), "id", F.lit("' already exists in library"))
    return told.withColumn("first", first).withColumn("error", F.coalesce("own", F.when(taken, exists))).drop("own", "taken", "first")


def append(forms: DataFrame, path: str, created: str) -> DataFrame:
    """Append the accepted forms to the store at a path, partitioned by topic; the judged forms come back.

    The store is read for taken ids first. One writer at a time, as with any file store.
    """
    spark = forms.sparkSession
    schema = "id string, version string, intent string, examples array<string>, negatives array<string>, history array<struct<timestamp:string,event:string,actor:string>>, deprecated boolean, topic string"
    found = stored(spark, path, schema)
    report = f"{path}-report"
    judged(forms, found.select("id")).write.mode("overwrite").parquet(report)
    told = spark.read.parquet(report)
    event = F.struct(F.lit(created).alias("timestamp"), F.lit("created").alias("event"), F.lit("author").alias("actor"))
    told.filter("error is null").select("id", F.lit("1.0").alias("version"), "intent", "examples", "negatives", F.array(event).alias("history"), F.lit(False).alias("deprecated"), "topic").write.mode("append").partitionBy("topic").json(path)
    return told


def stored(spark, path: str, schema: str) -> DataFrame:
    """The patterns of a store; none where there is no store yet."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)
