"""The search log kept by a stream: events in, counters out."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone import schema
from lodestone.functions import noise
from lodestone.functions.text import normalize


def events(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """All files there are make one batch, in which no event is late, unless ``files_per_trigger`` bounds it.

    With a bound, events older than the watermark when their batch comes are lost, so files have to come by time.
    """
    reader = spark.readStream.schema(schema.SEARCH_EVENT)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def counters(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Day counters with a watermark; a request's repeats of a term inside it count once."""
    found = stream.where("first_look").withColumn("term", normalize(F.col("term_raw"))).where("term <> ''").where(noise.reason(F.col("term_raw")).isNull())
    once = found.withWatermark("ts", late).dropDuplicatesWithinWatermark(["shop_id", "lang_id", "request_id", "term"])
    last = F.max_by(F.struct("term_raw", "hits", "corrected", "ts"), F.struct("ts", "term_raw", "hits"))
    out = once.groupBy(F.window("ts", "1 day"), "shop_id", "lang_id", "term").agg(F.count("*").alias("searches"), last.alias("x"))
    return out.select("shop_id", "lang_id", F.to_date("window.start").alias("day"), "term", "x.term_raw", "searches", "x.hits", "x.corrected", F.col("x.ts").alias("last_seen"))


#: Batches of a day that may lie beside each other before they become one.
KEPT = 8


def start(stream: DataFrame, folder: str, checkpoint: str, kept: int = KEPT) -> StreamingQuery:
    """Runs through what is there. Each batch writes a partition of its own in every day it touches, so a batch done
    twice changes nothing; earlier batches of a day are merged to one when there are more than ``kept``.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(folder)
        compact(batch.sparkSession, folder, number, kept)

    return counters(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, folder: str, before: int, kept: int = KEPT) -> None:
    """In days with more than ``kept`` batches ahead of ``before`` these become the last of them.

    They are complete, as a later batch has come. The merged rows lie beside the others until those are deleted, and
    count no more than they did, so an end in between does no harm.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # One name for each day and batch that is left: days times ``kept`` and a few.
    days: dict[str, list[tuple[int, object]]] = {}
    for status in files.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/day=*/batch=*")) or []:
        found = status.getPath()
        number = int(found.getName()[6:])
        if number < before:
            days.setdefault(found.getParent().getName()[4:], []).append((number, found))
    crowded = {day: sorted(parts, key=lambda p: p[0]) for day, parts in days.items() if len(parts) > kept}
    if not crowded:
        return
    # What each day's batches become is named by the last of them; days that end alike are written together.
    ends: dict[int, list[str]] = {}
    for day, parts in crowded.items():
        ends.setdefault(parts[-1][0], []).append(day)
    for last, names in ends.items():
        rows = spark.read.schema(STORED).parquet(folder).where(F.col("day").isin(*(date.fromisoformat(n) for n in names)) & (F.col("batch") <= last))
        newest(rows).withColumn("batch", F.lit(last).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(folder)
    for parts in crowded.values():
        for _, gone in parts[:-1]:
            files.delete(gone, True)


STORED = f"{schema.SEARCH_LOG}, batch long"


def newest(rows: DataFrame) -> DataFrame:
    """The newest row of each counter."""
    names = ["term_raw", "searches", "hits", "corrected", "last_seen"]
    return rows.groupBy("shop_id", "lang_id", "day", "term").agg(F.max_by(F.struct(*names), "batch").alias("x")).select("shop_id", "lang_id", "day", "term", *(f"x.{n}" for n in names))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The counters as the last batch left them; a filter on the day reads that day's files alone."""
    return newest(spark.read.schema(STORED).parquet(folder))
