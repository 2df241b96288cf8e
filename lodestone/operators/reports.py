"""What was searched: the counter table and the reports on it."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import noise
from lodestone.functions.periods import Period
from lodestone.functions.text import normalize
from lodestone.sources import staging


def searches(events: DataFrame) -> DataFrame:
    """Events that count: first looks for something that is a term, each once for a request and term.

    Each distinct spelling is normalised and judged once, however often it was searched: what is known of the
    spellings is written and read again, else Spark would push the judging below the grouping, to every event.
    """
    looks = events.where("first_look")
    judged = looks.select("term_raw").distinct().select("term_raw", normalize(F.col("term_raw")).alias("term"), noise.reason(F.col("term_raw")).alias("reason"))
    spellings = staging.staged(judged, "spellings").where("reason IS NULL AND term <> ''").drop("reason")
    found = looks.join(spellings, "term_raw")
    return found.groupBy("shop_id", "lang_id", "request_id", "term").agg(F.max_by(F.struct("ts", "term_raw", "hits", "corrected"), F.struct("ts", "term_raw", "hits")).alias("x")).select("shop_id", "lang_id", "term", "x.*")


def counted(events: DataFrame) -> DataFrame:
    """The log: a row for each scope, day and term, with the newest search's hits and spelling."""
    rows = searches(events).withColumn("day", F.to_date("ts"))
    last = F.max_by(F.struct("term_raw", "hits", "corrected", "ts"), F.struct("ts", "term_raw", "hits"))
    out = rows.groupBy("shop_id", "lang_id", "day", "term").agg(F.count("*").alias("searches"), last.alias("x"))
    return out.select("shop_id", "lang_id", "day", "term", "x.term_raw", "searches", "x.hits", "x.corrected", F.col("x.ts").alias("last_seen"))


def within(log: DataFrame, shop_id: int, lang_id: int, start: date, end: date) -> DataFrame:
    return log.where((F.col("shop_id") == shop_id) & (F.col("lang_id") == lang_id) & F.col("day").between(F.lit(start), F.lit(end)))


def top_terms(rows: DataFrame, limit: int) -> DataFrame:
    out = rows.groupBy("term").agg(F.max_by("term_raw", F.struct("last_seen", "term_raw")).alias("term_raw"), F.sum("searches").alias("searches"), F.max("hits").alias("hits"), F.max("last_seen").alias("last_seen"))
    return out.orderBy(F.desc("searches"), "term").limit(limit)


def zero_hits(rows: DataFrame, limit: int) -> DataFrame:
    """Terms that found nothing on the latest day they were asked for."""
    empty = F.when(F.col("hits") == 0, F.col("day"))
    out = rows.groupBy("term").agg(F.max_by("term_raw", F.struct("last_seen", "term_raw")).alias("term_raw"), F.sum("searches").alias("searches"), F.max("last_seen").alias("last_seen"), F.max("day").alias("latest"), F.max(empty).alias("latest_empty"))
    return out.where("latest = latest_empty").select("term", "term_raw", "searches", "last_seen").orderBy(F.desc("searches"), "term").limit(limit)


def summary(rows: DataFrame) -> DataFrame:
    nothing = F.col("hits") == 0
    return rows.agg(
        F.coalesce(F.sum("searches"), F.lit(0)).alias("searches"), F.count_distinct("term").alias("terms"),
        F.coalesce(F.sum(F.when(nothing, F.col("searches"))), F.lit(0)).alias("zero_searches"), F.count_distinct(F.when(nothing, F.col("term"))).alias("zero_terms"),
    )


def zero_share(searches_: int, zero: int) -> float:
    return round(zero / searches_ * 100, 1) if searches_ else 0.0


def series(log: DataFrame, shop_id: int, lang_id: int, period: Period, today: date) -> DataFrame:
    """One row for each day or month of the period up to today, zeros where nothing was searched."""
    rows = within(log, shop_id, lang_id, period.series_start, period.end)
    key = F.trunc("day", "MM") if period.monthly else F.col("day")
    found = rows.groupBy(key.alias("bucket")).agg(F.sum("searches").alias("s"), F.sum(F.when(F.col("hits") == 0, F.col("searches")).otherwise(0)).alias("z"), F.count_distinct("term").alias("t"))
    first = period.series_start.replace(day=1) if period.monthly else period.series_start
    step = F.expr("INTERVAL 1 MONTH") if period.monthly else F.expr("INTERVAL 1 DAY")
    axis = log.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(min(period.end, today)), step)).alias("bucket"))
    zero = F.lit(0).cast("long")
    return axis.join(found, "bucket", "left").select("bucket", F.coalesce("s", zero).alias("searches"), F.coalesce("z", zero).alias("zero_searches"), F.coalesce("t", zero).alias("terms"), (F.col("bucket") >= F.lit(period.start)).alias("in_period"))


def bars(points: DataFrame) -> DataFrame:
    """Chart height of each bucket: its share of the highest, two at least where there is anything."""
    top = points.agg(F.max("searches").alias("top"))
    height = F.when(F.col("searches") > 0, F.greatest(F.lit(2), F.round(F.col("searches") / F.col("top") * 100))).otherwise(0)
    return points.join(F.broadcast(top)).withColumn("height", height.cast("int")).drop("top")  # one row


LIMITS = (10, 25, 50)


def report(log: DataFrame, shop_id: int, lang_id: int, period: Period, today: date, limit: int = 25, hide_noise: bool = True) -> dict:
    """What a report shows: summary with the share of searches without hits, top terms, terms without hits and a chart.

    ``limit`` is one of LIMITS, else the middle one; noise that an older log holds is hidden and its terms counted.
    """
    limit = limit if limit in LIMITS else LIMITS[1]
    rows = within(log, shop_id, lang_id, period.start, period.end)
    spellings = annotated(rows.select("term_raw").distinct())
    words = rows.join(spellings.where("reason IS NULL").select("term_raw"), "term_raw", "left_semi") if hide_noise else rows
    total = summary(words).first()
    points = bars(series(log, shop_id, lang_id, period, today)).orderBy("bucket")
    return {
        **total.asDict(), "zero_share": zero_share(total["searches"], total["zero_searches"]), "noise_terms": spellings.where("reason IS NOT NULL").count(),
        "top": [r.asDict() for r in top_terms(words, limit).collect()], "without_hits": [r.asDict() for r in zero_hits(words, limit).collect()], "chart": [r.asDict() for r in points.collect()],
    }


def last_days(log: DataFrame, shop_id: int, lang_id: int, days: int, today: date, limit: int = 25) -> dict:
    """The report of the last ``days`` days, today included."""
    start = today - timedelta(days=max(1, days) - 1)
    return report(log, shop_id, lang_id, Period("days", start, today, False, start), today, limit)


def annotated(rows: DataFrame) -> DataFrame:
    """Terms with the reason why they are noise, null for words."""
    return rows.withColumn("reason", noise.reason(F.col("term_raw")))


def without_noise(rows: DataFrame) -> DataFrame:
    """Filter before the limit: exact without reading over."""
    return annotated(rows).where("reason IS NULL").drop("reason")


def benchmark_terms(rows: DataFrame, limit: int) -> DataFrame:
    return rows.groupBy("term").agg(F.max_by("term_raw", F.struct("last_seen", "term_raw")).alias("term_raw"), F.sum("searches").alias("searches")).orderBy(F.desc("searches"), "term").limit(limit).select("term_raw", "searches")
