"""Tables that one step writes and the next reads, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once, read as often as needed: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8_bytes(column: str):
    """Bytes of the text, 0 for null."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


def code_point_rank(column: str):
    """Sort key: nulls last, then by code point (Spark's binary order of UTF-8 is code point order)."""
    return F.col(column).asc_nulls_last()


LOWEST = -(1 << 63)
#: Most ids that are sent to every task to thin a scan before its shuffle; beyond it the scan is shuffled whole.
MOST_IDS = 500_000


def joined(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", name: str = "") -> DataFrame:
    """df joined with a table that is written (unless it has no name, being written already) and counted first.

    With MOST_IDS rows at most it is sent to every task; a larger one meets ``df`` in a join of two plain shuffles,
    whose large partitions Spark splits.
    """
    small = written(small, name) if name else small
    return df.join(F.broadcast(small) if small.count() <= MOST_IDS else small, keys, how)


def with_keys(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, id_key (null first), text_key and text: the two keys together tell rows apart by content."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LOWEST)).alias("id_key"), F.xxhash64(text).alias("text_key"), text.alias("text"), *more)


def with_text(keyed: DataFrame, docs: DataFrame) -> DataFrame:
    """keyed (written) with each row's text from ``docs`` (of with_keys)."""
    texts = docs.select("id_key", "text_key", "text")
    keys = ["id_key", "text_key"]
    wanted = written(keyed.select(*keys).distinct(), "wanted")
    if wanted.count() <= MOST_IDS:
        texts = texts.join(F.broadcast(wanted), keys, "left_semi")
    return keyed.join(texts, keys)
