"""A training corpus from raw documents: five stages, each an operator of lodestone.llm.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps with all their columns; the last
returns the shards. ``run`` writes each stage's result as Parquet in the shared folder and reads it again.

Nulls: a document with a null or empty text is not toxic by itself, links with nothing, is not contaminated
and has no words to mix, so it takes copies like any other row of its source. Repeated rows (alike in id and
text) are thinned to one by the similarity stage unless they have no words. Columns besides doc_id, text and source
pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import _shared, decontamination, mixing, sharding, similarity, toxicity


def _boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one struct, so that no name of theirs clashes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("rest"))


def _unboxed(boxed: DataFrame, docs: DataFrame) -> DataFrame:
    return boxed.select(*(F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unboxed(toxicity.scored(_boxed(docs), model, ["rest", "text"]).where("score < 0.5"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the smallest id stays, and of its repeated rows one.

    Near duplicates here share 80 % of their five-word shingles. Different texts without an id, or with the same
    one, are documents of their own.
    """
    found = _shared.written(similarity.classes(docs, size=5, percent=80).select("id_key", "text_key", "n_shingles", "leads"), "near-copies")
    keys = ["id_key", "text_key"]
    stay = found.groupBy(*keys).agg(F.min("n_shingles").alias("n"), F.count("*").alias("times"), F.max("leads").alias("leads"))
    stay = stay.select(*keys, "n", "times", ((F.col("n") == 0) | F.col("leads")).alias("stays"))
    stay = _shared.written(stay, "near-copies-stay")
    boxed = _boxed(docs).withColumn("id_key", F.coalesce("doc_id", F.lit(_shared.LOWEST))).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    gone, repeated = stay.where(~F.col("stays")).select(*keys), stay.where("stays AND n > 0 AND times > 1").select(*keys)
    repeated = _shared.written(repeated, "near-copies-repeated")
    once = _shared.joined(boxed, gone.unionByName(repeated), keys, "left_anti", "near-copies-gone")
    # Of rows alike in id and text the first by its other columns stays.
    one = _shared.joined(boxed, repeated, keys, "left_semi", "near-copies-again").groupBy(*keys).agg(F.min_by(F.struct("text", "rest"), F.to_json("rest")).alias("row"))
    return _unboxed(once.select("text", "rest").unionByName(one.select("row.text", "row.rest")), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _unboxed(decontamination.judged(_boxed(docs), benchmark, with_text=True).where(~F.col("contaminated")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    keys = ["id_key", "text_key"]
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(_shared.LOWEST))
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    boxed = _boxed(docs).withColumn("id_key", doc_id).withColumn("text_key", text_key).withColumn("source_name", F.col("rest.source"))
    # Words are counted with the keys, so that the copies find their texts again.
    copies = mixing.mixed(docs.select("doc_id", "source", "text"), with_text_key=True)
    copies = copies.withColumn("id_key", F.coalesce("doc_id", F.lit(_shared.LOWEST))).groupBy("id_key", "text_key", F.col("source").alias("mixed_source")).agg(F.sum("copies").alias("copies"), F.count("*").alias("times"))
    same = (boxed["id_key"] == copies["id_key"]) & (boxed["text_key"] == copies["text_key"]) & boxed["source_name"].eqNullSafe(copies["mixed_source"])
    joined = boxed.join(copies.where("copies > 0"), same).drop(copies["id_key"]).drop(copies["text_key"])
    # Rows that are alike in id, text and source share their copies evenly, in the order of their other columns.
    turn = F.row_number().over(Window.partitionBy(*keys, "source_name").orderBy(F.to_json("rest"))) - 1
    own = F.floor(F.col("copies") / F.col("times")) + F.when(F.col("turn") < F.col("copies") % F.col("times"), 1).otherwise(0)
    several = joined.where("times > 1").withColumn("turn", turn).withColumn("own", own.cast("int")).drop("turn")
    taken = joined.where("times = 1").withColumn("own", F.col("copies").cast("int")).unionByName(several).where("own > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("own"))))
    return _unboxed(taken, docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The first stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = _shared.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
