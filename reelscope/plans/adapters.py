"""Media tables bound to the relational fixtures: each is a projection that columns and filters are pushed through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscope.functions.media import micros

DAY = 86_400_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as frames: a customer is a stream, urgent orders are key frames."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("stream"), F.col("o_orderkey").alias("idx"), micros("o_orderdate").alias("pts_us"), micros("o_orderdate").alias("dts_us"), (F.col("o_orderpriority") == "1-URGENT").alias("is_key")
    )


def samples(spark: SparkSession, sf_dir: str, by: str = "event_type") -> DataFrame:
    """Events as samples: their type is the stream, their value the size; events of 'purchase' stand for key frames."""
    return read(spark, sf_dir, "events").select(
        F.col(by).alias("stream"), F.col("event_id").alias("idx"), micros("ts").alias("pts_us"), F.round(F.col("value") * 100).cast("long").alias("size"), F.col("event_type").alias("digest"),
        (F.col("event_id") % 12 == 0).alias("is_key"), "value", "event_type",
    )


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audio: a user is a stream, value / 500 an amplitude."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("slot"), (F.col("value") / 500).alias("value"))


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as small luma planes, eight streams dealt by id."""
    return read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 8).alias("stream"), F.floor(F.col("vec_id") / 8).alias("idx"), F.col("embedding").alias("values"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as metadata entries of 150 assets in two scopes each: language is the key, length class the value."""
    return read(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 150).alias("asset"), F.when(F.floor(F.col("doc_id") / 150) % 2 == 0, "container").otherwise("track").alias("scope"), F.col("lang").alias("key"), F.floor(F.col("n_chars") / 1000).cast("string").alias("value"), F.col("doc_id").alias("idx"), "text"
    )
