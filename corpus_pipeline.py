"""The corpus pipeline: toxicity, line dedup, near-duplicates, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscope.llm.decontaminate import decontaminate
from reelscope.llm.line_dedup import line_dedup
from reelscope.llm.minhash_dedup import minhash_dedup
from reelscope.llm.packing import pack
from reelscope.llm.shared import dealt_join, kept, part_of, position, written
from reelscope.llm.toxicity import fit, scored

#: SQL can express neither the toxicity model nor MinHash candidates; tests hold the stages against plain Python.
ORACLE_SQL = None


#: Names for columns of our own, apart from those a table may bring.
KEY, SCORE, PLACE = "__row_key", "__score", "__place"


#: Words from which a line is a passage of its own in line dedup.
LONG = 50


def _keyed(docs: DataFrame) -> DataFrame:
    """With ``KEY`` and ``PLACE``, the doc_id and 128 bits of the text: rows share both only if they are alike in both."""
    return docs.withColumns({KEY: F.col("doc_id").cast("long"), PLACE: part_of("text")})


def _same(left: str, right: str):
    return F.col(KEY).eqNullSafe(F.col(left)) & (F.col(PLACE) == F.col(right))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under 0.7. The model learns from the labelled documents among ``docs``."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model, SCORE, PLACE).where(F.col(SCORE) < 0.7).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their later repeated lines (two in a row, or one of ``LONG`` words or more); one that loses all of its lines goes. n_chars follows the text."""
    edited = line_dedup(docs, long=LONG).where("n_deleted > 0").dropDuplicates(["doc_id", "part"])
    edited = edited.select(F.col("doc_id").alias("__doc"), F.col("part").alias("__of"), F.col("text").alias("__text"), F.col("n_deleted").alias("__deleted"))
    rows = _keyed(docs).join(edited, _same("__doc", "__of"), "left")
    changed = F.col("__deleted") > 0
    rows = rows.where(~F.coalesce(changed & (F.trim("__text") == ""), F.lit(False)))
    text = F.when(changed, F.col("__text")).otherwise(F.col("text"))
    size = F.when(changed, F.length("__text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumns({"text": text, "n_chars": size}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id, and among rows that share it that of
    the smallest text hash; of rows alike in both, one. Rows without a word or a doc_id belong to no group and stay.

    Five-word shingles and similarity 0.8, as for every near-duplicate stage without a contract of its own.
    """
    found = minhash_dedup(docs).where(F.col("group").isNotNull())
    # One row for each text that stands in a group, then the first of each group: all others go.
    texts = written(found.groupBy("group", "doc_id", "part").agg(F.count(F.lit(1)).alias("rows")), "groups")
    first = texts.groupBy("group").agg(F.min(F.struct("doc_id", "part")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = written(first, "firsts")
    told = dealt_join(texts, first, ["group"], texts.count())
    gone = told.where(F.struct("doc_id", "part") != F.col("first")).select(F.col("doc_id").alias("__doc"), F.col("part").alias("__of"))
    twice = told.where((F.struct("doc_id", "part") == F.col("first")) & (F.col("rows") > 1)).select(F.col("doc_id").alias("__doc"), F.col("part").alias("__of"))
    rows = _keyed(docs).join(gone, _same("__doc", "__of"), "left_anti")
    once = rows.join(twice, _same("__doc", "__of"), "left_semi").dropDuplicates([KEY, PLACE])
    return rows.join(twice, _same("__doc", "__of"), "left_anti").unionByName(once).select(*docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of eight words with a benchmark item."""
    found = decontaminate(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = found.where("n_items > 0").select(F.col("doc_id").alias("__doc"), F.col("part").alias("__of")).distinct()
    return _keyed(docs).join(found, _same("__doc", "__of"), "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, with their ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("minhash_dedup", near_duplicates), ("decontamination", benchmarks), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = position()
    for name, stage in STAGES[:-1]:
        # What a stage has written for itself, and what it read, go when its output is stored.
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}", since)
    return STAGES[-1][1](spark, docs, sf_dir)
