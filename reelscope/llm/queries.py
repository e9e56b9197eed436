"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscope.llm.decontaminate import decontaminate
from reelscope.llm import language_id
from reelscope.llm.line_dedup import line_dedup
from reelscope.llm.minhash_dedup import minhash_dedup
from reelscope.llm.nn_descent import search
from reelscope.llm.packing import pack
from reelscope.llm.preference import conversations, preference_format
from reelscope.llm.quality import quality
from reelscope.llm.shared import table
from reelscope.llm.substring_dedup import substring_dedup
from reelscope.llm.toxicity import fit, score


def fold(of: int) -> Column:
    """crc32 of the doc_id as text, modulo ``of``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op2_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation up to its last assistant turn is chosen; rejected is the same with the last assistant turn of
    its neighbour (conv_id with the lowest bit flipped) in that turn's place. Conversations without one, or without
    such a neighbour, make no pair."""
    whole = conversations(table(spark, sf_dir, "conversations"))
    cut = whole.withColumn("n", F.expr("size(turns) + 1 - array_position(reverse(transform(turns, t -> t.role = 'assistant')), true)").cast("int"))
    cut = cut.where("exists(turns, t -> t.role = 'assistant')").select("conv_id", F.slice("turns", F.lit(1), F.col("n")).alias("chosen"))
    other = cut.select(F.expr("conv_id ^ 1").alias("conv_id"), F.element_at("chosen", -1).alias("reply"))
    pairs = cut.join(other, "conv_id").select(F.col("conv_id").alias("pair_id"), "chosen", F.concat(F.slice("chosen", F.lit(1), F.size("chosen") - 1), F.array("reply")).alias("rejected"))
    out = preference_format(pairs)
    return out.withColumn("mask", F.array_join(F.transform("mask", lambda r: F.concat_ws("-", r["first"].cast("string"), r["past"].cast("string"))), ";"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 100 == 0))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = F.col("lang").isNotNull() & (F.coalesce(fold(4), F.lit(2)) != 2)
    # A tenth of what may be learned from, by text, calibrates the rejection instead.
    apart = known & (F.pmod(F.xxhash64("text"), F.lit(10)) == 0)
    models = language_id.fit(docs.where(known & ~apart).select("text", "lang"))
    out = language_id.predict(docs, models, apart)
    return out.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    sha = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", sha, (F.col("n_items") >= 2).alias("contaminated"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), trusted)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4).drop("part", "group")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold(3) != 1))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_preference": op2_preference,
        "op3_nn_descent": op3_nn_descent,
        "op4_language_id": op4_language_id,
        "op5_decontaminate": op5_decontaminate,
        "op6_quality": op6_quality,
        "op7_minhash_dedup": op7_minhash_dedup,
        "op8_line_dedup": op8_line_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_substring_dedup": op10_substring_dedup,
    }
