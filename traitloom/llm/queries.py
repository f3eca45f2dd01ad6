"""Registered queries of this subpackage: thin calls of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, langid, near_dup, quality, suffix_dedup, suffix_tree_lm
from .common import crc_mod, read
from .decontam import annotate
from .licenses import scan_licenses
from .oracles import ORACLE_SQL
from .packing import pack

__all__ = ["ORACLE_SQL", "QUERIES"]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held))
    return langid.predict(docs, model, more=(held.alias("held_out"),)).select("doc_id", "held_out", "lang_pred", "score")


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = near_dup.link(read(spark, sf_dir, "documents"), words=2, least=0.8)
    return linked.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = quality.fit(docs, labels.where(~held))
    scored = quality.score(docs, model, more=(held.alias("held_out"),))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read(spark, sf_dir, "conversations"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x["stop"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    labels = F.array_sort(F.array_distinct(F.concat(F.col("places.label"), "notices", "expressions")))
    evidence = F.size("places") + F.size("notices") + F.lit(2) * F.size("expressions")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(F.col("places.word")).alias("first_word"),
        F.array_max(F.col("places.word")).alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"),
        F.concat_ws(",", labels).alias("labels"),
        (F.lit(1.0) - F.pow(F.lit(2.0), -evidence.cast("double"))).alias("score"),
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    scored = suffix_tree_lm.score(read(spark, sf_dir, "documents"), ~held, more=(held.alias("held_out"),))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x["stop"] - x["start"])
    return done.select("doc_id", F.octet_length("whole").cast("bigint").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_language_id": op2_language_id,
    "op3_near_dup": op3_near_dup,
    "op4_quality": op4_quality,
    "op5_ann": op5_ann,
    "op6_chat": op6_chat,
    "op7_decontamination": op7_decontamination,
    "op8_licenses": op8_licenses,
    "op9_lm_score": op9_lm_score,
    "op10_suffix_dedup": op10_suffix_dedup,
}
