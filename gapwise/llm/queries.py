"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm import bpe, decontaminate, importance, langid, licenses, linededup, merkle, mixing, ngramjoin, pii, ppm, quality, toolcalls
from gapwise.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "containment")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.ppm_score(table(spark, sf_dir, "documents"))


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.format_chat(table(spark, sf_dir, "conversations"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.ngram_jaccard_join(table(spark, sf_dir, "documents"))


#: Key of op7 where the session names none. It is no secret, so it is for tests and checks.
OPEN_KEY = "not a secret"


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.gapwise.pii.key", OPEN_KEY).encode()
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key).select("doc_id", "n_entities", "entities", "text")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup_digest(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.weak_supervision(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(table(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocab = bpe.vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    own = bpe.encoded(table(spark, sf_dir, "documents"), vocab, keep=["doc_id"], decoded="decoded")
    return own.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_decontaminate": op2_decontaminate,
        "op3_mix": op3_mix,
        "op4_ppm_score": op4_ppm_score,
        "op5_tool_calls": op5_tool_calls,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_pii_surrogates": op7_pii_surrogates,
        "op8_line_dedup": op8_line_dedup,
        "op9_language_id": op9_language_id,
        "op10_quality": op10_quality,
        "op11_merkle": op11_merkle,
        "op12_bpe": op12_bpe,
        "op13_importance": op13_importance,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": linededup.LINE_DEDUP_SQL, "op11_merkle": merkle.TAMPER_SQL, "op13_importance": importance.RESAMPLE_SQL}
