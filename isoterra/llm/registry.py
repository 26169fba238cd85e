"""Queries over whole tables that apply each operator with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from isoterra.llm import sql
from isoterra.llm.ann import nearest
from isoterra.llm.lattice import near_duplicates
from isoterra.llm.mixing import mix_sources
from isoterra.llm.ngram_join import ngram_jaccard_components
from isoterra.llm.packing import pack
from isoterra.llm.private import digests, find_private
from isoterra.llm.quality import score_quality
from isoterra.llm.repeats import remove_repeats
from isoterra.llm.token_files import read_tokens, token_folder, write_tokens
from isoterra.llm.toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(_table(spark, sf_dir, "documents"), num=85, den=100, k=4, lower=True)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return read_tokens(write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 2, token_folder(spark)))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_private(_table(spark, sf_dir, "documents")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _table(spark, sf_dir, "embeddings")
    return nearest(data, data.where("vec_id % 20 = 0"), k=20)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_ngram_jaccard_join, op2_substring_dedup, op3_mixing_sources, op4_token_output, op5_pii, op6_best_fit_packing,
            op7_toxicity, op8_quality_classifier,
            op9_approximate_nearest_neighbours, op10_embedding_near_dedup,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": sql.OP1, "op2_substring_dedup": sql.OP2, "op5_pii": sql.OP5, "op10_embedding_near_dedup": sql.OP10}
