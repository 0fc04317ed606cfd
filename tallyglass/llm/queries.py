"""The queries opN_<name>: each applies its operator, with production parameters, to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import attention_lm, byte_cnn, cost_packing, curriculum_mix, embedding_dedup, html_layout, jaccard_join, line_chunks, merkle_manifest, piece_codec, radix_dedup, robust_outliers, vector_codes


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.text_scores(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_classes(table(spark, sf_dir, "embeddings"))


def op4_radix_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_dedup.repeated_windows(table(spark, sf_dir, "documents"))


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.line_report(table(spark, sf_dir, "documents"))


def op6_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_outliers.quality_outliers(table(spark, sf_dir, "documents"))


def op7_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.visible_text(table(spark, sf_dir, "pages"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum_mix.mix_report(table(spark, sf_dir, "documents"))


def op10_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op11_adaptive_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(table(spark, sf_dir, "embeddings"))


def op12_merkle_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.proof_report(table(spark, sf_dir, "documents"))


def op13_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.codec_report(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_byte_cnn, op2_attention_lm, op3_pca_tiles, op4_radix_windows, op5_line_chunks, op6_robust_outliers, op7_html_layout, op8_ngram_jaccard, op9_curriculum_mix, op10_cost_packing, op11_adaptive_bounds, op12_merkle_descent, op13_piece_agenda)}
ORACLES = {"op9_curriculum_mix": curriculum_mix.ORACLE_SQL, "op12_merkle_descent": merkle_manifest.oracle_sql()}
