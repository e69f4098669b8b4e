"""Queries of the llm operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm import bpe, cotraining, crf_language, decontamination, jaccard_join, lexical_search, line_dedup, multi_index, quotes, recompression, spelling, sql, suffix_tree, token_files
from dayloom.llm.corpus import written

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary_path(name: str) -> str:
    """A vocabulary file of the public tokenizer package."""
    import public_tokenizers

    return f"file://{public_tokenizers.path(name)}"


def word_bpe_path() -> str:
    return vocabulary_path("word_bpe_49k.json")


def op8_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(read(spark, folder, "documents"), word_bpe_path())


def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.classes(read(spark, folder, "documents"))


def op2_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Learns from documents whose id's checksum modulo 5 is not 1 and scores all."""
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    return suffix_tree.score(read(spark, folder, "documents"), part != 1).withColumn("held_out", F.coalesce(part == 1, F.lit(False)))


def op4_recompression(spark: SparkSession, folder: str) -> DataFrame:
    return recompression.digests(read(spark, folder, "documents"))


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.clean(read(spark, folder, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op5_cotraining(spark: SparkSession, folder: str) -> DataFrame:
    scored = cotraining.classify(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return scored.select("doc_id", "keep", "score", "text_score", "meta_score")


def op6_crf_language(spark: SparkSession, folder: str) -> DataFrame:
    """Learns from documents whose id's checksum modulo 4 is not 2 and predicts all."""
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    docs = read(spark, folder, "documents")
    return crf_language.predict(docs, crf_language.train(docs, part != 2)).withColumn("held_out", F.coalesce(part == 2, F.lit(False)))


def op7_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.nearest(read(spark, folder, "embeddings"))


def op9_quotation_linking(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.threaded(read(spark, folder, "conversations"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of letters, of which some lose a letter chosen by a checksum; a null id counts as empty text."""
    runs = spelling.runs(read(spark, folder, "documents"))
    run, length = F.col("run"), F.length("run")
    h = F.crc32(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), run))
    at = (h % length).cast("int")
    word = F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, length))).otherwise(run)
    words = written(spelling.counted(runs.select(word.alias("word"))), "words")
    return spelling.groups(words)


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op13_repair_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.digests(read(spark, folder, "documents"), vocabulary_path("byte_bpe_50k.json"))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_suffix_tree": op2_suffix_tree,
    "op3_decontamination": op3_decontamination,
    "op4_recompression": op4_recompression,
    "op5_cotraining": op5_cotraining,
    "op6_crf_language": op6_crf_language,
    "op7_multi_index": op7_multi_index,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_quotation_linking": op9_quotation_linking,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_lexical_search": op12_lexical_search,
    "op13_repair_files": op13_repair_files,
}
SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op4_recompression": sql.REPEATED_PASSAGES,
    "op10_ngram_jaccard": sql.JACCARD_CLASSES,
    "op12_lexical_search": lexical_search.SQL,
}
