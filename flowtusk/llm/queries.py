"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtusk.llm import (alignment, bpe, chat, jaccard, mixing, packing, pages, quality_model, quality_rules, runs, separators,
                          toxicity, training, vectors)
from flowtusk.llm.common import ASCII_SPACE, read_table
from flowtusk.plans.storage import new_path

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SEPARATOR = 50256  # the id that the rank file leaves free


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as flat token files, then counted from the files by their separators."""
    folder = new_path(spark, "token-files")
    placed = separators.write_token_files(read_table(spark, sf_dir, "documents"), folder, RANKS,
                                          public_tokenizers.PATTERN, SEPARATOR)
    found = separators.count_tokens(spark, folder, SEPARATOR)
    found = found.withColumn("file", F.element_at(F.split("path", "/"), -1))
    return placed.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link_vectors(read_table(spark, sf_dir, "embeddings"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_texts(read_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(read_table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_documents(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", *[f"quality.{name}" for name in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rendered = chat.format_conversations(chat.turns_as_events(turns.unionByName(extra)))
    read = rendered.select(
        "conv_id", chat.read_turns(F.col("formatted")).alias("turns"), F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"])), "").alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def _classified(spark: SparkSession, sf_dir: str, method) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = method.fit(docs, labels)
    score = method.quality if method is quality_model else method.toxicity
    scored = docs.select("doc_id", training.held_out("doc_id", *method.HELD_OUT).alias("held_out"),
                         score("text", model, spark).alias("score"))
    return scored.select("*", (F.col("score") >= training.THRESHOLD).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, quality_model)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, toxicity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), WORDS)


def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(read_table(spark, sf_dir, "documents"), BYTE_BPE, PIECES)


def _repeating_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text: in a tenth of the documents the words from a place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", ASCII_SPACE + "+"), lambda word: word != "")
    split = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    split = split.select("*", F.expr("h div 10").alias("g"), F.size("words").alias("n"))
    placed = split.withColumn("a", F.expr("cast(g % nullif(n, 0) as int)"))
    placed = placed.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    turns = F.flatten(F.array_repeat(F.expr("slice(words, a + 1, p)"), F.expr("cast(ceil((n - a) / p) as int)")))
    repeating = F.concat(F.expr("slice(words, 1, a)"), F.slice(turns, 1, F.col("n") - F.col("a")))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeating, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(_repeating_texts(read_table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    found = found.withColumns({"longest": longest, "listed": listed})
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_html_extraction": op5_html_extraction,
    "op6_quality_rules": op6_quality_rules,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_toxicity": op9_toxicity,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_mix_sources": op11_mix_sources,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}
