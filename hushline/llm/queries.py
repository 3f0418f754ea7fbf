"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hushline.llm import alignment, decontaminate, hard_negatives, line_dedup, line_rules, packing, pii, quality, simhash, token_counts, toxicity, url_filter, warc
from hushline.llm.common import held_out, stored
from hushline.llm.comparison_sql import SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the registered query.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    words = url_filter.unigrams(url_filter.visible_text(pages), "text")
    seeds = spark.createDataFrame([(w, 1) for w in url_filter.SEEDS], "word string, n bigint")
    words = words.unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n"))
    judged = url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES), url_filter.stored(words, "words"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "log_odds")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed_digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(packing.pack(_table(spark, sf_dir, "documents"), vocabulary()))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", F.size("hits").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated(found).alias("contaminated"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.judge_lines(_table(spark, sf_dir, "documents"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
                         (~base & ~F.col("depleted")).alias("kept"), F.col("n_removed_words").cast("bigint").alias("n_removed_words"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    cleaned = line_dedup.LineIndex.build(docs).clean(docs)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[pii.counted("base", k).alias(f"n_{k}") for k in pii.BASE], F.sha2(pii.listed("base"), 256).alias("base_sha256"),
                        pii.listed("spans").alias("spans"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def pieces_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(_table(spark, sf_dir, "documents"), vocabulary(), pieces_model(), links=False)
    slim = found.withColumn("groups_sha256", F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))).drop("groups", "links")
    return alignment.with_counts(stored(slim, "aligned")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.prepared(vectors, label=moved))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary())
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > token_counts.LIMIT).alias("over_limit"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_packing, op3_decontamination, op4_warc, op5_line_rules, op6_simhash, op7_line_dedup, op8_quality, op9_pii, op10_toxicity,
                                   op11_alignment, op12_hard_negatives, op13_token_counts)}
