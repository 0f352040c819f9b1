"""Queries of this subpackage: each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import additive_quantization, conversation_repair, exact_dedup, filtering_lloyd, line_dedup, nbest, oracles, packing, quality, secret_scan, simhash, substring_dedup, toxicity, url_reputation


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark, sf_dir):
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), min_docs=3, min_chars=20)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents")).drop("at")


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, most_bits=4)


def op4_sentencepiece_nbest(spark, sf_dir):
    return nbest.encode_nbest(_table(spark, sf_dir, "documents"), n=4)


def op5_url_filter(spark, sf_dir):
    found = url_reputation.filter_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))
    return found.withColumn("reputation", F.round("reputation", 6))


def op6_substring_dedup(spark, sf_dir):
    found = substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_nearest(spark, sf_dir):
    return additive_quantization.nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op8_secret_scan(spark, sf_dir):
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"),
    )


def op9_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), size=1024)


def op10_quality(spark, sf_dir):
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op11_vector_codes(spark, sf_dir):
    made = filtering_lloyd.compress(_table(spark, sf_dir, "embeddings"), keep=("label",), parts=16, entries=64, rounds=2, scale=256)
    found = filtering_lloyd.with_label_errors(made.codes)
    return found.select("vec_id", "code", "error", "label_error", F.lit(made.digest()).alias("codebooks_sha256"))


def op12_conversation_repair(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    made = conversation_repair.repair(conversation_repair.damaged(turns))
    every, counted = turns.select("conv_id").distinct(), made.conversations.withColumnRenamed("conv_id", "_conv")
    hashed = made.transcripts().withColumnRenamed("conv_id", "_hashed")
    found = every.join(counted, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").join(hashed, F.col("conv_id").eqNullSafe(F.col("_hashed")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def queries():
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_simhash": op3_simhash,
        "op4_sentencepiece_nbest": op4_sentencepiece_nbest,
        "op5_url_filter": op5_url_filter,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_nearest": op7_nearest,
        "op8_secret_scan": op8_secret_scan,
        "op9_packing": op9_packing,
        "op10_quality": op10_quality,
        "op11_vector_codes": op11_vector_codes,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_toxicity": op13_toxicity,
    }


def oracle_sql():
    return {
        "op1_line_dedup": oracles.lines(min_docs=3, min_chars=20),
        "op2_exact_dedup": oracles.EXACT,
        "op5_url_filter": oracles.urls(),
        "op6_substring_dedup": oracles.substrings(window=20),
        "op11_vector_codes": oracles.codes(),
        "op12_conversation_repair": oracles.repairs(),
    }
