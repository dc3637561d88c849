"""One query for each operator of this package, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bins, chat, crf, decontam, fim, langid, packing, pii, quality, repetitions, rules, sharding, simhash
from .common import crc_mod, table
from .oracles import ORACLE_SQL  # noqa: F401


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    made = chat.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more))
    made = made.select("conv_id", "formatted", chat.read_back("formatted").alias("turns"), chat.loss_text("segments").alias("loss"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)))
    found = langid.identify(docs.select("doc_id", "held_out", "text"), langid.fit(docs.where("not held_out")))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _learn() -> Column:
    return F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(True))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(_learn()).select("doc_id", F.col("toxic").alias("label"))
    found = crf.score_toxicity(docs, crf.fit(docs, labels))
    return found.select("doc_id", (~_learn()).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rules.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _learn())
    return scored.select("doc_id", (~_learn()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality.STATISTICS, "base_failed", "kept", "d2", "outlier")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    counts = [pii.count_of(k).cast("long").alias(f"n_{k}") for k in pii.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(pii.digest("base"), 256).alias("base_sha256"), pii.digest("spans").alias("spans"))


def op10_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def planted(docs: DataFrame) -> DataFrame:
    """Documents of which about a tenth, by doc_id, run on as repeats: from word a on, the next p words over and over."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, words = F.floor(h / 10), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("words")
    made = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), g.alias("g")).withColumns({"n": n, "a": (F.col("g") % n).cast("int")})
    made = made.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    head, period = F.slice("words", 1, F.col("a")), F.slice("words", F.col("a") + 1, F.col("p"))
    rest = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - F.col("a")) / F.col("p")).cast("int"))), 1, n - F.col("a"))
    return made.select("doc_id", F.when(n > 0, F.array_join(F.concat(head, rest), " ")).otherwise(F.col("text")).alias("text"))


def op11_repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetitions.collapse(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longer = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(longer(r, best), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.select("doc_id", "runs", best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period"))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = bins.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    cut = ("doc_id", "n", "form", "prefix_chars", "middle_chars")
    back = fim.restore(made.withColumn("output_sha256", F.sha2("output", 256)), keep=(*cut, "output_sha256"))
    return back.select(*cut, "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_language_id, op3_sharding, op4_toxicity, op5_simhash_dedup, op6_decontaminate, op7_quality_classifier, op8_quality_rules, op9_personal_data, op10_curve_packing, op11_repetitions, op12_best_fit_packing, op13_fill_in_middle)}
