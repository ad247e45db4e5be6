"""One query for each text operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streampace.llm import (
    decontaminate, exact_dedup, language_id, merkle, mixing, secrets_ledger, sharding, simhash, spelling, token_counts, toxicity,
    url_filter, warc,
)
from streampace.llm.common import fold_of, table
from streampace.plans.durable import new_path


RULES = [url_filter.rule(*r.split()) for r in (
    "allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captured = warc.capture(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.resolved_pages(spark, warc.deduplicate(spark, captured)).drop("url")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.taken(mixing.mix(docs))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.learn(docs, labels.filter(fold_of("doc_id", 5) != 0))
    return docs.select(
        "doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), toxicity.toxicity(docs, model).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))


def language_model(docs: DataFrame) -> language_id.Model:
    """Learned from three of four documents, so that the others show the accuracy."""
    return language_id.learn(docs.filter(fold_of("doc_id", 4) != 2))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.languages(docs, language_model(docs))
    return docs.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), found.alias("_f")).select(
        "doc_id", "held_out", "_f.*")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, width=3, distance=2).drop("kept")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    changed = merkle.leaf([F.col(f).cast("long") + 1 if f == "n_chars" else F.col(f) for f in fields])
    tampered = F.when(fold_of("doc_id", 7) == 0, changed)
    found = merkle.proofs(docs, fields, "lang", "doc_id", {"tampered": tampered})
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"),
        merkle.folded(F.coalesce("tampered", "leaf"), F.col("steps")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(spelling.vocabulary(docs, damage=spelling.drop_letter))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = table(spark, sf_dir, "documents"), new_path(spark, "ledger")
    secrets_ledger.scan(docs, ledger, content="text")
    found = secrets_ledger.findings(docs, ledger, keys=["doc_id"], content="text")
    base = F.filter("spans", lambda s: s["order"] <= len(secrets_ledger.BASE))
    counts = [F.size(secrets_ledger.of_kind("spans", r.kind)).cast("long").alias(f"n_{r.kind}") for r in secrets_ledger.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets_ledger.listed(base), 256).alias("base_sha256"),
                        secrets_ledger.listed(F.col("spans")).alias("spans"))


QUERIES = {q.__name__: q for q in (
    op1_url_filter, op2_exact_dedup, op3_warc, op4_mixing, op5_toxicity, op6_sharding,
    op7_language_id, op8_token_counts, op9_simhash, op10_decontaminate, op11_merkle, op12_spelling,
    op13_secrets,
)}
